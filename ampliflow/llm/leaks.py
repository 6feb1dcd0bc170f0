"""Benchmark decontamination by pigeonhole edit matching.

An item matches a document that holds a passage within k = floor(RATE * length) edits of the whole item. Of k + 1 pieces of the item
one at least is untouched, so that an exact search of all pieces (one Aho-Corasick automaton) finds every candidate place, and
Myers' bit-parallel distance verifies the passage around it. Items and documents are compared in lower case with each run of other
characters than letters and digits as one space.

The benchmark is gone through in blocks of about BLOCK_CHARS characters, one after the other: a block is gathered and broadcast, meets
all documents, and what it finds is written before the next one comes. So memory doesn't follow the benchmark, and a benchmark of one
block (the usual case) is one lazy scan. Every whole text is searched, very long ones as any other.

Items with fewer than MIN_CHARS characters are found exactly, between word bounds, and reported; as they say little, drop_leaks doesn't
drop documents for them. Nulls: a null text or item matches nothing, nor does an item without letters and digits; a null item_id or
doc_id is reported as such. Repeated items are reported for each row; repeated documents likewise. An empty benchmark or an empty table
of documents yields no rows, and drops none. Only doc_id, text and item_id, text are read, so other columns can have any names.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import free, table, written

RATE, MIN_CHARS, BLOCK_CHARS = 1 / 15, 20, 1_000_000
EXACT = -1
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def places(text: str) -> tuple[str, list[int]]:
    """normalised(text) and the place in text of each of its characters."""
    chars, at = [], []
    for i, own in enumerate(text):
        for c in own.lower():
            c = " " if _OTHER.match(c) else c
            if c != " " or (chars and chars[-1] != " "):
                chars.append(c)
                at.append(i)
    if chars and chars[-1] == " ":
        chars.pop()
    return "".join(chars), at


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edits between a pattern of m characters and a substring of text (anchored: a prefix), and the first end that reaches it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        h_plus, h_minus = minus | (full & ~(d0 | plus)), plus & d0
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = ((h_plus << 1) | anchored) & full
        h_minus = (h_minus << 1) & full
        plus, minus = h_minus | (full & ~(d0 | h_plus)), h_plus & d0
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE, min_chars: int = MIN_CHARS, short: bool = True):
        import ahocorasick

        self.ids, self.items, pieces = [], [], defaultdict(list)
        for item_id, text in items:
            item = normalised(text or "")
            if not item or (len(item) < min_chars and not short):
                continue
            k, n = int(len(item) * rate) if len(item) >= min_chars else EXACT, len(self.items)
            if k == EXACT:
                pieces[item].append((n, 0))
                self.ids.append(item_id)
                self.items.append((item, k, None, None))
                continue
            cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                pieces[item[i:j]].append((n, i))
            self.ids.append(item_id)
            self.items.append((item, k, masks(item), masks(item[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item the stretches of a normalised text that can hold it; overlapping ones are one."""
        found: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                item, k, *_ = self.items[n]
                begin = last + 1 - size - offset
                if k == EXACT:
                    if n not in found and text[begin - 1 : begin] in ("", " ") and text[last + 1 : last + 2] in ("", " "):
                        found[n] = [[begin, last + 1]]
                    continue
                low, high = max(0, begin - k), min(len(text), begin + len(item) + k)
                spans = found.setdefault(n, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(low, spans[-1][0]), max(high, spans[-1][1])
                else:
                    spans.append([low, high])
        return found

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """For each item in the text: its id, the edits, start and end (code points) of its first nearest passage."""
        out, plain = [], normalised(text)
        if not self.items or not plain:
            return out
        at = None
        for n, spans in sorted(self.windows(plain).items()):
            item, k, peq, back = self.items[n]
            if k == EXACT:
                at = at or places(text)[1]
                out.append((self.ids[n], 0, at[spans[0][0]], at[spans[0][1] - 1] + 1))
                continue
            best = None
            for low, high in sorted(spans):
                edits, end = myers(peq, len(item), plain[low:high])
                if edits <= k and (best is None or edits < best[0]):
                    best = (edits, low, low + end)
            if best:
                edits, low, end = best
                size = myers(back, len(item), plain[low:end][::-1], anchored=True)[1]
                at = at or places(text)[1]
                out.append((self.ids[n], edits, at[end - size], at[end - 1] + 1))
        return out


_FINDERS: dict[str, Finder] = {}


def _function(rows: Broadcast, hit: T.StructType, **options):  # noqa: ANN003, ANN202
    key, arrow, names = uuid.uuid4().hex, pa.list_(to_arrow_type(hit)), hit.names

    def find(texts: pa.Array) -> pa.Array:
        if key not in _FINDERS:  # one for each Python worker
            _FINDERS.clear()
            _FINDERS[key] = Finder(rows.value, **options)
        own = _FINDERS[key]
        return pa.array([[dict(zip(names, x, strict=True)) for x in own.find(t)] for t in texts.fill_null("").to_pylist()], arrow)

    return F.arrow_udf(find, T.ArrayType(hit))


def _by_block(docs: DataFrame, benchmark: DataFrame, work, block_chars: int = BLOCK_CHARS, **options) -> list[DataFrame]:  # noqa: ANN001, ANN003
    """work(docs, function) for each block of the benchmark (item_id, text), the function being one of a text column:
    array<struct<item_id, distance, start, end>>. Of several blocks each result is written before the next block is gathered."""
    spark = benchmark.sparkSession
    kind = benchmark.schema["item_id"].dataType
    kind = T.LongType() if isinstance(kind, T.NullType) else kind
    hit = T.StructType().add("item_id", kind).add("distance", T.IntegerType()).add("start", T.LongType()).add("end", T.LongType())
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    n_blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) or 1
    out = []
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        rows = spark.sparkContext.broadcast([tuple(r) for r in own.orderBy("item_id", "text").collect()])
        found = work(docs, _function(rows, hit, **options))
        if n_blocks > 1:
            found = written(found, "leaks-block")
            rows.destroy()
        out.append(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """A row for each document and item that it holds: doc_id, item_id, distance, start, end."""
    find = lambda rows, search: rows.select("doc_id", F.explode(search(rows["text"].cast("string"))).alias("hit")).select("doc_id", "hit.*")
    return reduce(DataFrame.unionByName, _by_block(docs.select("doc_id", "text"), benchmark, find, **options))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of docs that hold no item of MIN_CHARS characters or more, columns as they were."""
    text, d, h = docs["text"].cast("string"), free(docs, "leak_doc"), free(docs, "leak_hash")
    text_hash = F.xxhash64(text)
    one = lambda rows, search: rows.where(F.size(search(text)) == 0)
    total = benchmark.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    if total <= options.get("block_chars", BLOCK_CHARS):
        return _by_block(docs, benchmark, one, short=False, **options)[0]
    # Of several blocks: the keys of documents that hold an item.
    keys = lambda rows, search: rows.where(F.size(search(text)) > 0).select(rows["doc_id"].alias(d), text_hash.alias(h)).distinct()
    gone = reduce(DataFrame.unionByName, _by_block(docs, benchmark, keys, short=False, **options)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(d)) & (text_hash == F.col(h)), "left_anti")


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
