"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal it.

Emails, IP addresses, card and phone numbers are found by pattern; each distinct value is a protected entity. A term co-occurs with
the entities that its document mentions, wherever it stands there. With document counts over the whole corpus,

    IC(e) = log N / n(e)        PMI(t; e) = log N n(t, e) / (n(t) n(e))

a term discloses the share PMI / IC of what the entity holds. From GENERALISE on it is replaced by its class in all documents that
mention the entity, from REMOVE on it is removed there. n(t, e) counts documents that have the term and mention the entity, n(t) those
that have the term; pairs seen in fewer than MIN_DOCS documents estimate nothing, so the words of an entity in fewer aren't paired.
Mentions themselves are replaced by their kind.

Counts are made before each shuffle. Term counts are taken for terms that a fixed-size bit map lets through, and joined exactly. Keys
that many documents share (an entity's common terms) are salted where they are shuffled. Entities that the same documents mention (by
two 64-bit hashes of their rows) are one; a document that mentions many others, each with its own set of documents, still pairs each of
them with its words.

A row is a document. Nulls: a null text counts as empty; a null doc_id is kept. Repeated rows count as often as they occur and get
equal results. Very long texts are rows as any other: scanned whole, in linear time. Only doc_id and text are read; sanitise keeps all
other columns, whatever their names. Offsets are code points, ends exclusive. Empty input, empty output.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BROADCAST_ROWS, free, row_count, small, table, written

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
MIN_DOCS, GENERALISE, REMOVE = 3, 0.8, 0.95
MAP_BITS, SALTS, KEPT_WORDS = 24, 16, 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of the pattern, in linear time: what stands before an @ is as long as it can be."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, i, j) for i, j in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def entity(kind: int, mention: str) -> str:
    """One name for all ways to write a value."""
    return f"{KINDS[kind]}:{mention.lower() if kind < 2 else re.sub('[^0-9]', '', mention)}"


def term_of(word: str) -> str:
    return word.strip(_EDGES).lower()


def words_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words that aren't part of a mention."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts = np.array([i for i, _ in words])
    taken = set()
    for _, i, j in spans:
        taken.update(range(max(0, int(np.searchsorted(starts, i, "right")) - 1), int(np.searchsorted(starts, j))))
    out = []
    for k, (a, b) in enumerate(words):
        if k not in taken:
            core = text[a:b].lstrip(_EDGES)
            a, core = b - len(core), core.rstrip(_EDGES)
            if core:
                out.append((core.lower(), a, a + len(core)))
    return out


_BASE = T.StructType().add("kind", T.IntegerType()).add("start", T.LongType()).add("end", T.LongType())
_WORDS = T.StructType().add("term", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
_FOUND = T.StructType().add("base", T.ArrayType(_BASE)).add("entities", T.ArrayType(T.StringType())).add("words", T.ArrayType(_WORDS))


def _found():  # noqa: ANN202
    from pyspark.sql.pandas.types import to_arrow_type

    def find(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.fill_null("").to_pylist():
            spans = base_spans(text)
            words = words_of(text, spans) if spans else []
            base = [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
            out.append({"base": base, "entities": sorted({entity(k, text[i:j]) for k, i, j in spans}), "words": [dict(zip(("term", "start", "end"), w, strict=True)) for w in words]})
        return pa.array(out, to_arrow_type(_FOUND))

    return F.arrow_udf(find, _FOUND)


def _bit_map(terms: DataFrame) -> np.ndarray:
    """2 ** MAP_BITS bits of which those of the terms' hashes are set: the same size for any number of terms."""
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(1 << MAP_BITS))
    words = terms.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 AS int)))").alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out


class _Terms(dict):
    """The term of a word if the bit map has it, else None."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __missing__(self, word: str) -> str | None:
        term = term_of(word)
        at = zlib.crc32(term.encode()) % (1 << MAP_BITS)
        self[word] = term if term and self.bits[at >> 5] >> (at & 31) & 1 else None
        return self[word]


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many rows of docs each of the terms (column term, distinct) occurs: term, term_docs."""
    bits = docs.sparkSession.sparkContext.broadcast(_bit_map(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(bits.value)
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update({known[w] for w in set(_WORD.findall(text or ""))})
            if len(known) > KEPT_WORDS:
                known.clear()
            counts.pop(None, None)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("term_docs"))
    missing = F.raise_error(F.concat(F.lit("term without a count: "), F.col("term"))).cast("long")
    return terms.join(counted, "term", "left").withColumn("term_docs", F.coalesce("term_docs", missing))


def disclosures(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE, min_docs: int = MIN_DOCS) -> DataFrame:
    """A written table of the terms that disclose entities: entity, term, share. Of entities that the same documents mention the first
    stands for all. found: a written table with entities and words."""
    n = row_count(found)
    rows = found.select("row", F.explode(F.array_distinct("entities")).alias("entity"))
    seen = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"rows_{k}") for k in (0, 1)]
    entities = rows.groupBy("entity").agg(F.count("*").alias("entity_docs"), *seen)
    entities = entities.where((F.col("entity_docs") >= min_docs) & (F.col("entity_docs") < n))
    # What the same documents mention has the same counts with every term: a list of addresses is paired with the words of its pages once.
    entities = written(entities.groupBy("entity_docs", "rows_0", "rows_1").agg(F.min("entity").alias("entity")).select("entity", "entity_docs"), "pii-entities")
    mentions = _mentions(found, entities, F.array_distinct("words.term"))
    pairs = mentions.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"))
    pairs = written(pairs.where(F.col("both") >= min_docs), "pii-pairs")
    terms = term_counts(docs, written(pairs.select("term").distinct(), "pii-terms"))
    rows = pairs.join(small(entities), "entity").join(terms, "term")
    share = 1 - F.log(F.col("term_docs") / F.col("both")) / F.log(F.lit(float(n)) / F.col("entity_docs"))
    return written(rows.withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", "share"), "pii-disclosures")


def _mentions(found: DataFrame, entities: DataFrame, words: Column) -> DataFrame:
    """row, entity, words: found's documents for each of the entities (a written table, distinct) they mention."""
    asked = found.select("row", F.explode("entities").alias("entity")).join(small(entities), "entity").groupBy("row").agg(F.collect_list("entity").alias("asked"))
    asked = written(asked, "pii-asked")
    return found.select("row", words.alias("words")).join(small(asked), "row").select("row", F.explode("asked").alias("entity"), "words")


def find(docs: DataFrame, generalise: float = GENERALISE, min_docs: int = MIN_DOCS) -> DataFrame:
    """A written table with a row for each row of docs (doc_id, text): doc_id, text_hash, base (array of kind, start, end) and
    terms (array of start, end, share), sorted."""
    text = docs["text"].cast("string")
    rows = docs.select("doc_id", F.xxhash64(docs["text"]).alias("text_hash"), _found()(text).alias("f"))
    found = written(rows.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("row"), "f.*"), "pii-found")
    shares = disclosures(found, docs.select(text.alias("text")), generalise, min_docs)
    near = _mentions(found, written(shares.select("entity").distinct(), "pii-disclosed"), F.col("words"))
    near = near.select("row", "entity", F.explode("words").alias("w")).select("row", "entity", "w.*")
    if row_count(shares) <= BROADCAST_ROWS:
        near = near.join(F.broadcast(shares), ["entity", "term"])
    else:
        salted = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = near.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int")).join(salted, ["entity", "term", "salt"])
    marks = near.groupBy("row", "start", "end").agg(F.max("share").alias("share"))
    marks = marks.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    marks = written(marks, "pii-marks")
    none = F.array().cast("array<struct<start:long,end:long,share:double>>")
    return written(found.join(small(marks), "row", "left").select("doc_id", "text_hash", "base", F.coalesce("terms", none).alias("terms")), "pii-spans")


def generalised(term: str) -> str:
    """The class that stands in place of a term."""
    if any(c.isdigit() for c in term):
        return "[NUMBER]" if not any(c.isalpha() for c in term) else "[CODE]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def cleaned(text: str, base: list, terms: list, remove: float = REMOVE) -> str:
    """text with mentions replaced by their kind, and terms by their class or nothing. Where spans overlap, the first by start and kind counts."""
    spans = sorted([(s["start"], s["kind"], s["end"], 0.0) for s in base] + [(s["start"], TERM, s["end"], s["share"]) for s in terms])
    out, at = [], 0
    for start, kind, end, share in spans:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]" if kind < TERM else "" if share >= remove else generalised(text[start:end])]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, remove: float = REMOVE, **options) -> DataFrame:  # noqa: ANN003
    """docs (doc_id, text and any others) with sanitised texts."""
    spans = find(docs.select("doc_id", "text"), **options).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "text_hash"])
    d, h, base_, terms_ = (free(docs, n) for n in ("pii_doc", "pii_hash", "pii_base", "pii_terms"))
    spans = spans.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("base").alias(base_), F.col("terms").alias(terms_))
    rows = docs.join(spans, docs["doc_id"].eqNullSafe(spans[d]) & F.xxhash64(docs["text"]).eqNullSafe(spans[h]), "left")

    def clean(texts: pa.Array, base: pa.Array, terms: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), base.to_pylist(), terms.to_pylist(), strict=True)
        return pa.array([t if t is None or b is None else cleaned(t, b, x, remove) for t, b, x in rows], pa.string())

    text = F.arrow_udf(clean, T.StringType())(F.col("text").cast("string"), base_, terms_)
    return rows.withColumn("text", text).drop(d, h, base_, terms_)


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def digest(spans: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    base = F.transform("base", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    sha = F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256")
    return spans.select("doc_id", *map(_count, range(len(KINDS))), sha, F.array_join(F.concat(base, terms), ",").alias("spans"))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents").select("doc_id", "text")))
