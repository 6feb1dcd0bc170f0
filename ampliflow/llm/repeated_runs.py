"""Runs: maximal stretches of words that repeat with a period, found with Lyndon arrays in both orders of the alphabet, after Ellert and
Fischer's runs over general ordered alphabets.

The words of a text are its letters; an order of them is all that is asked for. Of each place i the Lyndon array gives the next place
with a smaller suffix, nss(i). A run of period q that the order sees as falling at its end (in one of the two orders each run does) has
nss(i) = i + q at every place where its Lyndon root begins. So the runs are those of the edges (i, nss(i)), extended to both sides.

The array is filled from the right. Suffixes are compared along the chain of edges: what the suffixes of an edge have in common is kept
with it, so on the next link the comparison goes on where it stood, or is decided without reading a letter. Matches that were extended
are kept too: a comparison that comes to two places matched before takes their match over as a whole. No suffix tree or array is built,
and no word, text or substring is hashed.

With an exponent of at least 3, only edges that match further than their own length count, and of a run only its first root is extended
to the left, by less than its period. Each word of such a run occurs in it at least 3 times, so words that occur less often in what is
left of a text part it; this goes on in the parts, and parts shorter than the least length hold no run.

Nulls: a null text has no words and so no runs; a null doc_id gets no planted run in the query. An empty text too has no runs. Repeated
rows each get their own result. Very long texts are taken whole. Runs that tie for the greatest exponent: the smallest start, then
period. Other columns stay; those that have the names of new ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import WORD, free, table

MIN_LENGTH, MIN_EXPONENT = 24, 3


def ranks(words: list) -> np.ndarray:
    """The words' places in their own order, from 0; equal words share one."""
    order = sorted(range(len(words)), key=words.__getitem__)
    in_order = [words[i] for i in order]
    out = np.zeros(len(words), np.int64)
    out[order[1:]] = np.cumsum(np.fromiter(map(ne, in_order[1:], in_order), bool, max(0, len(words) - 1)))
    return out


def lyndon_edges(t: list[int]) -> tuple[list[int], list[int], int]:
    """nss, the length of what the suffixes of each edge have in common, and the number of letters compared. The end is the smallest."""
    n, compared = len(t), 0
    nss, common = [n] * (n + 1), [0] * (n + 1)
    matches: list = [()] * (n + 1)  # of each place: the places that it was compared with, and how far they match
    for i in range(n - 1, -1, -1):
        j, m = i + 1, 0
        while j < n:
            while j + m < n:
                for k, c in matches[i + m]:
                    if k == j + m:
                        m += c
                        break
                if j + m >= n:
                    break
                compared += 1
                if t[i + m] != t[j + m]:
                    break
                m += 1
            if m:
                matches[i] = (*matches[i], (j, m))
            if j + m >= n or t[j + m] < t[i + m]:
                break
            # The suffix at i is the smaller one. On the chain of j, links that match j further than i does are larger than i as well.
            k, c = nss[j], common[j]
            while k < n and c > m:
                k, c = nss[k], common[k]
            j = k
            if c < m:  # k leaves j where i still follows j, and downwards: it is smaller than i
                m = c
                break
        nss[i], common[i] = j, m if j < n else 0
    return nss, common, compared


def runs_in(t: list[int], least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of length max(least, exponent * period) or more, by start, then period. exponent >= 3."""
    if exponent < 3:
        raise ValueError("runs are told by edges that match further than their length, so the exponent is at least 3")
    found, top = [], max(t, default=0)
    for letters in (t, [top - x for x in t]):
        nss, common, _ = lyndon_edges(letters)
        for i in range(len(letters)):
            p, right = nss[i] - i, common[i]
            if right <= p or i >= p and nss[i - p] == i and common[i - p] >= p:  # too short, or not its run's first root
                continue
            start, end = i, i + p + right
            while start and letters[start - 1] == letters[start - 1 + p]:
                start -= 1
            if end - start >= max(least, exponent * p):
                found.append((start, p, end - start))
    found.sort()
    return [(s, length, p) for n, (s, p, length) in enumerate(found) if not n or found[n - 1] != (s, p, length)]


def word_runs(words: list, least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """The runs of a list of words."""
    if len(words) < least:
        return []
    t, out = ranks(words), []
    parts = [(0, len(words))]
    while parts:
        a, b = parts.pop()
        own = t[a:b]
        often = np.bincount(own)[own] >= exponent
        if often.all():
            out += [(a + s, length, p) for s, length, p in runs_in(ranks(own.tolist()).tolist(), least, exponent)]
            continue
        edges = (np.flatnonzero(np.diff(np.r_[False, often, False])) + a).tolist()
        parts += [(s, e) for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s >= least]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Of n words those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] == 0


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = T.StructType().add("n_words", T.LongType()).add("runs", T.ArrayType(_RUN)).add("collapsed", T.StringType())


def _finder(least: int, exponent: int):  # noqa: ANN202
    def find(texts: pa.Array) -> pa.Array:
        counts, places, starts, lengths, periods, collapsed = [], [0], [], [], [], []
        for text in texts.cast(pa.large_binary()):
            words = (text.as_py() or b"").split()  # at the white space of ASCII
            runs = word_runs(words, least, exponent)
            for s, length, p in runs:
                starts.append(s)
                lengths.append(length)
                periods.append(p)
            kept = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()] if runs else words
            counts.append(len(words))
            places.append(len(starts))
            collapsed.append(b" ".join(kept).decode())
        kind = to_arrow_type(_FOUND)
        fields = [pa.array(x, pa.int64()) for x in (starts, lengths, periods)]
        runs = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.field("runs").type.value_type)))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), runs.cast(kind.field("runs").type), pa.array(collapsed, kind.field("collapsed").type)], fields=list(kind))

    return F.arrow_udf(find, _FOUND)


def with_runs(docs: DataFrame, least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT, text: Column | None = None) -> DataFrame:
    """docs with n_words, runs (array of start, length, period in words, by start, then period) and collapsed: the words of the text but
    those that a run holds after its first period, joined by one space. text: what to look at, if not the column text."""
    name = free(docs, "found_runs")
    rows = docs.withColumn(name, _finder(least, exponent)((F.col("text") if text is None else text).cast("string")))
    return rows.withColumns({c: F.col(f"{name}.{c}") for c in ("n_words", "runs", "collapsed")}).drop(name)


def collapse_runs(docs: DataFrame, least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with one period of each run in its texts; texts without runs stay as they are, white space included."""
    name = free(docs, "found_runs")
    rows = docs.withColumn(name, _finder(least, exponent)(F.col("text").cast("string")))
    return rows.withColumn("text", F.when(F.size(f"{name}.runs") > 0, F.col(f"{name}.collapsed")).otherwise(F.col("text"))).drop(name)


def best_run(runs: Column) -> Column:
    """The run of the greatest exponent, exactly; of equals the smallest start, then period."""

    def order(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        first = (a > b) | (a == b) & ((x["start"] < y["start"]) | (x["start"] == y["start"]) & (x["period"] < y["period"]))
        return F.when(first, -1).otherwise(1)

    return F.get(F.array_sort(runs, order), 0)


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for one id in ten, the words from some place on repeat with some period. Its words are joined by one space."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), repeated).otherwise(text)


def op13_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = with_runs(docs, text=planted(F.col("doc_id"), F.col("text"))).withColumn("best", best_run(F.col("runs")))
    of = lambda f: F.col(f"best.{f}")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    milli = F.floor(F.lit(1000) * of("length") / of("period")).cast("long")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), of("start").alias("start"), of("length").alias("length"), of("period").alias("period"), milli.alias("exponent_milli"),
        digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
