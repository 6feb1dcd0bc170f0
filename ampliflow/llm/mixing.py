"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source s with S words and a target of t words has a repeat rate r = t / S of at most `most`. A document of s with `size` words is
expected e copies:  e = r + min(r, most - r, tilt) * (x_mean - x),  x = size / (size + half).  x_mean is the source's word-weighted
mean of x, so that the expected words of a source are exactly its target; long documents are repeated a little less than short
ones. floor(e) copies are certain. The fraction p = e - floor(e) is an inclusion probability: documents are ranked by
(u / (1 - u)) / (p / (1 - p)) with u a hash of the row, and one more copy goes to the first of them until the rest of the target
is filled. The sample's size is fixed in words.

A source is never sorted in one task: ranks fall into `buckets` intervals, whose word sums (aggregated before the shuffle) show the
one interval in which the target is reached; only that interval is ordered row by row.

Nulls: a null text has no words and takes nothing; a null source is a source of its own, the last one; a null doc_id is kept.
Equal rows have the same hash and get the same number of copies. Very long texts are rows as any other. Sources without words have the
target 0. Empty input, empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, small, table, written

MOST, TILT, HALF, BUCKETS, SEED = 3, 0.25, 256, 4096, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_bits(doc_id: Column, text: Column, seed: str) -> Column:
    """52 bits that depend on the row and the seed only."""
    row = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(row.cast("binary")), 1, 13), 16, 10).cast("long")


def _x(size: Column) -> Column:
    """size / (size + HALF) in millionths, as a whole number: its sums don't depend on their order."""
    return F.floor(size * F.lit(1_000_000) / (size + F.lit(HALF))).cast("long")


def source_targets(base: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """A row for each source: source, weight, source_size, target, x_mean. Weights repeat over the sources in code point order, null last.
    The target of a source is its share by weight of all words, at most `most` times its own; what is above is shared again."""
    per = base.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") * _x(F.col("size"))).cast("decimal(38,0)")).alias("x_sum")
    )
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    # Sources are capped in the order of words for each unit of weight. One is, if at this share it would pass its cap.
    order = W.orderBy((F.col("source_size").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = lambda c: c.cast("decimal(38,0)")
    per = per.withColumn("rest", whole(F.sum("source_size").over(all_rows)) - whole(most * F.coalesce(F.sum("source_size").over(before), F.lit(0))))
    per = per.withColumn("rest_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    over = whole(F.col("rest") * F.col("weight")) > whole(most * F.col("source_size") * F.col("rest_weight"))
    # The first source that isn't over ends the capping; its rest is shared among it and those after it.
    first = F.struct(F.col("source_size").cast("double") / F.col("weight"), F.col("source").isNull(), F.col("source"), "rest", "rest_weight").alias("s")
    per = per.withColumn("over", over).withColumn("s", first)
    stop = F.min(F.when(~F.col("over"), F.col("s"))).over(all_rows)
    per = per.withColumn("stop", stop)
    free = (~F.col("over")) | (F.col("s") >= F.col("stop"))
    share = F.col("stop.rest").cast("double") * F.col("weight") / F.col("stop.rest_weight")
    return per.select(
        "source", "weight", "source_size",
        F.when(F.coalesce(free, F.lit(False)), share).otherwise((most * F.col("source_size")).cast("double")).alias("target"),
        F.when(F.col("source_size") > 0, F.col("x_sum").cast("double") / F.col("source_size")).otherwise(0.0).alias("x_mean"),
    )


def _drawn(rows: DataFrame, most: int, tilt: float) -> DataFrame:
    """Adds whole (certain copies), p, q (the rank) and b (its interval) to rows with size, bits, source_size, target and x_mean."""
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    e = r + F.least(r, F.lit(float(most)) - r, F.lit(tilt)) * ((F.col("x_mean") - _x(F.col("size"))) / F.lit(1_000_000.0))
    e = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), e))
    u = (F.col("bits") + F.lit(0.5)) / F.lit(float(2**52))
    rows = rows.withColumn("e", e).withColumn("whole", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("whole"))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    return rows.withColumn("b", F.floor(F.col("q") / (F.col("q") + 1) * BUCKETS).cast("int"))


def _with(rows: DataFrame, side: DataFrame) -> DataFrame:
    """rows with the columns of a written table that has a row for each source."""
    side = side.withColumnRenamed("source", "source_key")
    return rows.join(small(side), rows["source"].eqNullSafe(side["source_key"]), "left").drop("source_key")


def _cuts(rows: DataFrame) -> DataFrame:
    """For each source: need, the words to draw; cut_b, the interval in which they are reached; start, the words drawn before it."""
    per = rows.groupBy("source", "b").agg(
        F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).alias("words"),
        F.sum(F.col("whole") * F.col("size")).alias("certain"),
        F.first("target").alias("target"),
    )
    of = W.partitionBy("source")
    per = per.withColumn("need", F.col("target") - F.sum("certain").over(of)).where(F.col("b").isNotNull())
    per = per.withColumn("upto", F.sum("words").over(of.orderBy("b"))).where(F.col("upto") > F.col("need"))
    per = per.groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("start"), "need")).alias("cut"))
    return per.select("source", F.col("cut.b").alias("cut_b"), F.col("cut.start").alias("start"), F.col("cut.need").alias("need"))


def plan(base: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, tilt: float = TILT) -> tuple[DataFrame, DataFrame]:
    """base: a written table with source, size and bits. Returns the sources with their targets, and for each source the rank up to
    which documents get one more copy: cut_b, and within it (cut_q, cut_bits); all ranks do where cut_b is null."""
    sources = written(source_targets(base, weights, most), "mix-sources")
    rows = _drawn(_with(base, sources), most, tilt)
    cuts = written(_cuts(rows), "mix-cuts")
    inside = _with(rows, cuts).where((F.col("b") == F.col("cut_b")) & (F.col("p") > 0))
    inside = inside.groupBy("source", "q", "bits").agg(F.sum("size").alias("words"), F.first("start").alias("start"), F.first("need").alias("need"))
    upto = F.col("start") + F.sum("words").over(W.partitionBy("source").orderBy("q", "bits"))
    # The document in which the target is reached goes to the side that comes nearer to it.
    inside = inside.withColumn("middle", upto - F.col("words") / 2).where(F.col("middle") <= F.col("need"))
    last = inside.groupBy("source").agg(F.max(F.struct("q", "bits")).alias("last"))
    cuts = cuts.withColumnRenamed("source", "k")
    last = cuts.join(last, cuts["k"].eqNullSafe(last["source"]), "left")
    last = last.select(F.col("k").alias("source"), "cut_b", F.col("last.q").alias("cut_q"), F.col("last.bits").alias("cut_bits"))
    return sources, written(last, "mix-last")


def _copies(rows: DataFrame, sources: DataFrame, last: DataFrame, most: int, tilt: float) -> DataFrame:
    rows = _with(_drawn(_with(rows, sources), most, tilt), last)
    inside = (F.col("b") == F.col("cut_b")) & ((F.col("q") < F.col("cut_q")) | ((F.col("q") == F.col("cut_q")) & (F.col("bits") <= F.col("cut_bits"))))
    more = F.col("cut_b").isNull() | (F.col("b") < F.col("cut_b")) | F.coalesce(inside, F.lit(False))
    return rows.withColumn("copies", F.col("whole") + F.when((F.col("p") > 0) & more, 1).otherwise(0))


def _sized(docs: DataFrame, seed: str) -> list[Column]:
    return [F.col("source"), word_count(docs["text"]).alias("size"), random_bits(docs["doc_id"], docs["text"], seed).alias("bits")]


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, tilt: float = TILT, seed: str = SEED) -> DataFrame:
    """The mixture itself: each row of docs (doc_id, text, source and any other columns) as often as the mix takes it."""
    base = written(docs.select(*_sized(docs, seed)), "mix-base")
    sources, last = plan(base, weights, most, tilt)
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *_sized(docs, seed))
    rows = _copies(row, sources, last, most, tilt).where(F.col("copies") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, tilt: float = TILT, seed: str = SEED) -> DataFrame:
    """For each document: doc_id, size, source_size, target, taken (words that the mix takes), copies."""
    base = written(docs.select("doc_id", *_sized(docs, seed)), "mix-base")
    sources, last = plan(base, weights, most, tilt)
    rows = _copies(base, sources, last, most, tilt)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def mix_sql(docs: str = "documents") -> str:
    """The sample in DuckDB SQL: CTEs that end with `mixed` (doc_id, text and the digest's columns)."""
    x = f"CAST(floor(size * 1000000 / (size + {HALF})) AS BIGINT)"
    return f"""
base AS (
  SELECT d.*, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat('{SEED}', ':', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 13))::BIGINT AS bits
  FROM {docs} d),
per AS (SELECT source, sum(size) AS source_size, sum(CAST(size * {x} AS DECIMAL(38, 0))) AS x_sum FROM base GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM per),
rested AS (
  SELECT *, sum(source_size) OVER () - coalesce({MOST} * sum(source_size) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest_weight,
    row_number() OVER (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST) AS n
  FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT min(n) AS n FROM rested WHERE NOT rest * weight > {MOST} * source_size * rest_weight),
stop AS (SELECT n, rest, rest_weight FROM rested WHERE n = (SELECT n FROM stopped)),
sources AS (
  SELECT r.source, r.source_size::BIGINT AS source_size, CASE WHEN r.n >= s.n THEN s.rest::DOUBLE * r.weight / s.rest_weight ELSE ({MOST} * r.source_size)::DOUBLE END AS target,
    CASE WHEN r.source_size > 0 THEN r.x_sum::DOUBLE / r.source_size ELSE 0 END AS x_mean
  FROM rested r LEFT JOIN stop s ON true),
rated AS (
  SELECT b.*, s.source_size, s.target, s.x_mean, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS r
  FROM base b JOIN sources s ON b.source IS NOT DISTINCT FROM s.source),
expected AS (
  SELECT *, least({MOST}.0::DOUBLE, greatest(0.0::DOUBLE, r + least(r, {MOST}.0::DOUBLE - r, {TILT}::DOUBLE) * ((x_mean - {x}) / 1000000.0::DOUBLE))) AS e,
    (bits + 0.5::DOUBLE) / {2**52}.0::DOUBLE AS u
  FROM rated),
parted AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM expected),
ranked AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM parted),
needed AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS need FROM ranked),
ties AS (SELECT source, q, bits, sum(size) AS words FROM needed WHERE p > 0 GROUP BY source, q, bits),
middles AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY q, bits) - words / 2.0::DOUBLE AS middle FROM ties),
mixed AS (
  SELECT n.*, n.whole + CASE WHEN m.middle <= n.need THEN 1 ELSE 0 END AS copies
  FROM needed n LEFT JOIN middles m ON n.source IS NOT DISTINCT FROM m.source AND n.q = m.q AND n.bits = m.bits)"""


OP4_SQL = f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mixed"
