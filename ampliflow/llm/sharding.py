"""Extendible hashing: shards that keep to a byte limit. DataFrame functions only.

A document's key is 48 bits of a hash of its doc_id and text. A shard is a prefix of these bits; the directory has, for each prefix
of its depth, the shard that holds it. A bucket over the limit is split on its next bit until every shard fits. Splits of a bucket
only move its own documents. All depths are found at once from the byte sums of the directory's prefixes, some bits deeper than an
even spread needs; only buckets that are still too large are read again, deeper.

A bucket of one single key can't be split by bits. Its equal rows fill pages 0, 1, ... of the shard, each within the limit; a
document that is larger than the limit has a page of its own. Nulls: a null text has no bytes; a null doc_id hashes like an empty one.
Equal rows are counted before anything is shuffled; very long texts count by their bytes. Only doc_id and text are read, so other columns can
have any names. Empty input, empty output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small, table, written

BITS = 48
#: Bytes of text in a shard at most.
LIMIT = 1 << 20
#: How many bits the directory's sums go beyond an even spread.
SPARE = 5


def key_bits(doc_id: Column, text: Column) -> Column:
    row = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(row.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _leaves(keys: DataFrame, depth: int, least: int, limit: int) -> DataFrame:
    """Of the prefixes up to `depth` bits, from `least` bits on: the shortest that fit the limit or hold a single key, and at `depth`
    what still doesn't fit. keys: k, n_bytes, n. Columns: prefix, depth, shard_bytes, fits, one."""
    sums = keys.groupBy(F.shiftright("k", BITS - depth).alias("deep")).agg(
        F.sum(F.col("n") * F.col("n_bytes")).alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high")
    )
    levels = sums.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(depth))))
    levels = levels.groupBy("depth", F.expr(f"shiftright(deep, {depth} - depth)").alias("prefix")).agg(
        F.sum("bytes").alias("shard_bytes"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    levels = levels.withColumn("one", F.col("low") == F.col("high")).withColumn("fits", (F.col("shard_bytes") <= limit) | F.col("one"))
    above = levels.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    at = levels.where(F.col("fits") | (F.col("depth") == depth)).withColumn("parent", F.shiftright("prefix", 1))
    first = at.where(F.col("depth") == least)
    return at.join(above, ["depth", "parent"], "left_semi").select("prefix", "depth", "shard_bytes", "fits", "one").unionByName(
        first.select("prefix", "depth", "shard_bytes", "fits", "one")
    )


def _placed(keys: DataFrame, leaves: DataFrame, depth: int, least: int) -> DataFrame:
    """keys with their leaf, through the directory: all prefixes of `depth` bits that are in use."""
    used = keys.select(F.shiftright("k", BITS - depth).alias("deep")).distinct()
    used = used.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(depth))))
    directory = used.withColumn("prefix", F.expr(f"shiftright(deep, {depth} - depth)")).join(leaves, ["depth", "prefix"])
    return keys.withColumn("deep", F.shiftright("k", BITS - depth)).join(small(written(directory, "shard-directory")), "deep").drop("deep")


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The shard of each row of docs (doc_id, text): doc_id, n_bytes, shard (its bits), depth, page, shard_bytes (of all its pages)."""
    rows = docs.select("doc_id", key_bits(docs["doc_id"], docs["text"]).alias("k"), n_bytes(docs["text"]).alias("n_bytes"))
    keys = written(rows.groupBy("doc_id", "k", "n_bytes").agg(F.count("*").alias("n")), "shard-keys")
    total = keys.agg(F.sum(F.col("n") * F.col("n_bytes"))).first()[0] or 0
    depth, least, rest, placed = min(BITS, math.ceil(math.log2(max(1.0, total / limit))) + SPARE), 0, keys, []
    while True:
        leaves = written(_leaves(rest, depth, least, limit), "shard-leaves")
        found = _placed(rest, leaves, depth, least)
        placed.append(found.where(F.col("fits")).drop("fits"))
        if depth == BITS or not leaves.where(~F.col("fits")).limit(1).count():
            break
        rest = written(found.where(~F.col("fits")).select("doc_id", "k", "n_bytes", "n"), "shard-rest")
        least, depth = depth + 1, min(BITS, depth + 1 + SPARE)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    page = F.when(F.col("one") & (F.col("shard_bytes") > limit), F.floor(F.col("copy") / each)).otherwise(0).cast("long")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    bits = F.when(F.col("depth") > 0, F.expr("right(lpad(bin(prefix), 48, '0'), depth)")).otherwise(F.lit(""))
    return out.select("doc_id", "n_bytes", bits.alias("shard"), "depth", page.alias("page"), "shard_bytes")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, {BITS // 4}))::BIGINT AS k
  FROM documents),
keys AS (SELECT doc_id, k, n_bytes, count(*) AS n FROM rows GROUP BY ALL),
depths AS (SELECT unnest(range(0, {BITS + 1})) AS depth),
prefixed AS (SELECT *, k // (1::BIGINT << ({BITS} - depth)) AS prefix FROM keys, depths),
nodes AS (SELECT depth, prefix, sum(n * n_bytes)::BIGINT AS shard_bytes, min(k) = max(k) AS one FROM prefixed GROUP BY depth, prefix),
fit AS (SELECT p.doc_id, p.k, p.n_bytes, min(p.depth) AS depth FROM prefixed p JOIN nodes USING (depth, prefix)
  WHERE shard_bytes <= {LIMIT} OR one GROUP BY ALL),
placed AS (SELECT f.*, p.n, o.shard_bytes, o.one, p.prefix FROM fit f JOIN prefixed p ON p.k = f.k AND p.depth = f.depth
  AND p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.n_bytes = f.n_bytes JOIN nodes o ON o.depth = p.depth AND o.prefix = p.prefix),
copied AS (SELECT *, unnest(range(0, n)) AS copy FROM placed)
SELECT doc_id, n_bytes, CASE WHEN depth > 0 THEN right(lpad(bin(prefix), 48, '0'), depth) ELSE '' END AS shard, depth,
  CASE WHEN one AND shard_bytes > {LIMIT} THEN copy // greatest(1, {LIMIT} // greatest(n_bytes, 1)) ELSE 0 END AS page, shard_bytes
FROM copied"""
