"""Helpers that every operator of this subpackage uses: the shared folder, written tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side that is broadcast, in rows and in bytes of its values; beyond it the join is left to Spark's own strategy.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20

#: White space as the contracts of this subpackage write it: space, tab, line feed, vertical tab, form feed, return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets one of its own; a cluster is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='ampliflow-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives lost executors. Its rows are counted as they are
    written (row_count, small)."""
    path, seen = new_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["row_count"] = seen.get["rows"]
    return out


def row_count(df: DataFrame) -> int:
    """Rows of a written table, known without a job; of any other data by counting."""
    known = df.__dict__.get("row_count")
    return df.count() if known is None else known


def _bytes(df: DataFrame) -> int:
    """Bytes of the values of a written table of few rows, about."""
    total, fixed = F.lit(8 * len(df.columns)), True
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total, fixed = total + F.coalesce(F.octet_length(f.name), F.lit(0)), False
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            each = F.octet_length(F.to_json(f.name)) if not isinstance(getattr(f.dataType, "elementType", None), T.NumericType) else 8 * F.size(f.name)
            total, fixed = total + F.coalesce(each, F.lit(0)), False
    return row_count(df) * 8 * len(df.columns) if fixed else df.agg(F.sum(total.cast("long"))).first()[0] or 0


def small(side: DataFrame, rows: int = BROADCAST_ROWS, n_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """side with a broadcast hint if it is a written table of at most so many rows and bytes; otherwise as it is."""
    known = side.__dict__.get("row_count")
    return F.broadcast(side) if known is not None and known <= rows and _bytes(side) <= n_bytes else side


def free(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
