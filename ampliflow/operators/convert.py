"""Specimen tables that hold primer sequences, turned into named primers and a table that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampliflow.sources.tables import FORWARD, REVERSE, WILDCARDS

SIDES = (("FwPrimer", FORWARD, "primer_F"), ("RvPrimer", REVERSE, "primer_R"))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def primer_names(specimens: DataFrame) -> DataFrame:
    """primer, direction, name: the distinct sequences of each side, numbered in their order."""
    out = None
    for column, direction, stem in SIDES:
        own = specimens.select(F.col(column).alias("primer")).where(~F.col("primer").isin(*WILDCARDS)).distinct()
        number = F.row_number().over(W.orderBy("primer"))  # as many rows as there are primers
        own = own.select("primer", F.lit(direction).alias("direction"), F.concat(F.lit(stem), number.cast("string")).alias("name"))
        out = own if out is None else out.unionByName(own)
    return out


def converted(specimens: DataFrame, names: DataFrame, pool: str = "pool1") -> DataFrame:
    """specimens with a PrimerPool column, and primers' names in place of their sequences; wildcards stay."""
    out = specimens
    for column, direction, _ in SIDES:
        own = names.where(F.col("direction") == direction).select(F.col("primer").alias("_p"), F.col("name").alias("_n"))
        out = out.join(own, out[column] == F.col("_p"), "left").withColumn(column, F.coalesce("_n", column)).drop("_p", "_n")
    first, *rest = specimens.columns
    return out.select(first, F.lit(pool).alias("PrimerPool"), *rest)


def fasta_line(pool: str) -> Column:
    return F.concat(F.lit(">"), "name", F.lit(" position="), "direction", F.lit(f" pool={pool}\n"), "primer")


def convert(spark: SparkSession, path: str, specimen_out: str, primer_out: str, pool: str = "pool1") -> None:
    """Writes the two files; rows keep the order of the input."""
    rows = read_legacy(spark, path).withColumn("_order", F.monotonically_increasing_id())
    names = primer_names(rows)
    with open(primer_out, "w") as f:
        f.writelines(r["line"] + "\n" for r in names.orderBy("direction", F.length("name"), "name").select(fasta_line(pool).alias("line")).toLocalIterator())
    done = converted(rows.select("SampleID", *[c for c in rows.columns if c != "SampleID"]), names, pool).orderBy("_order").drop("_order")
    with open(specimen_out, "w") as f:
        f.write("\t".join(done.columns) + "\n")
        f.writelines("\t".join(v or "" for v in r) + "\n" for r in done.toLocalIterator())
