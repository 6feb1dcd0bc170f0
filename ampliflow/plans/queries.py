"""The registered queries of the engine, over reads that are derived from the tables, each with its SQL.

Reads come from `documents`: the letters of a whole text as bases, between the primers and barcodes that the doc_id asks for; some
with errors, some reverse complemented."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampliflow.functions import dna
from ampliflow.operators import convert, demux, events, mining, outputs, stats
from ampliflow.sources.sequences import read_sequences
from ampliflow.sources.tables import Design, Primer, SheetDesign, Specimen, distance_counts
from ampliflow.sources.tables import pool_statistics as pools_of

PRIMERS = [
    ("F1", "GATTACGGCTAAGCTTCA", "forward", ["A"]), ("F2", "CCATGTAAGGCTTGACGT", "forward", ["B"]), ("R1", "TGCAGGATCCTTAACGAG", "reverse", ["A", "B"]),
]
SPECIMENS = [
    ("S1", "A", "ACGTTGCAAC", "F1", "TTGACCGATG", "R1"), ("S2", "A", "ACGTTGCAAC", "F1", "GGATCTAACC", "R1"), ("S3", "B", "CATGGTTCAG", "*", "AACCTTGGCA", "R1"),
]
WINDOW = 80


def design() -> Design:
    primers = [Primer(n, name, seq, way, list(pools)) for n, (name, seq, way, pools) in enumerate(PRIMERS)]
    return Design(primers, [Specimen(n, *s) for n, s in enumerate(SPECIMENS)])


def _reads_sql(everywhere: str) -> str:
    """Reads in SQL that Spark and DuckDB share but for how a pattern is replaced everywhere."""
    f1, f2, r1 = (p[1] for p in PRIMERS)
    (_, _, b1, _, c1, _), (_, _, _, _, c2, _), (_, _, b3, _, c3, _) = SPECIMENS
    rc = dna.complement
    wrong = lambda s, i: s[:i] + {"A": "C", "C": "G", "G": "T", "T": "A"}[s[i]] + s[i + 1 :]
    heads = {0: b1 + f1, 1: b1 + wrong(f1, 5), 2: b3 + f2, 3: b1 + f1, 6: b3 + f1, 7: wrong(b3, 4) + f2[:9] + f2[10:]}
    tails = {0: rc(r1) + rc(c1), 1: rc(r1) + rc(wrong(c2, 2)), 2: rc(r1) + rc(c3), 4: rc(r1) + rc(c3), 6: rc(r1) + rc(c1), 7: rc(wrong(r1, 3)) + rc(c3)}
    case = lambda m: "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in m.items()) + " ELSE '' END"
    inner = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', ''{everywhere}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTTGCAACTGGTCAACGTCATGGC')"
    return f"""
  SELECT read_id, CASE WHEN read_id % 16 >= 8 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS seq
  FROM (SELECT doc_id AS read_id, concat({case(heads)}, {inner}, {case(tails)}) AS s FROM documents)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = spark.sql(f"SELECT * FROM ({_reads_sql('').replace('FROM documents', 'FROM {documents}')})", documents=documents)
    # A quality for each base, from its place and the read.
    qual = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.char(38 + (i * 7 + F.col("read_id")) % 30)), "")
    return rows.select("read_id", F.concat(F.lit("read"), "read_id").alias("seq_id"), "seq", F.when(F.length("seq") > 0, qual).otherwise("").alias("qual"))


def _run(spark: SparkSession, sf_dir: str, **options) -> demux.Result:  # noqa: ANN003
    return demux.demultiplex(reads(spark, sf_dir), design(), demux.Options(**options))


#: A sheet of specimens from the suppliers, two for each, with barcodes of 12 letters from hashes; the forward primer has a code of two
#: bases (R). Reads: the letters of a document between the primers and barcodes of the specimen that its id asks for, some with errors.
SHEET_PRIMERS = [("FR", "GATTRCGGCTAAGCTTCA", "forward", ["P"]), ("RR", "TGCAGGATCCTTAACGAG", "reverse", ["P"])]
SHEET_EDITS = 2


def _sheet_sql() -> str:
    barcode = lambda n: f"translate(substr(md5(concat('barcode ', s_suppkey, ' ', 2 * c + {n})), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    return f"SELECT row_number() OVER (ORDER BY s_suppkey, c) - 1 AS n, concat('S', s_suppkey, '-', c) AS specimen_id, {barcode(0)} AS b1, {barcode(1)} AS b2 FROM (SELECT s_suppkey, 0 AS c FROM supplier UNION ALL SELECT s_suppkey, 1 FROM supplier) x"


def _sheet_reads_sql(everywhere: str) -> str:
    rc = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))"
    inner = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', ''{everywhere}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTTGCAACTGGTCAACGTCATGGC')"
    head = "CASE doc_id % 7 WHEN 0 THEN concat(b1, 'GATTACGGCTAAGCTTCA') WHEN 1 THEN concat(substr(b1, 1, 4), substr(b1, 6), 'GATTGCGGCTAAGCTTCA') WHEN 2 THEN concat(substr(b1, 1, 9), 'A', substr(b1, 10), 'GATTGCGGCTACGCTTCA') WHEN 3 THEN 'GATTACGGCTAAGCTTCA' WHEN 4 THEN concat(substr(b1, 1, 6), substr(b1, 8), 'GATTACGGTAAGCTTCA') WHEN 5 THEN '' ELSE concat(b1, 'GATTCCGGCTAAGCTTCA') END"
    tail = f"CASE doc_id % 5 WHEN 0 THEN concat({rc("'TGCAGGATCCTTAACGAG'")}, {rc('b2')}) WHEN 1 THEN concat({rc("'TGCAGGATCGTTAACGAG'")}, {rc('substr(b2, 2)')}) WHEN 2 THEN concat({rc("'TGCAGGATCCTTAACGAG'")}, {rc("concat(substr(b2, 1, 7), 'T', substr(b2, 9))")}) WHEN 3 THEN '' ELSE concat({rc("'TGCAGGATCCTTAACGAG'")}, {rc('b2')}) END"
    return f"""
  SELECT read_id, CASE WHEN read_id % 2 = 1 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS seq
  FROM (SELECT doc_id AS read_id, concat({head}, {inner}, {tail}) AS s FROM documents d JOIN sheet h ON h.n = d.doc_id % (SELECT count(*) FROM sheet))"""


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_sheet_sql().replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def sheet_design(spark: SparkSession, sf_dir: str) -> SheetDesign:
    """The sheet of specimens; read on the driver, as any design, but as a table."""
    sheet = _sheet(spark, sf_dir).orderBy("n").toArrow()
    same = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(sheet.num_rows, np.int8)), pa.array([x]))
    columns = {"spec_ord": sheet["n"], "specimen_id": sheet["specimen_id"], "pool": same("P"), "b1": sheet["b1"], "fw_primer": same("FR"), "b2": sheet["b2"], "rv_primer": same("RR")}
    return SheetDesign([Primer(n, name, seq, way, list(pools)) for n, (name, seq, way, pools) in enumerate(SHEET_PRIMERS)], pa.table(columns))


def sheet_run(spark: SparkSession, sf_dir: str) -> demux.Result:
    """Reads of the sheet of specimens, demultiplexed."""
    documents, design_ = spark.read.parquet(f"{sf_dir}/documents.parquet"), sheet_design(spark, sf_dir)
    # The sheet isn't broadcast, however large it is thought to be: the driver would hold it once more.
    rows = _sheet(spark, sf_dir).select("n", "b1", "b2").hint("merge")
    text = _sheet_reads_sql("").replace("FROM documents d", "FROM {documents} d").replace("JOIN sheet h", "JOIN {sheet} h").replace("(SELECT count(*) FROM sheet)", str(max(1, design_.table.num_rows)))
    reads_ = spark.sql(text, documents=documents, sheet=rows)
    reads_ = reads_.select("read_id", F.concat(F.lit("read"), "read_id").alias("seq_id"), "seq", F.lit(None).cast("string").alias("qual"))
    return demux.demultiplex(reads_, design_, demux.Options(index_distance=SHEET_EDITS, nearest=True))


def _sheet_ctes() -> str:
    rc = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))"
    # By hand: reverse complements with each reading of R, thresholds (5 of 17 and two thirds letters; 6 of 18).
    return rf"""
sheet AS ({_sheet_sql()}),
reads AS ({_sheet_reads_sql(", 'g'")}),
primers(p, name, direction, file_index) AS (VALUES (0, 'FR', 'forward', 0), (1, 'RR', 'reverse', 1)),
patterns(p, pattern, k) AS (VALUES (0, 'TGAAGCTTAGCCGTAATC', 5), (0, 'TGAAGCTTAGCCGCAATC', 5), (1, 'CTCGTTAAGGATCCTGCA', 6)),
bars AS (SELECT DISTINCT 0 AS p, b1 AS bc, {rc('b1')} AS pattern FROM sheet UNION ALL SELECT DISTINCT 1, b2, {rc('b2')} FROM sheet),
pairs(n, f, r, pool) AS (VALUES (0, 0, 1, 'P')),
keys AS (SELECT n AS spec_ord, specimen_id, 'P' AS specimen_pool, 'FR' AS kp1, 'RR' AS kp2, b1 AS kb1, b2 AS kb2 FROM sheet),
{_course(SHEET_EDITS)}"""


# --- scalar functions and the small tables


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", F.length("seq").alias("n"), F.md5(dna.reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


def average_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", F.round(dna.average_quality(F.col("qual")), 6).alias("average_quality"))


def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demux.filtered(reads(spark, sf_dir), demux.Options(min_length=300, max_length=4000))
    return rows.groupBy(F.coalesce("filter_reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def primer_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of part names as primers: letters as codes."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", dna.primer_threshold(F.upper("p_name")).alias("threshold"))


def barcode_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the barcodes that the sheet of specimens uses."""
    sheet = _sheet(spark, sf_dir)
    return distance_counts(sheet.select(F.col("b1").alias("w")).distinct().unionByName(sheet.select("b2").distinct().select(dna.reverse_complement(F.col("b2")).alias("w"))))


def pool_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as primers: each in the pools of its brand and of its type's first word, forward where its size is even."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pools = F.array(F.col("p_brand"), F.substring_index("p_type", " ", 1))
    return pools_of(part.select(pools.alias("pools"), F.when(F.col("p_size") % 2 == 0, "forward").otherwise("reverse").alias("direction")))


def primer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as specimens: the pool is the market segment, forward and reverse primers come from nation and key."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    f, r = F.concat(F.lit("F"), F.col("c_nationkey") % 7), F.concat(F.lit("R"), (F.col("c_custkey") * 3 + F.col("c_nationkey")) % 11)
    rows = customer.select(F.row_number().over(W.partitionBy("c_mktsegment", f, r).orderBy("c_custkey")).alias("nth"), "c_custkey", F.col("c_mktsegment").alias("pool"), f.alias("f"), r.alias("r"))
    found = rows.where((F.col("nth") == 1) & F.col("pool").isNotNull()).orderBy("c_custkey").collect()  # uses of primers: as many as a sheet has pairs and pools
    bases = lambda n: "".join("ACGT"[n >> 2 * k & 3] for k in range(8))
    primers = []
    for way, column, least in (("forward", "f", 0), ("reverse", "r", 1000)):
        primers += [Primer(len(primers) + n, name, bases(least + int(name[1:])), way, sorted({x["pool"] for x in found if x[column] == name})) for n, name in enumerate(sorted({x[column] for x in found}))]
    d = Design(primers, [Specimen(n, f"S{x['c_custkey']}", x["pool"], "ACGT", x["f"], "TTGA", x["r"]) for n, x in enumerate(found)])
    return spark.createDataFrame([(d.ordered[f].name, d.ordered[r].name, pool) for f, r, pool in d.pairs], "forward string, reverse string, pool string")


def convert_primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brands and types as the primers of a legacy table."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("FwPrimer"), F.col("p_type").alias("RvPrimer"))
    return convert.primer_names(part)


# --- the course of a read


def primer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = design()
    names = F.array(*[F.lit(p.name) for p in d.ordered])
    rows = _run(spark, sf_dir).hits.select("read_id", F.explode("hits").alias("h"))
    ends = F.array_join(F.transform("h.locs", lambda x: x["e"].cast("string")), ",")
    bars = F.array_join(F.array_sort(F.transform("h.bcs", lambda b: F.concat_ws(":", b["bc"], b["dist"].cast("string")))), ",")
    return rows.select("read_id", F.col("h.strand").alias("strand"), F.get(names, F.col("h.primer")).alias("primer"), F.col("h.dist").alias("dist"), ends.alias("ends"), bars.alias("barcodes"))


def orientation_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).hits.select("read_id", "forward_score", "reverse_score", "orientation", F.round("confidence", 6).alias("confidence"))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).candidates.select("read_id", "n1", "n2", "strand", "score")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).best.groupBy("read_id").agg(F.max("score").alias("score"), F.count("*").alias("n_best"))


def demultiplexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir).facts
    return out.select("read_id", "distance_code", "sample", "resolution", "path", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def sheet_demultiplexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of specimens, a primer with an ambiguity code, barcodes with errors and ties."""
    out = sheet_run(spark, sf_dir).facts
    return out.select("read_id", "distance_code", "sample", "resolution", "path", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trims that the other queries don't take."""
    rows = None
    for trim in ("primers", "tails"):
        own = _run(spark, sf_dir, trim=trim).facts.where("cand_ord >= 0").select(F.lit(trim).alias("trim"), "read_id", "cand_ord", "sample", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def undereplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, dereplicate="none", trim="none").facts.select("read_id", "cand_ord", "sample", "resolution", "pool")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard event log of a run, with all fields."""
    return events.run_events(_run(spark, sf_dir)).select("read_id", "event_type", F.array_join("fields", "|").alias("fields"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars that no other query shows, of parts: names of files and sequences, letters of primers, qualities and back, distances."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    number = lambda c: c.cast("int")
    return part.select(
        "p_partkey", dna.safe_name(F.concat("p_name", F.lit("/"), "p_type", F.lit("."), "p_brand")).alias("file_name"), dna.sequence_number_id("part", F.col("p_partkey"), F.col("p_brand")).alias("sequence_id"),
        F.round(dna.adjusted_length(F.upper("p_name")), 6).alias("letters"), F.aggregate(dna.phred(F.col("p_type")), F.lit(0), lambda a, q: a + q).cast("long").alias("phred_total"), dna.phred_string(dna.phred(F.col("p_type"))).alias("phred_back"),
        dna.distance_code(number(F.col("p_size")), number(F.nullif(F.col("p_size") % 3, F.lit(0))), F.lit(None).cast("int"), number(F.col("p_partkey") % 5)).alias("code"),
    )


# --- what is written to files and read back


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or of this machine in a local session without one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join((base or f"file://{tempfile.mkdtemp(prefix='ampliflow-')}").removeprefix("file://"), f"{name}-{uuid.uuid4().hex}")


def _read_back(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder's files, in small ranges, with their paths in it."""
    rows = read_sequences(spark, folder, split_size=100_000)
    return rows.select(F.replace("source_file", F.lit(f"{folder}/"), F.lit("")).alias("path"), "read_num", "seq_id", "description", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.md5(F.col("qual").cast("binary")).alias("qual_md5"))


def files_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a run, in two batches of which one is written twice."""
    run, folder = _run(spark, sf_dir).with_hits_written(f"file://{_folder(spark, 'hits')}"), _folder(spark, "files")
    for batch, rows in (("even", "read_id % 2 = 0"), ("odd", "read_id % 2 = 1"), ("odd", "read_id % 2 = 1")):
        outputs.write_files(run.facts.where(rows), folder, batch=batch)
    return _read_back(spark, folder)


def best_files_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the best records."""
    folder = _folder(spark, "best")
    outputs.write_subsample(_run(spark, sf_dir, trim="none").facts, design(), folder, 3)
    return _read_back(spark, folder).where(F.col("path").endswith(".fastq")).select("path", "read_num", "seq_id", "seq_md5")


def trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log, written and read back."""
    folder = _folder(spark, "trace")
    events.write_trace(events.run_events(_run(spark, sf_dir)), folder, "one")
    return events.read_trace(spark, folder).select("sequence_id", "event_type", F.array_join("fields", "|").alias("fields"))


def reads_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads as one FASTQ file, of which a range is read."""
    folder, rows = _folder(spark, "reads"), reads(spark, sf_dir)
    outputs.place_texts(rows.select(F.lit("all.fastq").alias("path"), F.concat_ws("\n", F.concat(F.lit("@"), "seq_id"), "seq", F.lit("+"), "qual", F.lit("")).alias("text"), "read_id"), folder, ["read_id"])
    return read_sequences(spark, folder, 101, 250, split_size=100_000).select("read_num", "seq_id", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.length("qual").alias("n_qual"))


def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads as FASTA files with lines of 60 bases."""
    folder, rows = _folder(spark, "fasta"), reads(spark, sf_dir)
    text = F.concat(F.lit(">"), F.col("seq_id"), F.lit(" of "), F.col("read_id").cast("string"), F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"), F.lit("\n"))
    outputs.place_texts(rows.select(F.concat(F.lit("part"), F.col("read_id") % 3, F.lit(".fasta")).alias("path"), text.alias("text"), "read_id"), folder, ["read_id"])
    return _read_back(spark, folder)


def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).totals().withColumn("match_rate", F.round("match_rate", 6))


def output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: records of each file."""
    return _run(spark, sf_dir).facts.groupBy("match_type", "pool", "primer_pair", "sample").agg(F.count("*").alias("n"))


def pool_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.rolled_up(_run(spark, sf_dir).facts).groupBy("path").agg(F.count("*").alias("n"))


def best_quality_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = outputs.top_quality(_run(spark, sf_dir, trim="none").facts, 3)
    return best.select("path", "rank", "read_id", F.round("average_quality", 6).alias("average_quality"))


#: The design as SQL sees it, worked out by hand: reverse complements, places in the order of search (specimens use F1, then R1, then F2),
#: thresholds (a third of a primer's length; half of the least distance between barcodes), pairs of a pool, keys of specimens.
_PRIMER_ROWS = """(0, 'F1', 'forward', 'TGAAGCTTAGCCGTAATC', 6, 0), (1, 'R1', 'reverse', 'CTCGTTAAGGATCCTGCA', 6, 2), (2, 'F2', 'forward', 'ACGTCAAGCCTTACATGG', 6, 1)"""
_BAR_ROWS = """(0, 'ACGTTGCAAC', 'GTTGCAACGT'), (1, 'TTGACCGATG', 'CATCGGTCAA'), (1, 'GGATCTAACC', 'GGTTAGATCC'), (1, 'AACCTTGGCA', 'TGCCAAGGTT'), (2, 'CATGGTTCAG', 'CTGAACCATG')"""
_PAIR_ROWS = "(0, 0, 1, 'A'), (1, 2, 1, 'B')"
_KEY_ROWS = """(0, 'S1', 'A', 'F1', 'R1', 'ACGTTGCAAC', 'TTGACCGATG'), (1, 'S2', 'A', 'F1', 'R1', 'ACGTTGCAAC', 'GGATCTAACC'), (2, 'S3', 'B', 'F2', 'R1', 'CATGGTTCAG', 'AACCTTGGCA')"""
_BARCODE_EDITS = 2


def _hits_ctes() -> str:
    return rf"""
reads AS ({_reads_sql(", 'g'")}),
primers(p, name, direction, pattern, k, file_index) AS (VALUES {_PRIMER_ROWS}),
bars(p, bc, pattern) AS (VALUES {_BAR_ROWS}),
pairs(n, f, r, pool) AS (VALUES {_PAIR_ROWS}),
keys(spec_ord, specimen_id, specimen_pool, kp1, kp2, kb1, kb2) AS (VALUES {_KEY_ROWS}),
patterns AS (SELECT p, pattern, k FROM primers),
{_course(_BARCODE_EDITS)}"""


def _course(kb: int) -> str:
    """The course of a read, from reads, primers, patterns (of a primer one for each way to read its codes), bars, pairs and keys."""
    return rf"""
strands AS (SELECT read_id, 0 AS x, seq AS s FROM reads UNION ALL SELECT read_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads),
tails AS (SELECT read_id, x, s, right(s, {WINDOW}) AS t, greatest(length(s) - {WINDOW}, 0) AS shift FROM strands),
spots AS (SELECT read_id, x, s, t, shift, unnest(range(1, length(t) + 1)) AS i FROM tails),
tried AS (
  SELECT q.read_id, q.x, q.s, q.shift, q.p, q.k, q.i, q.i + q.l - 1 AS e, levenshtein(q.pattern, substr(q.t, q.i::INT, q.l::INT)) AS d
  FROM (SELECT read_id, x, s, t, shift, i, p, k, pattern, unnest(range(length(pattern) - k, length(pattern) + k + 1)) AS l FROM spots, patterns) q
  WHERE q.i + q.l - 1 <= length(q.t)),
at_end AS (SELECT read_id, x, any_value(s) AS s, any_value(shift) AS shift, p, any_value(k) AS k, e, min(d) AS d, arg_min(i, d * 1000000 + i) AS i FROM tried GROUP BY read_id, x, p, e),
least AS (SELECT *, min(d) OVER (PARTITION BY read_id, x, p) AS dist FROM at_end),
ends AS (SELECT read_id, x, p, s, dist, (shift + e - 1)::BIGINT AS e, (shift + i - 1)::BIGINT AS b FROM least WHERE d = dist AND dist <= k),
hit AS (SELECT read_id, x, p, any_value(s) AS s, any_value(dist) AS dist, min(e) AS e0, arg_min(b, e) AS b0, string_agg(e::VARCHAR, ',' ORDER BY e) AS ends FROM ends GROUP BY read_id, x, p),
after AS (SELECT n.read_id, n.x, n.p, b.bc, b.pattern, n.e, substr(n.s, (n.e + 2)::INT, 40) AS t FROM ends n JOIN bars b ON b.p = n.p),
bar_tried AS (SELECT read_id, x, p, bc, pattern, e, t, unnest(range(greatest(1, length(pattern) - {kb}), length(pattern) + {kb} + 1)) AS l FROM after),
bar AS (SELECT read_id, x, p, bc, min(levenshtein(pattern, substr(t, 1, l::INT))) AS d FROM bar_tried WHERE l <= length(t) GROUP BY read_id, x, p, bc HAVING min(levenshtein(pattern, substr(t, 1, l::INT))) <= {kb}),
bar_list AS (SELECT read_id, x, p, string_agg(concat(bc, ':', d), ',' ORDER BY bc) AS barcodes, min(d) AS bd FROM bar GROUP BY read_id, x, p),
tied AS (SELECT b.read_id, b.x, b.p, b.bc, b.d FROM bar b JOIN bar_list l USING (read_id, x, p) WHERE b.d = l.bd),
votes AS (
  SELECT r.read_id, count(*) FILTER ((p.direction = 'forward' AND h.x = 1) OR (p.direction = 'reverse' AND h.x = 0)) AS f,
    count(*) FILTER ((p.direction = 'forward' AND h.x = 0) OR (p.direction = 'reverse' AND h.x = 1)) AS b
  FROM reads r LEFT JOIN hit h ON h.read_id = r.read_id LEFT JOIN primers p ON p.p = h.p GROUP BY r.read_id),
oriented AS (SELECT read_id, f, b, CASE WHEN f > 0 AND b = 0 THEN 'forward' WHEN b > 0 AND f = 0 THEN 'reverse' ELSE 'unknown' END AS orientation FROM votes),
ways AS (SELECT 0 AS strand UNION ALL SELECT 1),
tries AS (SELECT o.read_id, 2 * q.n + w.strand AS cand_ord, w.strand, q.f, q.r, q.pool FROM oriented o, pairs q, ways w
  WHERE (w.strand = 0 AND o.orientation <> 'reverse') OR (w.strand = 1 AND o.orientation <> 'forward')),
cands AS (
  SELECT t.*, a.dist AS d1, z.dist AS d2, a.e0 AS e1, z.e0 AS e2, a.b0 AS s1, z.b0 AS s2, CASE WHEN a.p IS NOT NULL THEN pf.name END AS n1, CASE WHEN z.p IS NOT NULL THEN pr.name END AS n2,
    la.bd AS bd1, lz.bd AS bd2, pf.file_index AS i1, pr.file_index AS i2
  FROM tries t JOIN primers pf ON pf.p = t.f JOIN primers pr ON pr.p = t.r
  LEFT JOIN hit a ON a.read_id = t.read_id AND a.x = 1 - t.strand AND a.p = t.f LEFT JOIN hit z ON z.read_id = t.read_id AND z.x = t.strand AND z.p = t.r
  LEFT JOIN bar_list la ON la.read_id = a.read_id AND la.x = a.x AND la.p = a.p LEFT JOIN bar_list lz ON lz.read_id = z.read_id AND lz.x = z.x AND lz.p = z.p
  WHERE a.p IS NOT NULL OR z.p IS NOT NULL),
scored AS (
  SELECT *, CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL AND bd1 IS NOT NULL AND bd2 IS NOT NULL THEN 5 WHEN n1 IS NOT NULL AND n2 IS NOT NULL AND (bd1 IS NOT NULL OR bd2 IS NOT NULL) THEN 4
    WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN 2 WHEN bd1 IS NOT NULL OR bd2 IS NOT NULL THEN 3 ELSE 1 END AS score FROM cands),
best AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY read_id) AS top FROM scored) WHERE score = top),
wide AS (
  SELECT b.*, t1.bc AS bc1, t2.bc AS bc2, k.specimen_id, k.specimen_pool, k.spec_ord FROM best b
  JOIN tied t1 ON t1.read_id = b.read_id AND t1.x = 1 - b.strand AND t1.p = b.f AND b.n1 IS NOT NULL JOIN tied t2 ON t2.read_id = b.read_id AND t2.x = b.strand AND t2.p = b.r AND b.n2 IS NOT NULL
  LEFT JOIN keys k ON k.kp1 = b.n1 AND k.kp2 = b.n2 AND k.kb1 = t1.bc AND k.kb2 = t2.bc),
full_ones AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id, specimen_id ORDER BY bd1 + bd2, d1 + d2, i1 + i2, cand_ord, bc1, bc2) AS nth FROM wide WHERE specimen_id IS NOT NULL) WHERE nth = 1),
others AS (SELECT * FROM best b WHERE bd1 IS NOT NULL AND bd2 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.read_id = b.read_id AND w.cand_ord = b.cand_ord AND w.specimen_id IS NOT NULL)),
halves AS (
  SELECT b.*, t.bc, CASE WHEN b.bd1 IS NOT NULL THEN 'fwd' ELSE 'rev' END AS side FROM best b JOIN tied t ON t.read_id = b.read_id
    AND ((b.bd1 IS NOT NULL AND t.x = 1 - b.strand AND t.p = b.f) OR (b.bd2 IS NOT NULL AND t.x = b.strand AND t.p = b.r))
  WHERE (b.bd1 IS NULL) <> (b.bd2 IS NULL)),
half_counted AS (SELECT *, count(*) OVER (PARTITION BY read_id, cand_ord) AS n_tied, row_number() OVER (PARTITION BY read_id, side, bc
  ORDER BY coalesce(bd1, bd2), -((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT), coalesce(d1, 0) + coalesce(d2, 0), CASE WHEN n1 IS NULL THEN 0 ELSE i1 END + CASE WHEN n2 IS NULL THEN 0 ELSE i2 END, cand_ord) AS nth FROM halves),
nones AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY -((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT), coalesce(d1, 0) + coalesce(d2, 0),
  CASE WHEN n1 IS NULL THEN 999 ELSE i1 END + CASE WHEN n2 IS NULL THEN 999 ELSE i2 END, cand_ord) AS nth FROM best WHERE bd1 IS NULL AND bd2 IS NULL),
chosen AS (
  SELECT read_id, cand_ord, strand, d1, d2, bd1, bd2, e1, e2, n1, n2, specimen_pool AS pool, specimen_id AS sample, 'dereplicated_full' AS resolution FROM full_ones
  UNION ALL SELECT read_id, cand_ord, strand, d1, d2, bd1, bd2, e1, e2, n1, n2, pool, 'unknown', 'unknown' FROM others
  UNION ALL SELECT read_id, cand_ord, strand, d1, d2, bd1, bd2, e1, e2, n1, n2, pool, CASE WHEN n_tied = 1 THEN concat('barcode_', side, '_', bc) ELSE 'unknown' END,
    CASE WHEN n_tied > 1 THEN 'unknown' WHEN side = 'fwd' THEN 'partial_forward' ELSE 'partial_reverse' END FROM half_counted WHERE nth = 1
  UNION ALL SELECT read_id, cand_ord, strand, d1, d2, bd1, bd2, e1, e2, n1, n2, pool, 'unknown', 'unknown' FROM nones WHERE nth = 1),
cut AS (
  SELECT c.*, CASE WHEN c.strand = 0 THEN r.seq ELSE reverse(translate(r.seq, 'ACGT', 'TGCA')) END AS own, coalesce(length(r.seq) - 1 - c.e1, 0) AS lo, coalesce(c.e2 + 1, length(r.seq)) AS hi
  FROM chosen c JOIN reads r USING (read_id)),
facts AS (
  SELECT read_id, cand_ord, concat(coalesce(d1::VARCHAR, 'X'), ',', coalesce(bd1::VARCHAR, 'X'), ',', coalesce(bd2::VARCHAR, 'X'), ',', coalesce(d2::VARCHAR, 'X')) AS distance_code,
    CASE WHEN lo >= hi THEN 'unknown' ELSE sample END AS sample, CASE WHEN lo >= hi THEN 'unknown' ELSE resolution END AS resolution, CASE WHEN lo >= hi THEN 'unknown' ELSE pool END AS pool,
    CASE WHEN lo >= hi THEN 'unknown' ELSE coalesce(n1, 'unknown') END AS p1, CASE WHEN lo >= hi THEN 'unknown' ELSE coalesce(n2, 'unknown') END AS p2,
    CASE WHEN lo >= hi THEN own ELSE substr(own, (lo + 1)::INT, (hi - lo)::INT) END AS seq FROM cut
  UNION ALL SELECT read_id, -1, 'X,X,X,X', 'unknown', 'unknown', 'unknown', 'unknown', 'unknown', seq FROM reads r WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.read_id = r.read_id)),
placed AS (
  SELECT *, concat(p1, '-', p2) AS primer_pair, CASE WHEN resolution = 'unknown' THEN 'unknown' WHEN resolution LIKE 'partial%' THEN 'partial' ELSE 'full' END AS match_type FROM facts)"""


def _mined_sql() -> str:
    """The least edits of a full read in any part of a partial one, over all parts whose length can be within the bound."""
    return """
WITH item AS (SELECT item_id % 4 AS key, item_id AS read_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTTGCAACTGGTCAACGTCATGGC') AS seq FROM benchmark),
partial AS (SELECT key, read_id, concat('ACGTAC', array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN i % 17 = 0 THEN translate(substr(seq, i, 1), 'ACGT', 'CGTA') ELSE substr(seq, i, 1) END), '')) AS seq FROM item),
pairs AS (SELECT p.key, p.read_id, p.seq AS t, f.read_id AS full_id, f.seq AS s, floor(length(f.seq) * 0.15 + 1e-9)::INT AS k FROM partial p JOIN item f USING (key) WHERE length(f.seq) > 0),
sized AS (SELECT *, unnest(range(greatest(0, length(s) - k), least(length(t), length(s) + k) + 1)) AS l FROM pairs),
placed AS (SELECT *, unnest(range(1, length(t) - l + 2)) AS i FROM sized),
least_edits AS (SELECT key, read_id, full_id, min(levenshtein(s, substr(t, i::INT, l::INT))) AS d, any_value(length(s)) AS n, any_value(k) AS k FROM placed GROUP BY key, read_id, full_id),
best AS (SELECT *, row_number() OVER (PARTITION BY key, read_id ORDER BY 1 - d / n::DOUBLE DESC, full_id) AS nth FROM least_edits WHERE d <= k)
SELECT key, read_id, full_id, round(1 - d / n::DOUBLE, 6) AS identity, concat('item', read_id, '_mined_forward_', printf('%.2f', 1 - d / n::DOUBLE)) AS seq_id FROM best WHERE nth = 1"""


def _trimmed_sql() -> str:
    """What each trim leaves of the chosen candidates, from the first places of primers and the places of their barcodes (of a barcode
    the first place with its least distance; of all barcodes within the bound the outermost end)."""
    return """,
calls AS (SELECT read_id, x, p, bc, e, l, levenshtein(pattern, substr(t, 1, l::INT)) AS d FROM bar_tried WHERE l <= length(t)),
near_calls AS (SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY read_id, x, p, bc) AS least FROM calls) WHERE d = least AND d <= 2),
first_calls AS (SELECT * FROM (SELECT *, min(e) OVER (PARTITION BY read_id, x, p, bc) AS first FROM near_calls) WHERE e = first),
outer_ends AS (SELECT read_id, x, p, max(e + l) AS far FROM first_calls GROUP BY read_id, x, p),
spans AS (
  SELECT c.*, r.seq, length(r.seq) AS n, s.s1, s.s2, o1.far AS far1, o2.far AS far2 FROM chosen c JOIN reads r USING (read_id) JOIN scored s ON s.read_id = c.read_id AND s.cand_ord = c.cand_ord
  LEFT JOIN outer_ends o1 ON o1.read_id = s.read_id AND o1.x = 1 - s.strand AND o1.p = s.f AND s.n1 IS NOT NULL LEFT JOIN outer_ends o2 ON o2.read_id = s.read_id AND o2.x = s.strand AND o2.p = s.r AND s.n2 IS NOT NULL),
trims AS (
  SELECT 'primers' AS trim, read_id, cand_ord, sample, strand, seq, coalesce(n - s1, 0) AS lo, coalesce(s2, n) AS hi FROM spans
  UNION ALL SELECT 'tails', read_id, cand_ord, sample, strand, seq, coalesce(n - 1 - far1, greatest(0, coalesce(n - 1 - e1, 0) - 10)), coalesce(far2 + 1, least(n, coalesce(e2 + 1, n) + 10)) FROM spans)
SELECT trim, read_id, cand_ord, CASE WHEN lo >= hi THEN 'unknown' ELSE sample END AS sample, length(cut) AS n, md5(cut) AS seq_md5
FROM (SELECT *, CASE WHEN lo >= hi THEN own ELSE substr(own, (lo + 1)::INT, (hi - lo)::INT) END AS cut FROM (SELECT *, CASE WHEN strand = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS own FROM trims))"""


def _undereplicated_sql() -> str:
    """Every best candidate, with all specimens that its tied barcodes give."""
    return """,
ties AS (SELECT read_id, x, p, count(*) AS n, min(bc) AS bc FROM tied GROUP BY read_id, x, p),
given AS (
  SELECT b.read_id, b.cand_ord, count(*) AS n, string_agg(k.specimen_id, '_' ORDER BY k.spec_ord) AS ids, arg_min(k.specimen_pool, k.spec_ord) AS specimen_pool
  FROM best b JOIN keys k ON k.kp1 = b.n1 AND k.kp2 = b.n2 JOIN tied t1 ON t1.read_id = b.read_id AND t1.x = 1 - b.strand AND t1.p = b.f AND t1.bc = k.kb1
  JOIN tied t2 ON t2.read_id = b.read_id AND t2.x = b.strand AND t2.p = b.r AND t2.bc = k.kb2 GROUP BY b.read_id, b.cand_ord),
called AS (
  SELECT b.read_id, b.cand_ord, b.pool, g.n, g.ids, g.specimen_pool, CASE WHEN b.bd1 IS NOT NULL AND b.bd2 IS NULL AND t1.n = 1 THEN concat('barcode_fwd_', t1.bc) WHEN b.bd2 IS NOT NULL AND b.bd1 IS NULL AND t2.n = 1 THEN concat('barcode_rev_', t2.bc) END AS part
  FROM best b LEFT JOIN given g ON g.read_id = b.read_id AND g.cand_ord = b.cand_ord LEFT JOIN ties t1 ON t1.read_id = b.read_id AND t1.x = 1 - b.strand AND t1.p = b.f AND b.n1 IS NOT NULL
  LEFT JOIN ties t2 ON t2.read_id = b.read_id AND t2.x = b.strand AND t2.p = b.r AND b.n2 IS NOT NULL)
SELECT read_id, cand_ord, coalesce(ids, part, 'unknown') AS sample, CASE WHEN n = 1 THEN 'full_match' WHEN n > 1 THEN 'multiple_specimens' WHEN part LIKE 'barcode_fwd%' THEN 'partial_forward' WHEN part IS NOT NULL THEN 'partial_reverse' ELSE 'unknown' END AS resolution,
  CASE WHEN n = 1 THEN specimen_pool ELSE pool END AS pool FROM called
UNION ALL SELECT read_id, -1, 'unknown', 'unknown', 'unknown' FROM reads r WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.read_id = r.read_id)"""


def _files_sql() -> str:
    """Records of each file in the order of reads, even reads before odd ones as they were written first."""
    return """,
copies AS (
  SELECT *, concat(match_type, '/', pool, '/', primer_pair, '/', sample, '.fastq') AS path FROM placed
  UNION ALL SELECT *, concat('full/', pool, '/', sample, '.fastq') FROM placed WHERE resolution = 'dereplicated_full'),
quals AS (SELECT c.*, array_to_string(list_transform(range(1, length(r.seq) + 1), lambda i: chr((38 + (i * 7 + c.read_id) % 30)::INT)), '') AS whole, r.seq AS read_seq FROM copies c JOIN reads r USING (read_id)),
cuts AS (SELECT DISTINCT read_id, cand_ord, strand, lo, hi FROM cut),
recs AS (SELECT q.*, CASE WHEN u.read_id IS NULL THEN whole WHEN u.strand = 0 THEN CASE WHEN lo >= hi THEN whole ELSE substr(whole, (lo + 1)::INT, (hi - lo)::INT) END ELSE CASE WHEN lo >= hi THEN reverse(whole) ELSE substr(reverse(whole), (lo + 1)::INT, (hi - lo)::INT) END END AS qual
  FROM quals q LEFT JOIN cuts u ON u.read_id = q.read_id AND u.cand_ord = q.cand_ord)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY read_id % 2, read_id, cand_ord) - 1 AS read_num, concat('read', read_id) AS seq_id, concat_ws(' ', distance_code, concat('pool=', pool), concat('primers=', p1, '+', p2), sample) AS description, md5(seq) AS seq_md5, md5(qual) AS qual_md5 FROM recs"""


def _run_events_sql() -> str:
    """Each event of the standard log with its fields."""
    side = lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 'both' WHEN {a} IS NOT NULL THEN 'forward_only' WHEN {b} IS NOT NULL THEN 'reverse_only' ELSE 'none' END"
    join = lambda *fields: "concat_ws('|', " + ", ".join(fields) + ")"
    none = lambda c: f"coalesce({c}::VARCHAR, 'none')"
    far = lambda c: f"coalesce({c}, -1)::VARCHAR"
    names, cid = [none(c) for c in ("n1", "n2", "b1", "b2")], "concat(read_id, '_', cand_ord)"
    score = "printf('%.3f', score::DOUBLE)"
    n_primers, primer_dist = "(n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT", "coalesce(d1, 0) + coalesce(d2, 0)"
    present, penalised = (f"CASE WHEN n1 IS NULL THEN {x} ELSE i1 END + CASE WHEN n2 IS NULL THEN {x} ELSE i2 END" for x in (0, 999))
    text = lambda c: f"({c})::VARCHAR"
    return f""",
firsts AS (SELECT read_id, x, p, min(bc) AS bc, count(*) AS n FROM tied GROUP BY read_id, x, p),
named AS (
  SELECT s.*, a.bc AS b1, z.bc AS b2, coalesce(a.n, 1) * coalesce(z.n, 1) AS ways, max(score) OVER (PARTITION BY s.read_id) AS top FROM scored s
  LEFT JOIN firsts a ON a.read_id = s.read_id AND a.x = 1 - s.strand AND a.p = s.f AND s.n1 IS NOT NULL LEFT JOIN firsts z ON z.read_id = s.read_id AND z.x = s.strand AND z.p = s.r AND s.n2 IS NOT NULL),
widest AS (SELECT *, count(*) OVER (PARTITION BY read_id, specimen_id) AS alternatives FROM wide WHERE specimen_id IS NOT NULL),
half_groups AS (SELECT *, count(*) OVER (PARTITION BY read_id, side, bc) AS alternatives FROM half_counted),
none_groups AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS alternatives FROM nones),
solved AS (SELECT c.read_id, c.cand_ord, c.sample, c.resolution, c.pool, c.n1, c.n2, m.b1, m.b2 FROM chosen c JOIN named m ON m.read_id = c.read_id AND m.cand_ord = c.cand_ord)
SELECT read_id, 'SEQUENCE_RECEIVED' AS event_type, {join("length(seq)::VARCHAR", "concat('read', read_id)")} AS fields FROM reads
UNION ALL SELECT read_id, 'ORIENTATION_DETECTED', {join("orientation", text("f"), text("b"), "printf('%.3f', CASE WHEN f + b > 0 THEN abs(f - b) / (f + b)::DOUBLE ELSE 0 END)")} FROM oriented
UNION ALL SELECT read_id, 'PRIMER_MATCHED', {join(cid, side("n1", "n2"), none("n1"), none("n2"), far("d1"), far("d2"), none("pool"), "CASE WHEN strand = 0 THEN 'as_is' ELSE 'reverse_complement' END")} FROM named
UNION ALL SELECT read_id, 'BARCODE_MATCHED', {join(cid, side("b1", "b2"), none("b1"), none("b2"), far("bd1"), far("bd2"), none("n1"), none("n2"))} FROM named
UNION ALL SELECT read_id, 'MATCH_SCORED', {join(cid, *names, text("coalesce(d1, 0) + coalesce(d2, 0) + coalesce(bd1, 0) + coalesce(bd2, 0)"), side("b1", "b2"), score)} FROM named
UNION ALL SELECT read_id, 'MATCH_DISCARDED', {join(cid, *names, score, "'lower_score'")} FROM named WHERE score < top
UNION ALL SELECT read_id, 'DEREPLICATE_EXPANDED', {join(text("count(*)"), text("sum(ways)::BIGINT"))} FROM named WHERE score = top GROUP BY read_id HAVING count(*) > 1 OR sum(ways) > 1
UNION ALL SELECT read_id, 'NO_MATCH_FOUND', 'primer_search|No primer matches found' FROM reads r WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.read_id = r.read_id)
UNION ALL SELECT read_id, 'SPECIMEN_RESOLVED', {join("sample", "resolution", none("pool"), *names)} FROM solved
UNION ALL SELECT read_id, 'DEREPLICATE_SELECTED', {join("specimen_id", text("alternatives"), text("bd1 + bd2"), text(primer_dist), text(present))} FROM (SELECT *, row_number() OVER (PARTITION BY read_id, specimen_id ORDER BY bd1 + bd2, d1 + d2, i1 + i2, cand_ord, bc1, bc2) AS nth FROM widest) WHERE nth = 1
UNION ALL SELECT h.read_id, 'DEREPLICATE_PARTIAL_SELECTED', {join("CASE WHEN side = 'fwd' THEN 'forward' ELSE 'reverse' END", "CASE WHEN side = 'fwd' THEN m.b1 ELSE m.b2 END", text("alternatives"), text("coalesce(h.bd1, h.bd2)"), text(n_primers.replace("n1", "h.n1").replace("n2", "h.n2")), text(primer_dist.replace("d1", "h.d1").replace("d2", "h.d2")), text(present.replace("n1", "h.n1").replace("n2", "h.n2").replace("i1", "h.i1").replace("i2", "h.i2")))}
  FROM half_groups h JOIN named m ON m.read_id = h.read_id AND m.cand_ord = h.cand_ord WHERE nth = 1
UNION ALL SELECT read_id, 'DEREPLICATE_UNKNOWN_SELECTED', {join(text("alternatives"), text(n_primers), text(primer_dist), text(penalised))} FROM none_groups WHERE nth = 1 AND alternatives > 1
UNION ALL SELECT read_id, 'SEQUENCE_TRIM_EMPTY', {join("'barcodes'", text("lo"), text("hi"), text("length(own)"), "'unknown'", "'unknown'")} FROM cut WHERE lo >= hi
UNION ALL SELECT read_id, 'SEQUENCE_OUTPUT', {join("sample", "pool", "primer_pair", "concat(match_type, '/', pool, '/', primer_pair, '/', sample)")} FROM placed"""


_QUAL = "list_sum(list_transform(range(1, length(seq) + 1), lambda i: 38 - 33 + (i * 7 + read_id) % 30)) / length(seq)"


def _sql() -> dict[str, str]:
    chain = _hits_ctes()
    reads_cte = f"WITH reads AS ({_reads_sql(chr(44) + chr(32) + chr(39) + 'g' + chr(39))})"
    kept = lambda letters: f"length(regexp_replace(upper(p_name), '[^{letters}]', '', 'g'))"
    top = f"SELECT path, rank, read_id, round(average_quality, 6) AS average_quality FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY average_quality DESC, read_id, cand_ord) AS rank FROM (SELECT p.path, r.read_id, p.cand_ord, CASE WHEN p.strand IS NULL THEN NULL ELSE {_QUAL.replace('seq', 'r.seq').replace('read_id', 'r.read_id')} END AS average_quality FROM paths p JOIN reads r USING (read_id))) WHERE rank <= 3"
    return {
        "reverse_complement": f"{reads_cte} SELECT read_id, length(seq) AS n, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM reads",
        "average_quality": f"{reads_cte} SELECT read_id, round(CASE WHEN length(seq) > 0 THEN {_QUAL} ELSE 0 END, 6) AS average_quality FROM reads",
        "length_filter": f"{reads_cte} SELECT CASE WHEN length(seq) < 300 THEN 'too_short' WHEN length(seq) > 4000 THEN 'too_long' ELSE 'passed' END AS reason, count(*) AS n FROM reads GROUP BY 1",
        "primer_thresholds": f"SELECT p_partkey, floor(({kept('ACGT')} * 3 + {kept('YRWMSK')} * 2 + {kept('BDHV')}) / 3.0::DOUBLE / 3)::INT AS threshold FROM part",
        "barcode_distances": f"WITH sheet AS ({_sheet_sql()}), w AS (SELECT row_number() OVER () AS i, s FROM (SELECT DISTINCT b1 AS s, 0 FROM sheet UNION ALL SELECT DISTINCT reverse(translate(b2, 'ACGT', 'TGCA')), 1 FROM sheet)) SELECT levenshtein(a.s, b.s)::INT AS distance, count(*) AS n FROM w a JOIN w b ON a.i < b.i GROUP BY 1",
        "pool_statistics": "WITH p AS (SELECT p_brand AS pool, p_size % 2 = 0 AS f FROM part UNION ALL SELECT split_part(p_type, ' ', 1), p_size % 2 = 0 FROM part) SELECT pool, count(*) FILTER (f) AS n_forward, count(*) FILTER (NOT f) AS n_reverse, count(*) AS n FROM p GROUP BY pool",
        "primer_pairs": "WITH u AS (SELECT DISTINCT c_mktsegment AS pool, concat('F', c_nationkey % 7) AS f, concat('R', (c_custkey * 3 + c_nationkey) % 11) AS r FROM customer), pools AS (SELECT DISTINCT f AS name, pool FROM u UNION SELECT DISTINCT r, pool FROM u) "
        "SELECT forward, reverse, min(a.pool) AS pool FROM (SELECT DISTINCT f AS forward, r AS reverse FROM u) x JOIN pools a ON a.name = x.forward JOIN pools b ON b.name = x.reverse AND b.pool = a.pool GROUP BY forward, reverse",
        "convert_primers": "SELECT primer, 'forward' AS direction, concat('primer_F', row_number() OVER (ORDER BY primer)) AS name FROM (SELECT DISTINCT p_brand AS primer FROM part) UNION ALL SELECT primer, 'reverse', concat('primer_R', row_number() OVER (ORDER BY primer)) FROM (SELECT DISTINCT p_type AS primer FROM part)",
        "primer_hits": f"WITH {chain} SELECT h.read_id, h.x AS strand, p.name AS primer, h.dist::INT AS dist, h.ends, coalesce(l.barcodes, '') AS barcodes FROM hit h JOIN primers p USING (p) LEFT JOIN bar_list l ON l.read_id = h.read_id AND l.x = h.x AND l.p = h.p",
        "orientation_votes": f"WITH {chain} SELECT read_id, f::INT AS forward_score, b::INT AS reverse_score, orientation, round(CASE WHEN f + b > 0 THEN abs(f - b) / (f + b)::DOUBLE ELSE 0 END, 6) AS confidence FROM oriented",
        "candidate_scores": f"WITH {chain} SELECT read_id, n1, n2, strand, score FROM scored",
        "best_candidates": f"WITH {chain} SELECT read_id, max(score) AS score, count(*) AS n_best FROM best GROUP BY read_id",
        "demultiplexed": f"WITH {chain} SELECT read_id, distance_code, sample, resolution, concat(match_type, '/', pool, '/', primer_pair, '/', sample) AS path, length(seq) AS n, md5(seq) AS seq_md5 FROM placed",
        "sheet_demultiplexed": f"WITH {_sheet_ctes()} SELECT read_id, distance_code, sample, resolution, concat(match_type, '/', pool, '/', primer_pair, '/', sample) AS path, length(seq) AS n, md5(seq) AS seq_md5 FROM placed",
        "match_rate": f"WITH {chain} SELECT (SELECT count(*) FROM reads) AS total, count(DISTINCT read_id) AS matched, round(count(DISTINCT read_id) / (SELECT count(*) FROM reads)::DOUBLE, 6) AS match_rate FROM placed WHERE resolution = 'dereplicated_full'",
        "trimmed": f"WITH {chain}{_trimmed_sql()}",
        "undereplicated": f"WITH {chain}{_undereplicated_sql()}",
        "run_events": f"WITH {chain}{_run_events_sql()}",
        "files_written": f"WITH {chain}{_files_sql()}",
        "trace_files": f"WITH {chain}{_run_events_sql()}".replace("SELECT read_id, 'SEQUENCE_RECEIVED' AS event_type,", "SELECT printf('%s#%08d#%s', 'read', read_id, 'spark') AS sequence_id, event_type, fields FROM (SELECT read_id, 'SEQUENCE_RECEIVED' AS event_type,") + ")",
        "reads_in_range": f"{reads_cte} SELECT read_num, concat('read', read_id) AS seq_id, md5(seq) AS seq_md5, length(seq) AS n_qual FROM (SELECT *, row_number() OVER (ORDER BY read_id) - 1 AS read_num FROM reads) WHERE read_num BETWEEN 100 AND 349",
        "fasta_files": f"{reads_cte} SELECT concat('part', read_id % 3, '.fasta') AS path, row_number() OVER (PARTITION BY read_id % 3 ORDER BY read_id) - 1 AS read_num, concat('read', read_id) AS seq_id, concat('of ', read_id) AS description, md5(seq) AS seq_md5, NULL::VARCHAR AS qual_md5 FROM reads",
        "scalar_functions": "SELECT p_partkey, regexp_replace(concat(p_name, '/', p_type, '.', p_brand), '[^\\p{L}\\p{N}._\\-$#]', '_', 'g') AS file_name, printf('%s#%08d#%s', 'part', p_partkey, p_brand) AS sequence_id, "
        f"round(({kept('ACGT')} * 3 + {kept('YRWMSK')} * 2 + {kept('BDHV')}) / 3.0::DOUBLE, 6) AS letters, list_sum(list_transform(range(1, length(p_type) + 1), lambda i: ascii(substr(p_type, i, 1)) - 33))::BIGINT AS phred_total, p_type AS phred_back, "
        "concat_ws(',', p_size::VARCHAR, coalesce(nullif(p_size % 3, 0)::VARCHAR, 'X'), 'X', (p_partkey % 5)::VARCHAR) AS code FROM part",
        "trace_pivot": f"WITH {chain}, solved AS (SELECT read_id, resolution FROM (SELECT read_id, resolution, row_number() OVER (PARTITION BY read_id ORDER BY cand_ord, sample, resolution) AS nth FROM chosen) WHERE nth = 1), "
        "tops AS (SELECT *, max(score) OVER (PARTITION BY read_id) AS top FROM scored), events AS (SELECT o.orientation, CASE WHEN bd1 IS NOT NULL AND bd2 IS NOT NULL THEN 'both' WHEN bd1 IS NOT NULL THEN 'forward_only' WHEN bd2 IS NOT NULL THEN 'reverse_only' ELSE 'none' END AS match_type, "
        "CASE WHEN score < top THEN 'discarded_lower_score' WHEN resolution = 'dereplicated_full' THEN 'matched' WHEN resolution LIKE 'partial%' THEN resolution ELSE 'unknown' END AS outcome_detailed, (bd1 IS NOT NULL)::INT + (bd2 IS NOT NULL)::INT AS barcode_count "
        "FROM tops JOIN oriented o USING (read_id) LEFT JOIN solved USING (read_id) UNION ALL SELECT orientation, 'none', 'unknown', 0 FROM oriented o WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.read_id = o.read_id)) SELECT orientation, match_type, outcome_detailed, barcode_count, count(*) AS n FROM events GROUP BY ALL",
        "output_counts": f"WITH {chain} SELECT match_type, pool, primer_pair, sample, count(*) AS n FROM placed GROUP BY ALL",
        "pool_roll_up": f"WITH {chain} SELECT path, count(*) AS n FROM (SELECT concat(match_type, '/', pool, '/', primer_pair, '/', sample) AS path FROM placed UNION ALL SELECT concat('full/', pool, '/', sample) FROM placed WHERE resolution = 'dereplicated_full') GROUP BY path",
        "best_files_written": f"WITH {chain}, full_rows AS (SELECT * FROM chosen WHERE resolution = 'dereplicated_full'), "
        "paths AS (SELECT concat('full/', pool, '/', n1, '-', n2, '/', sample) AS path, read_id, cand_ord, strand FROM full_rows UNION ALL SELECT concat('full/', pool, '/', sample), read_id, cand_ord, strand FROM full_rows), "
        f"ranked AS (SELECT path, read_id, cand_ord, strand, seq, row_number() OVER (PARTITION BY path ORDER BY {_QUAL} DESC, read_id, cand_ord) AS rank FROM paths JOIN reads USING (read_id)) "
        "SELECT concat('subsample/', path, '.fastq') AS path, row_number() OVER (PARTITION BY path ORDER BY read_id, cand_ord) - 1 AS read_num, concat('read', read_id) AS seq_id, md5(CASE WHEN strand = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END) AS seq_md5 FROM ranked WHERE rank <= 3",
        "best_quality_records": f"WITH {chain}, full_rows AS (SELECT c.*, CASE WHEN c.strand = 0 THEN r.seq ELSE r.seq END AS s FROM chosen c JOIN reads r USING (read_id) WHERE c.resolution = 'dereplicated_full'), "
        "paths AS (SELECT concat('full/', pool, '/', n1, '-', n2, '/', sample) AS path, read_id, cand_ord, strand FROM full_rows UNION ALL SELECT concat('full/', pool, '/', sample), read_id, cand_ord, strand FROM full_rows) " + top,
    }


# --- the event log and its statistics, over the events table


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidates: a user is a sequence."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_id").alias("candidate_match_id"), F.col("user_id").alias("sequence_id"), "event_type", F.when(F.col("value") < 50, "low").otherwise("high").alias("level"), (F.col("user_id") % 5).alias("group"))


DIMENSIONS = ["event_type", "level", "group"]


def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.nested_counts(_candidates(spark, sf_dir), DIMENSIONS)
    return out.withColumn("percent", F.round("percent", 6))


def stats_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.nested_counts(_candidates(spark, sf_dir), DIMENSIONS[:2], "sequences")
    return out.withColumn("percent", F.round("percent", 6))


def sankey_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sankey_nodes(_candidates(spark, sf_dir), DIMENSIONS)


def sankey_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sankey_links(_candidates(spark, sf_dir), DIMENSIONS)


def sankey_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.node_flow(stats.sankey_links(_candidates(spark, sf_dir), DIMENSIONS))


def event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


def pool_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return stats.pool_match_rates(rows, F.col("event_type"), F.col("value") >= 50).withColumn("rate", F.round("rate", 6))


def processing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.processing_times(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id"), F.col("ts"))


def trace_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's own events, read back as candidates and counted by outcome."""
    rows = events.numbered(events.run_events(_run(spark, sf_dir)))
    return events.with_dimensions(events.pivoted(rows)).groupBy("orientation", "match_type", "outcome_detailed", "barcode_count").agg(F.count("*").alias("n"))


def mined_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as reads: each item's letters with every 17th changed are a partial read, and mined for all items of its key."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTTGCAACTGGTCAACGTCATGGC")
    reads_ = item.select((F.col("item_id") % 4).alias("key"), F.col("item_id").alias("read_id"), letters.alias("seq"))
    changed = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.when(i % 17 == 0, F.translate(F.substring("seq", i, F.lit(1)), "ACGT", "CGTA")).otherwise(F.substring("seq", i, F.lit(1)))), "")
    partials = reads_.select("key", "read_id", F.concat(F.lit("item"), "read_id").alias("seq_id"), F.lit("").alias("description"), F.concat(F.lit("ACGTAC"), changed).alias("seq"), F.lit("").alias("qual"), F.lit("forward").alias("side"))
    return mining.mine(partials, reads_, 0.85).select("key", "read_id", "full_id", F.round("identity", 6).alias("identity"), "seq_id")


_CANDS = "c AS (SELECT event_id, user_id AS sequence_id, event_type, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS level, CAST(user_id % 5 AS VARCHAR) AS \"group\" FROM events)"


def _rolled(cte: str, source: str, dims: list[str]) -> str:
    quoted, parts = [f'"{d}"' for d in dims], []
    for d in range(len(dims) + 1):
        own = [*quoted[:d], *(f"CAST(NULL AS VARCHAR) AS {q}" for q in quoted[d:])]
        above = f"PARTITION BY {', '.join(quoted[: d - 1])}" if d > 1 else ""
        group = f"GROUP BY {', '.join(quoted[:d])}" if d else ""
        parts.append(f"SELECT {', '.join(own)}, {d} AS depth, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER ({above}), 6) AS percent FROM {source} {group}")
    return f"WITH {cte} " + " UNION ALL ".join(parts)


def _event_sql() -> dict[str, str]:
    links = " UNION ALL ".join(f'SELECT {n} AS layer, "{a}" AS source, "{b}" AS target, count(*) AS count FROM c GROUP BY 2, 3' for n, (a, b) in enumerate(zip(DIMENSIONS, DIMENSIONS[1:], strict=False)))
    first = f"{_CANDS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY event_id) AS nth FROM c) WHERE nth = 1)"
    return {
        "stats_rollup": _rolled(_CANDS, "c", DIMENSIONS),
        "stats_sequences": _rolled(first, "f", DIMENSIONS[:2]),
        "sankey_nodes": f"WITH {_CANDS} " + " UNION ALL ".join(f"SELECT DISTINCT '{d}' AS dimension, {n} AS layer, \"{d}\" AS value, \"{d}\" AS label FROM c" for n, d in enumerate(DIMENSIONS)),
        "sankey_links": f"WITH {_CANDS} {links}",
        "sankey_flow": f"WITH {_CANDS}, l AS ({links}), o AS (SELECT layer, source AS value, sum(count)::BIGINT AS n FROM l GROUP BY 1, 2), i AS (SELECT layer + 1 AS layer, target AS value, sum(count)::BIGINT AS n FROM l GROUP BY 1, 2) SELECT coalesce(o.layer, i.layer) AS layer, coalesce(o.value, i.value) AS value, coalesce(o.n, i.n) AS flow FROM o FULL JOIN i ON o.layer = i.layer AND o.value = i.value",
        "event_histogram": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
        "pool_match_rates": "SELECT event_type AS pool, count(*) AS n, count(*) FILTER (value >= 50) AS n_matched, round(count(*) FILTER (value >= 50) / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY event_type",
        "processing_times": "SELECT user_id AS key, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS micros FROM events GROUP BY user_id ORDER BY micros DESC, key LIMIT 10",
    }


_ALL = (
    reverse_complement, average_quality, length_filter, primer_thresholds, barcode_distances, pool_statistics, primer_pairs, convert_primers, primer_hits, orientation_votes, candidate_scores, best_candidates,
    demultiplexed, sheet_demultiplexed, trimmed, undereplicated, run_events, scalar_functions, files_written, best_files_written, trace_files, reads_in_range, fasta_files, match_rate, output_counts, pool_roll_up, best_quality_records, stats_rollup, stats_sequences, sankey_nodes, sankey_links, sankey_flow, event_histogram, pool_match_rates, processing_times, trace_pivot, mined_partials,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = _sql() | _event_sql() | {"mined_partials": _mined_sql()}
