"""Sinks of the demultiplexing facts: a partitioned table, text records, and the exact file layout with its roll-ups and sidecars."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampliflow.functions.dna import mean_quality
from ampliflow.operators.demux import Result
from ampliflow.sources.tables import FORWARD, REVERSE, Design

LAYOUT = ["match_type", "pool", "primer_pair", "sample"]


def record(facts: DataFrame, named: bool = True) -> Column:
    """The text of a record: FASTQ, or FASTA where there is no quality. named: with pool and primers in the header, as in files."""
    place = [F.concat(F.lit("pool="), "pool"), F.concat(F.lit("primers="), "p1_name", F.lit("+"), "p2_name")] if named else []
    head = F.concat_ws(" ", "seq_id", "distance_code", *place, "sample")
    fasta = F.concat(F.lit(">"), head, F.lit("\n"), F.col("seq"), F.lit("\n"))
    return F.when(F.col("qual").isNull(), fasta).otherwise(F.concat(F.lit("@"), head, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"), F.lit("\n")))


def _regions(run: Result) -> Column:
    """Where barcodes and primers stand in what is written of a read: array of (start, end, kind), ends inclusive."""
    shift = F.when(F.col("fact.trim_empty"), 0).otherwise(F.col("fact.start"))
    of = lambda loc, kind: F.struct((loc["s"] - shift).alias("start"), (loc["e"] - shift).alias("end"), F.lit(kind).alias("kind"))
    first = lambda locs: F.get(locs, 0)
    found = [of(first(F.get(F.col(f"b{n}"), 0)["locs"]), "barcode") for n in (1, 2)] + [of(first(F.col(f"p{n}.locs")), "primer") for n in (1, 2)]
    return F.filter(F.array(*found), lambda r: r["start"].isNotNull())


def console(run: Result, colour: bool = False) -> Iterator[str]:
    """Records of a run one by one, partition by partition; with colour their barcodes, primers and weak bases are marked."""
    rows = run.outcomes.select("fact.*", (_regions(run) if colour else F.lit(None)).alias("regions"))
    for row in rows.select(record(rows, named=False).alias("r"), "seq", "qual", "regions").toLocalIterator(prefetchPartitions=True):
        text, seq = row["r"], row["seq"]
        if colour:
            text = text.replace(f"\n{seq}\n", f"\n{coloured(seq, row['qual'], [tuple(r) for r in row['regions']])}\n", 1)
        yield text


def rolled_up(facts: DataFrame) -> DataFrame:
    """The facts, and for full matches a second row at the pool's own level (primer_pair null)."""
    pool_level = F.concat_ws("/", F.lit("full"), "pool", F.element_at(F.split("path", "/"), -1))
    place = lambda pair, path: F.struct(pair.alias("primer_pair"), path.alias("path"))
    own, above = place(F.col("primer_pair"), F.col("path")), place(F.lit(None).cast("string"), pool_level)
    # One pass: as a union both branches would search the reads.
    places = F.when(F.col("is_full"), F.array(own, above)).otherwise(F.array(own))
    rows = facts.withColumn("place", F.explode(places))
    return rows.withColumns({"primer_pair": F.col("place.primer_pair"), "path": F.col("place.path")}).drop("place")


def write_lake(facts: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, partitioned as the files are. A sample's rows may be most of all (unknown): they spread over tasks by read."""
    spread = facts.repartition("match_type", "pool", "primer_pair", F.pmod(F.xxhash64("read_id"), F.lit(16)))
    spread.write.mode(mode).partitionBy(*LAYOUT[:3]).parquet(path)


def top_quality(facts: DataFrame, n: int) -> DataFrame:
    """The n records of each full sample (at pair and pool level) with the best mean quality, first read first among equals.

    Reads are searched once, and a quality is taken once for both levels. Each task keeps the n best of a file before the shuffle, and so
    does each merge of them: Spark limits the groups of a window whose rank has a bound."""
    rows = facts.where(F.col("match_type") == "full").withColumn("average_quality", mean_quality("qual"))
    rows = rolled_up(rows)
    order = W.partitionBy("path").orderBy(F.desc("average_quality"), "read_id", "cand_ord")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


#: Bytes that are copied at a time.
CHUNK = 4 << 20
_LEDGER, _STAGE, _INTENT = ".batches", ".parts-", "_INTENT"


def _mark(path: str, text: str = "") -> None:
    """A file that is there whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "w") as f:
        f.write(text)
    os.replace(draft, path)


def _ledger(folder: str, batch: str) -> str:
    return os.path.join(folder, _LEDGER, hashlib.sha256(batch.encode()).hexdigest())


def is_written(folder: str, batch: str) -> bool:
    """Whether a batch of that name is in the folder's files."""
    return os.path.exists(_ledger(folder.removeprefix("file://"), batch))


def _write_parts(stage: str):  # noqa: ANN202
    """Writes a task's records of each file as a part, in a folder of the task's own: path, part, own (that folder), bytes, records."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, sizes, counts = TaskContext.get().partitionId(), {}, {}
        own = f"{stage}/{part}-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for path, group in batch.groupby("path", sort=False):
                data = "".join(group["text"]).encode()
                if path not in sizes:
                    os.makedirs(os.path.dirname(f"{own}/{path}"), exist_ok=True)
                with open(f"{own}/{path}", "ab") as f:
                    f.write(data)
                sizes[path], counts[path] = sizes.get(path, 0) + len(data), counts.get(path, 0) + len(group)
        rows = {"path": list(sizes), "part": part, "own": own, "bytes": list(sizes.values()), "records": list(counts.values())}
        yield pd.DataFrame(rows).astype({"path": "object", "part": "int32", "own": "object", "bytes": "int64", "records": "int64"})

    return write


def _target(folder: str, stage: str, path: str, held: int) -> str:
    """Where parts are put: at the end of the file that is there, or in a draft of a new one."""
    return os.path.join(folder, path) if held else os.path.join(stage, "_new", path)


def _finish(spark: SparkSession, folder: str, stage: str) -> int:
    """Puts the parts of a stage with an intent in their places and commits it. May be done again, whole or in part: each part has its
    place in its file, fixed before. Returns the number of files."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, own, held, at in zip(batch["path"], batch["own"], batch["held"], batch["at"], strict=True):
                target = _target(folder, stage, path, held)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                fd = os.open(target, os.O_RDWR | os.O_CREAT, 0o644)
                try:
                    with open(f"{own}/{path}", "rb") as f:
                        while data := f.read(CHUNK):
                            while data:
                                done = os.pwrite(fd, data, at)
                                data, at = data[done:], at + done
                    os.fsync(fd)
                finally:
                    os.close(fd)
            yield pd.DataFrame({"n": [len(batch)]})

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, held in zip(batch["path"], batch["held"], strict=True):
                target, draft = os.path.join(folder, path), _target(folder, stage, path, held)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                if draft != target and os.path.exists(draft):
                    os.replace(draft, target)
            yield pd.DataFrame({"n": [len(batch)]})

    placed = spark.read.parquet(f"file://{stage}/_placed")
    n = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = spark.sparkContext.defaultParallelism
    n(placed.repartition(tasks, "path", "part").mapInPandas(place, "n long"))
    files = n(placed.where(F.col("first")).mapInPandas(show, "n long"))
    with open(os.path.join(stage, _INTENT)) as f:
        batch = f.read()
    if batch:
        _mark(_ledger(folder, batch))
    shutil.rmtree(stage, ignore_errors=True)
    return files


def recover(spark: SparkSession, folder: str) -> int:
    """Ends what a run that broke off has left in a folder of files: batches whose places were fixed are put in place, others go. Returns
    how many were ended. A folder has one writer at a time."""
    folder, done = folder.removeprefix("file://"), 0
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        stage = os.path.join(folder, name)
        if name.startswith(_STAGE) and os.path.exists(os.path.join(stage, _INTENT)):
            _finish(spark, folder, stage)
            done += 1
        elif name.startswith(_STAGE):
            shutil.rmtree(stage, ignore_errors=True)
    return done


def place_texts(rows: DataFrame, folder: str, order: list[str], batch: str | None = None) -> tuple[int, int]:
    """Appends texts (path, text, and the columns of order, by which texts of a file stand) to files of a folder, on a file system that
    all executors share. Returns the number of files and of texts. batch: a name under which the folder remembers the write; a second
    write of that name does nothing.

    Each task first writes its texts of each file as a part. The sizes of the parts and of the files so far give each part its place in
    its file; once these are written down, parts are copied there by as many tasks as there are parts, also those of one large file, and
    bytes that a file holds already aren't touched. New files show when they are whole. Copies may be made again, by a task that runs
    twice or by the next run after one that broke off (recover), which leaves no text twice and none out."""
    folder, spark = folder.removeprefix("file://"), rows.sparkSession
    recover(spark, folder)
    if batch is not None and is_written(folder, batch):
        return 0, 0
    stage = os.path.join(folder, f"{_STAGE}{uuid.uuid4().hex}")
    # Files are in order inside a range; large files spread over several tasks.
    rows = rows.repartitionByRange(*order).sortWithinPartitions("path", *order)
    rows.select("path", "text").mapInPandas(_write_parts(stage), "path string, part int, own string, bytes long, records long").write.parquet(f"file://{stage}/_parts")

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            targets = [os.path.join(folder, p) for p in b["path"]]
            yield b.assign(held=pd.Series([os.path.getsize(t) if os.path.exists(t) else 0 for t in targets], dtype="int64"))

    parts = spark.read.parquet(f"file://{stage}/_parts")
    held = parts.select("path").distinct().mapInPandas(sized, "path string, held long")
    before = W.partitionBy("path").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.join(held, "path").withColumns({"at": F.col("held") + F.coalesce(F.sum("bytes").over(before), F.lit(0)), "first": F.row_number().over(W.partitionBy("path").orderBy("part")) == 1})
    placed.write.parquet(f"file://{stage}/_placed")
    n = parts.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    _mark(os.path.join(stage, _INTENT), batch or "")
    return _finish(spark, folder, stage), n


def write_files(facts: DataFrame, folder: str, roll_up: bool = True, batch: str | None = None) -> int:
    """Appends each record to <folder>/<path>.fastq (.fasta without qualities), by read. Returns the number of files. batch, and what
    holds for broken runs: as of place_texts."""
    rows = rolled_up(facts) if roll_up else facts
    rows = rows.select(F.concat("path", F.when(F.col("qual").isNull(), ".fasta").otherwise(".fastq")).alias("path"), "read_id", "cand_ord", record(facts).alias("text"))
    return place_texts(rows, folder, ["read_id", "cand_ord"], batch)[0]


def write_sidecars(design: Design, folder: str) -> None:
    """primers.fasta and primers.txt in each folder under full/ that holds records: of a pool, or of a pair."""
    root = os.path.join(folder.removeprefix("file://"), "full")
    by_name = {p.name: p for p in design.ordered}
    for d, _, names in os.walk(root):
        if not any(n.endswith((".fastq", ".fasta")) and n != "primers.fasta" for n in names):
            continue
        parts = os.path.relpath(d, root).split(os.sep)
        own = [p for p in design.ordered if parts[0] in p.pools]
        if len(parts) == 2:
            own = [by_name[f] for f in by_name for r in by_name if f"{f}-{r}" == parts[1]] + [by_name[r] for f in by_name for r in by_name if f"{f}-{r}" == parts[1]]
        own = sorted(own, key=lambda p: (p.direction != FORWARD, p.file_index))
        with open(os.path.join(d, "primers.fasta"), "w") as f:
            f.writelines(f">{p.name} position={p.direction} pool={','.join(p.pools)}\n{p.primer}\n" for p in own)
        with open(os.path.join(d, "primers.txt"), "w") as f:
            f.writelines(f">{p.name}\n{p.primer}\n" for p in own)


def scaffold(design: Design) -> list[str]:
    """All folders that a run can fill: match type, pool, and each forward and reverse primer of the pool, or unknown."""
    out = []
    for pool in sorted({x for p in design.ordered for x in p.pools}):
        fw, rv = ([p.name for p in design.ordered if pool in p.pools and p.direction == d] for d in (FORWARD, REVERSE))
        pairs = [f"{f}-{r}" for f in fw for r in rv] + [f"{f}-unknown" for f in fw] + [f"unknown-{r}" for r in rv]
        out += [f"{kind}/{pool}/{pair}" for kind in ("full", "partial", "unknown") for pair in pairs]
    return [*out, "unknown/unknown/unknown-unknown"]


def write_subsample(facts: DataFrame, design: Design, folder: str, n: int, batch: str | None = None) -> int:
    """subsample/ beside full/, with the n best records of each of its files. 0 writes nothing. batch: as of write_files."""
    if n <= 0:
        return 0
    best = top_quality(facts, n).withColumn("path", F.regexp_replace("path", "^full/", "subsample/full/"))
    count = write_files(best.drop("average_quality", "rank"), folder, roll_up=False, batch=batch and f"{batch} subsample")
    write_sidecars(design, os.path.join(folder, "subsample"))
    return count


def coloured(seq: str, qual: str | None, regions: list[tuple[int, int, str]], low: int = 10) -> str:
    """A record's sequence for a terminal: regions (start, end, `barcode` or `primer`) in blue and green, later ones over earlier ones,
    bases under `low` quality in lower case."""
    codes, marks = {"barcode": "\033[34m", "primer": "\033[32m"}, [""] * len(seq)
    for start, end, kind in regions:
        for i in range(max(0, start), min(len(seq), end + 1)):
            marks[i] = codes[kind]
    out, last = [], ""
    for i, (base, mark) in enumerate(zip(seq, marks, strict=True)):
        if mark != last:
            out.append("\033[0m" * bool(last) + mark)
        out.append(base.lower() if qual and ord(qual[i]) - 33 < low else base)
        last = mark
    return "".join(out) + "\033[0m" * bool(last)
