"""A watched folder: each file that arrives and has settled goes through the batch pipeline once.

The stream's source publishes a file when its size has not changed for settle_time seconds; files that are there at the start are
left out, and recorded as ignored. What was published stands in a log beside the checkpoint, and an offset is a place in it, so that it
stays as small after a million files as after one. What became of a file is recorded under its place in the log: a batch that is run
again after a crash finds what it has written and records the same once more, in the same place."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

SCHEMA = T.StructType().add("path", T.StringType()).add("size", T.LongType()).add("place", T.LongType())
STATUS = "path string, timestamp timestamp, size long, status string"


def listed(folder: str, pattern: str) -> dict[str, int]:
    """Files right in a folder, and their sizes."""
    out = {}
    with os.scandir(folder) as entries:
        for e in entries:
            if e.is_file() and fnmatch.fnmatch(e.name, pattern):
                out[e.path] = e.stat().st_size
    return out


class ArrivalLog:
    """Published files in the order of their places, as segments <first>-<last> of JSON lines. Two segments of one length are merged as
    the next is added, so that n files make at most log n segments, each written log n times in all. A segment is there whole or not at
    all; those that a crash left inside a merged one are passed over."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")
        os.makedirs(self.folder, exist_ok=True)

    def segments(self) -> list[tuple[int, int]]:
        """(first, last) of segments that make up the log."""
        found = sorted((int(m[1]), -int(m[2])) for n in os.listdir(self.folder) if (m := re.fullmatch(r"(\d+)-(\d+)", n)))
        out: list[tuple[int, int]] = []
        for first, last in found:
            if not out or first > out[-1][1]:
                out.append((first, -last))
        return out

    def __len__(self) -> int:
        own = self.segments()
        return own[-1][1] + 1 if own else 0

    def read(self, start: int = 0, end: int | None = None) -> list[tuple[str, int]]:
        """(path, size) of the files from place start up to end, exclusive."""
        out = []
        for first, last in self.segments():
            if last < start or (end is not None and first >= end):
                continue
            with open(f"{self.folder}/{first}-{last}") as f:
                rows = [tuple(json.loads(x)) for x in f]
            out += rows[max(0, start - first) : None if end is None else end - first]
        return out

    def _write(self, first: int, rows: list[tuple[str, int]]) -> None:
        draft = f"{self.folder}/.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, f"{self.folder}/{first}-{first + len(rows) - 1}")

    def append(self, files: list[tuple[str, int]]) -> None:
        for row in files:
            own = self.segments()
            first, rows, merged = (own[-1][1] + 1 if own else 0), [row], []
            while own and own[-1][1] - own[-1][0] + 1 == len(rows):
                merged.append(own.pop())
                rows = self.read(*(merged[-1][0], merged[-1][1] + 1)) + rows
                first = merged[-1][0]
            self._write(first, rows)
            for a, b in merged:
                os.remove(f"{self.folder}/{a}-{b}")


class _Range(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class SettledReader(DataSourceStreamReader):
    """An offset is a place in the log of published files."""

    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*.fastq")
        self.settle = float(options.get("settleTime", 30))
        self.log = ArrivalLog(options["log"])
        self.left_out = set(json.loads(options.get("ignored", "[]"))) | {p for p, _ in self.log.read()}
        self.most = int(options.get("maxFilesPerTrigger", 1))
        self.seen: dict[str, tuple[int, float]] = {}

    def initialOffset(self) -> dict:
        return {"place": 0}

    def latestOffset(self) -> dict:
        now, added = time.time(), []
        for path, size in sorted(listed(self.folder, self.pattern).items()):
            if path in self.left_out:
                continue
            if self.seen.get(path, (None, 0))[0] != size:
                self.seen[path] = (size, now)
            if now - self.seen[path][1] >= self.settle and len(added) < self.most:
                added.append((path, size))
        self.log.append(added)  # before the offset that names their places
        self.left_out |= {p for p, _ in added}
        for p, _ in added:
            del self.seen[p]
        return {"place": len(self.log)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        files = self.log.read(start["place"], end["place"])
        return [_Range([(p, s, start["place"] + n) for n, (p, s) in enumerate(files)])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from partition.files

    def commit(self, end: dict) -> None:
        pass


class SettledFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "settled_files"

    def schema(self) -> T.StructType:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> SettledReader:
        return SettledReader(self.options)


def arrivals(spark: SparkSession, folder: str, log: str, pattern: str = "*.fastq", settle_time: float = 30, ignored: list[str] | None = None) -> DataFrame:
    """A stream of settled new files: path, size, place (in the log, a folder that a restart finds again)."""
    spark.dataSource.register(SettledFiles)
    options = {"path": folder, "log": log, "pattern": pattern, "settleTime": str(settle_time), "ignored": json.dumps(ignored or [])}
    return spark.readStream.format("settled_files").options(**options).load()


def _record(spark: SparkSession, status: str, name: str, rows: list[tuple[str, int, str]]) -> None:
    """Records rows (path, size, status) under a name; again under the same name replaces them."""
    table = spark.createDataFrame(rows, "path string, size long, status string")
    table.select("path", F.current_timestamp().alias("timestamp"), "size", "status").coalesce(1).write.mode("overwrite").parquet(f"{status}/{name}")


def watch(
    spark: SparkSession, folder: str, process: Callable[[DataFrame, str, str], None], checkpoint: str, status: str,
    pattern: str = "*.fastq", settle_time: float = 30, stop_after: int | None = None, reads: Callable[[str], DataFrame] | None = None,
) -> StreamingQuery:
    """Calls process(reads, path, batch) for each settled file, one at a time. batch names the file's arrival: after a crash the same name
    comes again, and a sink that remembers names (write_files) writes nothing twice. status: a folder for the status table, where success,
    failed and ignored files are recorded; failed files aren't tried again. Files that are there at a restart and aren't recorded yet are
    ignored as well; what was recorded or published before stays so. The query stops after stop_after successes."""
    from ampliflow.sources.sequences import read_sequences

    place = f"{checkpoint}/arrivals"
    log, there = ArrivalLog(place), listed(folder, pattern)
    known = {p for p, _ in log.read()}
    if os.path.isdir(status.removeprefix("file://")):
        known |= {r["path"] for r in status_table(spark, status).select("path").collect()}  # names of files of one folder
    if ignored := sorted(set(there) - known):
        _record(spark, status, f"ignored-{uuid.uuid4().hex}", [(p, there[p], "ignored") for p in ignored])
    left_out = sorted((set(there) | known) - {p for p, _ in log.read()})
    done = {"n": 0}

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.collect():  # the names of at most maxFilesPerTrigger files
            path, size, name = row["path"], row["size"], f"arrival-{row['place']}"
            try:
                process((reads or (lambda p: read_sequences(spark, p)))(path), path, name)
                outcome = "success"
            except Exception:  # recorded: a bad file mustn't end the watch
                outcome = "failed"
            _record(spark, status, name, [(path, size, outcome)])
            done["n"] += outcome == "success"
        if stop_after and done["n"] >= stop_after:
            threading.Thread(target=query.stop).start()  # a batch can't wait for its own query

    stream = arrivals(spark, folder, place, pattern, settle_time, left_out)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    return query


def status_table(spark: SparkSession, status: str) -> DataFrame:
    """The last status of each file."""
    rows = spark.read.schema(STATUS).option("recursiveFileLookup", "true").parquet(status)
    return rows.groupBy("path").agg(F.max_by(F.struct("timestamp", "size", "status"), "timestamp").alias("s")).select("path", "s.*")
