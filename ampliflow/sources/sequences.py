"""FASTQ and FASTA files as a Spark data source: spark.read.format("sequences").load(path).

A path is a file, a folder or a glob that every executor can open (a shared file system); files ending in .gz or .gzip are
decompressed as they are read. Records: read_num (place in its file, from 0), seq_id, description, seq, qual (null in FASTA, whose
sequences may span lines), source_file.

With the option splitSize, files of more bytes are read in ranges, each a partition: a range has the records that begin after its first
byte, up to its end, the first range also one at its first byte. As `@` and `+` are legal quality characters, a range in FASTQ finds its
first record by four lines that fit (a header, a line `+`, and as many qualities as bases): a line of bases never begins with `+`, so no
other phase fits. Blocked gzip (members that tell their size) is split at its blocks; other gzip files aren't split. read_num is then the
place in the range, and split_start its first byte; read_sequences gives places in the file."""

from __future__ import annotations

import glob
import gzip
import os
from collections import deque
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = T.StructType(
    [
        T.StructField("read_num", T.LongType(), False), T.StructField("seq_id", T.StringType(), False), T.StructField("description", T.StringType()),
        T.StructField("seq", T.StringType(), False), T.StructField("qual", T.StringType()), T.StructField("source_file", T.StringType(), False),
    ]
)
ZIPPED = (".gz", ".gzip")
PACKED = (*ZIPPED, ".bz2", ".zip")


def detect_format(path: str) -> str:
    """fastq or fasta: by suffix under any compression suffixes, else by the first byte, else fasta."""
    name = path.lower()
    while name.endswith(PACKED):
        name = name[: name.rindex(".")]
    if name.endswith((".fastq", ".fq")):
        return "fastq"
    if name.endswith((".fasta", ".fa", ".fna")):
        return "fasta"
    try:
        with opened(path) as f:
            return {"@": "fastq", ">": "fasta"}.get(f.read(1), "fasta")
    except (OSError, UnicodeDecodeError):
        return "fasta"


def opened(path: str):  # noqa: ANN201
    return gzip.open(path, "rt") if path.lower().endswith(ZIPPED) else open(path)


def _head(line: str) -> tuple[str, str]:
    parts = line[1:].split(None, 1)
    return (parts[0] if parts else ""), (parts[1] if len(parts) > 1 else "")


def records(path: str, kind: str | None = None) -> Iterator[tuple[str, str, str, str | None]]:
    """seq_id, description, seq, qual of each record."""
    with opened(path) as f:
        if (kind or detect_format(path)) == "fastq":
            while head := f.readline():
                if head.strip():
                    seq, plus, qual = (f.readline().rstrip("\r\n") for _ in range(3))
                    if head[0] != "@" or plus[:1] != "+" or len(seq) != len(qual):
                        raise ValueError(f"{path}: a FASTQ record is malformed at {head.strip()!r}")
                    yield (*_head(head.rstrip("\r\n")), seq, qual)
            return
        head, parts = None, []
        for line in f:
            line = line.rstrip("\r\n")
            if line.startswith(">"):
                if head is not None:
                    yield (*_head(head), "".join(parts), None)
                head, parts = line, []
            elif head is not None:
                parts.append(line.strip())
        if head is not None:
            yield (*_head(head), "".join(parts), None)


def files(path: str, pattern: str = "*") -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{path}/**/{pattern}", recursive=True) if os.path.isfile(p))
    return sorted(glob.glob(path)) or [path]


def block_size(head: bytes) -> int:
    """The bytes of a block of blocked gzip, from its first bytes (at least 18); 0 if they don't begin one."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return 0


#: Bytes that are read at a time; a block of blocked gzip is no longer.
_READ = 1 << 16


def _first_block(f: BinaryIO, start: int) -> int:
    """The first block of blocked gzip at or after a byte: bytes that look like one and are followed by another, or by the end."""
    size = os.fstat(f.fileno()).st_size
    at, data = start, b""
    while at < size:
        f.seek(at)
        data = f.read(2 * _READ)
        k = data.find(b"\x1f\x8b\x08\x04")
        while k >= 0:
            n = block_size(data[k : k + 64])
            if n:
                f.seek(at + k + n)
                if at + k + n == size or block_size(f.read(64)):
                    return at + k
            k = data.find(b"\x1f\x8b\x08\x04", k + 1)
        at += max(1, len(data) - 64)
    return size


class _Lines:
    """Lines of a range of a file and of what follows it, with their places. limit: the last place where a record of the range begins,
    known once the range's end was read."""

    def __init__(self, path: str, start: int, end: int):
        self.limit: float = float("inf")
        self.chunks = self._blocks(path, start, end) if path.lower().endswith(ZIPPED) else self._bytes(path, start, end)

    def _bytes(self, path: str, start: int, end: int) -> Iterator[bytes]:
        with open(path, "rb") as f:
            f.seek(start)
            self.limit = end - start
            while data := f.read(_READ):
                yield data

    def _blocks(self, path: str, start: int, end: int) -> Iterator[bytes]:
        with open(path, "rb") as f:
            at, out = _first_block(f, start) if start else 0, 0
            f.seek(at)
            if at >= end:
                self.limit = -1
                return
            while head := f.read(64):
                n = block_size(head)
                if not n:
                    raise ValueError(f"{path}: no block of blocked gzip at byte {at}")
                if at >= end and self.limit == float("inf"):
                    self.limit = out
                data = gzip.decompress(head[:n] + f.read(max(0, n - len(head))))
                at, out = at + n, out + len(data)
                f.seek(at)
                if data:
                    yield data

    def __iter__(self) -> Iterator[tuple[int, str]]:
        at, rest = 0, b""
        for data in self.chunks:
            *whole, rest = (rest + data).split(b"\n")
            for line in whole:
                yield at, line.rstrip(b"\r").decode()
                at += len(line) + 1
        if rest:
            yield at, rest.rstrip(b"\r").decode()


def records_of_range(path: str, kind: str, start: int, end: int) -> Iterator[tuple[str, str, str, str | None]]:
    """seq_id, description, seq, qual of the records that begin in a range of a file (of its compressed bytes, in blocked gzip)."""
    source = _Lines(path, start, end)
    lines = iter(source)
    if start:
        next(lines, None)  # a part of a line, or one that begins where the range does: the range before has it
    if kind == "fastq":
        ahead: deque[tuple[int, str]] = deque(islice(lines, 4))
        passed = 0
        while start and ahead and not (len(ahead) == 4 and ahead[0][1][:1] == "@" and ahead[2][1][:1] == "+" and len(ahead[1][1]) == len(ahead[3][1])):
            passed += bool(ahead[0][1].strip())
            if passed > 3 and len(ahead) == 4:  # of the record that the range begins in three lines are left at most
                raise ValueError(f"{path}: a FASTQ record is malformed at {ahead[0][1]!r}")
            ahead.popleft()
            ahead.extend(islice(lines, 1))
        while ahead:
            at, head = ahead.popleft()
            ahead.extend(islice(lines, 4 - len(ahead)))
            if not head.strip():
                continue
            if at > source.limit:
                return
            seq, plus, qual = (ahead.popleft()[1] if ahead else "" for _ in range(3))
            if head[0] != "@" or plus[:1] != "+" or len(seq) != len(qual):
                raise ValueError(f"{path}: a FASTQ record is malformed at {head.strip()!r}")
            yield (*_head(head), seq, qual)
            ahead.extend(islice(lines, 4 - len(ahead)))
        return
    name, parts = None, []
    for at, line in lines:
        if line.startswith(">"):
            if name is not None:
                yield (*_head(name), "".join(parts), None)
            if at > source.limit:
                return
            name, parts = line, []
        elif name is not None:
            parts.append(line.strip())
    if name is not None:
        yield (*_head(name), "".join(parts), None)


def ranges(path: str, size: int) -> list[tuple[int, int]]:
    """Ranges of about so many bytes, or one with (0, -1) for a file that isn't split."""
    whole = [(0, -1)]
    n = os.path.getsize(path) if size > 0 else 0
    if n <= size or path.lower().endswith(PACKED) and not path.lower().endswith(ZIPPED):
        return whole
    if path.lower().endswith(ZIPPED):
        with open(path, "rb") as f:
            if not block_size(f.read(64)):
                return whole
    count = -(-n // size)
    return [(n * k // count, n * (k + 1) // count) for k in range(count)]


#: Bytes of a range of a large file, and of the ranges that a task reads; tasks that there are at least, as far as there are ranges.
SPLIT, TASKS = 64 << 20, 32


def dealt(found: list[tuple[str, int, int]], size: int = SPLIT, tasks: int = TASKS) -> list[list[tuple[str, int, int]]]:
    """Ranges (path, start, end; end -1 for a whole file) in runs of so many bytes, or of fewer where that gives too few runs: the number
    of tasks goes with the bytes, not with the ranges."""
    lengths = [(os.path.getsize(p) if os.path.exists(p) else 0) if end < 0 else end - start for p, start, end in found]
    most, out, held = min(size, -(-sum(lengths) // tasks)), [], 0
    for place, length in zip(found, lengths, strict=True):
        if not out or held + length > most:
            out.append([])
            held = 0
        out[-1].append(place)
        held += length
    return out


class _Ranges(InputPartition):
    def __init__(self, places: list[tuple[str, int, int]]):
        self.places = places


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Ranges]:
        found = files(self.options["path"], self.options.get("pathGlobFilter", "*"))
        return [_Ranges(x) for x in dealt([(p, *r) for p in found for r in ranges(p, int(self.options.get("splitSize", 0)))])]

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        kind, split = self.options.get("fileFormat"), int(self.options.get("splitSize", 0))
        for path, start, end in partition.places:
            place = (start,) if split else ()
            rows = records(path, kind) if end < 0 else records_of_range(path, kind or detect_format(path), start, end)
            for n, (seq_id, description, seq, qual) in enumerate(rows):
                yield n, seq_id, description, seq, qual, path, *place


class SequenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> T.StructType:
        return T.StructType([*SCHEMA.fields, T.StructField("split_start", T.LongType(), False)]) if int(self.options.get("splitSize", 0)) else SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)


def read_sequences(spark: SparkSession, path: str, first: int | None = None, number: int | None = None, split_size: int = SPLIT) -> DataFrame:
    """Reads of path. first, number: only so many of each file from the first-th (from 1) on. Files of more than split_size bytes are read
    in ranges; then their records are counted by range first, for the places of records in their files."""
    spark.dataSource.register(SequenceSource)
    if any(len(ranges(p, split_size)) > 1 for p in files(path) if os.path.exists(p)):
        reads = spark.read.format("sequences").option("splitSize", split_size).load(path)
        counts = reads.groupBy("source_file", "split_start").agg(F.count("*").alias("n"))
        before = F.sum("n").over(W.partitionBy("source_file").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1))
        starts = counts.select("source_file", "split_start", F.coalesce(before, F.lit(0)).alias("before"))
        reads = reads.join(starts, ["source_file", "split_start"]).withColumn("read_num", F.col("read_num") + F.col("before")).select(*SCHEMA.names)
    else:
        reads = spark.read.format("sequences").load(path)
    if number is not None and number >= 0:
        begin = (first or 1) - 1
        reads = reads.where(F.col("read_num").between(begin, begin + number - 1))
    elif first:
        reads = reads.where(F.col("read_num") >= first - 1)
    return reads


def parse_range(text: str) -> tuple[int | None, int | None]:
    """ "-1": all; "N": the first N; "start,num"."""
    parts = [int(x) for x in str(text).split(",")]
    if len(parts) > 2:
        raise ValueError(f"a range is a number, or start,number: {text}")
    if len(parts) == 2:
        return parts[0], parts[1]
    return None, None if parts[0] < 0 else parts[0]
