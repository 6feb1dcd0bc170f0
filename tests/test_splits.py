"""Ranges of FASTQ, FASTA and blocked gzip files: each record once, at every split."""

import gzip
import random
import zlib

import pytest

from ampliflow.sources import sequences
from ampliflow.sources.sequences import read_sequences, records, records_of_range

#: Qualities that look like headers and separators, repeated headers in the third line, an empty read, blank lines between records.
HARD = "@a first\nACGT\n+\n@+@+\n@b\nAC\n+b\n+@\n@c\n\n+\n\n\n@d x y\nA\n+@d\n@\n@@e\nACGTACGT\n+\n@@@@@@@@\n\n\n@f\nGG\n+\n++\n@g\nTTT\n+\n@f\n\n@h\nC\n+\n+\n"
HARD = HARD.replace("\n@f\n\n@h", "\n@fg\n@h")


def split(path, kind, cuts):
    out = []
    for a, b in zip(cuts, cuts[1:]):
        out += list(records_of_range(str(path), kind, a, b))
    return out


def test_every_split_of_a_hard_file(tmp_path):
    for name, text in (("a.fastq", HARD), ("b.fastq", HARD.replace("\n", "\r\n")), ("c.fastq", HARD.rstrip("\n"))):
        (tmp_path / name).write_bytes(text.encode())
        want, n = list(records(str(tmp_path / name))), len(text.encode())
        assert len(want) == 8
        for k in range(1, n):
            assert split(tmp_path / name, "fastq", [0, k, n]) == want, (name, k)
        for step in (1, 2, 3, 7):
            assert split(tmp_path / name, "fastq", [*range(0, n, step), n]) == want


def test_every_split_of_fasta(tmp_path):
    text = ">a first\nAC\nGT\n>b\n\n>c > d\nA\n\nC\n>e\nGGG"
    (tmp_path / "a.fasta").write_text(text)
    want = list(records(str(tmp_path / "a.fasta")))
    for k in range(1, len(text)):
        assert split(tmp_path / "a.fasta", "fasta", [0, k, len(text)]) == want
    assert split(tmp_path / "a.fasta", "fasta", [*range(len(text)), len(text)]) == want


def blocked(data, size):
    """Blocked gzip: members with their size in an extra field, an empty one at the end."""
    out = b""
    for at in [*range(0, len(data), size), len(data)]:
        piece = data[at : at + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(piece) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(piece).to_bytes(4, "little") + len(piece).to_bytes(4, "little")
    return out


def test_every_split_of_blocked_gzip(tmp_path):
    for size in (5, 16, 37, 1000):
        path = tmp_path / f"a{size}.fastq.gz"
        path.write_bytes(blocked(HARD.encode(), size))
        assert gzip.open(path, "rt").read() == HARD
        want, n = list(records(str(path))), path.stat().st_size
        for k in range(1, n, 3):
            assert split(path, "fastq", [0, k, n]) == want, (size, k)
    path = tmp_path / "magic.fastq.gz"  # a block's first bytes inside a block
    path.write_bytes(blocked(HARD.encode(), 30)[:-28] + blocked(b"@z\nA\n+\n\x1f\n", 9))
    assert sequences.block_size(path.read_bytes()[:64]) and len(split(path, "fastq", [0, 40, path.stat().st_size])) == len(list(records(str(path))))


def test_malformed_records_are_errors_in_any_range(tmp_path):
    text = "@a\nAC\n+\nII\n" * 5 + "@bad\nACG\n+\nI\n" + "@a\nAC\n+\nII\n" * 5
    (tmp_path / "a.fastq").write_text(text)
    for k in range(1, len(text)):
        with pytest.raises(ValueError, match="malformed"):
            split(tmp_path / "a.fastq", "fastq", [0, k, len(text)])


def test_large_files_are_read_in_ranges(spark, tmp_path):
    r = random.Random(3)
    text = "".join(f"@r{n} d\n{'ACGT' * (n % 9)}\n+\n{''.join(r.choice('@+I') for _ in range(4 * (n % 9)))}\n" for n in range(3000))
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "b.fastq.gz").write_bytes(blocked(text.encode(), 900))
    with gzip.open(tmp_path / "c.fastq.gz", "wt") as f:
        f.write(text)
    whole = read_sequences(spark, str(tmp_path))
    parts = read_sequences(spark, str(tmp_path), split_size=7000)
    assert whole.rdd.getNumPartitions() == 3 and parts.columns == whole.columns
    ranges = {n: len(sequences.ranges(str(tmp_path / n), 7000)) for n in ("a.fastq", "b.fastq.gz", "c.fastq.gz")}
    assert ranges["a.fastq"] > 10 and ranges["b.fastq.gz"] > 2 and ranges["c.fastq.gz"] == 1
    order = ["source_file", "read_num"]
    assert parts.orderBy(*order).collect() == whole.orderBy(*order).collect()
    some = read_sequences(spark, str(tmp_path), 11, 5, split_size=7000).orderBy(*order).collect()
    assert [x["seq_id"] for x in some] == [f"r{n}" for n in range(10, 15)] * 3


def test_tasks_go_with_bytes_not_with_ranges(spark, tmp_path):
    r = random.Random(5)
    want = []
    for name in ("a.fastq", "b.fastq", "empty.fastq"):
        seqs = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 90))) for _ in range(0 if name == "empty.fastq" else 1500)]
        (tmp_path / name).write_text("".join(f"@{name}{n}\n{x}\n+\n{'@' * len(x)}\n" for n, x in enumerate(seqs)))
        want += [(str(tmp_path / name), n, f"{name}{n}", x) for n, x in enumerate(seqs)]
    rows = sequences.read_sequences(spark, str(tmp_path), split_size=200)
    assert sorted((x["source_file"], x["read_num"], x["seq_id"], x["seq"]) for x in rows.collect()) == want
    spark.dataSource.register(sequences.SequenceSource)
    assert spark.read.format("sequences").option("splitSize", 200).load(str(tmp_path)).rdd.getNumPartitions() <= 2 * sequences.TASKS
    assert [len(x) for x in sequences.dealt([("none", n, n + 1) for n in range(100)], size=10, tasks=1)] == [10] * 10
    assert sequences.dealt([]) == []
