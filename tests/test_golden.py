"""A given set of reads, primers and specimens with the files that they make: set GOLDEN_DIR to a folder with sequences.fastq,
sequences_rc.fastq, primers.fasta, specimens.txt and expected_output/."""

import os

import pytest

from ampliflow import cli
from ampliflow.sources.sequences import records

FOLDER = os.environ.get("GOLDEN_DIR", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="GOLDEN_DIR isn't set")


def written(folder):
    out = {}
    for d, _, names in os.walk(folder):
        out |= {os.path.relpath(os.path.join(d, n), folder): sorted(records(os.path.join(d, n))) for n in names if n.endswith(".fastq")}
    return out


def run(name, out, *more):
    assert cli.main(["demux", f"{FOLDER}/primers.fasta", f"{FOLDER}/specimens.txt", f"{FOLDER}/{name}", "-F", "-O", str(out), *more]) == 0
    return written(out)


def test_files_and_match_rate(spark, tmp_path):
    got, want = run("sequences.fastq", tmp_path / "a", "-d"), written(f"{FOLDER}/expected_output")
    assert got == want
    full = {r[0] for path, rows in got.items() if path.startswith("full/") for r in rows}
    n = len(list(records(f"{FOLDER}/sequences.fastq")))
    assert abs(len(full) / n - 0.15) <= 0.05
    back = run("sequences_rc.fastq", tmp_path / "b")
    ids = lambda files: {path: sorted(r[0].removesuffix("_RC") for r in rows) for path, rows in files.items()}
    assert ids(back) == ids(want)


@pytest.mark.parametrize("n", [5, 10, 20])
def test_rate_of_the_first_reads(spark, tmp_path, n):
    got = run("sequences.fastq", tmp_path / "o", "-n", str(n))
    full = {r[0] for path, rows in got.items() if path.startswith("full/") for r in rows}
    assert abs(len(full) / n - 0.2) <= 0.05
