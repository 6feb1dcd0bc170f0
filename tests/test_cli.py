"""The command line on files of our own: primers with ambiguity codes, two pools, a reverse complemented copy of every read."""

import json
import random

import pytest

from ampliflow import cli
from ampliflow.functions.dna import complement
from ampliflow.operators import mining
from ampliflow.sources.sequences import records

PRIMERS = {"FA": "CTTGGTCATTTAGAGGAAGTAA", "FB": "GTGARTCATCGARTCTTTG", "RZ": "TCCTCCGCTTATTGATATGC"}
FASTA = ">RZ pool=P,Q position=reverse\n{RZ}\n>FA pool=P position=forward\n{FA}\n>FB position=forward pool=Q\n{FB}\n"
BARS = {"S1": ("Q", "ATAATATTCGGCA", "FB", "AACGGCCTTGAGG"), "S2": ("Q", "ATAATATTCGGCA", "FB", "CATCTTCTGCCTT"), "S3": ("P", "ATGCTAGACATCG", "FA", "GCAATAAGGAGCG")}


def plain(primer, r):
    return "".join({"R": r.choice("AG")}.get(c, c) for c in primer)


@pytest.fixture
def files(tmp_path):
    r = random.Random(4)
    insert = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    (tmp_path / "p.fasta").write_text(FASTA.format(**PRIMERS))
    (tmp_path / "s.txt").write_text("SampleID\tPrimerPool\tFwIndex\tFwPrimer\tRvIndex\tRvPrimer\n" + "".join(f"{s}\t{pool}\t{b1}\t{f}\t{b2}\tRZ\n" for s, (pool, b1, f, b2) in BARS.items()))
    reads, want, bodies = [], {}, {s: insert(200) for s in BARS}
    for n in range(24):
        s = ("S1", "S2", "S3")[n % 3]
        pool, b1, f, b2 = BARS[s]
        body = bodies[s][:-1] + "ACGT"[n % 4]
        head, tail = b1 + plain(PRIMERS[f], r), complement(plain(PRIMERS["RZ"], r)) + complement(b2)
        pair, place = f"{f}-RZ", f"full/{pool}/{f}-RZ/{s}"
        if n % 8 == 5:  # without the forward barcode
            head, place = insert(5) + head[len(b1) :], f"partial/{pool}/{pair}/barcode_rev_{b2}"
        elif n % 8 == 6:  # without barcodes
            head, tail, place = head[len(b1) :], tail[: -len(b2)], f"unknown/{pool}/{pair}/unknown"
        elif n % 8 == 7:  # without anything
            head, body, tail, place = "", "AC" * 100, "", "unknown/unknown/unknown-unknown/unknown"
        seq = head + body + tail
        reads.append((f"r{n}", seq, "".join(chr(35 + (n + i) % 40) for i in range(len(seq)))))
        want.setdefault(place, []).append(f"r{n}")
    for name, turn in (("a.fastq", False), ("b.fastq", True)):
        (tmp_path / name).write_text("".join(f"@{i} note\n{complement(s) if turn else s}\n+\n{q[::-1] if turn else q}\n" for i, s, q in reads))
    return tmp_path, want


def written(folder):
    return {str(p.relative_to(folder))[:-6]: sorted((x[0], x[2]) for x in records(str(p))) for p in folder.rglob("*.fastq")}


def test_files_of_both_strands(spark, files):
    d, want = files
    for name in ("a.fastq", "b.fastq"):
        out = d / f"out-{name[0]}"
        assert cli.main(["demux", str(d / "p.fasta"), str(d / "s.txt"), str(d / name), "-F", "-O", str(out), "-d", "3", "--sample-topq", "2"]) == 0
        got = written(out)
        pairs = {k: [i for i, _ in v] for k, v in got.items() if not k.startswith("subsample") and k.count("/") == 3}
        assert pairs == {k: sorted(v) for k, v in want.items()}
        assert got["full/Q/S1"] == got["full/Q/FB-RZ/S1"] and len(got["subsample/full/P/S3"]) == 2
        assert "reads matched" in (out / "log.txt").read_text()
        assert (out / "full/Q/primers.txt").read_text() == ">FB\nGTGARTCATCGARTCTTTG\n>RZ\nTCCTCCGCTTATTGATATGC\n"
    # What has primers is the same of both strands.
    a, b = ({k: v for k, v in written(d / f"out-{x}").items() if "unknown-unknown" not in k} for x in "ab")
    assert a == b


def test_numbers_of_reads_statistics_and_pages(spark, files, capsys):
    d, _ = files
    assert cli.main(["demux", str(d / "p.fasta"), str(d / "s.txt"), str(d / "a.fastq"), "-F", "-O", str(d / "o"), "-n", "3,5", "-d"]) == 0
    assert sorted(i for k, v in written(d / "o").items() if k.count("/") == 3 for i, _ in v) == [f"r{n}" for n in range(2, 7)]
    assert cli.main(["stats", str(d / "o/trace"), "--hierarchical", "outcome", "--count-by", "sequences"]) == 0
    assert "Total: 5" in capsys.readouterr().out
    assert cli.main(["stats", str(d / "o/trace"), "--list-dimensions"]) == 0 and "outcome_detailed" in capsys.readouterr().out
    assert cli.main(["stats", str(d / "o/trace"), "--sankey-data", "orientation", "outcome", "-o", str(d / "f.json")]) == 0
    assert json.loads((d / "f.json").read_text())["dimensions"] == ["orientation", "outcome"]
    assert cli.main(["draw", str(d / "f.json"), str(d / "f.html")]) == 0 and "<svg" in (d / "f.html").read_text()
    assert cli.main(["demux", str(d / "p.fasta"), str(d / "s.txt"), str(d / "a.fastq"), "-n", "2", "--color"]) == 0
    assert capsys.readouterr().out.count("\033[34m") == 0  # barcodes are trimmed
    assert cli.main(["demux", str(d / "p.fasta"), str(d / "none.txt"), str(d / "a.fastq")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_mined_files(spark, files):
    d, want = files
    out = d / "out"
    assert cli.main(["demux", str(d / "p.fasta"), str(d / "s.txt"), str(d / "a.fastq"), "-F", "-O", str(out), "--trim", "primers"]) == 0
    for path in ("full/P/S3.fastq", "full/P/FA-RZ/S3.fastq"):
        assert cli.main(["mine", "--index", str(d / "s.txt"), "--fastq", str(out / path)]) == 0
        rows = list(records(str(out / f"{path}.mined"), "fastq"))
        assert [r[0].split("_mined_")[0] for r in rows] == want[f"partial/P/FA-RZ/barcode_rev_{BARS['S3'][3]}"] and all("identity=" in r[1] for r in rows)
    assert mining.place_of_file(str(out / "full/P/S3.fastq"))[1:] == ("P", None)
    assert cli.main(["mine", "--index", str(d / "s.txt"), "--fastq", str(out / "unknown/S3.fastq")]) == 1
    assert cli.main(["mine", "--index", str(d / "s.txt"), "--fastq", str(out / "full/P/S9.fastq")]) == 1


def test_watch_command(spark, files):
    """A daemon's course: its log is a file, what was there is left out, the files of what arrives are written once."""
    import shutil
    import threading

    from ampliflow.streaming import watch

    d, want = files
    folder, out = d / "in", d / "out"
    folder.mkdir()
    shutil.copy(d / "b.fastq", folder / "before.fastq")
    threading.Timer(8, lambda: shutil.copy(d / "a.fastq", folder / "new.fastq")).start()
    argv = ["watch", str(d / "p.fasta"), str(d / "s.txt"), str(folder), "-F", "-O", str(out), "-d", "--settle-time", "0.5", "--daemon", "--state-file", str(d / "state"), "--stop-after", "1"]
    assert cli.main(argv) == 0
    got = {k: [i for i, _ in v] for k, v in written(out).items() if k.count("/") == 3}
    assert got == {k: sorted(v) for k, v in want.items()}
    log = (out / "log.txt").read_text()
    assert "new.fastq" in log and "reads matched" in log and "before.fastq" not in log
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in watch.status_table(spark, str(d / "state/status")).collect()}
    assert status == {"before.fastq": "ignored", "new.fastq": "success"}
    assert cli.main(["stats", str(out / "trace"), "--list-dimensions"]) == 0
