"""Demultiplexing from files to files, and its rules one by one."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ampliflow.functions.dna import complement
from ampliflow.operators import demux, events, outputs, stats
from ampliflow.sources import tables
from ampliflow.sources.sequences import detect_format, parse_range, read_sequences, records

F1, F2, R1 = "GATTACGGCTAAGCTTCA", "CCATGTAAGGCTTGACGT", "TGCAGGATCCTTAACGAG"
PRIMERS = f">F1 pool=A position=forward\n{F1}\n>F2 position=forward pool=B;C\n{F2}\n>R1 pool=A,B,C position=reverse\n{R1.lower()}\n"
SPECIMENS = "SampleID\tPrimerPool\tFwIndex\tFwPrimer\tRvIndex\tRvPrimer\tnote\nS1\tA\tACGTTGCAAC\tF1\tttgaccgatg\tR1\tx\nS2\tA\tACGTTGCAAC\tF1\tGGATCTAACC\tR1\t\nS3\tB\tCATGGTTCAG\t*\tAACCTTGGCA\t-\t\n"


@pytest.fixture
def design(tmp_path):
    (tmp_path / "p.fasta").write_text(PRIMERS)
    (tmp_path / "s.txt").write_text(SPECIMENS)
    return tables.load_design(str(tmp_path / "p.fasta"), str(tmp_path / "s.txt"))


def reads_of(spark, seqs):
    rows = [(n, f"r{n}", s, "".join(chr(40 + (n + i) % 30) for i in range(len(s)))) for n, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "read_id long, seq_id string, seq string, qual string")


def insert(seed, n=150):
    return "".join(random.Random(seed).choice("ACGT") for _ in range(n))


def whole(seed, b1="ACGTTGCAAC", f=F1, b2="TTGACCGATG"):
    return b1 + f + insert(seed) + complement(R1) + complement(b2)


def test_design(spark, design):
    assert [p.name for p in design.ordered] == ["F1", "R1", "F2"]
    assert design.pairs == [(0, 1, "A"), (2, 1, "B")]
    assert design.uses["S3"] == (["F2"], ["R1"])
    assert [p.pools for p in design.ordered] == [["A"], ["A", "B"], ["B"]]  # pool C has no specimen
    params = demux.Parameters.of(spark, design, demux.Options())
    assert params.primers == {"F1": 6, "F2": 6, "R1": 6}
    own = demux.Parameters.of(spark, design, demux.Options(index_distance=2, primer_distance=3))
    assert own.barcode == 2 and set(own.primers.values()) == {3}


@pytest.mark.parametrize(
    "primers, specimens, words",
    [
        (PRIMERS.replace("pool=A ", "", 1), SPECIMENS, "no pool"),
        (PRIMERS.replace("position=forward", "", 1), SPECIMENS, "no position"),
        (PRIMERS.replace("position=forward", "position=up", 1), SPECIMENS, "not forward"),
        (PRIMERS.replace("F2", "F1"), SPECIMENS, "two primers"),
        (PRIMERS.replace("pool=A,B,C", "pool=B,C"), SPECIMENS, "no reverse primer"),
        (PRIMERS, SPECIMENS.replace("FwIndex", "Index"), "no column"),
        (PRIMERS, SPECIMENS.replace("S2", "S1"), "two specimens"),
        (PRIMERS, SPECIMENS.replace("GGATCTAACC", ""), "empty barcode"),
        (PRIMERS, SPECIMENS.split("\n")[0], "no specimens"),
        (PRIMERS, SPECIMENS.replace("\tF1\t", "\tF9\t"), "no primer"),
        (PRIMERS, SPECIMENS.replace("\tF1\t", "\tR1\t"), "reverse primer"),
        (PRIMERS, SPECIMENS.replace("\tF1\t", "\tF2\t"), "isn't in pool"),
    ],
)
def test_bad_tables(tmp_path, primers, specimens, words):
    (tmp_path / "p.fasta").write_text(primers)
    (tmp_path / "s.txt").write_text(specimens)
    with pytest.raises(ValueError, match=words):
        tables.load_design(str(tmp_path / "p.fasta"), str(tmp_path / "s.txt"))


def test_course_of_reads(spark, design, tmp_path):
    seqs = [
        whole(1), complement(whole(2)), whole(3, b2="GGATCTAACC"), whole(4, "CATGGTTCAG", F2, "AACCTTGGCA"), "ACGTTGCAAC" + F1 + insert(5), insert(6) + complement(R1) + complement("AACCTTGGCA"),
        "T" * 120, whole(7, b2="AACCTTGGCA"), whole(8)[:30], "", "acgt" * 30,
    ]
    reads = reads_of(spark, seqs)
    run = demux.demultiplex(reads, design)
    by_read = {}
    for f in run.facts.collect():
        by_read.setdefault(f["read_id"], []).append(f)
    one = {k: v[0] for k, v in by_read.items() if len(v) == 1}
    assert [one[n]["sample"] for n in (0, 1, 2, 3)] == ["S1", "S1", "S2", "S3"]
    assert all(one[n]["resolution"] == "dereplicated_full" and one[n]["distance_code"] == "0,0,0,0" for n in range(4))
    assert one[0]["seq"] == seqs[0][10:-10] and one[1]["seq"] == whole(2)[10:-10]
    assert one[4]["path"] == "partial/A/F1-unknown/barcode_fwd_ACGTTGCAAC" and one[4]["distance_code"] == "0,0,X,X"
    assert one[5]["sample"] == "barcode_rev_AACCTTGGCA" and one[5]["pool"] == "A"  # the first of tied candidates
    assert one[6]["path"] == one[9]["path"] == one[10]["path"] == "unknown/unknown/unknown-unknown/unknown"
    assert one[7]["path"] == "unknown/A/F1-R1/unknown"
    total = run.totals().first()
    assert (total["total"], total["matched"]) == (11, 4)

    # Both strands of every read give the same records.
    back = demux.demultiplex(reads_of(spark, [complement(s) for s in seqs]), design)
    known = lambda r: sorted((f["read_id"], f["path"], f["seq"], f["distance_code"]) for f in r.facts.where("distance_code <> 'X,X,X,X'").collect())
    assert known(run) == known(back)

    n = outputs.write_files(run.facts, str(tmp_path / "out"))
    outputs.write_sidecars(design, str(tmp_path / "out"))
    full = tmp_path / "out/full/A"
    assert n == len({f["path"] for v in by_read.values() for f in v}) + 3
    assert [r[0] for r in records(str(full / "F1-R1/S1.fastq"))] == ["r0", "r1"] == [r[0] for r in records(str(full / "S1.fastq"))]
    assert (full / "F1-R1/S1.fastq").read_text().startswith("@r0 0,0,0,0 pool=A primers=F1+R1 S1\n")
    assert (full / "primers.txt").read_text() == f">F1\n{F1}\n>R1\n{R1}\n"
    assert outputs.write_subsample(run.facts, design, str(tmp_path / "out"), 1) == 6
    assert len(list(records(str(tmp_path / "out/subsample/full/A/S1.fastq")))) == 1
    outputs.write_lake(run.facts, str(tmp_path / "lake"))
    assert spark.read.parquet(str(tmp_path / "lake")).where("match_type = 'partial'").count() == 3  # reads 4, 5, and 8, which ends within the target
    assert sum(1 for _ in outputs.console(run)) == sum(map(len, by_read.values()))
    painted = next(t for t in outputs.console(run, colour=True) if t.startswith("@r0 "))
    assert f"\033[32m{F1}" in "".join(c.upper() if c in "acgt" else c for c in painted)
    # Written again, each file holds its records twice.
    outputs.write_files(run.facts, str(tmp_path / "out"))
    assert [r[0] for r in records(str(full / "S1.fastq"))] == ["r0", "r1", "r0", "r1"]


def test_one_search_for_all_queries(spark, design, tmp_path):
    run = demux.demultiplex(reads_of(spark, [whole(1), whole(2)[:40]]), design)
    for rows in (run.hits, run.candidates, run.best, run.chosen, run.facts):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    for rows, searches in ((outputs.rolled_up(run.facts), 1), (outputs.top_quality(run.facts, 3), 1)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("[find(") == searches
    assert plan.count("WindowGroupLimit") >= 2 and plan.index("Exchange") < plan.rindex("WindowGroupLimit")  # the best of a task before the shuffle
    assert events.run_events(run, level=3)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_trace_and_statistics(spark, design, tmp_path):
    seqs = [whole(1), whole(3, b2="GGATCTAACC"), "ACGTTGCAAC" + F1 + insert(5), "T" * 120, whole(7, b2="AACCTTGGCA"), whole(8)[:30], "A"]
    run = demux.demultiplex(reads_of(spark, seqs), design, demux.Options(min_length=2))
    n_facts = run.facts.count()

    # The trace, written and read back.
    events.write_trace(events.run_events(run, level=3), str(tmp_path / "trace"))
    trace = events.read_trace(spark, str(tmp_path / "trace"))
    counts = {r["event_type"]: r["n"] for r in events.event_counts(trace).collect()}
    assert counts["SEQUENCE_RECEIVED"] == 7 and counts["SEQUENCE_FILTERED"] == 1 and counts["NO_MATCH_FOUND"] == 1 and counts["SEQUENCE_OUTPUT"] == n_facts
    assert counts["ORIENTATION_DETECTED"] == 6 and counts["DEREPLICATE_SELECTED"] == 2 and counts["SPECIMEN_RESOLVED"] == n_facts - 1
    assert counts["PRIMER_MATCHED"] == counts["BARCODE_MATCHED"] == counts["MATCH_SCORED"] == run.candidates.count()
    assert counts["MATCH_DISCARDED"] == run.candidates.count() - run.best.count()
    hits = run.hits.select(F.explode("hits").alias("h"))
    assert counts["PRIMER_SEARCH"] == hits.count() + 6 * 2 * 3  # and what was tried: three primers on two strands
    found = trace.where("event_type = 'BARCODE_SEARCH' AND fields[5] = 'true'").count()
    assert found == hits.select(F.explode("h.bcs")).count() and counts["BARCODE_SEARCH"] > found
    cands = events.with_dimensions(events.pivoted(trace))
    assert {r["outcome"] for r in cands.where("sequence_id LIKE '%00000000%'").collect()} == {"matched", "discarded"}
    text = stats.report(cands, ["orientation", "outcome"])
    assert text.startswith("Dimensions: orientation → outcome\nCount by: candidate_matches\nTotal: ")
    data = stats.sankey(cands, ["orientation", "match_type", "outcome"], "sequences")
    assert data["total_count"] == 7 and sum(x["value"] for x in data["links"] if data["nodes"][x["source"]]["layer"] == 0) == 7
    stats.render_html(data, str(tmp_path / "d.html"))
    assert "<svg" in (tmp_path / "d.html").read_text()
    with pytest.raises(ValueError):
        stats.counted(cands, ["nothing"])
    with pytest.raises(ValueError):
        stats.counted(cands, ["pool"], "reads")


def test_trims_filters_and_strategies(spark, design):
    seq = whole(1)
    reads = reads_of(spark, [seq, seq[:10] + F1 + complement(R1) + seq[-10:], "A" * 5])
    cut = {}
    for trim in demux.TRIMS:
        cut[trim] = {f["read_id"]: f for f in demux.demultiplex(reads, design, demux.Options(trim=trim, min_length=10)).facts.collect()}
        assert set(cut[trim]) == {0, 1}  # the short one is dropped
    assert cut["none"][0]["seq"] == seq and cut["tails"][0]["seq"] == seq
    assert cut["barcodes"][0]["seq"] == seq[10:-10] and cut["primers"][0]["seq"] == seq[28:-28]
    assert len(cut["barcodes"][0]["qual"]) == len(seq) - 20
    empty = cut["primers"][1]
    assert empty["trim_empty"] and empty["path"] == "unknown/unknown/unknown-unknown/unknown" and len(empty["seq"]) == 56
    rows = demux.demultiplex(reads, design, demux.Options(dereplicate="none", preorient=False, max_length=1000)).facts.where("read_id = 0").collect()
    assert [(f["sample"], f["resolution"]) for f in rows] == [("S1", "full_match")]


def test_sources(spark, tmp_path):
    import gzip

    (tmp_path / "a.fastq").write_text("@r1 one\nACGT\n+\n@III\n@r2\nGG\n+r2\nI@\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@z\nA\n+\nI\n")
    (tmp_path / "c.fa").write_text(">x first\nAC\nGT\n>y\n\n")
    (tmp_path / "d").write_text("@q\nA\n+\nI\n")
    rows = read_sequences(spark, str(tmp_path)).orderBy("source_file", "read_num").collect()
    assert [(r["seq_id"], r["description"], r["seq"], r["qual"]) for r in rows] == [("r1", "one", "ACGT", "@III"), ("r2", "", "GG", "I@"), ("z", "", "A", "I"), ("x", "first", "ACGT", None), ("y", "", "", None), ("q", "", "A", "I")]
    assert [detect_format(n) for n in ("X.FASTQ.gz", "x.fna.bz2", str(tmp_path / "d"), "nowhere")] == ["fastq", "fasta", "fastq", "fasta"]
    assert read_sequences(spark, str(tmp_path / "a.fastq"), 2, 5).count() == 1
    assert (parse_range("-1"), parse_range("7"), parse_range("3,4")) == ((None, None), (None, 7), (3, 4))
    (tmp_path / "bad.fastq").write_text("@r\nAC\n+\nI\n")
    with pytest.raises(ValueError):
        list(records(str(tmp_path / "bad.fastq")))


def test_first_of_equal_mined_reads(spark):
    from ampliflow.operators import mining

    partials = spark.createDataFrame([("k", 1, "p1", "d", "TTACGTACGTTT", "", "reverse"), ("k", 2, "p2", "d", "GGGG", "", "reverse"), ("j", 3, "p3", "d", "ACGTACGT", "", "reverse")], "key string, read_id long, seq_id string, description string, seq string, qual string, side string")
    fulls = spark.createDataFrame([("k", 9, "ACGTACGA"), ("k", 8, "ACGTACGT"), ("k", 7, "ACGTACGT")], "key string, read_id long, seq string")
    rows = mining.mine(partials, fulls).collect()
    assert [(r["read_id"], r["full_id"], r["seq_id"]) for r in rows] == [(1, 7, "p1_mined_reverse_1.00")]


def test_conversion(spark, tmp_path):
    from ampliflow.operators import convert

    (tmp_path / "old.txt").write_text("SampleID\tFwIndex\tFwPrimer\tRvIndex\tRvPrimer\ns2\tAA\tGGT\tCC\t*\ns1\tAC\tACT\tCC\tTTT\n")
    convert.convert(spark, str(tmp_path / "old.txt"), str(tmp_path / "new.txt"), str(tmp_path / "p.fasta"))
    assert (tmp_path / "new.txt").read_text() == "SampleID\tPrimerPool\tFwIndex\tFwPrimer\tRvIndex\tRvPrimer\ns2\tpool1\tAA\tprimer_F2\tCC\t*\ns1\tpool1\tAC\tprimer_F1\tCC\tprimer_R1\n"
    assert (tmp_path / "p.fasta").read_text().startswith(">primer_F1 position=forward pool=pool1\nACT\n")


def test_watch(spark, tmp_path):
    from ampliflow.streaming import watch

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "old.fastq").write_text("@o\nA\n+\nI\n")
    seen = []
    query = watch.watch(spark, str(folder), lambda reads, path, batch: seen.append((path, reads.count())), str(tmp_path / "c"), str(tmp_path / "s"), settle_time=0.5, stop_after=1)
    (folder / "bad.fastq").write_text("@o\nAC\n+\nI\n")
    (folder / "new.fastq").write_text("@n\nA\n+\nI\n@m\nC\n+\nI\n")
    (folder / "other.txt").write_text("x")
    query.awaitTermination(120)
    assert [(p.rsplit("/", 1)[1], n) for p, n in seen] == [("new.fastq", 2)]
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in watch.status_table(spark, str(tmp_path / "s")).collect()}
    assert status == {"old.fastq": "ignored", "bad.fastq": "failed", "new.fastq": "success"}


def test_a_sheet_of_many_specimens(spark):
    """Tens of thousands of barcodes of one primer: the design, and the specimens of what is found."""
    r = random.Random(13)
    bars = ["".join(r.choice("ACGT") for _ in range(12)) for _ in range(60_000)]
    begin = time.monotonic()
    d = tables.Design([tables.Primer(0, "F1", F1, "forward", ["A"]), tables.Primer(1, "R1", R1, "reverse", ["A"])], [tables.Specimen(n, f"S{n}", "A", bars[2 * n], "F1", bars[2 * n + 1], "R1") for n in range(30_000)])
    assert time.monotonic() - begin < 5 and len(d.barcodes["F1"]) == len(set(bars[::2]))
    picked = [0, 1, 17, 29_999]
    run = demux.demultiplex(reads_of(spark, [whole(n, bars[2 * n], F1, bars[2 * n + 1]) for n in picked]), d, demux.Options(index_distance=0))
    assert [x["sample"] for x in run.facts.orderBy("read_id").collect()] == [f"S{n}" for n in picked]


def test_only_the_ends_of_reads_are_searched(spark, design):
    run = demux.demultiplex(reads_of(spark, [whole(1), "A" * 200_000, "", "ACGT"]), design)
    plan = run.hits._jdf.queryExecution().optimizedPlan().toString()
    assert "find(" in plan and "find(seq" not in plan
    assert [len(x["hits"]) for x in run.hits.orderBy("read_id").collect()] == [2, 0, 0, 0]


def table_of(specimens):
    rows = [dict(zip(("spec_ord", "specimen_id", "pool", "b1", "fw_primer", "b2", "rv_primer"), s.row, strict=True)) for s in specimens]
    return pa.Table.from_pylist(rows)


def test_a_table_of_specimens_is_a_design(spark):
    """Pools, wildcards, equal keys, codes in barcodes and lengths, against a design of objects; and nearest barcodes against all."""
    r = random.Random(21)
    primers = lambda: [tables.Primer(0, "F1", F1, "forward", ["A", "B"]), tables.Primer(1, "F2", F2, "forward", ["B"]), tables.Primer(2, "R1", R1, "reverse", ["A", "B"])]
    bars = ["".join(r.choice("ACGT") for _ in range(r.choice([9, 10, 10]))) for _ in range(60)] + ["ACGTRACCTG", "ACGTAACCTG", "ACGTGACCTG"]
    specimens = []
    for n in range(150):
        pool = r.choice("AB")
        specimens.append(tables.Specimen(n, f"S{n}", pool, r.choice(bars), "F1" if pool == "A" else r.choice(["F1", "F2", "*"]), r.choice(bars), r.choice(["R1", "-"])))
    specimens.append(tables.Specimen(150, "S150", *specimens[3].row[2:]))  # the same key once more
    plain, sheet = tables.Design(primers(), specimens), tables.SheetDesign(primers(), table_of(specimens))
    assert [p.name for p in plain.ordered] == [p.name for p in sheet.ordered] and plain.pairs == sheet.pairs and plain.barcode_length == sheet.barcode_length
    assert {k: sorted(v) for k, v in plain.barcodes.items()} == {k: sorted(v.to_pylist()) for k, v in sheet.barcodes.items()}
    seqs = []
    for n in range(120):
        s = r.choice(specimens)
        wrong = lambda b: b[: (i := r.randrange(len(b)))] + r.choice(["", "A", b[i]]) + b[i + 1 :]
        seqs.append(whole(n, wrong(s.b1), r.choice([F1, F2]), wrong(s.b2)))
        seqs[-1] = complement(seqs[-1]) if n % 2 else seqs[-1]
    columns = ["read_id", "cand_ord", "sample", "resolution", "pool", "path", "seq", "distance_code"]
    rows = lambda d, **o: sorted(map(tuple, demux.demultiplex(reads_of(spark, seqs), d, demux.Options(index_distance=2, **o)).facts.select(*columns).collect()))
    want = rows(plain)
    keys = {}
    for s in specimens:
        for f in plain.uses[s.specimen_id][0]:
            keys.setdefault((f, s.b1, s.b2), s.specimen_id)
    assert want == rows(sheet) == rows(sheet, nearest=True) == rows(plain, nearest=True)
    full = {x[2] for x in want if x[3] == "dereplicated_full"}
    assert len(full) > 20 and full <= set(keys.values()) and "S150" not in full
    with pytest.raises(ValueError, match="tails"):
        demux.Options(nearest=True, trim="tails")


def test_a_specimen_takes_some_bytes():
    """What the driver holds and sends of a large sheet: numbers and letters, no objects."""
    r, n = random.Random(22), 40_000
    bars = ["".join(r.choice("ACGT") for _ in range(12)) for _ in range(2 * n)]
    own = lambda x: pa.array([x] * n).dictionary_encode()
    table = pa.table({"spec_ord": range(n), "specimen_id": [f"S{i}" for i in range(n)], "pool": own("A"), "b1": bars[:n], "fw_primer": own("F1"), "b2": bars[n:], "rv_primer": own("R1")})
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    d = tables.SheetDesign([tables.Primer(0, "F1", F1, "forward", ["A"]), tables.Primer(1, "R1", R1, "reverse", ["A"])], table)
    sent = cloudpickle.dumps(demux._Sheet(d))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sent) < 200 * n and peak < 1000 * n and pa.total_allocated_bytes() - before < 200 * n
