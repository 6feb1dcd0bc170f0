"""Registered queries that have no SQL, against plain Python on small tables."""

from collections import Counter

from ampliflow.plans import queries

LETTERS = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTTGCAACTGGTCAACGTCATGGC")


def infix(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_mined_partials(spark, tmp_path):
    words = ["river", "stone", "quiet", "mills", "water", "amber", "north", "field"]
    items = [(n, " ".join(words[(n * k + k * k) % 8] for k in range(1, 10 + n % 5))) for n in range(14)] + [(14, "the same"), (18, "the same"), (15, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seqs = {n: "".join(c for c in t.lower() if c.isalpha()).translate(LETTERS) for n, t in items}
    want = {}
    for n, s in seqs.items():
        text = "ACGTAC" + "".join(c.translate(str.maketrans("ACGT", "CGTA")) if i % 17 == 0 else c for i, c in enumerate(s, 1))
        best = None
        for m, full in sorted(seqs.items()):
            if m % 4 == n % 4 and full:
                d = infix(full, text)
                if d <= int(len(full) * (1 - 0.85)) and 1 - d / len(full) >= 0.85 and (best is None or 1 - d / len(full) > best[0]):
                    best = (1 - d / len(full), m)
        if best:
            want[n] = (n % 4, best[1], round(best[0], 6), f"item{n}_mined_forward_{best[0]:.2f}")
    got = {r["read_id"]: (r["key"], r["full_id"], r["identity"], r["seq_id"]) for r in queries.mined_partials(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 10


def test_trace_pivot(spark, tmp_path):
    rows = [(n, "a b c lorem ipsum " * (1 + n % 7)) for n in range(64)] + [(64, None), (65, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = queries._run(spark, str(tmp_path))
    chosen = {}
    for r in run.outcomes.select("read_id", "nth", "resolution").collect():
        if not r["nth"]:
            chosen[r["read_id"]] = r["resolution"]
    want: Counter = Counter()
    for r in run.hits.select("read_id", "orientation", "cands").collect():
        top = max((c["score"] for c in r["cands"]), default=0)
        for c in r["cands"]:
            b1, b2 = bool(c["b1"]), bool(c["b2"])
            p1, p2 = c["p1"] is not None, c["p2"] is not None
            side = lambda x, y: "both" if x and y else "forward_only" if x else "reverse_only" if y else "none"
            done = {"dereplicated_full": "matched", "partial_forward": "partial_forward", "partial_reverse": "partial_reverse"}.get(chosen[r["read_id"]], "unknown")
            assert p1 or p2
            want[r["orientation"], side(b1, b2), "discarded_lower_score" if c["score"] < top else done, b1 + b2] += 1
        if not r["cands"]:
            want[r["orientation"], "none", "unknown", 0] += 1
    got = {(r["orientation"], r["match_type"], r["outcome_detailed"], r["barcode_count"]): r["n"] for r in queries.trace_pivot(spark, str(tmp_path)).collect()}
    assert got == want and sum(n for (_, _, o, _), n in got.items() if o == "matched") > 10
