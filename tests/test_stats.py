"""Event pivot with selections, diagrams' checks and colours, one aggregation for nested counts."""

import pytest

from ampliflow.operators import events, stats


def trace(spark, rows):
    out = []
    for n, (sequence, kind, *fields) in enumerate(rows):
        out.append(("t", "w", n, sequence, kind, [str(f) for f in fields], "f"))
    return spark.createDataFrame(out, "timestamp string, worker_id string, event_seq long, sequence_id string, event_type string, fields array<string>, file string")


def test_selections_and_old_logs(spark):
    rows = [
        ("a", "ORIENTATION_DETECTED", "forward", 1, 0, "1.000"), ("a", "PRIMER_MATCHED", "a_0", "both", "F", "R", 0, 0, "P", "as_is"), ("a", "BARCODE_MATCHED", "a_0", "both", "B1", "B2", 0, 0, "F", "R"),
        ("a", "PRIMER_MATCHED", "a_1", "forward_only", "F", "none", 0, -1, "P", "as_is"), ("a", "MATCH_DISCARDED", "a_1", "F", "none", "none", "none", "1.000", "lower_score"),
        ("a", "MATCH_SELECTED", "unique", "F", "R", "B1", "B2", "P", "true"), ("a", "MATCH_SELECTED", "later", "F", "R", "B1", "B2", "P", "true"), ("a", "MATCH_SELECTED", "other", "F", "none", "none", "none", "P", "true"),
        ("a", "SPECIMEN_RESOLVED", "S", "dereplicated_full", "P", "F", "R", "B1", "B2"), ("b", "SEQUENCE_RECEIVED", 9, "b"), ("c", "PRIMER_MATCHED", "c_0", "both", "F", "R", 0, 0, "P", "as_is"), ("c", "SPECIMEN_RESOLVED", "x", "partial_forward", "P", "F", "R", "B1", "none"),
    ]
    for compat, outcome in ((False, "matched"), (True, "unknown")):
        got = {(r["sequence_id"], r["candidate_match_id"]): (r["outcome"], r["selection_strategy"], r["resolution_type"]) for r in events.pivoted(trace(spark, rows), compat).collect()}
        assert got == {
            ("a", "a_0"): (outcome, "unique", "none" if compat else "dereplicated_full"), ("a", "a_1"): ("discarded", "discarded", "none"), ("b", "none"): ("unknown", "none", "none"), ("c", "c_0"): ("partial", "none", "partial_forward"),
        }


def test_one_aggregation_for_nested_counts(spark):
    rows = spark.createDataFrame([(n, n % 7, "x" if n % 2 else None, n % 3) for n in range(60)], "candidate_match_id long, sequence_id long, a string, b long")
    out = stats.nested_counts(rows, ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Window [") + plan.count("Window(") <= 1 and plan.count("Scan") <= 1
    got = {(r["depth"], r["a"], r["b"]): (r["count"], r["percent"]) for r in out.collect()}
    assert got[0, None, None] == (60, 100) and got[1, None, None] == got[1, "x", None] == (30, 50)
    assert got[2, None, "0"] == got[2, "x", "1"] == (10, pytest.approx(100 / 3)) and len(got) == 9


def test_diagrams_are_checked(tmp_path):
    node = lambda n, layer, dimension, value: {"id": n, "label": str(value), "layer": layer, "dimension": dimension, "value": value}
    good = {"dimensions": ["pool", "outcome"], "nodes": [node(0, 0, "pool", "P"), node(1, 1, "outcome", "matched")], "links": [{"source": 0, "target": 1, "value": 3}]}
    stats.render_html(good, str(tmp_path / "a.html"))
    assert "#2a9d55" in (tmp_path / "a.html").read_text()
    bad = [
        {"nodes": [], "links": []}, good | {"nodes": [{"id": 0}]}, good | {"nodes": [node(1, 0, "pool", "P")]}, good | {"nodes": [node(0, 5, "pool", "P")]}, good | {"links": [{"source": 0, "value": 1}]},
        good | {"links": [{"source": 0, "target": 9, "value": 1}]}, good | {"links": [{"source": 1, "target": 0, "value": 1}]}, good | {"links": [{"source": 0, "target": 1, "value": -1}]},
    ]
    for data in bad:
        with pytest.raises(ValueError):
            stats.render_html(data, str(tmp_path / "b.html"))
    colour = lambda dimension, value, n=0: stats.colour(node(n, 0, dimension, value))
    assert colour("pool", "P") == colour("pool", "P", 7) != colour("pool", "Q") and colour("barcode_count", 2) == colour("outcome", "matched") and colour("pool", None) == colour("outcome", "none")
    assert colour("specimen_matched", "true") != colour("specimen_matched", "false") and colour("sequence_id", "x", 1) != colour("sequence_id", "x", 2)
