"""Mixing, sharding and line templates: odd rows, skew, and brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ampliflow.llm import line_templates, mixing, sharding

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DDL)


def words(n):
    return " ".join(["w"] * n)


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", None, "b", 3), (3, "z " * 5000, "en", "a", 1), (3, "z " * 5000, "en", "a", 1), (4, "q", None, None, None)]


def test_mix_comes_near_its_targets(spark):
    rows = [(n, words(1 + n * 7919 % 400), "en", "hot" if n % 3 else f"s{n % 5}", 0) for n in range(1500)]
    out = mixing.mix_sizes(docs_of(spark, rows))
    sources = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest")).collect()
    total = sum(s["source_size"] for s in sources)
    assert sum(s["target"] for s in sources) == pytest.approx(total)
    for s in sources:
        assert s["target"] <= 3 * s["source_size"] + 1e-6
        assert abs(s["taken"] - s["target"]) <= s["largest"]
    assert out.where("copies > 3 OR copies < 0").count() == 0
    again = mixing.mix_sizes(docs_of(spark, rows[::-1]).repartition(7))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    whole = mixing.mix(docs_of(spark, rows))
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert whole.count() == out.agg(F.sum("copies")).first()[0]


def test_mix_of_odd_rows(spark):
    out = mixing.mix_sizes(docs_of(spark, ODD)).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["size"] == by[1]["taken"] == 0 and by[3]["size"] == 5000
    assert len({r["copies"] for r in out if r["doc_id"] == 3}) == 1
    clash = docs_of(spark, ODD).withColumns({c: F.lit(9) for c in ("size", "target", "copies", "row", "bits", "e", "q", "b")})
    assert mixing.mix(clash).columns == clash.columns
    assert mixing.mix_sizes(docs_of(spark, [])).count() == mixing.mix(docs_of(spark, [])).count() == 0


def test_targets_share_what_is_over(spark):
    rows = [(1, words(10), "", "a", 0), (2, words(1000), "", "b", 0), (3, words(20), "", "c", 0), (4, words(500), "", None, 0)]
    got = {r["source_size"]: (r["weight"], r["target"]) for r in mixing.source_targets(docs_of(spark, rows).select("source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    # Weights 1, 2, 3 and again 1; a and c stop at three times their size, the rest goes 2 to 1.
    assert got == {10: (1, 30.0), 1000: (2, pytest.approx((1530 - 90) * 2 / 3)), 20: (3, 60.0), 500: (1, pytest.approx((1530 - 90) / 3))}


def brute_shards(keys, limit, prefix=""):
    inside = [k for k in keys if k[0].startswith(prefix)]
    if not inside:
        return {}
    if sum(b for _, b in inside) <= limit or len({k for k, _ in inside}) == 1:
        return {k: prefix for k, _ in inside}
    return brute_shards(inside, limit, prefix + "0") | brute_shards(inside, limit, prefix + "1")


def test_shards_keep_to_the_limit(spark):
    docs = docs_of(spark, [(n, words(1 + n * 31 % 60), "en", "s", 0) for n in range(400)])
    key = F.lpad(F.bin(sharding.key_bits(F.col("doc_id"), F.col("text"))), 48, "0")
    keys = {r[0]: (r[1], r[2]) for r in docs.select("doc_id", key, sharding.n_bytes(F.col("text"))).collect()}
    for limit in (200, 3000, 10**9):
        out = sharding.assign(docs, limit).collect()
        want = brute_shards(list(keys.values()), limit)
        assert {r["doc_id"]: r["shard"] for r in out} == {d: want[k] for d, (k, _) in keys.items()}
        assert all(r["shard_bytes"] <= limit and r["page"] == 0 and r["depth"] == len(r["shard"]) for r in out)


def test_shards_of_odd_rows(spark):
    out = sharding.assign(docs_of(spark, ODD + [(9, "abcd", "", "", 0)] * 10), 10)
    assert out.count() == len(ODD) + 10
    pages = sorted(r["page"] for r in out.where("doc_id = 9").collect())
    assert pages == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert sorted(r["page"] for r in out.where("doc_id = 3").collect()) == [0, 1]
    assert sharding.assign(docs_of(spark, []), 10).count() == 0


def test_lines_of_a_template_go(spark):
    rows = [(n, f"Only here {chr(97 + n)} {chr(98 + n)} {chr(99 + n)} {chr(100 + n)}\nUser {n} has logged in from host{n}\n\nEnd", "en", "s", 0) for n in range(4)]
    rows += [(10, "User 7 has\nnothing in common", "en", "s", 0), (11, None, "en", "s", 0), (12, "", "en", "s", 0), (None, "End", "en", "s", 0), (13, "x\ty\r\nx y", "en", "s", 0)]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_templates.drop_lines(docs_of(spark, rows)).collect()}
    assert out[0] == ("Only here a b c d\n", 4, 2)
    assert out[10] == ("User 7 has\nnothing in common", 2, 0)
    assert out[11] == (None, 0, 0) and out[12] == ("", 1, 0) and out[None] == ("", 1, 1) and out[13] == ("x\ty\r\nx y", 2, 0)
    assert line_templates.drop_lines(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("d", "h", "dropped", "n_lines", "line", "leaf")})
    assert line_templates.drop_lines(clash).count() == len(rows)


def test_fields_with_many_common_values_are_variable(spark):
    name = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(3))
    rows = [(n, f"Parcel for {name(n % 100)} {name(5000 + n * 7 % 97)} has left the depot today\nonly {name(n)} in {name(n * 31)} line {name(n * 17)}", "en", "s", 0) for n in range(600)]
    out = line_templates.drop_lines(docs_of(spark, rows)).agg(F.sum("n_dropped").alias("n"), F.min("n_dropped").alias("least")).first()
    assert (out["n"], out["least"]) == (600, 1)


def test_long_texts_take_linear_time(spark):
    """A text of many lines with a recurring one is split once, not once for each line."""
    import time

    took = {}
    for n in (2_000, 40_000):
        text = "\n".join(f"unlike line {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]} of {k} and its end" if k else "Copyright of the same house" for k in range(n))
        docs = docs_of(spark, [(d, text if d == 0 else "Copyright of the same house\nrest", "en", "a", 0) for d in range(12)])
        began = time.time()
        row = line_templates.drop_lines(docs).where("doc_id = 0").select("n_lines", "n_dropped", F.length("text")).first()
        took[n] = time.time() - began
        assert row["n_lines"] == n and row["n_dropped"] >= 1
    assert took[40_000] < took[2_000] + 30


def model_of_lines(texts):
    """The rule in plain Python: what stays of each text."""
    docs, children, same, leading = line_templates.MIN_DOCS, line_templates.CHILDREN, line_templates.SAME, line_templates.LEADING
    mask = lambda t: "<*>" if any("0" <= c <= "9" for c in t) else t
    tokens = lambda line: [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
    leaf = lambda ts: (len(ts), mask(ts[0]), mask(ts[1]) if len(ts) > 1 else "")
    rows_of, in_leaf = defaultdict(set), defaultdict(set)
    for n, text in enumerate(texts):
        for line in (text or "").split("\n") if text is not None else ():
            if ts := tokens(line):
                rows_of[line].add(n)
                in_leaf[leaf(ts)].add(n)
    lines = {line: rows for line, rows in rows_of.items() if len(in_leaf[leaf(tokens(line))]) >= docs}
    times, totals = defaultdict(int), defaultdict(int)
    for line, rows in lines.items():
        ts = tokens(line)
        totals[leaf(ts)] += len(rows)
        for k, t in enumerate(ts):
            times[leaf(ts), k, mask(t)] += len(rows)
    fixed = {key: n for key, n in times.items() if n >= docs and key[2] != "<*>"}
    many = Counter(key[:2] for key in fixed)
    templates = defaultdict(set)
    for line in lines:
        ts = tokens(line)
        keys = [(leaf(ts), k, mask(t)) for k, t in enumerate(ts)]
        one = [key[2] if key in fixed else "<*>" for key in keys]
        two = [key[2] if key in fixed and (many[key[:2]] <= children or fixed[key] * children >= totals[key[0]]) else "<*>" for key in keys]
        share = lambda x: sum(t != "<*>" for t in x) / len(x)
        if share(one) >= same:
            templates[line].add(" ".join(one))
        if one != two and two[leading:] and share(two[leading:]) >= same:
            templates[line].add(" ".join(two))
    holders = defaultdict(set)
    for line, own in templates.items():
        for t in own:
            holders[t] |= lines[line]
    gone = {line for line, own in templates.items() if any(len(holders[t]) >= docs for t in own)}
    return [None if text is None else "\n".join(x for x in text.split("\n") if x not in gone) for text in texts]


def test_lines_against_a_model(spark):
    r = random.Random(12)
    names, words_ = [f"name{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)], [f"word{chr(97 + k)}" for k in range(26)]
    shapes = [
        lambda: f"User {r.choice(names)} came from {r.choice(names[:60])} at last", lambda: f"Copyright {r.randint(1990, 2020)} by the house", lambda: "All rights reserved", lambda: f"item {r.randint(1, 9)} of {r.choice(words_)} here",
        lambda: " ".join(r.choice(words_) for _ in range(r.randint(1, 9))), lambda: f"one {r.choice(names)}", lambda: r.choice(["", " ", "\t", "x"]), lambda: f"Log {r.choice(words_[:3])} {r.choice(names)} {r.choice(names)} end of the line",
    ]
    texts = ["\n".join(r.choice(shapes)() for _ in range(r.choice([0, 1, 3, 8]))) for _ in range(700)] + [None, "", "All rights reserved"]
    docs = docs_of(spark, [(n, t, None, None, None) for n, t in enumerate(texts)]).repartition(4)
    got = [x["text"] for x in line_templates.drop_lines(docs).orderBy("doc_id").collect()]
    want = model_of_lines(texts)
    assert got == want and sum(a != b for a, b in zip(texts, want, strict=True)) > 300
