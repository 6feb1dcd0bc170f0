"""Mining against all pairs: the nearest full read, few candidates, hot keys, odd reads."""

import random

import pytest

from ampliflow.operators import mining


def mutated(r, seq, share):
    return "".join("" if (x := r.random()) < share / 3 else c + r.choice("ACGT") if x < 2 * share / 3 else r.choice("ACGT") if x < share else c for c in seq)


def reads(seed, n_fulls, n_partials):
    r = random.Random(seed)
    kinds = ["".join(r.choice("ACGT") for _ in range(r.choice([60, 130, 300]))) for _ in range(6)]
    fulls = [mutated(r, r.choice(kinds), 0.02) for _ in range(n_fulls)]
    fulls += [fulls[0], fulls[0], "", "ACG"]
    partials = [r.choice(["", "ACGTACGTAC"]) + mutated(r, r.choice(kinds), r.choice([0, 0.02, 0.05, 0.12, 0.2])) + r.choice(["", "TTGACA"]) for _ in range(n_partials)]
    return fulls, [*partials, None, "", "ACG", "".join(r.choice("ACGT") for _ in range(200)), fulls[0]]


def brute(fulls, partials, least):
    own = [(n, f.encode()) for n, f in enumerate(fulls) if f]
    texts = [(p or "").encode() for p in partials]
    pairs = [(k, t) for k in range(len(own)) for t in range(len(texts))]
    distance = dict(zip(pairs, mining.infix_distances([f for _, f in own], texts, pairs), strict=True))
    out = {}
    for t, p in enumerate(partials):
        for k, (n, f) in enumerate(own):
            identity = 1 - distance[k, t] / len(f)
            if p is not None and identity >= least and (t not in out or identity > out[t][0]):
                out[t] = (identity, n)
    return out


@pytest.mark.parametrize("least", [0.6, 0.85, 0.95])
def test_nearest_equals_all_pairs(least):
    for seed in range(3):
        fulls, partials = reads(seed, 25, 40)
        first = {f: n for n, f in reversed(list(enumerate(fulls))) if f}
        patterns, ranks = [f.encode() for f in first], list(first.values())
        found = mining.nearest([p if p is None else p.encode() for p in partials], patterns, ranks, least)
        got = {t: (b[0], ranks[b[1]]) for t, (b, _) in enumerate(found) if b}
        assert got == brute(fulls, partials, least)


def test_candidates_are_few():
    fulls, partials = reads(5, 60, 60)
    patterns = [f.encode() for f in dict.fromkeys(fulls) if len(f) > 3]
    found = mining.nearest([p.encode() for p in partials if p and len(p) > 50], patterns, list(range(len(patterns))), 0.9)
    alike = [n for b, n in found if b and b[0] >= 0.97]
    assert len(alike) > 10 and max(alike) <= 0.6 * len(patterns)  # reads of one kind, not all


def test_hot_key_in_blocks(spark):
    fulls, partials = reads(9, 40, 50)
    left = spark.createDataFrame([("hot", n, "forward", p) for n, p in enumerate(partials)] + [("lone", 0, "forward", "ACGT")], "key string, read_id long, side string, seq string")
    right = spark.createDataFrame([("hot", n, f) for n, f in enumerate(fulls)] + [("other", 0, "ACGT")], "key string, read_id long, seq string")
    for blocks in ((1000, 1000), (7, 6)):
        rows = mining.nearest_fulls(left, right, 0.85, *blocks).collect()
        assert {r["read_id"]: (r["identity"], r["full_id"]) for r in rows} == brute(fulls, partials, 0.85)
        assert all(r["key"] == "hot" and 1 <= r["candidates"] <= len(fulls) for r in rows)
    assert mining.nearest_fulls(left.limit(0), right, 0.85).collect() == []
