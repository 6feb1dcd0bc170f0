"""Nearest neighbours against brute force."""

from pathlib import Path

import numpy as np

from ampliflow.llm import neighbours
from ampliflow.llm.shared import shared_dir


def brute(rows, queries, k):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in queries:
        near = sorted((-round(float(x[i] @ x[j]), 10), rows[j][0]) for j in range(len(rows)) if j != i)[:k]
        out[rows[i][0]] = [v for _, v in near]
    return out


def test_recall_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(n, [float(v) for v in np.float32(centres[n % 12] + rng.normal(size=16) * 0.4)]) for n in range(600)]
    rows += [(n, rows[3][1]) for n in range(1000, 1100)]  # many copies of one vector
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0]), (None, [1.0] * 16)]
    schema = "vec_id long, embedding array<float>"
    vectors = spark.createDataFrame(rows + odd, schema)
    for members in (16_384, 100):
        got: dict = {}
        for r in neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), members=members, asked=8).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        want = brute(rows, [i for i, (n, _) in enumerate(rows) if n % 50 == 0], 5)
        assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
        assert got[1000] == want[1000] == [3, 1001, 1002, 1003, 1004] and got[1050] == want[1050]
        assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    few = spark.createDataFrame(rows[:3], schema)
    assert neighbours.nearest(few, few).count() == 6
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


def test_probes_come_in_order():
    inside = np.array([0.1, 0.45, 0.8])
    steps = neighbours.probe_steps(inside, 27)
    cost = [sum((inside[i] if s < 0 else 1 - inside[i]) ** 2 for i, s in enumerate(row) if s) for row in steps]
    assert cost == sorted(cost) and len({tuple(s) for s in steps}) == 27


def test_recall_holds_where_probes_are_capped():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.fit(x[:2000], x[:60], 2_000_000, 5)
    held = x[2000:2060]
    cosine = held @ x.T
    cosine[cosine > 1 - 1e-9] = -2
    near = np.argsort(-cosine, axis=1)[:, :5]
    cells, (own, inside) = index.cells(x)[0], index.cells(held)
    hit = np.zeros(near.shape, bool)
    for q in range(len(held)):
        for t in range(neighbours.TABLES):
            visited = neighbours.keys(own[q, t] + neighbours.probe_steps(inside[q, t], index.probes))
            hit[q] |= np.isin(neighbours.keys(cells[near[q], t]), visited)
    assert hit.mean() >= 0.9


def test_queries_in_sparse_regions_get_k_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(n, [float(v) for v in np.float32(np.eye(16)[0] + rng.normal(size=16) * 0.01)]) for n in range(400)]
    rows += [(1000 + n, [float(v) for v in -np.eye(16)[n + 1]]) for n in range(3)]  # far from all others
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id >= 1000 OR vec_id < 200")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, range(400, 403), 5)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 203
    assert {n: got[n] for n in want} == want


def test_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 6))
    scale = np.array([1e-320, 1e-200, 1.0, 1e200, 1e307])[np.arange(60) % 5]
    rows = [(n, [float(v) for v in x[n] * scale[n]]) for n in range(60)]
    vectors = spark.createDataFrame([*rows, (99, [0.0] * 6)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 10 = 0 OR vec_id % 5 = 3")).orderBy("query_id", "rank").collect():
        assert -1 - 1e-9 <= r["score"] <= 1 + 1e-9
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    # What denormal numbers keep of a direction.
    want = brute([(n, [a / max(map(abs, v)) for a in v]) for n, v in rows], range(60), 5)
    assert len(got) == 18 and np.mean([len(set(v) & set(want[q])) / 5 for q, v in got.items()]) >= 0.9


def test_little_more_than_the_input_is_written(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    vectors = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<float>")
    folder = Path(shared_dir(spark).removeprefix("file://"))
    there = set(folder.rglob("*.parquet"))
    assert neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), members=500).count() == 400
    assert sum(p.stat().st_size for p in set(folder.rglob("*.parquet")) - there) < 2 * x.nbytes


def test_probes_made_again_are_those_of_the_steps():
    rng = np.random.default_rng(9)
    cells, inside = rng.integers(-9, 9, (40, 7)), rng.uniform(size=(40, 7))
    for probes in (1, 5, 300, 3000):
        who, key = neighbours.probe_keys(cells, inside, neighbours.probe_costs(inside, probes))
        for i in range(40):
            want = neighbours.keys(cells[i] + neighbours.probe_steps(inside[i], probes))
            assert sorted(key[who == i].tolist()) == sorted(want.tolist())
