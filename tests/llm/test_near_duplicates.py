"""Near duplicates against brute force."""

import random

from ampliflow.llm import near_duplicates as nd


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 100 >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": nd.F.lit(1), "class": nd.F.lit("x"), "label": nd.F.lit(2)})
    out = nd.components(docs, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


def test_edits_of_a_few_texts(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(6):
        words = [r.choice(vocabulary) for _ in range(r.choice([4, 30, 90, 200]))]
        for _ in range(30):
            own = [r.choice(vocabulary) if r.random() < r.choice([0, 0.02, 0.06, 0.15]) else w for w in words]
            rows.append((len(rows), " ".join(own)))
    r.shuffle(rows)
    for width in (2, 5):
        assert got(spark, rows, width=width, block=8) == brute(rows, width, 80)


def test_odd_rows(spark):
    rows = [(7, None), (8, ""), (9, " \n\t"), (None, "a b c d e f"), (3, "A B\tC d e f"), (3, "A B\tC d e f"), (3, "other"), (5, "other"), (None, "alone here"), (11, "x" * 100_000), (12, "y " * 30_000)]
    assert got(spark, rows, width=5) == brute(rows, 5, 80)
    assert got(spark, [], width=5) == []
