"""The search kernel and the mining distance against plain dynamic programming."""

import random
import timeit
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from ampliflow.functions.dna import IUPAC, complement, mean_quality
from ampliflow.operators import align, mining
from ampliflow.sources import tables


def same(a, b):
    return a == b or b in IUPAC.get(a, "") or a in IUPAC.get(b, "")


def by_end(pattern, text, prefix, equal=same):
    best = {}
    for start in [0] if prefix else range(len(text)):
        row = list(range(len(pattern) + 1))
        for end in range(start, len(text)):
            new = [row[0] + 1]
            for i, p in enumerate(pattern):
                new.append(min(row[i] + (not equal(p, text[end])), row[i + 1] + 1, new[i] + 1))
            row = new
            if end not in best or row[-1] < best[end][0]:
                best[end] = (row[-1], start)
    return best


def test_search_equals_dynamic_programming():
    r = random.Random(2)
    for _ in range(400):
        pattern = "".join(r.choice("ACGTRN") for _ in range(r.randint(2, 9)))
        texts = ["".join(r.choice("ACGTN") for _ in range(r.randint(1, 20))) for _ in range(3)]
        bound, prefix = r.randint(0, 3), r.random() < 0.5
        rows, size = align.packed([t.encode() for t in texts])
        distance, places = align.search(rows, size, pattern, bound, prefix)
        for text, d, own in zip(texts, distance, places):
            best = by_end(pattern, text, prefix)
            least = min(v[0] for v in best.values())
            want = [(s, e) for e, (v, s) in sorted(best.items()) if v == least] if least <= bound else []
            assert (d, own) == (least if least <= bound else -1, want)


def test_patterns_of_any_length():
    r = random.Random(7)
    for n in (63, 64, 65, 100, 128, 129, 200):
        pattern = "".join(r.choice("ACGTRYN") for _ in range(n))
        plain = "".join(c if c in "ACGT" else r.choice(IUPAC[c]) for c in pattern)
        edits = lambda: "".join("" if r.random() < 0.03 else c + r.choice("ACGT") if r.random() < 0.03 else r.choice("ACGT") if r.random() < 0.04 else c for c in plain)
        texts = [edits(), "ACGT" * 9 + edits() + "TTGA" * 5, plain, "".join(r.choice("ACGT") for _ in range(40)), edits()[: n // 2]]
        rows, size = align.packed([t.encode() for t in texts])
        for prefix in (False, True):
            distance, places = align.search(rows, size, pattern, n // 5, prefix)
            for text, d, own in zip(texts, distance, places):
                row, ends = list(range(n + 1)), []  # of a column: least edits of each beginning of the pattern
                for c in text:
                    new = [row[0] + 1 if prefix else 0]
                    for i, p in enumerate(pattern):
                        new.append(min(row[i] + (not same(p, c)), row[i + 1] + 1, new[i] + 1))
                    row = new
                    ends.append(row[-1])
                least = min(ends)
                assert (d, [e for _, e in own]) == ((least, [k for k, v in enumerate(ends) if v == least]) if least <= n // 5 else (-1, []))
    # Rows that each have a pattern of their own.
    patterns = ["".join(r.choice("ACGT") for _ in range(n)) for n in (3, 70, 64, 150)]
    texts = [p[:-1] + "A" + "CG" * 30 for p in patterns]
    words = max(align.equalities(p).shape[1] for p in patterns)
    equal = np.stack([np.pad(e, ((0, 0), (0, words - e.shape[1]))) for e in map(align.equalities, patterns)])
    rows, size = align.packed([t.encode() for t in texts])
    scores = align.end_scores(rows, size, equal, np.array([len(p) for p in patterns]), False, np.arange(4))
    for k, p in enumerate(patterns):
        one = align.end_scores(rows[k : k + 1], size[k : k + 1], align.equalities(p), len(p), False)
        assert (scores[k] == one[0]).all()


def test_a_trie_finds_what_a_loop_finds():
    r = random.Random(6)
    for turn in range(150):
        letters, n = r.choice(["ACGT", "AC", "ACGTRYN"]), r.choice([1, 3, 20, 60])
        patterns = ["".join(r.choice(letters) for _ in range(r.randint(1, 12) if turn % 2 else 9)) for _ in range(n)]
        texts = ["".join(r.choice("ACGTN") for _ in range(r.randint(0, 14))) for _ in range(6)]
        texts += [(p[1:] if r.random() < 0.5 else p.replace("R", "A")) + r.choice(["", "A", "GT"]) for p in patterns[:5]]
        rows, size = align.packed([t.encode() for t in texts])
        bound = r.randint(0, 4)
        trie = align.Trie(patterns)
        row, pattern, least, ends = trie.search(rows, size, bound, cells=r.choice([1, 100, 1 << 20]))
        found = {(int(i), trie.patterns[p]): (int(d), e) for i, p, d, e in zip(row, pattern, least, ends, strict=True)}
        want = {}
        for p in set(patterns):
            distance, places = align.search(rows, size, p, bound, prefix=True)
            want |= {(i, p): (int(d), [e for _, e in places[i]]) for i, d in enumerate(distance) if d >= 0}
        assert found == want and [(i, p) for i, p in zip(row.tolist(), pattern.tolist(), strict=True)] == sorted(zip(row.tolist(), pattern.tolist(), strict=True))
    assert align.Trie([]).search(*align.packed([b"ACGT"]), 2)[3] == []


def test_a_trie_reads_less_than_a_loop():
    """Of four times the barcodes the trie has fewer than four times the states: they share beginnings, and few get to their ends."""
    r = random.Random(8)
    barcodes = ["".join(r.choice("ACGT") for _ in range(13)) for _ in range(800)]
    rows, size = align.packed(["".join(r.choice("ACGT") for _ in range(16)).encode() for _ in range(200)])
    took = {}
    for n in (200, 800):
        trie = align.Trie(barcodes[:n])
        took[n] = min(timeit.repeat(lambda t=trie: t.search(rows, size, 3), number=1, repeat=3))
    loop = min(timeit.repeat(lambda: [align.search(rows, size, b, 3, prefix=True) for b in barcodes], number=1, repeat=1))
    assert took[800] < loop / 2 and took[800] < 4 * took[200]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        new = [i]
        for j, t in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return row[-1]


def test_counts_of_distances():
    r = random.Random(9)
    for longest in (3, 12, 16, 17, 33, 64, 65, 140):
        letters = r.choice(["ACGT", "AC", "ACGTRYé"])
        word = lambda n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
        own, others = [word(longest) for _ in range(12)], [word(r.choice([3, longest])) for _ in range(15)]
        others += others[:2]
        got = align.distance_counts(own, others, cells=r.choice([1, 40, 1 << 17]))
        assert {d: int(n) for d, n in enumerate(got) if n} == Counter(edits(a, b) for a in own for b in others)
    assert not align.distance_counts([], ["A"]).any() and align.distance_counts([""], [""]).tolist() == [1]


def test_distances_of_all_pairs(spark):
    r = random.Random(10)
    words = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 9))) for _ in range(70)]
    want = Counter(edits(a, b) for n, a in enumerate(words) for b in words[:n])
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for block in (7, 10, 25, 64, 1000):
        assert {x["distance"]: x["n"] for x in tables.distance_counts(df, block).collect()} == want
    assert tables.distance_counts(df.limit(0)).collect() == []


def test_many_barcodes_are_compared_quickly(spark):
    r = random.Random(11)
    words = ["".join(r.choice("ACGT") for _ in range(12)) for _ in range(12_000)]
    begin = timeit.default_timer()
    assert tables.distance_counts(spark.createDataFrame([(w,) for w in words], "w string")).agg({"n": "sum"}).first()[0] == 12_000 * 11_999 // 2
    assert timeit.default_timer() - begin < 20


def test_many_barcodes_are_searched_for_many_rows_at_once():
    r = random.Random(12)
    trie = align.Trie(["".join(r.choice("ACGT") for _ in range(12)) for _ in range(20_000)])
    rows, size = align.packed(["".join(r.choice("ACGT") for _ in range(14)).encode() for _ in range(300)])
    begin = timeit.default_timer()
    found = trie.search(rows, size, 1, cells=1 << 20)
    assert timeit.default_timer() - begin < 1
    again = trie.search(rows, size, 1, cells=500)
    assert all((a == b).all() for a, b in zip(found[:3], again[:3], strict=True)) and found[3] == again[3]


def test_search_of_nothing():
    rows, size = align.packed([b"", b"ACGT"])
    distance, places = align.search(rows, size, "ACG", 1)
    assert list(distance) == [-1, 0] and places == [[], [(0, 2)]]
    assert align.search(*align.packed([]), "ACG", 1)[1] == []


def test_lower_case_bases_match_nothing():
    assert align.search(*align.packed([b"acgt"]), "ACGT", 1)[0][0] == -1


def test_infix_distances():
    r = random.Random(4)
    texts = ["".join(r.choice("ACGT") for _ in range(r.choice([0, 1, 5, 14, 90]))) for _ in range(60)]
    patterns = ["".join(r.choice("ACGT") for _ in range(r.choice([0, 1, 5, 14, 80]))) for _ in range(40)] + ["N", "acgt"]
    pairs = [(p, t) for p in range(len(patterns)) for t in range(len(texts)) if len(patterns[p]) * len(texts[t]) < 500 or r.random() < 0.02]
    got = mining.infix_distances([p.encode() for p in patterns], [t.encode() for t in texts], pairs)
    for (p, t), d in zip(pairs, got, strict=True):
        row = list(range(len(patterns[p]) + 1))
        least = row[-1]
        for c in texts[t]:
            new = [0]
            for i, x in enumerate(patterns[p]):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row, least = new, min(least, new[-1])
        assert d == least


def test_complement():
    assert complement("ACGTRN") == "NYACGT"
    assert complement(complement("ACGTRYKMBDHVSWNacgt")) == "ACGTRYKMBDHVSWNacgt"


def test_mean_qualities_take_little_memory():
    texts = ["I" * 10_000, None, "", "!#"] * 500
    column = pa.array(texts)
    tracemalloc.start()
    got = mean_quality.func(column).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [40.0, 0.0, 0.0, 1.0] * 500 and peak < 5_000_000  # of 5 MB of letters
