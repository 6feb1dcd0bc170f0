"""Runs against brute force over all periods, Lyndon arrays against their definition, comparisons on hard words."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ampliflow.llm import repeated_runs as rr


def brute(t, least=24, exponent=3):
    ids: dict = {}
    a, out = np.array([ids.setdefault(x, len(ids)) for x in t]), []
    for p in range(1, len(t) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, a[p:] == a[:-p], False])).tolist()
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            length, w = e - s + p, t[s : s + p]
            if length >= max(least, exponent * p) and not any(p % d == 0 and w == w[:d] * (p // d) for d in range(1, p)):
                out.append((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def hard_words(n):
    r = random.Random(2)
    fibonacci, more = [0], [0, 1]
    while len(more) < n:
        fibonacci, more = more, more + fibonacci
    thue = [0]
    while len(thue) < n:
        thue = thue + [1 - x for x in thue]
    block, nested = [r.randrange(3) for _ in range(200)], [0, 1]
    while len(nested) < n:
        nested = nested * 3 + [len(nested) % 3]
    blocks = lambda w, end: [x for k in range(1, n) if k * k * len(w) < 2 * n for x in [*w * k, *end]]
    words = [[0] * n, [r.randrange(2) for _ in range(n)], [r.randrange(500) for _ in range(n)], list(range(n)), more, thue, nested, [x for k in range(n // 200) for x in [*block, 3 + k % 7]], ([0] * 150 + [1]) * (n // 151)]
    words += [blocks([0], [1]), blocks([1], [0]), blocks([0, 1], [2]), blocks([0, 0, 1], [0, 2]), ([0, 1] * 80 + [2]) * (n // 161)]
    return [w[:n] for w in words] + [w[:n][::-1] for w in words]


def test_few_comparisons():
    for t in hard_words(20_000):
        for own in (t, [-x for x in t]):
            assert rr.lyndon_edges(own)[2] <= 12 * len(t)


def test_lyndon_arrays():
    r = random.Random(4)
    for _ in range(1500):
        t = [r.randrange(r.choice([1, 2, 2, 3, 6])) for _ in range(r.randint(0, 35))]
        n, (nss, common, _) = len(t), rr.lyndon_edges(t)
        for i in range(n):
            j = next((j for j in range(i + 1, n) if t[j:] < t[i:]), n)
            m = next((m for m in range(n - j) if t[i + m] != t[j + m]), n - j)
            assert (nss[i], common[i]) == (j, m)


def test_runs():
    r = random.Random(9)
    for _ in range(4000):
        n, letters = r.randint(0, 60), r.choice([1, 2, 2, 3, 8])
        t = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.choice([0, 1, 1, 2])):
            if n > 8:
                i, p = r.randrange(n), r.randint(1, 7)
                t = [t[k] if k < i else t[i + (k - i) % p] if i + (k - i) % p < n else 0 for k in range(n)]
                t[r.randrange(n)] = r.randrange(letters)
        least = r.choice([1, 3, 6, 12, 24])
        words = [b"w%d" % x for x in t]
        assert rr.word_runs(words, least, 3) == brute(t, least)
        assert rr.word_runs(words, least, 4) == brute(t, least, 4)
    for t in hard_words(600):
        assert rr.word_runs([b"%05d" % x for x in t]) == brute(t)
    with pytest.raises(ValueError, match="at least 3"):
        rr.runs_in([0] * 30, exponent=2)


def rows():
    r = random.Random(1)
    vocabulary = [f"w{k}ö" for k in range(40)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = [(n, prose(r.choice([1, 5, 50, 200]))) for n in range(300)]
    out += [(n, f"{prose(9)}\n{'BUY  now ! ' * r.randint(5, 20)} {prose(5)} {prose(7) + ' '} {'x ' * r.randint(20, 30)}") for n in range(300, 340)]
    return [*out, (400, None), (401, ""), (402, " \n "), (None, "a b " * 20), (403, "lorem ipsum dolor " * 8000), (404, "a " * 24), (405, "a " * 23), (300, out[300][1])]


def want(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(lines), digest(kept)


def test_query_against_brute_force(spark, tmp_path):
    spark.createDataFrame([(d, t, 1, "c") for d, t in rows()], "doc_id long, text string, runs int, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in rr.op13_repeated_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((want(d, t) for d, t in rows()), key=key)
    assert sum(g[1] > 0 for g in got) > 40 and max(g[1] for g in got) > 1


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "a  b\nc", 1), (2, "go  " + "x y " * 20 + "end", 2), (3, None, 3)], "doc_id long, text string, found_runs int")
    got = {r["doc_id"]: (r["text"], r["found_runs"]) for r in rr.collapse_runs(docs).collect()}
    assert got == {1: ("a  b\nc", 1), 2: ("go x y end", 2), 3: (None, 3)}
    assert rr.with_runs(docs.limit(0)).collect() == []
