"""Cuts for fill-in-middle against tokens found by a regular expression, and the succinct bit vector against plain lists."""

import hashlib
import random
import re

import numpy as np

from ampliflow.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text, marks = text or "", ("<P>", "<S>", "<M>")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = TOKEN.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in marks) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rank_and_select():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 63, 64, 65, 511, 512, 513, 3000, 70_000):
        for share in (0, 0.01, 0.5, 1):
            bits = r.random(n) < share
            v, ones = fim.BitVector(bits), np.flatnonzero(bits)
            assert (v.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(bits)])).all()
            assert (v.select(np.arange(len(ones))) == ones).all()


def rows():
    r = random.Random(5)
    out = [(n, "".join(r.choice(["a", "ö", "日", "😀", " ", "  ", "\n", "\t", "\x0b", "\xa0", "<", "P>", "<S", "word"]) for _ in range(r.choice([0, 1, 3, 30, 300])))) for n in range(600)]
    return [*out, (700, None), (None, "no id here"), (701, ""), (702, "   "), (703, "holds <M> in it"), (704, "long text " * 200_000), (1, out[1][1]), (1, "again")]


def test_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows()], "doc_id long, text string, form string, fim_cuts string").repartition(3)
    got = fim.with_fill_in_middle(docs)
    assert "fim_cuts" in got.columns and {r["fim_cuts"] for r in got.collect()} == {"y"}
    key = lambda r: tuple((x is None, x) for x in r)
    found = [tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    assert sorted(found, key=key) == sorted((brute(d, t) for d, t in rows()), key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    back = got.select("text", fim.restored(fim.F.col("output"), fim.F.col("form")).alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in back)


def test_slices():
    assert list(fim._slices(np.array([0]))) == [] and list(fim._slices(np.array([5, 5]))) == [(0, 1)]
    big = fim.BYTES
    assert list(fim._slices(np.array([0, 10, big, big + 5, 3 * big, 3 * big + 1]))) == [(0, 2), (2, 3), (3, 4), (4, 5)]
