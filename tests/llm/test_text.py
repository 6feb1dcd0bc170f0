"""Operators on texts: tokens, quality, personal data, benchmark passages, secrets."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ampliflow.llm import leaks, private_data, quality, secrets, token_shards


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


ODD = [(5, None), (6, ""), (None, "a@b.cd x"), (7, "same"), (7, "same"), (8, "long " * 40_000)]


def library():
    return Tokenizer.from_file(token_shards.tokenizer_path())


def test_encoder_equals_the_library():
    own, r = token_shards.Encoder(token_shards.tokenizer_path()), random.Random(1)
    parts = [" ", "  ", "\n", " a", "b", "Zé", "1", ".", "'s", "'", "!", "<|endoftext|>", "\t", "日本", " ", "\x1c", "\0", ", ", "word,"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["first part <|endoftext|> second part", "<|endoftext|>", "a<|endoftext|>. b", "a \n<|endoftext|>\n b", ""]
    want = [e.ids for e in library().encode_batch_fast(texts, add_special_tokens=False)]
    assert 50256 in want[3000]
    for _ in range(2):
        ids, sizes = own.encode(texts)
        assert [len(w) for w in want] == list(sizes) and [x for w in want for x in w] == list(ids)


def test_eviction_keeps_results(monkeypatch):
    monkeypatch.setattr(token_shards, "KEPT_PIECES", 40)
    own = token_shards.Encoder(token_shards.tokenizer_path())
    for n in range(20):
        texts = [f"piece{n} of number{i} and more" for i in range(20)]
        ids, _ = own.encode(texts)
        assert list(ids) == [x for e in library().encode_batch_fast(texts, add_special_tokens=False) for x in e.ids]


def test_shards_round_trip(spark, tmp_path):
    rows = ODD + [(n, f"text number {n}") for n in range(100, 140)] + [(50, "one <|endoftext|> two")]
    path = str(tmp_path / "ids")
    token_shards.write_shards(docs_of(spark, rows), path, n_shards=3)
    out = token_shards.digest(token_shards.read_shards(spark, path)).collect()
    own, want = library(), []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, sum(w[2] for w in want), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    token_shards.write_shards(docs_of(spark, []), str(tmp_path / "none"))
    assert token_shards.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_quality_of_held_out_texts(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["river", "stone", "the", "of", "mill", "water", "quiet", "a"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY!!", "$$$", "CLICK!!", "WIN***"]) for _ in range(60))
    rows = [(n, good() if n % 3 else bad()) for n in range(600)]
    labels = spark.createDataFrame([(n, int(n % 3 > 0)) for n in range(400)] + [(None, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.train(docs_of(spark, rows), labels)
    scored = {r["doc_id"]: r["score"] for r in quality.with_score(docs_of(spark, rows + ODD), model).collect()}
    assert np.mean([(scored[n] >= 0.3) == (n % 3 > 0) for n in range(400, 600)]) > 0.97
    assert all(0 <= s <= 1 for s in scored.values())
    assert quality.keep_good(docs_of(spark, rows), model).columns == ["doc_id", "text"]
    none = quality.train(docs_of(spark, rows), labels.limit(0))
    assert {r["score"] for r in quality.with_score(docs_of(spark, ODD), none).collect()} == {0.5}
    assert quality.with_score(docs_of(spark, []), model).count() == 0


def test_scans_take_linear_time_and_match_the_patterns():
    r = random.Random(4)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    for _ in range(20_000):
        t = "".join(r.choice("ab@.. 1+-%_9@.1") for _ in range(r.randint(0, 30)))
        assert list(private_data.emails(t)) == [m.span() for m in email.finditer(t)]
        assert [m.span() for m in private_data._IP.finditer(t)] == [m.span() for m in ip.finditer(t)]
    for t in ("a." * 100_000, "1" * 100_000, "1." * 100_000, "+1 " * 50_000, "@a." * 50_000):
        private_data.base_spans(t)


def test_private_data(spark):
    near = [(n, f"call me, Zorbo, at z@x.org now {n}") for n in range(4)]
    rows = near + ODD + [(20, "ip 1.2.3.4 and 1.2.3.400, card 4539 1488 0343 6467, +1 (555) 010-9999"), (21, "at the mill, call me now")]
    found = private_data.find(docs_of(spark, rows))
    out = {r["doc_id"]: r for r in private_data.digest(found).collect()}
    assert [out[20][f"n_{k}"] for k in private_data.KINDS] == [0, 1, 1, 1]
    text = rows[-2][1]
    spans = [("ip", text.index("1.2.3.4"), 7), ("card", text.index("4539"), 19), ("phone", text.index("+1"), 17)]
    want = ",".join(f"{k}:{i}:{i + n}" for k, i, n in spans)
    assert out[20]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert out[5]["base_sha256"] == out[6]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[None]["n_email"] == 1
    # Zorbo stands with z@x.org only; the other words also elsewhere.
    assert out[0]["spans"] == "email:19:26,term:9:14"
    clean = {r["doc_id"]: r["text"] for r in private_data.sanitise(docs_of(spark, rows)).collect()}
    assert clean[0] == "call me, , at [EMAIL] now 0" and clean[21] == "at the mill, call me now" and clean[5] is None
    assert private_data.find(docs_of(spark, [])).count() == 0


def test_private_terms_far_from_the_mention(spark):
    far = " ".join(["mill"] * 30)
    rows = [(n, f"Zorbo {far} by Zorbo z@x.org {far} Quent {far} Zorbo") for n in range(4)] + [(100 + n, f"{far} by") for n in range(20)] + [(200, "Quent and Zorbo")]
    clean = {r["doc_id"]: r["text"] for r in private_data.sanitise(docs_of(spark, rows)).collect()}
    assert {clean[n] for n in range(4)} == {f"[NAME] {far} by [NAME] [EMAIL] {far} [NAME] {far} [NAME]"}
    assert clean[100] == rows[4][1] and clean[200] == "Quent and Zorbo"


def test_private_terms_with_other_spaces(spark):
    rows = [(n, f"Nom\u00a0: Zorbo\u202fQuent\x1cX z@x.org {n}") for n in range(4)] + [(100 + n, "by the mill") for n in range(20)]
    found = {r["doc_id"]: r for r in private_data.find(docs_of(spark, rows)).collect()}
    text = rows[0][1]
    assert [text[t["start"] : t["end"]] for t in found[0]["terms"]] == ["Nom\u00a0", "Zorbo\u202fQuent\x1cX"] and not found[100]["terms"]


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_against_brute_force(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    items = [(n, " ".join(word() for _ in range(r.randint(8, 25)))) for n in range(12)] + [(90, None), (91, "short"), (None, " ".join(word() for _ in range(12)))]
    rows = []
    for n in range(60):
        item = r.choice(items[:12])[1]
        own = "".join(r.choice(["", c, c + "x"]) if r.random() < r.choice([0, 0.03, 0.1]) else c for c in item)
        rows.append((n, " ".join([*(word() for _ in range(20)), own.upper() if n % 2 else own, *(word() for _ in range(20))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in leaks.leaks(docs_of(spark, rows + ODD), bench, block_chars=300).collect()}
    want = {}
    for d, t in rows:
        for i, item in items:
            pattern = leaks.normalised(item or "")
            if len(pattern) >= leaks.MIN_CHARS:
                e = edits(pattern, leaks.normalised(t))
                if e <= int(len(pattern) * leaks.RATE):
                    want[d, i] = e
    assert {k: x["distance"] for k, x in got.items()} == want and len(want) > 20
    texts = dict(rows)
    for (d, i), x in got.items():
        assert edits(leaks.normalised(dict(items)[i]), leaks.normalised(texts[d][x["start"] : x["end"]])) == x["distance"]
    kept = leaks.drop_leaks(docs_of(spark, rows + ODD), bench)
    assert kept.count() == len(rows) + len(ODD) - len({d for d, _ in want})
    assert leaks.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_secrets(spark):
    r = random.Random(8)
    prose = lambda: " ".join(r.choice(["the", "river", "runs", "by", "old", "stone", "mills", "Ingeborg", "INTERNATIONALISATION", "2024"]) for _ in range(40))
    rows = [(1000 + n, f"{prose()} password = '{'%016x' % r.getrandbits(64)}Xy' {prose()}") for n in range(60)] + [(n, prose()) for n in range(100, 160)]
    rows += ODD + [(70, f"key AKIA{'A1' * 8} {'ab' * 12} {'a' * 23}"), (71, "password: short"), (72, f"{prose()} pwd = 'k9{'%015x' % r.getrandbits(60)}Qz' {prose()}")]
    docs = docs_of(spark, rows)
    model = secrets.model_of(docs.where("doc_id IS NULL OR doc_id <> 72"))
    out = {x["doc_id"]: x["s"] for x in secrets.with_spans(docs, model, "s").collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in out[70]] == [(1, 4, 24), (2, 25, 49)]
    assert not out[71] and not out[5] and not any(out[n] for n in range(100, 160))
    assert all([s["kind"] for s in out[n]] == [0] for n in range(1000, 1060))
    assert [s["kind"] for s in out[72]] == [secrets.CRF]
    # Without any keyword, in lower case or capitals, not longer than what was learnt: the shape alone.
    bare = [(n, f"{prose()} {'%017x' % r.getrandbits(68)} {prose()}".replace("2024", "mills")) for n in range(30)] + [(n, f"{prose()} {'%016X' % r.getrandbits(64)} {prose()}") for n in range(30, 60)]
    found = [any(k == secrets.CRF for k, _, _ in s) for s in secrets.all_spans([t for _, t in bare], model)]
    assert np.mean(found) > 0.5
    assert "[SECRET]" in secrets.redact(docs.where("doc_id = 72"), model).first()["text"]
    assert secrets.model_of(docs_of(spark, [(1, "nothing")])) is None
    assert secrets.with_spans(docs_of(spark, []), None).count() == 0


def test_viterbi_is_the_best_path_and_cuts_change_nothing():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(50):
        score, moves = rng.normal(size=(5, 3)) * 2, rng.normal(size=(3, 3))
        value = lambda p: sum(score[i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=5), key=value)
        assert tuple(secrets.viterbi(score, moves)) == best
        model = secrets.Model(np.zeros((secrets.SIZE, 3), np.float32), moves, "m")
        long = rng.normal(size=(60, 3)) * 3
        long[:, 0] += 4
        assert (secrets.Tagger(model)._decoded(long) == secrets.viterbi(long, moves)).all()


def test_crf_gradient():
    rng = np.random.default_rng(1)
    score, moves, real = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), np.ones((2, 4), bool)

    def total(s):
        a = s[:, 0]
        for i in range(1, 4):
            a = secrets._log_sum(a[:, :, None] + moves, 1) + s[:, i]
        return secrets._log_sum(a, 1)

    marginal, pairs = secrets._expected(score, moves, real)
    for place in ((0, 1, 2), (1, 3, 0)):
        up = score.copy()
        up[place] += 1e-5
        assert (total(up) - total(score)).sum() / 1e-5 == pytest.approx(marginal[place], abs=1e-3)
    assert pairs.sum() == pytest.approx(6)




def test_many_entities_of_one_page_are_counted_once(spark):
    """A directory of addresses in some copies: its entities are one, and its words are marked as if each were alone."""
    many = " ".join(f"user{n}@mail{n % 7}.example.org" for n in range(400))
    rows = [(n, f"quartzite {many} tail{n}") for n in range(3)] + [(100 + n, f"plain words number {n % 5} here") for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = spark.createDataFrame([(d, t.replace(many, "user0@mail0.example.org")) for d, t in rows], "doc_id long, text string")
    marked = lambda df: {r["doc_id"]: [t["start"] for t in r["terms"]] for r in private_data.find(df).collect()}
    got, want = marked(docs), marked(one)
    assert got[0] == want[0] == [0] and got.keys() == want.keys() and not any(got[100 + n] for n in range(60))
    found = docs.select("doc_id", private_data._found()(docs["text"]).alias("f")).selectExpr("monotonically_increasing_id() AS row", "f.*")
    found = private_data.written(found, "test-found")
    assert private_data.disclosures(found, docs).select("entity").distinct().count() == 1
