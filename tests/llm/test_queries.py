"""Each registered query of the subpackage, and the pipeline stage by stage, on whole small tables with odd rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from ampliflow.llm import leaks, quality, token_shards

from test_near_duplicates import brute as near_brute
from test_text import edits

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("score", "spans", "label", "class", "text_hash", "start", "rank", "shard", "taken", "gone_doc", "leak_hash", "row", "key", "n", "base", "line")


def corpus():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(n, prose(18)) for n in range(6)] + [(6, "tiny item"), (7, None), (8, ""), (0, "another text with a repeated id of twenty letters")]
    texts = {n: prose(r.choice([5, 30, 80])) for n in range(120)}
    for n in range(120, 160):  # near copies of eight documents
        words = texts[n % 8 * 5].split()
        texts[n] = " ".join(r.choice(vocabulary) if r.random() < r.choice([0, 0.02, 0.1]) else w for w in words)
    for n in range(160, 180):  # personal data and secrets
        texts[n] = f"{prose(6)} mail a.b{n}@mail-{n % 3}.example.org or 10.0.{n}.{n * 2} {prose(3)} 4111 1111 1111 1111 +49 (30) 1234-{n} token = 'Zx{n}qwErty' AKIA{'Q7' * 8} {'0a' * 12} {prose(4)}"
    for n in range(180, 190):  # passages of the benchmark, some changed in a letter, and short items
        texts[n] = f"{prose(10)} {items[n % 6][1][:-1] + ('x' if n % 2 else items[n % 6][1][-1])} {prose(10)}"
    texts[190] = f"{prose(5)} Tiny, item! {prose(5)} tiny items"
    texts |= {191: None, 192: "", 193: " \n\t ", 194: "<|endoftext|> a <|endoftext|>b", 195: "wörld " * 30_000, 196: "!!! $$$ " * 20, 197: "no break   here", 198: "BUY $$$ NOW !!! " * 10}
    texts |= {n: "BUY $$$ NOW !!! CLICK " * (2 + n % 5) for n in range(200, 240)}
    rows = list(texts.items()) + [(3, texts[3]), (3, "another text of a repeated id"), (None, "without an id"), (None, "without an id")]
    labels = [(n, int(n < 200), 0) for n in texts if n % 3] + [(None, 1, 0), (5000, 0, 1), (7, 0, 0)]
    vectors = [(n, [float(x) for x in np.random.default_rng(n % 90).normal(size=12)]) for n in range(300)]
    vectors += [(1000, None), (1050, [0.0] * 12), (1100, [float("nan")] + [1.0] * 11), (None, [1.0] * 12)]
    return rows, items, labels, vectors


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows, items, labels, vectors = corpus()
    full, none = (str(tmp_path_factory.mktemp(n)) for n in ("sf", "none"))
    docs = spark.createDataFrame([(d, t, "en", [None, "a", "b", "hot"][(d or 0) % 4], len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES])
    tables = {
        "documents": docs, "benchmark": spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS distance"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "pages": spark.createDataFrame([(1, "u", "<p>x"), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS score"),
    }
    for name, df in tables.items():
        df.repartition(3).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{none}/{name}.parquet")
    return full, none


def run(spark, sf, name):
    return [r.asDict(True) for r in entry_points.queries()[name](spark, sf).collect()]


NAMES = [n for n in entry_points.queries() if re.match(r"op\d+_|pipeline", n)]


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES if n != "pipeline") == list(range(1, 14)) and "pipeline" in NAMES


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, sf, name):
    assert run(spark, sf[1], name) == []


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 0


def test_op1(spark, sf):
    got = run(spark, sf[0], "op1_quality")
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(d) for d, _ in corpus()[0])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] is held(r["doc_id"]) for r in got)
    sure = [r for r in got if r["held_out"] and r["doc_id"] < 120 or r["held_out"] and r["doc_id"] >= 200]
    assert np.mean([r["predicted"] == (r["doc_id"] < 200) for r in sure]) > 0.9 and len(sure) > 15
    # Labels of held-out rows change nothing.
    docs, labels = (spark.read.parquet(f"{sf[0]}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", quality.F.when(quality.held_out(labels["doc_id"]), 1 - labels["quality"]).otherwise(labels["quality"]))
    model = quality.train(docs.select("doc_id", "text"), other.where(~quality.held_out(other["doc_id"])))
    assert sorted(r["score"] for r in quality.with_score(docs.select("doc_id", "text"), model).collect()) == pytest.approx(sorted(r["score"] for r in got))


def ids_of(rows):
    tokenizer, out, at = Tokenizer.from_file(token_shards.tokenizer_path()), [], 0
    for d, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op2(spark, sf):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, sf[0], "op2_token_shards") if r["doc_id"] is not None or r["start"] >= 0)
    want = ids_of(sorted(corpus()[0], key=lambda x: (x[0] is not None, x[0] or 0)))
    assert [g[1] for g in got] == [w[0] for w in want] and sorted(g[2:] for g in got) == sorted(w[2:] for w in want)
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    assert {g[1:] for g in got if g[1] not in (3, None)} == {(w[0], *w[2:]) for w in want if w[0] not in (3, None)}


def test_a_reader_of_shards_skips_stripes(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    token_shards.write_shards(docs, path, n_shards=4)
    rows = token_shards.read_shards(spark, path)
    assert rows.where("doc_id = 17000").count() == 1

    def scanned(where):
        df = spark.read.orc(path).select("doc_id", "tokens").where(where)
        df.collect()
        return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    everything = scanned("doc_id >= 0")
    # Row indexes skip by range, Bloom filters what isn't there though it is in range.
    assert everything == 20_000 and scanned("doc_id = 17000") <= 2000 and scanned("doc_id = 17001") <= 1000


def test_op3(spark, sf):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]

    texts = {}
    for d, t in corpus()[0]:
        spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t or "") if good(k, m[0])]
        texts.setdefault(d, set()).add(tuple(spans))
    for r in run(spark, sf[0], "op3_private_data"):
        own = [s for s in texts[r["doc_id"]] if hashlib.sha256(",".join(f"{k}:{i}:{j}" for k, i, j in s).encode()).hexdigest() == r["base_sha256"]]
        assert len(own) == 1 and [r[f"n_{k}"] for k in patterns] == [sum(s[0] == k for s in own[0]) for k in patterns]
        assert r["spans"].startswith(",".join(f"{k}:{i}:{j}" for k, i, j in own[0]))


def test_op4(spark, sf):
    got = run(spark, sf[0], "op4_mix")
    size = sorted((str(d), len(WORDS.findall(t or ""))) for d, t in corpus()[0])
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == size
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and got[0].keys() >= {"source_size", "target"}
    assert sorted(map(str, got)) == sorted(map(str, run(spark, sf[0], "op4_mix")))


def test_op6(spark, sf):
    want = set()
    for d, t in corpus()[0]:
        plain = leaks.normalised(t or "")
        for i, item in corpus()[1]:
            pattern = leaks.normalised(item or "")
            if len(pattern) >= leaks.MIN_CHARS:
                e = edits(pattern, plain) if len(plain) < 20_000 else len(pattern)
                if e <= int(len(pattern) * leaks.RATE):
                    want.add((d, i, e))
            elif pattern and f" {pattern} " in f" {plain} ":
                want.add((d, i, 0))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in run(spark, sf[0], "op6_leaks")}
    assert got == want and (190, 6, 0) in got and len(got) > 9


def test_op7(spark, sf):
    x = {n: np.array(v, np.float32).astype(float) for n, v in corpus()[3] if n is not None and v is not None and np.isfinite(v).all() and np.abs(v).max() > 0}
    found: dict = {}
    for r in sorted(run(spark, sf[0], "op7_neighbours"), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert set(found) == {n for n in x if n % 50 == 0}
    hits = 0
    for q, rows in found.items():
        near = sorted(((-round(float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), 12), n) for n, v in x.items() if n != q))[:5]
        assert rows == sorted(rows, key=lambda r: (-round(r[1], 12), r[0])) and len(rows) == 5
        assert all(s == pytest.approx(x[q] @ x[n] / np.linalg.norm(x[q]) / np.linalg.norm(x[n]), abs=1e-12) for n, s in rows)
        hits += len({n for n, _ in rows} & {n for _, n in near})
    assert hits >= 0.9 * 5 * len(found)


def test_op9(spark, sf):
    patterns = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    good = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    texts = {}
    for d, t in corpus()[0]:
        spans = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(patterns.items()) for m in p.finditer(t or "") if good[k](m))
        texts.setdefault(d, set()).add(tuple((k, i, j) for i, _, k, j in spans))
    for r in run(spark, sf[0], "op9_secrets"):
        own = [s for s in texts[r["doc_id"]] if hashlib.sha256(",".join(f"{k}:{i}:{j}" for k, i, j in s).encode()).hexdigest() == r["base_sha256"]]
        assert len(own) == 1 and [r[f"n_{k}"] for k in patterns] == [sum(s[0] == k for s in own[0]) for k in patterns]
        assert {f"{k}:{i}:{j}" for k, i, j in own[0]} <= set(r["spans"].split(","))


def test_op10(spark, sf):
    got = run(spark, sf[0], "op10_near_duplicates")
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == near_brute(corpus()[0], 2, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op5_and_op8_give_each_document_once(spark, sf):
    for name in ("op5_line_templates", "op8_shards"):
        assert sorted(str(r["doc_id"]) for r in run(spark, sf[0], name)) == sorted(str(d) for d, _ in corpus()[0])


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    names = docs.columns
    (_, first), (_, second), (_, third), (_, fourth), (_, last) = corpus_pipeline.STAGES
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    # 1: what scores under the limit goes.
    good = first(spark, docs, sf[0])
    scored = quality.with_score(docs.select("doc_id", "text"), quality.model_of(spark, sf[0], docs), "p").collect()
    assert good.columns == names and rows(good) == sorted(((r["doc_id"], r["text"]) for r in scored if r["p"] >= 0.3), key=str)

    # 2: of each group of near duplicates the least doc_id stays.
    unique = second(spark, docs, sf[0])
    groups = near_brute(corpus()[0], 5, 80)
    least = {d for d, n, c in groups if n and d is not None and d == c}
    empty = [(d, t) for d, t in corpus()[0] if not WORDS.findall(t or "")]
    kept = rows(unique)
    assert unique.columns == names and {d for d, t in kept if d is not None and WORDS.findall(t or "")} == least
    assert [k for k in kept if not WORDS.findall(k[1] or "")] == sorted(empty, key=str)
    assert sum(d == 3 for d, _ in kept) <= 2 and sum(d is None for d, _ in kept) == 1

    # 3: documents with an item go.
    clean = third(spark, docs, sf[0])
    bad = {r["doc_id"] for r in run(spark, sf[0], "op6_leaks") if r["item_id"] != 6}
    assert clean.columns == names and rows(clean) == sorted(((d, t) for d, t in corpus()[0] if d not in bad), key=str)
    blocks = leaks.drop_leaks(docs, spark.read.parquet(f"{sf[0]}/benchmark.parquet"), block_chars=200)
    assert blocks.columns == names and rows(blocks) == rows(clean)

    # 4: each document as often as the mix takes it.
    mixed = fourth(spark, docs, sf[0])
    times = sorted((str(r["doc_id"]), r["taken"] // r["size"]) for r in run(spark, sf[0], "op4_mix") if r["taken"])
    got: dict = {}
    for d, t in rows(mixed):
        got[str(d), t] = got.get((str(d), t), 0) + 1
    once = {d for d, _ in times if sum(d == e for e, _ in times) == 1}
    assert mixed.columns == names and sorted((d, n) for (d, _), n in got.items() if d in once) == [x for x in times if x[0] in once]

    # 5: the ids of what the stages before kept.
    small = docs.where("doc_id < 100 AND doc_id <> 3")
    ids = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in last(spark, small, sf[0]).collect())
    assert ids == ids_of(sorted((d, t) for d, t in corpus()[0] if d is not None and d < 100 and d != 3))
    out = corpus_pipeline.run(spark, sf[0]).collect()
    assert out and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)


def test_sanitised_texts_keep_other_columns(spark, sf):
    from ampliflow.llm import private_data

    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").selectExpr("*", "1 AS pii_doc", "2 AS PII_base", "3 AS _pii_base")
    out = private_data.sanitise(docs)
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == len(corpus()[0]) and {(r["pii_doc"], r["PII_base"], r["_pii_base"]) for r in rows} == {(1, 2, 3)}
    assert all("@mail" not in (r["text"] or "") and ("[EMAIL]" in r["text"]) == (160 <= (r["doc_id"] or 0) < 180) for r in rows if r["text"])
