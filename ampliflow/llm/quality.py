"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut into blocks, so that the dictionaries
weigh the same anywhere in it, and each block is compressed with both. From the summed sizes come the normalised difference of the
two and the compression ratios, which a logistic regression over piecewise linear terms turns into a calibrated score.

Fitting uses a bounded sample of labelled rows: at most MAX_ROWS whole texts of each label (those with the smallest hashes of their
doc_id). One half trains the dictionaries, the other half the calibration, weighted to the labels' frequencies among all
labelled rows. Where the sample has too few blocks to choose a dictionary from, its last DICTIONARY_BYTES are the dictionary. Scoring
reads every whole text, and nothing but the text.

Nulls: a null text counts as empty, and an empty text gets a score as any other. Labels other than 0 and 1, labels without a document
and null doc_ids train nothing. With no rows of one label the score is the share of label 1 (0.5 without labels). A null doc_id isn't
held out. Repeated rows are scored alike; repeated labels of a document count as often as they occur. Very long texts are scored whole,
block by block. Of other columns, one that has the name of the new score is replaced, all others stay. An empty table of documents
yields no rows, and without texts for one of the labels the score is the share of label 1, as above.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

MAX_ROWS = 2000
BLOCK, LEVEL, DICTIONARY_BYTES = 4096, 3, 65_536
KNOTS = (0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95)
#: A document is kept if its score is at least this.
KEEP = 0.3


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


def _dictionary(texts: list[bytes]):  # noqa: ANN202
    import zstandard

    samples = [b for t in texts for b in _blocks(t)]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary
        trained = zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return trained.as_bytes()


class Sizes:
    """Bytes of a text: raw, compressed with the good dictionary, compressed with the bad one."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(data: bytes):  # noqa: ANN202
            trained = zstandard.ZstdCompressionDict(data)
            trained.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_dict_id=False).compress

        self.good, self.bad = compressor(good), compressor(bad)

    def of(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            blocks = _blocks(text)
            out[i] = len(text), sum(len(self.good(b)) for b in blocks), sum(len(self.bad(b)) for b in blocks)
        return out


@dataclass
class Model:
    """good, bad: dictionaries; the rest is the calibration. Without dictionaries every score is the prior."""

    prior: float
    good: bytes | None = None
    bad: bytes | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    knots: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, sizes: np.ndarray) -> np.ndarray:
        x = _terms(_features(sizes, self.centre, self.scale), self.knots) @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _raw(sizes: np.ndarray) -> np.ndarray:
    raw, good, bad = sizes.T
    return np.stack([(bad - good) / (bad + good + 1), (bad - good) / (raw + 16), (bad + 1) / (raw + 16), (good + 1) / (raw + 16), np.log1p(raw)], 1)


def _features(sizes: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = (_raw(sizes) - centre) / scale
    return np.c_[x, x[:, 0] * x[:, 2], x[:, 0] * x[:, 4], x[:, 2] * x[:, 4]]


def _terms(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(x)), x, np.maximum(0, x[:, None, :] - knots[None]).reshape(len(x), -1)]


def _logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-6 * np.eye(len(w)), a.T @ (weight * (p - y)) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[str, int]], prior: float) -> Model:
    """rows: texts and labels of both kinds, in a fixed order; prior: share of label 1."""
    by = {k: [(t or "").encode() for t, y in rows if y == k] for k in (0, 1)}
    if min(map(len, by.values())) < 2:
        return Model(prior)
    half = {k: (len(v) + 1) // 2 for k, v in by.items()}
    good, bad = (_dictionary(by[k][: half[k]]) for k in (1, 0))
    rest = {k: by[k][half[k] :] for k in by}
    sizes = Sizes(good, bad).of(rest[1] + rest[0])
    y = np.r_[np.ones(len(rest[1])), np.zeros(len(rest[0]))]
    raw = _raw(sizes)
    centre, scale = raw.mean(0), raw.std(0) + 1e-9
    x = _features(sizes, centre, scale)
    knots = np.quantile(x, KNOTS, axis=0)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return Model(prior, good, bad, centre, scale, knots, _logistic(_terms(x, knots), y, weight))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality, of which the rows to learn from are given."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = []
    for k in (0, 1):
        order = [F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"]
        picked = labels.where(F.col("quality") == k).orderBy(*order).limit(max_rows)  # at most max_rows ids are broadcast
        found = texts.join(F.broadcast(picked), "doc_id").orderBy(*order, "text").limit(max_rows)
        rows += [(r["text"], k) for r in found.select("text").collect()]
    return fit(rows, prior)


def scorer(model: Model):  # noqa: ANN201
    """A function of a text column: its score."""

    def score(texts: pa.Array) -> pa.Array:
        if model.good is None:
            return pa.array(np.full(len(texts), model.prior))
        own = Sizes(model.good, model.bad)
        return pa.array(model.score(own.of(texts.cast(pa.binary()).fill_null(b"").to_pylist())))

    return F.arrow_udf(score, T.DoubleType())


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    return docs.withColumn(name, scorer(model)(docs["text"].cast("string")))


def keep_good(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of docs with at least this score, columns as they were."""
    return docs.where(scorer(model)(docs["text"].cast("string")) >= least)


def model_of(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    labels = table(spark, sf_dir, "labels")
    return train(docs, labels.where(~held_out(labels["doc_id"])))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, model_of(spark, sf_dir, docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
