"""Secrets: patterns, and a linear-chain conditional random field that finds more of them.

Tokens are runs of word characters and `+ / -`, and single other marks. Each is tagged as a secret's begin, its inside, or outside.
A tag's score adds weights of hashed features: the token's shape (length, kinds of characters, changes between them, spread), words
and shapes of its neighbours, and features of the whole file; weights between adjacent tags join them. The field is trained by
gradient ascent on its log-likelihood, on what the patterns find in a bounded sample of whole texts: at most MAX_POSITIVE with a
pattern's mark and MAX_OTHER others, those with the least hashes (only hashes are compared; the texts chosen are fetched then). Each
stretch around a secret is learnt MASKED times more with other words of the text in the neighbours' places and the secret shortened or
in capitals, so that a secret's own shape counts where no keyword stands beside it. Of one text at most SECRETS_OF_TEXT secrets are
learnt, so that a file full of them isn't all there is to learn; every text is searched whole.

Decoding is Viterbi's, on every whole text. Where "outside" wins by more than adjacent tags can ever change, it is part of any best
path; the chain is cut there, and the short stretches between are decoded side by side. That is exact.

Base spans stay as the patterns define them; the field's spans that touch none of them are added as kind `crf`.

Nulls: a null text counts as empty; a null doc_id is kept. With nothing to learn from, nothing is added. Repeated rows get equal
results; of equal rows one trains. Very long texts are tagged whole, CHUNK_CHARS or one text at a time. Of other columns, one that has
the name of the new one is replaced, all others stay. Offsets are code points, ends exclusive. Empty input, empty output.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import table, written

KINDS = ("assign", "access", "hex")
CRF = len(KINDS)
OUT, BEGIN, INSIDE = 0, 1, 2
MAX_POSITIVE, MAX_OTHER = 1000, 1000
SIZE, EPOCHS, RATE, RIDGE, SIDE, MASKED = 1 << 14, 25, 0.3, 1e-4, 30, 3
#: Of a text of the sample at most so many secrets, and so many of its longest other tokens, are learnt from.
SECRETS_OF_TEXT, OTHERS_OF_TEXT = 8, 3
CHUNK_CHARS, KEPT_TOKENS = 2_000_000, 300_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A token and the space after it are one piece.
_PIECE = re.compile(r"[\w+/-]+\x20?|[\x20\x09-\x0D]+|.", re.S)
#: Searches that are cheaper than the patterns and hold wherever they match: a keyword in lower case, a run of 24 hexadecimal digits.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX_MARK = bytes(ord("h") if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"h" * 24


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), sorted."""
    out, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_MARK):
        out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


_CLASSES = {c: "0" if chr(c).isdigit() else "a" if chr(c).islower() else "A" if chr(c).isupper() else "-" for c in range(128)}
_CLASS_BYTES = bytes(ord(_CLASSES.get(c, "x")) for c in range(256))
#: For tokens with other letters, which become question marks: no such token has one itself.
_OTHER_BYTES = _CLASS_BYTES[: ord("?")] + b"x" + _CLASS_BYTES[ord("?") + 1 :]
_SPACE = frozenset("\x20\t\n\x0b\x0c\r")
#: Where a token's word counts: for its own tag, and for those one, two, three places on and one place back.
PLACES = 5


def _hash(*parts: object) -> int:
    return zlib.crc32(repr(parts).encode()) % SIZE


def _key(token: str) -> tuple[str, int, bool]:
    """What the shape features depend on: few values for many tokens."""
    classes = token.encode("ascii", "replace").translate(_CLASS_BYTES if token.isascii() else _OTHER_BYTES).decode()
    return classes, len(set(token)) * 4 // len(token), not token.strip("0123456789abcdef")


def _shape_features(classes: str, spread: int, in_hex: bool) -> list[int]:
    length = min(7, len(classes).bit_length())
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    parts = [("bias",), ("len", length), ("kinds", length, *sorted(set(classes))), ("changes", length, min(changes, 12)), ("digits", length, classes.count("0") * 4 // len(classes)), ("spread", length, spread), ("hex", length, in_hex)]
    return [_hash(*p) for p in parts]


def _word(token: str, classes: str) -> int:
    """A hash of a short word, or of the kind of any other token."""
    if len(token) <= 12 and "0" not in classes:
        return zlib.crc32(token.lower().encode())
    return zlib.crc32(f"#{len(classes).bit_length()}{''.join(sorted(set(classes)))}".encode())


def place_features(words: np.ndarray) -> np.ndarray:
    """Of word hashes, the feature for each place (words x PLACES)."""
    odd = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)
    return ((words.astype(np.uint64)[:, None] * odd & np.uint64(0xFFFFFFFF)) >> np.uint64(13)).astype(np.int64) % SIZE


def file_features(n_tokens: int, n_digits: int, n_marks: int) -> list[int]:
    """A file's length, its share of tokens with digits, its number of marks (= : quotes)."""
    share = (n_digits * 50 // max(n_tokens, 1)).bit_length()
    return [_hash("file", n_tokens.bit_length()), _hash("file digits", share), _hash("file marks", min(8, n_marks).bit_length())]


class Tokens:
    """Numbers distinct pieces of texts and keeps what is known of each: its length (span), its token's length (size), kind, features.
    Number 0 is no token at all."""

    def __init__(self):
        outer = self

        class Numbers(dict):
            def __missing__(self, piece: str) -> int:
                self[piece] = n = len(self) + 1
                outer.fresh.append(piece)
                return n

        self.numbers, self.fresh, self.shapes = Numbers(), [], {}
        self.shape_list: list[list[int]] = [[]]
        self.span, self.size, self.space = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool)
        self.digit, self.mark = np.zeros(1, bool), np.zeros(1, bool)
        self.shape, self.word = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The tokens of each text and their starts. What is new in all of them is looked at together."""
        pieces = []
        for text in texts:
            found = _PIECE.findall(text)
            pieces.append(np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)))
        if self.fresh:
            self._look()
        out = []
        for ids in pieces:
            span = self.span[ids]
            keep = ~self.space[ids]
            out.append((ids[keep], (np.cumsum(span) - span)[keep]))
        return out

    def _look(self) -> None:
        pieces, self.fresh = self.fresh, []
        new = [p.rstrip("\x20") or p for p in pieces]
        keys = [_key(t) for t in new]
        for k in keys:
            if k not in self.shapes:
                self.shapes[k] = len(self.shape_list)
                self.shape_list.append(_shape_features(*k))
        add = lambda a, b: np.concatenate([a, np.array(b, a.dtype)])
        self.span = add(self.span, [len(p) for p in pieces])
        self.size = add(self.size, [len(t) for t in new])
        self.space = add(self.space, [t[0] in _SPACE for t in new])
        self.digit = add(self.digit, ["0" in k[0] for k in keys])
        self.mark = add(self.mark, [t in "=:\"'" for t in new])
        self.shape = add(self.shape, [self.shapes[k] for k in keys])
        self.word = add(self.word, [_word(t, k[0]) for t, k in zip(new, keys, strict=True)])

    def file(self, ids: np.ndarray) -> list[int]:
        return file_features(len(ids), int(self.digit[ids].sum()), int(self.mark[ids].sum()))


@dataclass
class Model:
    """weights: SIZE x 3 tags; moves: 3 x 3, from tag to tag."""

    weights: np.ndarray
    moves: np.ndarray
    name: str

    @property
    def sure(self) -> float:
        """By so much a tag must win to be on every best path, whatever stands beside it."""
        t = self.moves
        inner = max(t[a, b] + t[b, c] - t[a, OUT] - t[OUT, c] for a in range(3) for b in range(3) for c in range(3))
        ends = max(max(t[a, b] - t[a, OUT], t[b, a] - t[OUT, a]) for a in range(3) for b in range(3))
        return max(0.0, inner, ends)


def _tags(starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
    tags = np.zeros(len(starts), np.int64)
    for _, _, end, start in base_spans(text):
        at = np.flatnonzero((ends > start) & (starts < end))
        if len(at) and not tags[at].any():
            tags[at] = INSIDE
            tags[at[0]] = BEGIN
    return tags


def _varied(token: str, known: Tokens, rng: np.random.Generator) -> int:
    """A secret's token, or a shorter one or one in capitals: secrets of other lengths and alphabets have such shapes."""
    token = token[: rng.integers(min(16, len(token)), len(token) + 1)]
    [(ids, _)] = known.read([token.upper() if rng.random() < 0.3 else token])
    return int(ids[0])


def train(texts: list[str], seed: int = 5) -> Model | None:
    """texts in a fixed order. Stretches around secrets, and some others, are the chains."""
    rng, chains, known = np.random.default_rng(seed), [], Tokens()
    near_places = ((0, 0), (1, 1), (2, 2), (3, 3), (-1, 4))
    for text in texts:
        [(ids, starts)] = known.read([text])
        if not len(ids):
            continue
        tags, file = _tags(starts, starts + known.size[ids], text), known.file(ids)
        words = place_features(known.word[ids]).tolist()
        # Beside the secrets: the longest other tokens, which resemble them most, and any two places.
        longest = np.argsort(-np.where(tags == OUT, known.size[ids], 0), kind="stable")[:OTHERS_OF_TEXT]
        secrets = np.flatnonzero(tags == BEGIN)[:SECRETS_OF_TEXT].tolist()
        for at, masked in [*((at, False) for at in (*secrets, *longest.tolist(), *rng.integers(len(ids), size=2).tolist())), *((at, True) for at in secrets for _ in range(MASKED))]:
            low, high = max(0, at - SIDE), min(len(ids), at + SIDE)
            other = rng.integers(len(ids), size=len(ids)) if masked else np.arange(len(ids))
            rows = []
            for i in range(low, high):
                near = [words[i if not back else other[i - back]][place] for back, place in near_places if 0 <= i - back < len(ids)]
                own = _varied(text[starts[i] : starts[i] + known.size[ids[i]]], known, rng) if masked and tags[i] != OUT else ids[i]
                rows.append(known.shape_list[known.shape[own]] + file + near)
            chains.append((rows, tags[low:high]))
    if not any((t > 0).any() for _, t in chains):
        return None
    length, width = max(len(r) for r, _ in chains), max(len(x) for r, _ in chains for x in r)
    ids = np.full((len(chains), length, width), SIZE, np.int64)  # the last weight stays 0
    gold, real = np.zeros((len(chains), length), np.int64), np.zeros((len(chains), length), bool)
    for c, (rows, tags) in enumerate(chains):
        for i, row in enumerate(rows):
            ids[c, i, : len(row)] = row
        gold[c, : len(tags)], real[c, : len(tags)] = tags, True
    weights, moves = np.zeros((SIZE + 1, 3)), np.zeros((3, 3))
    seen, seen_moves = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 256)):
            x, y, m = ids[part], gold[part], real[part]
            score = weights[x].sum(2) * m[..., None]
            marginal, pairs = _expected(score, moves, m)
            error = (np.eye(3)[y] - marginal) * m[..., None]
            flat = np.repeat(error.reshape(-1, 3), x.shape[2], 0)
            grad = np.stack([np.bincount(x.ravel(), flat[:, tag], SIZE + 1) for tag in range(3)], 1)
            grad = grad / len(part) - RIDGE * weights
            grad[SIZE] = 0
            both = m[:, 1:]
            counts = np.zeros((3, 3))
            np.add.at(counts, (y[:, :-1][both], y[:, 1:][both]), 1)
            step = (counts - pairs) / len(part) - RIDGE * moves
            seen += grad**2
            seen_moves += step**2
            weights += RATE * grad / np.sqrt(seen)
            moves += RATE * step / np.sqrt(seen_moves)
    return Model(weights[:SIZE].astype(np.float32), moves, uuid.uuid4().hex)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _expected(score: np.ndarray, moves: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums: each place's tag probabilities, and the expected number of each move in all chains."""
    n, length, _ = score.shape
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    for i in range(1, length):
        ahead[:, i] = np.where(real[:, i, None], _log_sum(ahead[:, i - 1, :, None] + moves, 1) + score[:, i], ahead[:, i - 1])
    for i in range(length - 2, -1, -1):
        behind[:, i] = np.where(real[:, i + 1, None], _log_sum(moves + (score[:, i + 1] + behind[:, i + 1])[:, None, :], 2), 0)
    total = _log_sum(ahead[:, -1], 1)
    marginal = np.exp(ahead + behind - total[:, None, None])
    pairs = ahead[:, :-1, :, None] + moves + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
    return marginal, (np.exp(np.minimum(pairs, 0)) * real[:, 1:, None, None]).sum((0, 1))


def viterbi(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of one chain (length x 3)."""
    best, back = score[0], np.zeros(score.shape, np.int8)
    for i in range(1, len(score)):
        way = best[:, None] + moves
        back[i] = way.argmax(0)
        best = way.max(0) + score[i]
    out = np.zeros(len(score), np.int64)
    out[-1] = best.argmax()
    for i in range(len(score) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


class Tagger:
    """Decodes many texts with one model."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known = Tokens()
        self.scores, self.shape_scores = np.zeros((1, PLACES, 3), np.float32), np.zeros((1, 3), np.float32)

    def _look(self) -> None:
        """Scores of what is new, for each place."""
        w, k = self.model.weights, self.known
        if len(k.shape_list) > len(self.shape_scores):
            more = np.array([w[f].sum(0) for f in k.shape_list[len(self.shape_scores) :]], np.float32)
            self.shape_scores = np.concatenate([self.shape_scores, more])
        first = len(self.scores)
        new = w[place_features(k.word[first:])]
        new[:, 0] += self.shape_scores[k.shape[first:]]
        self.scores = np.concatenate([self.scores, new])

    def tags(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the tags, starts and ends of its tokens."""
        if len(self.known.numbers) > KEPT_TOKENS:
            self.forget()
        read = self.known.read(texts)
        if len(self.known.size) > len(self.scores):
            self._look()
        gap, parts, begin, at = np.zeros(3, np.int64), [], [], 0
        for ids, _ in read:
            parts += [gap, ids]
            begin.append(at + 3)
            at += 3 + len(ids)
        ids = np.concatenate([*parts, gap])
        score = self.scores[ids, 0]
        for back, place in ((1, 1), (2, 2), (3, 3)):
            score[back:] += self.scores[ids[:-back], place]
        score[:-1] += self.scores[ids[1:], 4]
        out = []
        for i, (own, starts) in zip(begin, read, strict=True):
            part = score[i : i + len(own)]
            part += self.model.weights[self.known.file(own)].sum(0)
            out.append((self._decoded(part), starts, starts + self.known.size[own]))
        return out

    def _decoded(self, score: np.ndarray) -> np.ndarray:
        tags = np.zeros(len(score), np.int64)
        at = np.flatnonzero(score[:, OUT] - np.maximum(score[:, BEGIN], score[:, INSIDE]) <= self.model.sure)
        if len(at):
            # A stretch has sure places on both sides, which are outside, unless the text ends there.
            for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                low, high = max(0, part[0] - 1), min(len(score), part[-1] + 2)
                own = score[low:high].copy()
                if part[0] > 0:
                    own[0, 1:] = -np.inf
                if part[-1] + 1 < len(score):
                    own[-1, 1:] = -np.inf
                tags[low:high] = viterbi(own, self.model.moves)
        return tags


def tagged_spans(tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of begin and inside; an inside after outside begins one too."""
    out: list[list[int]] = []
    last = OUT
    for k in np.flatnonzero(tags):
        if out and tags[k] == INSIDE and last == k - 1:
            out[-1][1] = int(ends[k])
        else:
            out.append([int(starts[k]), int(ends[k])])
        last = k
    return [tuple(s) for s in out]


_TAGGERS: dict[str, Tagger] = {}
_SPAN = T.StructType().add("kind", T.IntegerType()).add("start", T.LongType()).add("end", T.LongType())


def all_spans(texts: list[str], model: Model | None) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of each text: base spans by start and kind, then the field's by start."""
    out = [[(kind, start, end) for start, kind, end, _ in base_spans(t)] for t in texts]
    if model is None:
        return out
    if model.name not in _TAGGERS:  # one for each Python worker
        _TAGGERS.clear()
        _TAGGERS[model.name] = Tagger(model)
    for spans, tagged in zip(out, _TAGGERS[model.name].tags(texts), strict=True):
        base = list(spans)
        spans += [(CRF, i, j) for i, j in tagged_spans(*tagged) if not any(i < e and s < j for _, s, e in base)]
    return out


def finder(model: Model | None):  # noqa: ANN201
    """A function of a text column: array<struct<kind, start, end>>."""
    from .token_shards import chunks

    def find(texts: pa.Array) -> pa.Array:
        rows, out = texts.fill_null("").to_pylist(), []
        for i, j in chunks(list(map(len, rows)), CHUNK_CHARS):
            out += [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in all_spans(rows[i:j], model)]
        return pa.array(out, pa.list_(to_arrow_type(_SPAN)))

    return F.arrow_udf(find, T.ArrayType(_SPAN))


def _marked(text: Column) -> Column:
    """Whether a text holds what a base span begins with; looked for only where a cheaper search finds a part of it."""
    low = F.lower(text)
    word = F.lit(False)
    for k in _KEYWORDS:
        word = word | F.contains(low, F.lit(k))
    assign = F.when(word, low.rlike(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")).otherwise(F.lit(False))
    return assign | F.contains(text, F.lit("AKIA")) | text.rlike("[0-9a-f]{24}")


def model_of(docs: DataFrame, positive: int = MAX_POSITIVE, other: int = MAX_OTHER) -> Model | None:
    """Trained on a sample of docs (doc_id, text). Only keys and marks of all rows are written, and only the sample's texts are gathered."""
    text = docs["text"].cast("string")
    key = F.xxhash64(docs["doc_id"], text)
    keys = written(docs.where(text.isNotNull()).select(key.alias("key"), _marked(text).alias("marked")), "secret-keys")
    chosen = []
    for marked, n in ((True, positive), (False, other)):
        own = F.col("marked") if marked else ~F.col("marked")
        chosen += [(r["key"], marked) for r in keys.where(own).select("key").distinct().orderBy("key").limit(n).collect()]
    if not chosen:
        return None
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "key long, marked boolean"))  # at most positive + other keys
    rows = docs.select(key.alias("key"), text.alias("text")).join(picked, "key").dropDuplicates(["key"]).orderBy(F.desc("marked"), "key")
    return train([r["text"] for r in rows.select("text").collect()])


def with_spans(docs: DataFrame, model: Model | None, name: str = "spans") -> DataFrame:
    return docs.withColumn(name, finder(model)(docs["text"].cast("string")))


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text and any others) with "[SECRET]" in place of each span; overlapping spans are one."""

    def clean(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        out = []
        for text, spans in zip(rows, all_spans([t or "" for t in rows], model), strict=True):
            parts, at = [], 0
            for start, end in sorted((s, e) for _, s, e in spans):
                if start >= at:
                    parts += [text[at:start], "[SECRET]"]
                at = max(at, end)
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn("text", F.arrow_udf(clean, T.StringType())(docs["text"].cast("string")))


def _count(kind: int) -> Column:
    return F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, model_of(docs), "s")
    names = F.array(*map(F.lit, (*KINDS, "crf")))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("s", lambda s: s["kind"] < CRF)
    by_start = F.transform(F.array_sort(F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: s)
    return found.select("doc_id", *map(_count, range(len(KINDS))), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(by_start).alias("spans"))
