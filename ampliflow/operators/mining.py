"""Mining: partial matches that resemble a specimen's full matches, by edit distance of the full read inside the partial one."""

from __future__ import annotations

import glob
import logging
import os
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliflow.operators.align import end_scores, equalities, packed
from ampliflow.operators.outputs import place_texts
from ampliflow.sources.tables import Design

log = logging.getLogger("ampliflow")


#: Reads of a key that meet in one task: partial ones, full ones. Pairs that are verified together, and letters of a seed at most.
PARTIALS, FULLS, PAIRS, SEED = 256, 1024, 512, 32
#: Identities that are tried one after the other, above the least that is asked for.
STEPS = (0.97, 0.94, 0.9)


def infix_distances(patterns: list[bytes], texts: list[bytes], pairs: list[tuple[int, int]]) -> list[int]:
    """Least edits of a pattern in any part of a text, for pairs of places in the two lists: many at a time, by bit-parallel columns of
    as many words as the patterns need."""
    out = [0] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda n: (len(patterns[pairs[n][0]]), len(texts[pairs[n][1]])))
    for at in range(0, len(order), PAIRS):
        own = [n for n in order[at : at + PAIRS] if patterns[pairs[n][0]]]  # an empty pattern is found anywhere
        used = sorted({pairs[n][0] for n in own})
        tables = [equalities(patterns[p].decode("latin-1"), ambiguous=False) for p in used]
        words, place = max((t.shape[1] for t in tables), default=1), {p: k for k, p in enumerate(used)}
        equal = np.zeros((len(used), 256, words), np.uint64)
        for k, t in enumerate(tables):
            equal[k, :, : t.shape[1]] = t
        rows, size = packed([texts[pairs[n][1]] for n in own])
        lengths = np.array([len(patterns[pairs[n][0]]) for n in own])
        if rows.shape[1]:
            least = end_scores(rows, size, equal, lengths, False, np.array([place[pairs[n][0]] for n in own])).min(1)
            lengths = np.minimum(lengths, least)
        for n, d in zip(own, lengths.tolist(), strict=True):
            out[n] = d
    return out


def seeded(patterns: list[bytes], identity: float) -> tuple[dict[int, dict[bytes, list[tuple[int, int]]]], list[int]]:
    """An inverted index of patterns: by length of seed, from seed to (pattern, its place there); and the edits allowed to each pattern.
    A pattern with k edits allowed is cut into k + 1 pieces, of which one at least stays as it is; a piece's first letters are its seed."""
    index: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    allowed = []
    for n, pattern in enumerate(patterns):
        k = int(len(pattern) * (1 - identity) + 1e-9)
        allowed.append(k)
        size = len(pattern) // (k + 1)
        own = index.setdefault(min(size, SEED), {})
        for place in range(0, size * (k + 1), size) if size else (0,):
            own.setdefault(pattern[place : place + min(size, SEED)], []).append((n, place))
    return index, allowed


def candidates_of(text: bytes, index: dict[int, dict[bytes, list[tuple[int, int]]]], patterns: list[bytes], allowed: list[int]) -> set[int]:
    """The patterns that have a seed in the text from where they fit: what is before and after the seed must find its letters there, but
    for the edits allowed."""
    found: set[int] = set()
    for size, own in index.items():
        if not size:
            found.update(n for places in own.values() for n, _ in places)
            continue
        for at in range(len(text) - size + 1):
            for n, place in own.get(text[at : at + size], ()):
                k = allowed[n]
                if place - at <= k and len(patterns[n]) - place - (len(text) - at) <= k:
                    found.add(n)
    return found


def nearest(partials: list[bytes | None], patterns: list[bytes], ranks: list[int], min_identity: float) -> list[tuple[tuple[float, int] | None, int]]:
    """For each partial read (identity, place) of the most similar pattern of least rank, or None, and how many pairs were verified.

    Similarity is tried from high to low: at a high identity seeds are long and few patterns have one by chance. What is found at or
    above an identity is the most similar of all, since all others that are as similar have a seed at that identity too."""
    best: list[tuple[float, int, int] | None] = [None] * len(partials)
    verified: list[set[int]] = [set() for _ in partials]
    asked = [n for n, seq in enumerate(partials) if seq is not None]
    for identity in [x for x in STEPS if x > min_identity] + [min_identity]:
        if not asked:
            break
        index, allowed = seeded(patterns, identity)
        pairs = []
        for n in asked:
            new = candidates_of(partials[n], index, patterns, allowed) - verified[n]
            verified[n] |= new
            pairs += [(p, n) for p in sorted(new)]
        for (p, n), d in zip(pairs, infix_distances(patterns, partials, pairs), strict=True):
            own = (1 - d / len(patterns[p]), -ranks[p], p)
            if d <= int(np.floor(len(patterns[p]) * (1 - min_identity))) and own[0] >= min_identity and (best[n] is None or own > best[n]):
                best[n] = own
        asked = [n for n in asked if best[n] is None or best[n][0] < identity]
    return [(b and (b[0], b[2]), len(v)) for b, v in zip(best, verified, strict=True)]


def nearest_fulls(partials: DataFrame, fulls: DataFrame, min_identity: float = 0.85, n_partials: int = PARTIALS, n_fulls: int = FULLS) -> DataFrame:
    """For each partial read (key, read_id, side, seq) its nearest full read (key, read_id, seq) of the same key: key, read_id, side,
    identity, full_id, the first of equals, and candidates, the full reads that it was compared with. Reads of a key meet in blocks, so a
    hot key spreads over tasks; in a block candidates come from an inverted index of seeds, and pairs never become rows."""
    sizes = fulls.groupBy("key").agg(F.ceil(F.count("*") / n_fulls).alias("f_blocks")).join(partials.groupBy("key").agg(F.ceil(F.count("*") / n_partials).alias("p_blocks")), "key")
    place = lambda n, *c: F.pmod(F.xxhash64(*c), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = partials.select("key", "read_id", "side", "seq").join(sizes, "key").withColumns({"p": place(F.col("p_blocks"), "read_id", "side")}).withColumn("f", every(F.col("f_blocks")))
    right = fulls.select("key", "read_id", "seq").join(sizes, "key").withColumns({"f": place(F.col("f_blocks"), "read_id")}).withColumn("p", every(F.col("p_blocks")))

    def meet(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        first: dict[bytes, int] = {}
        for full_id, seq in zip(known["full_id"], known["full_seq"], strict=True):
            letters = seq.encode("latin-1", "replace") if seq else b""
            if letters and (letters not in first or full_id < first[letters]):
                first[letters] = full_id
        patterns, ranks = list(first), list(first.values())
        texts = [None if seq is None else seq.encode("latin-1", "replace") for seq in asked["seq"]]
        found = nearest(texts, patterns, ranks, min_identity)
        out = asked[["key", "read_id", "side"]].assign(identity=[b[0] if b else None for b, _ in found], full_id=[ranks[b[1]] if b else None for b, _ in found], candidates=[n for _, n in found])
        return out.astype({"read_id": "int64", "identity": "float64", "full_id": "Int64", "candidates": "int64"})

    left = left.select("key", "p", "f", "read_id", "side", "seq")
    right = right.select(F.col("key").alias("f_key"), F.col("p").alias("f_p"), F.col("f").alias("f_f"), F.col("read_id").alias("full_id"), F.col("seq").alias("full_seq"))
    blocks = left.groupBy("key", "p", "f").cogroup(right.groupBy("f_key", "f_p", "f_f"))
    found = blocks.applyInPandas(meet, f"key {partials.schema['key'].dataType.simpleString()}, read_id long, side string, identity double, full_id long, candidates long")
    order = F.when(F.col("full_id").isNotNull(), F.struct("identity", -F.col("full_id")))
    best = found.groupBy("key", "read_id", "side").agg(F.max_by(F.struct("identity", "full_id"), order).alias("best"), F.sum("candidates").alias("candidates"))
    return best.where(F.col("best.full_id").isNotNull()).select("key", "read_id", "side", "best.*", "candidates")


def mine(partials: DataFrame, fulls: DataFrame, min_identity: float = 0.85) -> DataFrame:
    """partials: key, read_id, seq_id, description, seq, qual, side (forward, reverse); fulls: key, read_id, seq. For each partial read
    that is similar enough to a full read of its key, the nearest one (the first of equals): new seq_id, identity, full_id."""
    out = partials.join(nearest_fulls(partials, fulls, min_identity), ["key", "read_id", "side"])
    score = F.format_string("%.2f", F.col("identity"))
    out = out.withColumn("seq_id", F.concat_ws("_", "seq_id", F.lit("mined"), "side", score))
    return out.withColumn("description", F.concat_ws(" ", F.coalesce("description", F.lit("")), F.concat(F.lit("mined_"), "side"), F.concat(F.lit("identity="), score)))


def partials_of(facts: DataFrame, design: Design, specimen_id: str, forward: bool = False, reverse: bool = True, pool: str | None = None) -> DataFrame:
    """The partial matches of a specimen's barcodes, of one pool or all, from facts or a lake of them (partitions are pruned)."""
    s = next((s for s in design.specimens if s.specimen_id == specimen_id), None)
    if s is None:
        raise ValueError(f"there is no specimen {specimen_id}")
    names = [("forward", f"barcode_fwd_{s.b1}")] * forward + [("reverse", f"barcode_rev_{s.b2}")] * reverse
    side: Column = F.lit(None).cast("string")
    for kind, name in names:
        side = F.when(F.col("sample") == name, kind).otherwise(side)
    rows = facts.where((F.col("match_type") == "partial") & F.col("sample").isin([n for _, n in names]))
    rows = rows.where(F.col("pool") == pool) if pool else rows
    return rows.withColumn("side", side)


def specimen_of_file(name: str) -> str:
    """sample_X.fastq or X.fastq: X."""
    found = re.search(r"(?:sample_)?(.+)\.fastq", name.rsplit("/", 1)[-1])
    if not found:
        raise ValueError(f"{name} is no FASTQ file of a specimen")
    return found[1]


def place_of_file(path: str) -> tuple[str, str, str | None]:
    """Of <root>/full/<pool>[/<pair>]/<file>: root, pool, and pair or None."""
    found = re.fullmatch(r"(?:(.*)/)?full/([^/]+)(?:/([^/]+))?/[^/]+", os.path.abspath(path))
    if not found:
        raise ValueError(f"{path} isn't in a pool's or a primer pair's folder under full/")
    return found[1] or "/", found[2], found[3]


def barcodes_of(spark: SparkSession, index: str, specimen_id: str) -> tuple[str, str]:
    """A specimen's barcodes in a table of specimens; without headers of these names they are columns 1, 3 and 5."""
    rows = spark.read.csv(index, sep="\t", header=True)
    named = lambda name, n: F.col(f"`{name if name in rows.columns else rows.columns[n]}`")
    own = rows.where(named("SampleID", 0) == specimen_id).select(F.upper(named("FwIndex", 2)), F.upper(named("RvIndex", 4))).first()
    if own is None or not (own[0] and own[1]):
        raise ValueError(f"{index} has no barcodes of a specimen {specimen_id}")
    return own[0], own[1]


def partial_files(path: str, b1: str, b2: str, forward: bool = False, reverse: bool = True) -> list[tuple[str, str]]:
    """(side, file) of a specimen's partial reads: of the file's primer pair, or of all pairs of its pool. Names with sample_ before them
    count where there are no others."""
    root, pool, pair = place_of_file(path)
    out = []
    for side, name in [("forward", f"barcode_fwd_{b1}.fastq")] * forward + [("reverse", f"barcode_rev_{b2}.fastq")] * reverse:
        folders = sorted(f for f in glob.glob(f"{glob.escape(root)}/partial/{glob.escape(pool)}/{glob.escape(pair) if pair else '*'}") if os.path.isdir(f))
        own = [next((f"{d}/{n}" for n in (name, f"sample_{name}") if os.path.exists(f"{d}/{n}")), None) for d in folders]
        if not any(own):
            log.warning("no %s partial reads of %s", side, name)
        out += [(side, f) for f in own if f]
    return out


def mine_file(spark: SparkSession, index: str, path: str, forward: bool = False, reverse: bool = True, min_identity: float = 0.85) -> int:
    """Mines the partial reads of a specimen for its full file and writes them to <path>.mined, in the order of their files. Returns how
    many they are."""
    from ampliflow.sources.sequences import read_sequences

    found = partial_files(path, *barcodes_of(spark, index, specimen_of_file(path)), forward, reverse)
    if not found:
        raise ValueError(f"there are no partial reads for {path}")
    parts = [read_sequences(spark, f).select(F.lit("k").alias("key"), (F.col("read_num") + (n << 40)).alias("read_id"), "seq_id", "description", "seq", "qual", F.lit(side).alias("side")) for n, (side, f) in enumerate(found)]
    fulls = read_sequences(spark, path).select(F.lit("k").alias("key"), F.col("read_num").alias("read_id"), "seq")
    rows = mine(reduce(DataFrame.unionByName, parts), fulls, min_identity)
    head = F.concat(F.lit("@"), "seq_id", F.lit(" "), F.btrim("description", F.lit(" \t\r\n")))
    text = F.concat_ws("\n", head, "seq", F.lit("+"), "qual", F.lit(""))
    if os.path.exists(f"{path}.mined"):
        os.remove(f"{path}.mined")
    folder, name = os.path.split(os.path.abspath(path))
    return place_texts(rows.select(F.lit(f"{name}.mined").alias("path"), "read_id", text.alias("text")), folder, ["read_id"])[1]
