"""Near duplicates: bottom-k sketches from one hash function, inverted lists, union-sketch estimation, exact Jaccard.

Each document's set of shingles (runs of `width` words, hashed to 63 bits) is reduced to its k least hashes. Equal sets are one class
from then on; classes are linked if their Jaccard similarity is at least percent / 100, and documents with linked classes are near
duplicates, also through others.

A link means that of the k least hashes of the union at least `need` are in both sketches. Sketches with so many values in common share
SHARED of the k - need + SHARED that come first in any one order; the rarest come first here. Inverted lists of those values hold every
candidate pair. A value counts for a class only if another class of like size has it; classes with too few such values leave.

A list isn't expanded into pairs. Its pivot, the class with the most values, stands for it, and all lists of a pivot are one group, so
that a pair with a list in common is in a group together. First each class meets its pivots only. The links found are joined to
components, and a group of one component is done. In the groups that are left all members of different components are compared, in
blocks of at most 2 * block classes at a time, whatever the size of the group. Of what is compared

* classes whose first values overlap too little leave (rows carry those values only),
* the others' whole sets are fetched; a pair is estimated on the union's sketch, and verified on the sets,
* pairs that other links already join are passed over, so that a block returns fewer links than it has classes.

Nowhere are pairs rows of a table, but for the links. A group whose members are mostly just under the threshold costs comparisons with
the square of its members.

Words are runs of other characters than white space, A-Z in lower case. A text with fewer words than `width` has its whole sequence
as its one shingle. Nulls: a null or empty text has no shingle and no link; a null doc_id gives no component its name, and alone it
has a null component. Rows are classed one by one, so repeated rows and repeated doc_ids need no care; very long texts have longer sets
and sketches of the same size. Only doc_id and text are read, so other columns can have any names. Empty input, empty output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .shared import free, row_count, small, table, written

WIDTH, PERCENT, K, BLOCK = 5, 80, 96, 256
#: So many of their rarest values two linked classes share (fewer if the sketch is short).
SHARED = 8
#: Chance that a pair at the very threshold is missed; above it the chance falls fast.
CHANCE = 2e-8
_PRIME, _KEPT_WORDS, _ROWS, _PAIRS = np.uint64(0x9E3779B97F4A7C15), 150_000, 500, 4096
_KEYS = ("p", "z", "i", "j")


def needed(k: int, percent: int) -> int:
    """Values of a union's sketch that a pair at the threshold has in common, but for CHANCE."""
    p, total, need = percent / 100, 0.0, 0
    while need < k and (total := total + math.comb(k, need) * p**need * (1 - p) ** (k - need)) <= CHANCE:
        need += 1
    return max(1, need)


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, width: int, known: _Words) -> np.ndarray:
    """The sorted distinct shingles of a text, as 63-bit hashes."""
    if len(known) > _KEPT_WORDS:
        known.clear()
    words = text.lower().split()  # of bytes: A-Z, and white space as in the contract
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) == 0:
        return np.empty(0, np.int64)
    run = min(width, len(h))
    out = np.full(len(h) - run + 1, run, np.uint64)
    for i in range(run):
        out = out * _PRIME + h[i : len(h) - run + 1 + i]
    return np.unique(_mixed(out) >> np.uint64(1)).astype(np.int64)


def _sums(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    u = s.astype(np.uint64)
    return int(u.sum().astype(np.int64)), int(_mixed(u + _PRIME).sum().astype(np.int64))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at a time: what is made of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield batch.slice(i, _ROWS)


def _sketched(rows: DataFrame, width: int, k: int) -> DataFrame:
    """rows: doc_id, text_hash, text. In place of the text: n, s1, s2 (the set's size and sums) and its k least values."""
    schema = T.StructType(rows.schema.fields[:2]).add("n", T.LongType()).add("s1", T.LongType()).add("s2", T.LongType()).add("sketch", T.ArrayType(T.LongType()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in _small(batches):
            n, sums, least = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                s = shingle_set(text.as_py() or b"", width, known)
                n.append(len(s))
                sums.append(_sums(s))
                least.append(s[:k])
            ends = np.cumsum([0, *map(len, least)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *least])))
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(sketch, schema)


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    """rows: cid, n, text. The whole set in place of the text."""
    schema = T.StructType().add("cid", T.LongType()).add("n", T.LongType()).add("shingles", T.ArrayType(T.LongType()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in _small(batches):
            own = [shingle_set(t.as_py() or b"", width, known) for t in batch.column(2).cast(pa.binary())]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *own])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], schema.names)

    return rows.mapInArrow(sets, schema)


def _bucket(n: Column, percent: int) -> Column:
    """Sizes of linked classes are in the same bucket or in two adjacent ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent * 1.01)).cast("int")


def _first_values(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """A written table of the classes that can have links: cid, n, b (its bucket), few (so many of its values any linked class has too)
    and values, the rarest of those that others have."""
    need, p = needed(k, percent), percent / 100
    values = classes.select("cid", _bucket(F.col("n"), percent).alias("b"), F.explode("sketch").alias("value"))
    # A class's own values come first in its order; only their number matters. Two classes of other sizes have nothing in common either.
    counts = values.groupBy("value").agg(F.count("*").cast("int").alias("times"), F.min("b").alias("low"), F.max("b").alias("high"))
    counts = counts.where((F.col("times") > 1) & ((F.col("times") > 2) | (F.col("high") - F.col("low") < 2))).select("value", "times")
    ranked = values.drop("b").join(counts, "value").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("times", "value"))).alias("shared"))
    ranked = ranked.join(classes.select("cid", F.col("n").cast("int").alias("n")), "cid")
    size = F.least("n", F.lit(k))
    own = size - F.size("shared")
    full = F.ceil(F.col("n") * F.lit(percent) / 100)
    least = F.when(F.col("n") < k * p, full).otherwise(F.least(full, F.lit(need)))
    few = F.least(F.lit(SHARED), least).cast("int")
    first = F.slice("shared.value", 1, F.greatest(F.lit(0), size - least + few - own).cast("int"))
    rows = ranked.select("cid", "n", _bucket(F.col("n"), percent).alias("b"), few.alias("few"), first.alias("values"))
    rows = written(rows.where(F.size("values") >= F.col("few")), "near-values")
    # Of these values only those count that a class of like size has among its own.
    one = rows.select("cid", "b", F.explode("values").alias("value"))
    counts = one.groupBy("value", "b").count()
    around = counts.select("value", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), "count").groupBy("value", "b").agg(F.sum("count").alias("like"))
    kept = one.join(around.where(F.col("like") > 1).drop("like"), ["value", "b"]).groupBy("cid").agg(F.collect_list("value").alias("values"))
    rows = rows.drop("values").join(kept, "cid").where(F.size("values") >= F.col("few"))
    return written(rows, "near-values")


def _groups(rows: DataFrame) -> DataFrame:
    """A written table of the groups' members: p (the pivot), cid, b."""
    lists = rows.select("cid", "b", (-F.size("values")).alias("less"), F.explode("values").alias("value"))
    heads = lists.groupBy("value").agg(F.min(F.struct("less", "cid"))["cid"].alias("p"), F.count("*").alias("members")).where(F.col("members") > 1)
    return written(lists.join(heads.select("value", "p"), "value").select("p", "cid", "b").distinct(), "near-groups")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sets_of(cids: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The whole sets of classes, from the text of one document of each, as a written table: cid, n, shingles."""
    used = cids.join(classes.select("cid", "n", "rep"), "cid").select("cid", "n", F.col("rep.doc_id").alias("d"), F.col("rep.text_hash").alias("h"))
    used = written(used, "near-reps")
    texts = docs.join(small(used), docs["doc_id"].eqNullSafe(F.col("d")) & (docs["text_hash"] == F.col("h"))).select("cid", "n", "text")
    sets = written(_with_sets(texts, width), "near-sets")
    twice = row_count(sets) != row_count(used)  # repeated rows of a representative
    return sets if not twice else written(sets.dropDuplicates(["cid"]), "near-sets")


def _star_blocks(groups: DataFrame, rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Each class with its pivots, so many to a block: p, z (-1), i, j, side (0: the pivot, 1: the others), cid, label."""
    sizes = rows.select("cid", "n")
    pairs = groups.select("p", "cid").where(F.col("p") != F.col("cid")).distinct()
    pairs = pairs.join(sizes, "cid").join(sizes.select(F.col("cid").alias("p"), F.col("n").alias("p_n")), "p")
    pairs = written(pairs.where(_sizes_fit(F.col("n"), F.col("p_n"), percent)).select("p", "cid"), "near-stars")
    large = written(pairs.groupBy("p").count().where(F.col("count") > block).select("p", F.ceil(F.col("count") / block).alias("blocks")), "near-large")
    placed = pairs.join(small(large), "p", "left").select("p", F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).alias("i"), F.lit(1).alias("side"), "cid")
    pivots = placed.select("p", "i").distinct().select("p", "i", F.lit(0).alias("side"), F.col("p").alias("cid"))
    return placed.union(pivots).select("p", F.lit(-1).cast("long").alias("z"), "i", F.lit(0).cast("long").alias("j"), "side", "cid", F.col("cid").alias("label"))


def _rest_blocks(groups: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """The groups that aren't done, without their pivots, in pairs of blocks: p, z, i, j, side (0, 1, or 2 for both), cid, label. A
    group falls into parts by size: of part z are the pairs whose larger bucket is z."""
    rest = groups.where(F.col("p") != F.col("cid")).join(small(labels), "cid", "left")
    rest = rest.select("p", "cid", "b", F.coalesce("label", "cid").alias("label"), F.explode(F.array(F.col("b").cast("long"), F.col("b").cast("long") + 1)).alias("z"))
    parts = rest.groupBy("p", "z").agg(F.count("*").alias("count"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("b").alias("top"))
    parts = parts.where((F.col("low") != F.col("high")) & (F.col("top") == F.col("z"))).select("p", "z", F.ceil(F.col("count") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    rest = rest.join(small(written(parts, "near-parts")), ["p", "z"])
    rest = rest.select("p", "z", "cid", "label", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    return rest.select("p", "z", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "cid", "label")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by _KEYS (the first columns) as tables of whole groups, each with the places where its groups begin and end."""
    rest = None
    for batch in _small(batches):
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        keys = np.stack([rows.column(c).to_numpy() for c in _KEYS])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if len(cuts):
            yield rows.slice(0, cuts[-1]), np.concatenate([[0], cuts])
        rest = rows.slice(cuts[-1]) if len(cuts) else rows
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _arrays(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays, and where each row's begin and end."""
    own = column.combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    ends = own.offsets.to_numpy()
    return own.values.to_numpy(zero_copy_only=False), ends


def _asked(rows: dict[str, np.ndarray], at: slice, percent: int) -> np.ndarray:
    """Which pairs of a group's rows are to be compared (a symmetric matrix)."""
    n, b, z, side, label = (rows[c][at] for c in ("n", "b", "z", "side", "label"))
    fit = np.minimum.outer(n, n) * 100 >= np.maximum.outer(n, n) * percent
    fit &= (side[:, None] != side) | (side == 2)
    fit &= label[:, None] != label
    return fit & ((z[0] < 0) | (np.maximum.outer(b, b) == z[0]))


_COLUMNS = (*_KEYS, "side", "cid", "label", "n", "b")
_PLACED = "p long, z long, i long, j long, side int, cid long, label long, n int, b int"


def _likely(placed: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """A written table of the rows of blocks (as of _star_blocks) that share enough first values with another row they are to meet."""
    brief = F.transform("values", lambda v: (v.bitwiseAND(F.lit((1 << 31) - 1))).cast("int")).alias("values")  # a clash of two only adds a pair
    placed = placed.join(rows.select("cid", "n", "b", "few", brief), "cid").select(*_COLUMNS, "few", "values")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_, bounds in _by_group(batches):
            own = {c: table_.column(c).to_numpy() for c in (*_COLUMNS, "few")}
            values, ends = _arrays(table_.column("values"))
            keep = np.zeros(table_.num_rows, bool)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                at = slice(low, high)
                ask = _asked(own, at, percent) if high - low > 1 else np.zeros((1, 1), bool)
                if ask.any():
                    few = own["few"][at]
                    keep[at] = (ask & (_overlaps(values, ends[low : high + 1]) >= np.minimum.outer(few, few))).any(1)
            if keep.any():
                yield from table_.select(list(_COLUMNS)).filter(pa.array(keep)).combine_chunks().to_batches()

    dealt = placed.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return written(dealt.mapInArrow(pick, _PLACED), "near-likely")


def _overlaps(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many values each two of the rows have in common."""
    names, place, times = np.unique(values[ends[0] : ends[-1]], return_inverse=True, return_counts=True)
    row, out = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), np.zeros((len(ends) - 1,) * 2, np.float32)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    for first in range(0, int(number.max()) + 1, 4096):
        has = (number >= first) & (number < first + 4096)
        part = np.zeros((len(out), min(4096, len(names))), np.float32)
        part[row[has], number[has] - first] = 1
        out += part @ part.T
    return out


def _estimated(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, need: int, percent: int) -> np.ndarray:
    """Which pairs (a, b: rows of padded sketches) have enough values of the union's sketch in common."""
    k, out = sketches.shape[1], []
    for first in range(0, len(a), _PAIRS):
        x, y = a[first : first + _PAIRS], b[first : first + _PAIRS]
        both = np.sort(np.concatenate([sketches[x], sketches[y]], 1), 1)
        common = np.zeros(both.shape, bool)
        common[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)
        # Padding is negative and stands first; distinct values are counted after it.
        distinct = np.cumsum((both >= 0) & ~common, 1)
        union = np.minimum(k, distinct[:, -1])
        found = (common & (distinct <= k)).sum(1)
        out.append(found >= np.minimum(need, -(-union * percent // 100)))
    return np.concatenate(out) if out else np.zeros(0, bool)


def _group_links(sets: list[np.ndarray], cids: np.ndarray, ask: np.ndarray, k: int, percent: int) -> list[tuple[int, int]]:
    """Links of a group that join what no other of them joins."""
    sketches = np.full((len(sets), k), -1, np.int64)
    for i, s in enumerate(sets):
        sketches[i, : min(k, len(s))] = s[:k]
    a, b = np.nonzero(np.triu(ask, 1))
    good = _estimated(sketches, a, b, needed(k, percent), percent)
    parent, out = list(range(len(sets))), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a[good].tolist(), b[good].tolist(), strict=True):
        if top(i) != top(j):
            x, y = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if both * 100 >= (len(x) + len(y) - both) * percent:
                parent[top(i)] = top(j)
                out.append((min(cids[i], cids[j]), max(cids[i], cids[j])))
    return out


def _links(likely: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """A written table of links (a, b) that join all classes of these blocks that are linked."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_, bounds in _by_group(batches):
            own = {c: table_.column(c).to_numpy() for c in _COLUMNS}
            values, ends = _arrays(table_.column("shingles"))
            out: list[tuple[int, int]] = []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                at = slice(low, high)
                if high - low > 1 and (ask := _asked(own, at, percent)).any():
                    out += _group_links([values[ends[i] : ends[i + 1]] for i in range(low, high)], own["cid"][at], ask, k, percent)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in out], pa.int64()), pa.array([int(y) for _, y in out], pa.int64())], ["a", "b"])

    dealt = sets.select("cid", "shingles").join(small(likely), "cid").select(*_COLUMNS, "shingles").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return written(dealt.mapInArrow(verify, "a long, b long"), "near-links")


def _linked(classes: DataFrame, docs: DataFrame, width: int, percent: int, k: int, block: int) -> DataFrame:
    """For each class that is linked: cid, label. classes: a written table; docs: doc_id, text_hash, text."""
    rows = _first_values(classes, k, percent)
    groups = _groups(rows)
    likely = _likely(_star_blocks(groups, rows, percent, block), rows, percent)
    sets = _sets_of(likely.select("cid").distinct(), classes, docs, width)
    stars = _links(likely, sets, k, percent)
    labels = connected(stars).select(F.col("node").alias("cid"), "label")
    likely = _likely(_rest_blocks(groups, written(labels, "near-labels"), block), rows, percent)
    more = likely.select("cid").distinct().join(sets.select("cid"), "cid", "left_anti")
    rest = _links(likely, sets.unionByName(_sets_of(more, classes, docs, width)), k, percent)
    return connected(stars.unionByName(rest)).select(F.col("node").alias("cid"), "label")


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, k: int = K, block: int = BLOCK) -> DataFrame:
    """A written table with a row for each row of docs (doc_id, text): doc_id, text_hash, n_shingles, class (of equal
    sets) and label (of linked classes; both null without shingles), component_id (the least doc_id that it reaches, its own
    included), kept (doc_id is component_id)."""
    rows = docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].cast("string").alias("text"))
    sketched = written(_sketched(rows, width, k), "near-sketches")
    rep = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    classes = sketched.where(F.col("n") > 0).groupBy("n", "s1", "s2").agg(rep, F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    linked = _linked(classes, rows, width, percent, k, block)
    named = classes.select("n", "s1", "s2", "cid", "least").join(linked, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = written(named, "near-named")
    names = written(named.groupBy("label").agg(F.min("least").alias("component_id")), "near-names")
    named = written(named.join(small(names), "label").select("n", "s1", "s2", "cid", "label", "component_id"), "near-components")
    out = sketched.select("doc_id", "text_hash", "n", "s1", "s2").join(small(named), ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("cid").alias("class"), "label", component.alias("component_id"))
    return written(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-result")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """One row of docs (doc_id, text and any others) for each group of near duplicates: that of its least doc_id, columns as they were.
    Of several rows with that doc_id it is the one with the least hash of its text, of equal ones any. Rows without shingles stay."""
    found = components(docs.select("doc_id", "text"), **options)
    # The row to keep of each group. Rows without shingles are no one's duplicates.
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    found = found.where(F.col("label").isNotNull())
    best = found.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("rows")).where(F.col("rows") > 1)
    gone = found.join(small(written(best, "near-best")), "label").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_hash").eqNullSafe(F.col("best.text_hash"))))
    d, h = free(docs, "gone_doc"), free(docs, "gone_hash")
    text_hash = F.xxhash64(docs["text"])
    same = docs["doc_id"].eqNullSafe(F.col(d)) & (text_hash == F.col(h))
    gone = small(written(gone.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct(), "near-gone"))
    rows = docs.join(gone, same, "left_anti")
    twice = written(found.groupBy("doc_id", "text_hash").count().where(F.col("count") > 1).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)), "near-twice")
    if row_count(twice):
        again, key = small(twice), free(docs, "row_hash")
        equal = rows.join(again, same, "left_semi").withColumn(key, text_hash).dropDuplicates(["doc_id", key]).drop(key)
        rows = rows.join(again, same, "left_anti").unionByName(equal)
    return rows
