"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Vectors are scaled to length 1, where the largest cosine is the least Euclidean distance. Each of TABLES tables hashes a vector to M
cells floor((a . v + b) / w) with Gaussian a; a bucket is a tuple of cells. A query visits its own bucket and those whose cells
differ by one step in some places, in the order of estimated success: least sum of squared distances to the borders crossed first.
Candidates of all tables are merged and the nearest reranked by their exact cosine in double precision.

M follows the logarithm of the number of vectors as far as MOST_PROBES probes of a table allow; M, the width w and the number of
probes are fitted to a sample of at most SAMPLE vectors and SAMPLE_QUERIES queries, so that RECALL of the sample's own neighbours are
found (those of all vectors are nearer, and so found more often); where no M does, w grows. Every vector is indexed. Queries whose
buckets hold fewer than k other rows are compared with all rows, in the same blocks.

Equal vectors: only the k + 1 with the least ids can be among anyone's k nearest, so the others leave before anything is hashed, and
equal queries are one. Each row is in one block of at most MEMBERS rows with the buckets of all its tables, which are made where the
block is, and each query goes to every block with the cost of its last probe in each table, from which its probes are made again there.
So a vector is written and dealt out once and a query as often as there are blocks; buckets and probes are never written. In a block the
cosines of a query are those with the members of the buckets it visits, and the k + 1 nearest return as ids and scores. Neither a large
bucket nor a query that visits many makes a block larger. More than QUERIES queries meet the blocks in several parts.

Only vec_id and embedding are read, so other columns can have any names. Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids or vectors of another length than
most. Repeated rows are rows of their own: a query's own row is the one that is left out. Empty input, empty output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import row_count, small, table, written

TABLES, RECALL, SAMPLE, SAMPLE_QUERIES, MOST_PROBES = 8, 0.95, 20_000, 100, 2048
MEMBERS, QUERIES, SEED, LEAST_M = 65_536, 65_536, 7, 4
#: Blocks have at least so many rows, unless their cores would wait; bytes of a block's vectors; cosines held at a time.
LEAST_MEMBERS, BLOCK_BYTES, CELLS = 8_192, 32 << 20, 1 << 22


@dataclass
class Index:
    """a: dimensions x (tables * m); b: offsets."""

    a: np.ndarray
    b: np.ndarray
    m: int
    width: float
    probes: int

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (rows x tables x m) and the places inside them, 0 to 1."""
        p = (vectors @ self.a + self.b) / self.width
        c = np.floor(p)
        shape = (len(vectors), -1, self.m)
        return c.astype(np.int64).reshape(shape), (p - c).reshape(shape)


def keys(cells: np.ndarray) -> np.ndarray:
    """A number for each tuple of cells along the last axis. Two buckets may share one; then both are looked at."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        h = _mixed(h, cells[..., i])
    return h.view(np.int64)


def _mixed(h: np.ndarray, cell: np.ndarray) -> np.ndarray:
    h = (h ^ cell.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def probe_steps(inside: np.ndarray, probes: int) -> np.ndarray:
    """The first `probes` tuples of steps (-1, 0, 1 in each place), least sum of squared border distances first."""
    # A first tuple's places up to any one are among the first of these places, so no more are kept.
    cost, steps = np.zeros(1), np.zeros((1, len(inside)), np.int8)
    for i, x in enumerate(inside):
        ways = np.add.outer([0.0, x**2, (1 - x) ** 2], cost).ravel()
        first = np.argpartition(ways, probes)[:probes] if len(ways) > probes else np.arange(len(ways))
        cost, steps = ways[first], steps[first % len(cost)]
        steps[:, i] = np.array([0, -1, 1], np.int8)[first // (len(ways) // 3)]
    return steps[np.argsort(cost, kind="stable")]


def probe_costs(inside: np.ndarray, probes: int) -> np.ndarray:
    """Of the first `probes` tuples of steps the cost of the last one, for each row of places."""
    cost = np.zeros((len(inside), 1))
    for x in inside.T:
        cost = np.hstack([cost, cost + (x**2)[:, None], cost + ((1 - x) ** 2)[:, None]])
        if cost.shape[1] > probes:
            cost = np.partition(cost, probes - 1, 1)[:, :probes]
    return cost.max(1)


def probe_keys(cells: np.ndarray, inside: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of cells, and the keys of all buckets whose steps cost each row its `most` at most."""
    most = most * (1 + 1e-9)  # sums may be rounded otherwise than where the costs were fixed
    who, cost, key = np.arange(len(cells)), np.zeros(len(cells)), np.zeros(len(cells), np.uint64)
    for i in range(cells.shape[1]):
        ways = [(who, cost, key, 0)]
        for step, more in ((-1, inside[:, i] ** 2), (1, (1 - inside[:, i]) ** 2)):
            total = cost + more[who]
            ok = total <= most[who]
            ways.append((who[ok], total[ok], key[ok], step))
        key = np.concatenate([_mixed(k, cells[w, i] + step) for w, _, k, step in ways])
        who, cost = (np.concatenate([way[n] for way in ways]) for n in (0, 1))
    return who, key.view(np.int64)


def fit(sample: np.ndarray, queries: np.ndarray, n: int, k: int) -> Index:
    """sample, queries: unit vectors; n: how many there are in all."""
    most = int(np.clip(round(math.log2(max(n, 2))) - 5, LEAST_M, 16))
    cosine = queries @ sample.T
    cosine[cosine > 1 - 1e-9] = -2  # a query's own row, and its copies
    nearest = np.argsort(-cosine, axis=1)[:, :k]
    near = np.take_along_axis(cosine, nearest, 1)
    ok = near > -2
    far = np.median(np.sqrt(np.maximum(0, 2 - 2 * near[ok]))) if ok.any() else 1.0
    width = 1.86 * max(far, 1e-3)
    # With LEAST_M all buckets one step away are visited, so that a width does at last.
    for m, wider in [*((m, 1.0) for m in range(most, LEAST_M - 1, -1)), *((LEAST_M, 1.5**i) for i in range(1, 40))]:
        rng, w = np.random.default_rng(SEED), width * wider
        index = Index(rng.normal(size=(sample.shape[1], TABLES * m)), rng.uniform(0, w, TABLES * m), m, w, MOST_PROBES)
        if not ok.any():
            return index
        needed = int(np.quantile(_ranks(index, sample, queries, nearest)[ok], RECALL, method="higher")) + 1
        if needed <= MOST_PROBES:
            index.probes = needed
            return index
    raise RuntimeError(f"{MOST_PROBES} probes of {TABLES} tables don't find {RECALL} of the sample's neighbours")


def _ranks(index: Index, sample: np.ndarray, queries: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """By how many probes before it each of the nearest (rows of sample by query) is found at first; MOST_PROBES if it isn't."""
    of_sample, (of_queries, inside) = index.cells(sample)[0], index.cells(queries)
    ranks, code = np.full(nearest.shape, MOST_PROBES), 3 ** np.arange(index.m)
    for q in range(len(queries)):
        for t in range(inside.shape[1]):
            steps = of_sample[nearest[q], t] - of_queries[q, t]
            close = np.abs(steps).max(1) <= 1
            if close.any():
                visited = probe_steps(inside[q, t], MOST_PROBES) @ code
                at = visited == (steps @ code)[:, None]
                ranks[q] = np.where(close & at.any(1), np.minimum(ranks[q], at.argmax(1)), ranks[q])
    return ranks


def _unit(x: np.ndarray | list) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    n = len(vectors)
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _fine(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _with_costs(rows: DataFrame, index: Index) -> DataFrame:
    """rows: id, v. With costs: what the last probe of each table costs."""

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                own = batch.slice(i, 64)
                inside = index.cells(_unit(_matrix(own.column(1))))[1]
                most = probe_costs(inside.reshape(-1, index.m), index.probes)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(most.reshape(len(inside), -1).tolist(), pa.list_(pa.float64()))], ["id", "v", "costs"])

    return rows.mapInArrow(costs, f"id long, v {rows.schema['v'].dataType.simpleString()}, costs array<double>")


class _Buckets:
    """The buckets of a block's rows (of length 1) in each table."""

    def __init__(self, index: Index, unit: np.ndarray):
        self.index, self.n = index, len(unit)
        own = np.concatenate([keys(index.cells(unit[i : i + 4096])[0]) for i in range(0, len(unit), 4096)])
        self.tables = []
        for key in own.T:
            order = np.argsort(key, kind="stable")
            names, first = np.unique(key[order], return_index=True)
            there = np.zeros(1 << 20, bool)  # by the first bits of a key, which leave out most of those that no row has
            there[names.view(np.uint64) >> np.uint64(44)] = True
            self.tables.append((names, np.append(first, self.n), order, there))

    def visited(self, asked: np.ndarray, costs: np.ndarray) -> np.ndarray:
        """For each query (of length 1) and row whether it is in a bucket that the query visits."""
        cells, inside = self.index.cells(asked)
        out = np.zeros((len(asked), self.n), bool)
        for t, (names, first, order, there) in enumerate(self.tables):
            who, key = probe_keys(cells[:, t], inside[:, t], costs[:, t])
            some = there[key.view(np.uint64) >> np.uint64(44)]
            who, key = who[some], key[some]
            at = np.minimum(np.searchsorted(names, key), len(names) - 1)
            same = names[at] == key
            who, at = who[same], at[same]
            size = first[at + 1] - first[at]
            place = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out[np.repeat(who, size), order[place]] = True
        return out


def _mid(x: np.ndarray) -> np.ndarray:
    """Rows, times a power of two where their squares would leave the range of doubles."""
    most = np.abs(x).max(1, keepdims=True)
    return x * np.where(most < 1e-100, 2.0**600, np.where(most > 1e100, 2.0**-600, 1.0))


def _dots(x: np.ndarray, y: np.ndarray, at: np.ndarray | slice = slice(None), to: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Of rows `at` of x and `to` of y, summed from the first component to the last."""
    total = x[at, 0] * y[to, 0]
    for d in range(1, x.shape[1]):
        total += x[at, d] * y[to, d]
    return total


def _best(best: int, index: Index | None):  # noqa: ANN202
    """Of a block and queries, for each query the best of the rows it visits, or of all without an index."""

    def block(members: pa.Table, queries: pa.Table) -> pa.Table:
        parts = [tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.float64))]
        if members.num_rows and queries.num_rows:
            ids, x = members["id"].to_numpy(), _matrix(members["v"])
            unit, mid = _unit(x), _mid(x)
            size, buckets = np.sqrt(_dots(mid, mid)), _Buckets(index, unit) if index else None
            step = max(1, min(128, CELLS // len(ids)))
            for i in range(0, queries.num_rows, step):
                own = queries.slice(i, step)
                y = _matrix(own["v"])
                asked, own_mid = _unit(y), _mid(y)
                own_size = np.sqrt(_dots(own_mid, own_mid))
                visited = buckets.visited(asked, _matrix(own["costs"])) if buckets else np.ones((len(y), len(ids)), bool)
                near = np.full(visited.shape, -2.0)  # of what isn't visited
                if visited.mean() > 0.1:  # then one product of all is quicker than those of the pairs
                    np.copyto(near, asked @ unit.T, where=visited)
                else:
                    for q, v in enumerate(visited):
                        near[q, v] = unit[v] @ asked[q]
                last = np.partition(near, -best, 1)[:, -best] if len(ids) > best else np.full(len(y), -2.0)
                # All that may be among the best are ordered by the exact measure.
                q, m = np.nonzero(near >= np.maximum(last - 1e-12, -1.5)[:, None])
                score = _dots(own_mid, mid, q, m) / (own_size[q] * size[m])
                order = np.lexsort((ids[m], -score, q))
                q, m, score = q[order], m[order], score[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < best
                q, m, score = q[first], m[first], score[first]
                parts.append((own["id"].to_numpy()[q], ids[m], (y[q] == x[m]).all(1), score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["q", "vec_id", "equal", "score"])

    return block


def _found(rows: DataFrame, asked: DataFrame, best: int, index: Index | None, blocks: int, parts: int) -> DataFrame:
    """The best of each block for each query: q, vec_id, equal (to the query's vector), score. rows: id, v; asked: id, v, costs."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    left = rows.select(place(blocks, "id", "v").alias("block"), every(parts).alias("part"), "id", "v")
    right = asked.select(every(blocks).alias("block"), place(parts, "id").alias("part"), "id", "v", "costs")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_best(best, index), "q long, vec_id long, equal boolean, score double")


def _of_equals(rows: DataFrame, most: int) -> DataFrame:
    """rows (id, v) without those that have so many equal ones of lesser ids. Only vectors whose hash occurs more often are compared."""
    rows = rows.withColumn("hash", F.xxhash64("v"))
    often = written(rows.groupBy("hash").count().where(F.col("count") > most).select("hash"), "nn-often")
    if not row_count(often):
        return rows.drop("hash")
    several = rows.join(small(often), "hash", "left_semi").withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id")))
    return rows.join(small(often), "hash", "left_anti").drop("hash").unionByName(several.where(F.col("n") <= most).drop("hash", "n"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, members: int = MEMBERS, asked: int = QUERIES) -> DataFrame:
    """vectors, queries (rows of vectors): vec_id, embedding. For each query its k nearest: query_id, rank, vec_id, score. members,
    asked: rows of a block and queries of a part, about, as far as BLOCK_BYTES hold them."""
    spark = vectors.sparkSession
    plain = all(isinstance(getattr(d.schema["embedding"].dataType, "elementType", None), T.FloatType) for d in (vectors, queries))
    kind = "array<float>" if plain else "array<double>"  # exact either way, and half the bytes
    typed = lambda d: d.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v")).where(F.col("id").isNotNull() & _fine(F.col("v")))
    rows, ask = typed(vectors), typed(queries)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not most:
        return empty
    rows, ask = (d.where(F.size("v") == most[0]["d"]) for d in (rows, ask))
    rows, ask = written(_of_equals(rows, k + 1), "nn-rows"), written(ask, "nn-asked")
    # Equal vectors may have the same least id as others' ids repeat: queries are numbered.
    unique = written(ask.select("v").distinct().select(F.monotonically_increasing_id().alias("id"), "v"), "nn-queries")
    # The sample: vectors with the least hashes.
    wide = F.col("v").cast("array<double>")
    pick = lambda d, n: [r["v"] for r in d.select(wide.alias("v")).orderBy(F.xxhash64("v"), "v").limit(n).collect()]
    sample, few = pick(rows, SAMPLE), pick(unique, SAMPLE_QUERIES)
    if not few:
        return empty
    n, fits = row_count(rows), max(1, BLOCK_BYTES // (8 * most[0]["d"]))
    index = fit(_unit(sample), _unit(few), n, k)
    blocks = max(-(-n // min(members, fits)), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_MEMBERS)))
    parts = -(-row_count(unique) // min(asked, fits))
    spread = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), row_count(unique) // 16))  # probing is the work of a query
    costly = written(_with_costs(unique.repartition(spread), index), "nn-costs")
    # A query's own row may be among those found, so k + 1 are enough.
    found = written(_found(rows, costly, k + 1, index, blocks, parts), "nn-near")
    enough = found.groupBy("q").count().where(F.col("count") > k).select(F.col("q").alias("id"))
    sparse = written(costly.join(enough, "id", "left_anti"), "nn-sparse")
    if row_count(sparse):
        everything = written(_found(rows, sparse, k + 1, None, blocks, -(-row_count(sparse) // min(asked, fits))), "nn-all")
        found = found.join(small(written(sparse.select(F.col("id").alias("q")), "nn-without")), "q", "left_anti").union(everything)
    order = [F.desc("score"), F.col("vec_id")]
    found = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")
    # Repeated rows keep their number: of those that equal the query's own row it is one.
    found = found.withColumn("copy", F.row_number().over(W.partitionBy("q", "vec_id", "equal").orderBy("score")))
    asked_rows = ask.select(F.col("id").alias("query_id"), "v", F.monotonically_increasing_id().alias("row")).join(unique.withColumnRenamed("id", "q"), "v").drop("v")
    out = asked_rows.join(found, "q").where(~(F.col("equal") & (F.col("vec_id") == F.col("query_id")) & (F.col("copy") == 1)))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(*order, "copy"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
