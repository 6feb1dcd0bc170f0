"""Demultiplexing: reads to specimens by approximate primers and barcodes.

Everything about one read is worked out inside its row, by functions on arrays of hits, candidates and what is chosen of them, so that
the search runs once for each read and reads aren't shuffled. Filters stand below the search function, which Catalyst can't push
through. Layout of a read:  [b1][forward primer] target [rc(reverse primer)][rc(b2)]."""

from __future__ import annotations

import shutil
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ampliflow.functions.dna import complement, complements, distance_code, reverse_complement, safe_name
from ampliflow.operators.align import Trie, packed, search
from ampliflow.sources.tables import FORWARD, Design, barcode_threshold, primer_thresholds

FULL, PARTIAL_F, PARTIAL_R, SEVERAL, BEST, UNKNOWN = "full_match", "partial_forward", "partial_reverse", "multiple_specimens", "dereplicated_full", "unknown"
FULL_KINDS = (FULL, BEST)
TRIMS = ("none", "tails", "barcodes", "primers")


@dataclass(frozen=True)
class Options:
    """min_length, max_length: -1 for no bound. index_distance, primer_distance: -1 to derive them. search_length: bases of each end
    that are searched for primers. dereplicate: best or none. preorient: leave out the strand that a read surely isn't on. nearest: hits
    have only their nearest barcodes, which are all that records depend on unless their tails are cut off; large sheets are searched much faster."""

    min_length: int = -1
    max_length: int = -1
    index_distance: int = -1
    primer_distance: int = -1
    search_length: int = 80
    trim: str = "barcodes"
    dereplicate: str = "best"
    preorient: bool = True
    prefix: str = ""
    nearest: bool = False

    def __post_init__(self) -> None:
        if self.trim not in TRIMS or self.dereplicate not in ("best", "none"):
            raise ValueError("trim is none, tails, barcodes or primers; dereplicate is best or none")
        if self.nearest and self.trim == "tails":
            raise ValueError("tails are cut off by all barcodes of a hit, not only the nearest")


@dataclass(frozen=True)
class Parameters:
    primers: dict[str, int]
    barcode: int

    @staticmethod
    def of(spark, design: Design, options: Options) -> Parameters:  # noqa: ANN001
        primers = primer_thresholds(spark, design)
        if options.primer_distance != -1:
            primers = dict.fromkeys(primers, options.primer_distance)
        return Parameters(primers, options.index_distance if options.index_distance != -1 else barcode_threshold(spark, design))


_LOC = T.StructType().add("s", T.IntegerType()).add("e", T.IntegerType())
_BARCODE = T.StructType().add("bc", T.StringType()).add("dist", T.IntegerType()).add("locs", T.ArrayType(_LOC))
_HIT = T.StructType().add("strand", T.IntegerType()).add("primer", T.IntegerType()).add("dist", T.IntegerType()).add("locs", T.ArrayType(_LOC)).add("bcs", T.ArrayType(_BARCODE))
HITS = T.ArrayType(_HIT)
#: Of a read, all pairs of tied barcodes that belong to a specimen: places of the primers in Design.ordered, the candidate's strand.
_KNOWN = T.StructType().add("f", T.IntegerType()).add("r", T.IntegerType()).add("strand", T.IntegerType()).add("o1", T.StringType()).add("o2", T.StringType()).add("dist", T.IntegerType()).add("id", T.StringType()).add("pool", T.StringType())
FOUND = T.StructType().add("hits", HITS).add("known", T.ArrayType(_KNOWN))


class _Barcodes:
    """The barcodes of a primer, and a trie of their reverse complements, which are what follows its hits."""

    def __init__(self, barcodes: list[str] | pa.Array):
        self.names = pa.array(barcodes, pa.string()) if isinstance(barcodes, list) else barcodes
        after = complements(self.names)
        self.trie = Trie(after)
        #: Names by their patterns: those of a pattern lie together.
        pattern = pc.index_in(after, self.trie.words).to_numpy()
        self.order = np.argsort(pattern, kind="stable").astype(np.int32)
        self.first = np.append(0, np.cumsum(np.bincount(pattern))).astype(np.int32)

    def of(self, pattern: int) -> list[int]:
        return self.order[self.first[pattern] : self.first[pattern + 1]].tolist()


class _Sheet:
    """What tasks need of a design, as arrays: barcodes of each primer, and the first specimen of each pair of barcodes."""

    def __init__(self, design: Design):
        self.primers, self.ids, self.pools = [(p.name, complement(p.primer)) for p in design.ordered], design.ids, design.pools
        self.barcodes = [_Barcodes(design.barcodes[p.name]) for p in design.ordered]
        #: By places of forward and reverse primers: pairs as numbers, ascending, and their specimens' places.
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for f, r, _ in design.pairs:
            own = [p for p in design.keyed() if self.primers[f][0] in p[0] and self.primers[r][0] in p[1]]
            place = lambda b, n: pc.index_in(b, self.barcodes[n].names).to_numpy().astype(np.int64)
            pair = np.concatenate([place(p[3], f) * len(self.barcodes[r].names) + place(p[4], r) for p in own])
            at = np.concatenate([p[2] for p in own])
            order = np.lexsort((at, pair))  # of specimens with the same barcodes the first
            pair, at = pair[order], at[order]
            first = np.append(True, pair[1:] != pair[:-1])
            self.pairs[f, r] = pair[first], at[first].astype(np.int32)

    def known(self, tied: list[dict[tuple[int, int], list[tuple[int, int, str]]]]) -> list[list[dict]]:
        """tied: for each read its tied barcodes by strand and primer: their place, distance and letters. The pairs of specimens, in the
        order of the first barcode, then of the second."""
        out: list[list[dict]] = [[] for _ in tied]
        for (f, r), (pairs, places) in self.pairs.items():
            many = len(self.barcodes[r].names)
            asked = [(i, s, a, b) for i, own in enumerate(tied) if own for s in (0, 1) for a in own.get((1 - s, f), ()) for b in own.get((s, r), ())]
            pair = np.fromiter((a[0] * many + b[0] for _, _, a, b in asked), np.int64, len(asked))
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            for n in np.flatnonzero(pairs[at] == pair).tolist():
                (i, s, a, b), place = asked[n], int(places[at[n]])
                out[i].append({"f": f, "r": r, "strand": s, "o1": a[2], "o2": b[2], "dist": a[1] + b[1], "id": self.ids[place].as_py(), "pool": self.pools[place].as_py()})
        return out


def _search_strand(tails: list[bytes], lengths: np.ndarray, strand: int, sheet: _Sheet, params: Parameters, nearest: bool, out: list[list[dict]], tied: list[dict]) -> None:
    """Searches the last bases of reads for each primer's reverse complement, and what follows a hit for its barcodes, all at once in
    their trie. Locations are places in the searched strand, which has so many bases. nearest: bounds are tried from 0 up, until a hit has
    barcodes."""
    rows, size = packed(tails)
    shift = lengths - size
    for n, (primer, own) in enumerate(zip(sheet.primers, sheet.barcodes, strict=True)):
        distance, places = search(rows, size, primer[1], params.primers[primer[0]])
        found = np.flatnonzero(distance >= 0)
        if not len(found):
            continue
        spots = [(i, e, e + int(shift[i])) for i in found.tolist() for _, e in places[i]]
        after, after_size = packed([tails[i][e + 1 : e + 1 + own.trie.depth + params.barcode] for i, e, _ in spots])
        best: dict[int, dict[int, dict]] = {i: {} for i in found.tolist()}
        open_ = np.arange(len(spots))
        for bound in range(params.barcode + 1) if nearest else [params.barcode]:
            spot, pattern, dist, ends = own.trie.search(after[open_], after_size[open_], bound)
            for k, p, d, at in zip(open_[spot].tolist(), pattern.tolist(), dist.tolist(), ends, strict=True):
                i, _, e = spots[k]
                for b in own.of(p):
                    if b not in best[i] or d < best[i][b]["dist"]:  # of equals the first location
                        best[i][b] = {"bc": own.names[b].as_py(), "dist": d, "locs": [{"s": e + 1, "e": e + 1 + x} for x in at]}
            open_ = np.array([k for k in open_.tolist() if not best[spots[k][0]]], np.int64)
            if not len(open_):
                break
        for i in found.tolist():
            locs = [{"s": s + int(shift[i]), "e": e + int(shift[i])} for s, e in places[i]]
            bcs = sorted(best[i].items(), key=lambda b: (b[1]["dist"], b[1]["bc"]))
            out[i].append({"strand": strand, "primer": n, "dist": int(distance[i]), "locs": locs, "bcs": [b for _, b in bcs]})
            if bcs:
                tied[i][strand, n] = [(at, b["dist"], b["bc"]) for at, b in bcs if b["dist"] == bcs[0][1]["dist"]]


#: Reads that are searched at a time.
SEARCHED = 1000


def hit_finder(design: Design, params: Parameters, nearest: bool = False):  # noqa: ANN201
    """A function of the last bases of a sequence and of its reverse complement, and of their length: all primer hits on both (strand 0
    and 1) with the barcodes after them, and the specimens of tied barcodes (FOUND)."""
    sheet = _Sheet(design)

    def find(seqs: pa.Array, backs: pa.Array, lengths: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(seqs), SEARCHED):
            n = min(SEARCHED, len(seqs) - at)
            out: list[list[dict]] = [[] for _ in range(n)]
            tied: list[dict] = [{} for _ in range(n)]
            for strand, column in enumerate((seqs, backs)):
                # A letter outside ASCII matches nothing, and stays one place.
                texts = [(t or "").encode("latin-1", "replace") for t in column.slice(at, SEARCHED).to_pylist()]
                _search_strand(texts, lengths.slice(at, SEARCHED).to_numpy(zero_copy_only=False), strand, sheet, params, nearest, out, tied)
            parts.append(pa.StructArray.from_arrays([pa.array(out, to_arrow_type(HITS)), pa.array(sheet.known(tied), to_arrow_type(T.ArrayType(_KNOWN)))], fields=list(to_arrow_type(FOUND))))
        return pa.concat_arrays(parts) if parts else pa.array([], to_arrow_type(FOUND))

    return F.arrow_udf(find, FOUND)


def _lookup(strand: Column, primer: Column) -> Column:
    return F.get(F.filter("hits", lambda h: (h["strand"] == strand) & (h["primer"] == primer)), 0)


def _mirrored(locs: Column) -> Column:
    return F.transform(locs, lambda x: F.struct((F.col("length") - 1 - x["e"]).alias("s"), (F.col("length") - 1 - x["s"]).alias("e")))


def _mirrored_hit(hit: Column) -> Column:
    bcs = F.transform(hit["bcs"], lambda b: F.struct(b["bc"].alias("bc"), b["dist"].alias("dist"), _mirrored(b["locs"]).alias("locs")))
    return F.when(hit.isNotNull(), F.struct(hit["strand"].alias("strand"), hit["primer"].alias("primer"), hit["dist"].alias("dist"), _mirrored(hit["locs"]).alias("locs"), bcs.alias("bcs")))


def _tied(bcs: Column) -> Column:
    """The barcodes of least distance; the first of all has it."""
    return F.coalesce(F.filter(bcs, lambda b: b["dist"] == F.get(bcs, 0)["dist"]), F.expr("array()").cast(T.ArrayType(_BARCODE)))


def filtered(reads: DataFrame, options: Options) -> DataFrame:
    """reads with length and filter_reason (too_short, too_long or null)."""
    n = F.length("seq")
    short = F.lit(options.min_length != -1) & (n < options.min_length)
    long = F.lit(options.max_length != -1) & (n > options.max_length)
    return reads.withColumn("length", n).withColumn("filter_reason", F.when(short, "too_short").when(long, "too_long"))


def with_hits(reads: DataFrame, design: Design, params: Parameters, options: Options) -> DataFrame:
    """reads (read_id, seq, ...) that pass the length filter, with rc_seq, hits, known, orientation, forward_score, reverse_score, confidence."""
    rows = filtered(reads, options).where(F.col("filter_reason").isNull()).withColumn("rc_seq", reverse_complement(F.col("seq")))
    # Only the ends go to Python: a batch of whole reads has no bound.
    window = options.search_length
    tail, head = (F.right("seq", F.lit(window)), F.left("seq", F.lit(window))) if window else (F.col("seq"), F.col("seq"))
    rows = rows.withColumn("found", hit_finder(design, params, options.nearest)(tail, reverse_complement(head), F.coalesce("length", F.lit(0)).cast("long")))
    rows = rows.withColumns({"hits": F.col("found.hits"), "known": F.col("found.known")}).drop("found")
    directions = F.array(*[F.lit(p.direction == FORWARD) for p in design.ordered])
    # A forward primer at a strand's head is its complement at the other strand's tail.
    votes = lambda own, other: F.size(F.filter("hits", lambda h: F.when(F.get(directions, h["primer"]), h["strand"] == own).otherwise(h["strand"] == other)))
    f, r = (votes(1, 0), votes(0, 1)) if options.preorient else (F.lit(0), F.lit(0))
    rows = rows.withColumn("forward_score", f).withColumn("reverse_score", r)
    f, r = F.col("forward_score"), F.col("reverse_score")
    way = F.when((f > 0) & (r == 0), "forward").when((r > 0) & (f == 0), "reverse").otherwise("unknown")
    return rows.withColumn("orientation", way).withColumn("confidence", F.when(f + r > 0, F.abs(f - r) / (f + r)).otherwise(0.0))


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


#: Fields of a candidate: cand_ord (its place in the order of trial), strand, p1, p2 (hits in places of the strand's sequence), n1, n2
#: (primer names), pool, b1, b2 (tied barcodes, best first), score, kind (ends that have barcodes), and what dereplication orders by.
FIELDS = (
    "cand_ord", "f", "r", "pool", "strand", "p1", "p2", "n1", "n2", "b1", "b2", "score", "kind",
    "primer_dist", "n_primers", "file_present", "file_penalised", "d1", "d2",
)


def with_candidates(hits: DataFrame, design: Design) -> DataFrame:
    """hits with cands (all candidates of the read, an array of FIELDS in the order of trial) and best (those of the highest score)."""
    names = F.array(*[F.lit(p.name) for p in design.ordered])
    order = F.array(*[F.lit(p.file_index) for p in design.ordered])
    pairs = [(2 * n + s, f, r, pool, s) for n, (f, r, pool) in enumerate(design.pairs) for s in (0, 1)]
    literal = F.array(*[_struct(cand_ord=F.lit(o), f=F.lit(f), r=F.lit(r), pool=F.lit(pool).cast("string"), strand=F.lit(s)) for o, f, r, pool, s in pairs])
    on = lambda p: F.when(p["strand"] == 0, F.col("orientation") != "reverse").otherwise(F.col("orientation") != "forward")
    hit = lambda p: F.exists("hits", lambda h: ((h["primer"] == p["f"]) & (h["strand"] == 1 - p["strand"])) | ((h["primer"] == p["r"]) & (h["strand"] == p["strand"])))

    def placed(p: Column) -> Column:
        own = {n: p[n] for n in ("cand_ord", "f", "r", "pool", "strand")}
        return _struct(**own, p1=_mirrored_hit(_lookup(1 - p["strand"], p["f"])), p2=_lookup(p["strand"], p["r"]))

    def named(c: Column) -> Column:
        name = lambda p, n: F.when(p.isNotNull(), F.get(names, n))
        own = {n: c[n] for n in ("cand_ord", "f", "r", "pool", "strand", "p1", "p2")}
        return _struct(**own, n1=name(c["p1"], c["f"]), n2=name(c["p2"], c["r"]), b1=_tied(c["p1"]["bcs"]), b2=_tied(c["p2"]["bcs"]))

    def scored(c: Column) -> Column:
        p1, p2, some1, some2 = c["p1"], c["p2"], F.size(c["b1"]) > 0, F.size(c["b2"]) > 0
        n_b, both = some1.cast("int") + some2.cast("int"), p1.isNotNull() & p2.isNotNull()
        score = F.when(both & (n_b == 2), 5).when(both & (n_b == 1), 4).when(~both & (n_b > 0), 3).when(both, 2).otherwise(1)
        kind = F.when(some1, F.when(some2, "both").otherwise("forward")).otherwise(F.when(some2, "reverse").otherwise("none"))
        at = lambda p, none: F.when(p.isNotNull(), F.get(order, p["primer"])).otherwise(none)
        own = {n: c[n] for n in ("cand_ord", "f", "r", "pool", "strand", "p1", "p2", "n1", "n2", "b1", "b2")}
        return _struct(
            **own, score=score, kind=kind, primer_dist=F.coalesce(p1["dist"], F.lit(0)) + F.coalesce(p2["dist"], F.lit(0)), n_primers=p1.isNotNull().cast("int") + p2.isNotNull().cast("int"),
            file_present=at(p1, 0) + at(p2, 0), file_penalised=at(p1, 999) + at(p2, 999), d1=F.get(c["b1"], 0)["dist"], d2=F.get(c["b2"], 0)["dist"],
        )

    rows = hits.withColumn("cands", F.transform(F.transform(F.transform(F.filter(literal, lambda p: on(p) & hit(p)), placed), named), scored))
    top = F.array_max("cands.score")
    return rows.withColumn("best", F.filter("cands", lambda c: c["score"] == top))


def exploded(rows: DataFrame, column: str) -> DataFrame:
    """A row for each candidate in an array of candidates: the read's columns and FIELDS."""
    # From explode() Spark would infer a filter on the array's size and push it down, where the search would run once more.
    rows = rows.withColumn("c", F.explode_outer(column)).where(F.col("c").isNotNull())
    return rows.drop("cands", "best").select("*", "c.*").drop("c")


def _first(rows: Column, by: str) -> Column:
    """Of an array of structs with fields order, c and others, the least of each value of `by`, and how many of it there were."""
    groups = F.array_distinct(F.transform(rows, lambda x: x[by]))
    own = lambda g: F.filter(rows, lambda x: x[by] == g)
    return F.transform(groups, lambda g: _struct(x=F.array_min(own(g)), alternatives=F.size(own(g)).cast("long")))


def dereplicated(rows: DataFrame) -> DataFrame:
    """rows of with_candidates with chosen: an entry for each specimen of a read, each tied barcode of a partial match, one for
    unknowns; candidates whose barcodes belong to no specimen as they are. An entry: group_kind (full, partial, unknown, other),
    specimen_id, specimen_pool, alternatives, barcode_dist, c."""
    none, best = F.lit(None).cast("string"), F.col("best")
    of = lambda *kinds: F.filter(best, lambda c: c["kind"].isin(*kinds))

    def known(c: Column) -> Column:
        """The specimens that a candidate's tied barcodes give."""
        own = F.filter("known", lambda k: (k["f"] == c["f"]) & (k["r"] == c["r"]) & (k["strand"] == c["strand"]))
        return F.transform(own, lambda k: _struct(s=_struct(id=k["id"], pool=k["pool"]), o1=k["o1"], o2=k["o2"], dist=k["dist"]))

    def full(c: Column) -> Column:
        order = lambda x: _struct(barcode_dist=x["dist"], primer_dist=c["primer_dist"], file=c["file_present"], cand_ord=c["cand_ord"], o1=x["o1"], o2=x["o2"])
        return F.transform(c["known"], lambda x: _struct(order=order(x), by=x["s"]["id"], pool=x["s"]["pool"], c=c["c"]))

    def partial(c: Column) -> Column:
        order = lambda t: _struct(barcode_dist=t["dist"], less=-c["n_primers"], primer_dist=c["primer_dist"], file=c["file_present"], cand_ord=c["cand_ord"])
        bars = F.when(c["kind"] == "forward", c["b1"]).otherwise(c["b2"])
        return F.transform(bars, lambda t: _struct(order=order(t), by=F.concat_ws("\t", c["kind"], t["bc"]), c=c))

    def unknown(c: Column) -> Column:
        return _struct(order=_struct(less=-c["n_primers"], primer_dist=c["primer_dist"], file=c["file_penalised"], cand_ord=c["cand_ord"]), by=F.lit(1), c=c)

    entry = lambda kind, c, alternatives, dist, specimen=none, pool=none: _struct(group_kind=F.lit(kind), specimen_id=specimen, specimen_pool=pool, alternatives=alternatives, barcode_dist=dist, c=c)
    rows = rows.withColumn("both", F.transform(of("both"), lambda c: _struct(c=c, known=known(c), primer_dist=c["primer_dist"], file_present=c["file_present"], cand_ord=c["cand_ord"])))
    rows = rows.withColumns({"fulls": F.flatten(F.transform("both", full)), "partials": F.flatten(F.transform(of("forward", "reverse"), partial)), "unknowns": F.transform(of("none"), unknown)})
    chosen = F.concat(
        F.transform(_first(F.col("fulls"), "by"), lambda g: entry("full", g["x"]["c"], g["alternatives"], g["x"]["order"]["barcode_dist"], g["x"]["by"], g["x"]["pool"])),
        F.transform(F.filter("both", lambda c: F.size(c["known"]) == 0), lambda c: entry("other", c["c"], F.lit(1).cast("long"), c["c"]["d1"] + c["c"]["d2"])),
        F.transform(_first(F.col("partials"), "by"), lambda g: entry("partial", g["x"]["c"], g["alternatives"], g["x"]["order"]["barcode_dist"])),
        F.transform(_first(F.col("unknowns"), "by"), lambda g: entry("unknown", g["x"]["c"], g["alternatives"], F.lit(None).cast("int"))),
    )
    return rows.withColumn("chosen", chosen).drop("both", "fulls", "partials", "unknowns", "known")


def outcomes(rows: DataFrame, design: Design, options: Options) -> DataFrame:
    """A row for each record that a read becomes: the read's columns, cands, best, nth (its place among the read's), FIELDS (null in the
    only row of a read without candidates), what dereplication adds, sample, resolution, pool."""
    if options.dereplicate == "best":
        rows = dereplicated(rows)
        added = ("group_kind", "specimen_id", "specimen_pool", "alternatives", "barcode_dist")
        rows = rows.select("*", F.posexplode_outer("chosen").alias("nth", "x")).drop("chosen")
        return resolved(rows.select("*", *[F.col(f"x.{c}").alias(c) for c in added], "x.c.*").drop("x"))
    rows = rows.drop("known").select("*", F.posexplode_outer("best").alias("nth", "x"))
    return resolved(undereplicated(rows.select("*", "x.*").drop("x"), design))


def undereplicated(rows: DataFrame, design: Design) -> DataFrame:
    """Candidates, each with the specimens that any of its tied barcodes give: specimens, in file order."""
    specimens = [(s.spec_ord, s.specimen_id, s.pool, f, r, s.b1, s.b2) for s in design.specimens for f in design.uses[s.specimen_id][0] for r in design.uses[s.specimen_id][1]]
    every = rows.sparkSession.createDataFrame(specimens, "spec_ord int, specimen_id string, specimen_pool string, k1 string, k2 string, kb1 string, kb2 string")
    grouped = every.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("spec_ord", "specimen_id", "specimen_pool", "kb1", "kb2"))).alias("all"))
    rows = rows.join(F.broadcast(grouped), (F.col("n1") == F.col("k1")) & (F.col("n2") == F.col("k2")), "left").drop("k1", "k2")
    names = lambda b: F.transform(b, lambda x: x["bc"])
    mine = F.filter("all", lambda s: F.array_contains(names(F.col("b1")), s["kb1"]) & F.array_contains(names(F.col("b2")), s["kb2"]))
    return rows.withColumn("specimens", F.coalesce(mine, F.expr("array()").cast("array<struct<spec_ord:int,specimen_id:string,specimen_pool:string,kb1:string,kb2:string>>"))).drop("all")


def resolved(rows: DataFrame) -> DataFrame:
    """Adds sample and resolution to dereplicated or undereplicated candidates."""
    one = lambda b: F.when(F.size(b) == 1, F.get(b, 0)["bc"])
    partial = F.when(F.col("kind") == "forward", F.concat(F.lit("barcode_fwd_"), one("b1"))).when(F.col("kind") == "reverse", F.concat(F.lit("barcode_rev_"), one("b2")))
    partial_kind = F.when(partial.isNotNull(), F.when(F.col("kind") == "forward", PARTIAL_F).otherwise(PARTIAL_R))
    if "specimens" in rows.columns:
        n = F.size("specimens")
        ids = F.transform("specimens", lambda s: s["specimen_id"])
        sample = F.when(n == 1, F.get(ids, 0)).when(n > 1, F.array_join(ids, "_")).otherwise(partial)
        kind = F.when(n == 1, FULL).when(n > 1, SEVERAL).otherwise(partial_kind)
        rows = rows.withColumn("specimen_pool", F.when(n > 0, F.get("specimens", 0)["specimen_pool"]))
    else:
        sample = F.when(F.col("group_kind") == "full", F.col("specimen_id")).otherwise(partial)
        kind = F.when(F.col("group_kind") == "full", BEST).otherwise(partial_kind)
    rows = rows.withColumn("sample", F.coalesce(sample, F.lit("unknown"))).withColumn("resolution", F.coalesce(kind, F.lit(UNKNOWN)))
    return rows.withColumn("pool", F.coalesce(F.when(F.col("resolution").isin(FULL, BEST), F.col("specimen_pool")), F.col("pool")))


def _extent(trim: str, barcode_length: int) -> tuple[Column, Column]:
    """Start and end (exclusive) of what trimming leaves of the strand's sequence."""
    p1, p2, length = F.col("p1.locs"), F.col("p2.locs"), F.col("length")
    s1, e1, s2, e2 = F.get(p1, 0)["s"], F.get(p1, 0)["e"], F.get(p2, 0)["s"], F.get(p2, 0)["e"]
    if trim == "none":
        return F.lit(0), length
    inner = (F.coalesce(e1 + 1, F.lit(0)), F.coalesce(s2, length))
    if trim == "primers":
        return inner
    if trim == "barcodes":
        return F.coalesce(s1, F.lit(0)), F.coalesce(e2 + 1, length)
    outer = (F.coalesce(s1, F.lit(0)), F.coalesce(e2 + 1, length))
    start = F.array_min(F.flatten(F.transform("p1.bcs", lambda b: F.transform(b["locs"], lambda x: x["s"]))))
    end = F.array_max(F.flatten(F.transform("p2.bcs", lambda b: F.transform(b["locs"], lambda x: x["e"])))) + 1
    return F.coalesce(start, F.greatest(F.lit(0), outer[0] - barcode_length)), F.coalesce(end, F.least(length, outer[1] + barcode_length))


def with_trim(rows: DataFrame, design: Design, options: Options) -> DataFrame:
    """outcomes with start, end and trim_empty, and w: the names that are written, those of an unknown where nothing is left."""
    start, end = _extent(options.trim, design.barcode_length)
    rows = rows.withColumns({"start": start.cast("int"), "end": end.cast("int")})
    rows = rows.withColumn("trim_empty", F.col("cand_ord").isNotNull() & F.lit(options.trim != "none") & (F.col("start") >= F.col("end")))
    kept = lambda c, other="unknown": F.when(F.col("trim_empty"), F.lit(other)).otherwise(F.coalesce(c, F.lit(other)))
    own_names = {"sample": kept(F.col("sample")), "resolution": kept(F.col("resolution"), UNKNOWN), "pool": kept(F.col("pool")), "p1_name": kept(F.col("n1")), "p2_name": kept(F.col("n2"))}
    return rows.withColumn("w", _struct(**own_names))


def fact_columns(options: Options) -> dict[str, Column]:
    """What is written of each row of with_trim: read_id, seq_id, distance_code, sample, resolution, match_type, pool, primer names, seq,
    qual, is_full, path, start and end of the trim, trim_empty. A read without candidates is cand_ord -1."""
    own = F.when(F.col("strand") == 1, F.col("rc_seq")).otherwise(F.col("seq"))
    qual = F.when(F.col("strand") == 1, F.reverse("qual")).otherwise(F.col("qual"))
    cut = lambda c: F.when(F.col("trim_empty"), c).otherwise(F.substring(c, F.col("start") + 1, F.col("end") - F.col("start")))
    code = distance_code(F.col("p1.dist"), F.get("b1", 0)["dist"], F.get("b2", 0)["dist"], F.col("p2.dist"))
    of = lambda n: F.col(f"w.{n}")
    place = F.when(of("resolution") == UNKNOWN, "unknown").when(of("resolution").startswith("partial"), "partial").otherwise("full")
    pair = F.concat_ws("-", of("p1_name"), of("p2_name"))
    path = F.concat_ws("/", place, of("pool"), pair, F.concat(F.lit(options.prefix), safe_name(of("sample"))))
    return {
        "read_id": F.col("read_id"), "seq_id": F.col("seq_id"), "cand_ord": F.coalesce("cand_ord", F.lit(-1)), "distance_code": code, **{n: of(n) for n in ("sample", "resolution", "pool", "p1_name", "p2_name")}, "seq": cut(own), "qual": cut(qual),
        "start": F.col("start"), "end": F.col("end"), "trim_empty": F.col("trim_empty"), "match_type": place, "primer_pair": pair, "is_full": of("resolution").isin(*FULL_KINDS), "path": path,
    }


@dataclass
class Result:
    """The stages of one run, all lazy, each with one search: hits (a row for each read, with cands and best), trimmed (a row for each
    record, of with_trim)."""

    reads: DataFrame
    hits: DataFrame
    trimmed: DataFrame
    design: Design
    options: Options
    parameters: Parameters
    written: str | None = None

    @property
    def candidates(self) -> DataFrame:
        return exploded(self.hits, "cands")

    @property
    def best(self) -> DataFrame:
        return exploded(self.hits, "best")

    @property
    def outcomes(self) -> DataFrame:
        """outcomes with fact, a struct of fact_columns."""
        return self.trimmed.withColumn("fact", _struct(**fact_columns(self.options))).drop("w", "start", "end", "trim_empty")

    @property
    def chosen(self) -> DataFrame:
        return self.outcomes.where(F.col("cand_ord").isNotNull())

    @property
    def facts(self) -> DataFrame:
        # Columns of their own, not of a struct: those that aren't asked for, as sequences and qualities, are never made.
        return self.trimmed.select(*[c.alias(n) for n, c in fact_columns(self.options).items()])

    def totals(self) -> DataFrame:
        """Reads in all (filtered ones too), reads with a full match, and their share."""
        n = self.reads.agg(F.count("*").alias("total"))
        full = self.facts.where("is_full").agg(F.countDistinct("read_id").alias("matched"))
        return n.join(F.broadcast(full)).withColumn("match_rate", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))

    def with_hits_written(self, path: str) -> Result:
        """The same run from hits that are written once, for several consumers (facts, events, counts)."""
        self.hits.write.mode("overwrite").parquet(path)
        hits = self.reads.sparkSession.read.schema(self.hits.schema).parquet(path)
        return replace(run_on(self.reads, hits, self.design, self.options, self.parameters), written=path)

    def drop_written(self) -> None:
        """Removes what with_hits_written wrote to a folder of this machine's file system."""
        if self.written:
            shutil.rmtree(self.written.removeprefix("file://"), ignore_errors=True)


def run_on(reads: DataFrame, hits: DataFrame, design: Design, options: Options, params: Parameters) -> Result:
    hits = hits if "cands" in hits.columns else with_candidates(hits, design)
    return Result(reads, hits, with_trim(outcomes(hits, design, options), design, options), design, options, params)


def demultiplex(reads: DataFrame, design: Design, options: Options | None = None) -> Result:
    """reads: read_id (unique), seq_id, seq, qual (may be null), and any others."""
    options = options or Options()
    params = Parameters.of(reads.sparkSession, design, options)
    return run_on(reads, with_hits(reads, design, params, options), design, options, params)


