"""The small tables beside the reads: primers, specimens, and what is derived from them.

They are checked as they are loaded, so they are read on the driver; the engine broadcasts them after counting them. Of files there are
a few thousand rows; a sheet of more specimens is an Arrow table (SheetDesign), and tasks get arrays of numbers and letters made of it."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliflow.functions.dna import complement, primer_threshold
from ampliflow.operators.align import distance_counts as distances_of
from ampliflow.sources.sequences import records

FORWARD, REVERSE = "forward", "reverse"
COLUMNS = ("SampleID", "PrimerPool", "FwIndex", "FwPrimer", "RvIndex", "RvPrimer")
WILDCARDS = ("*", "-")
PRIMER_DDL = "file_index int, name string, primer string, primer_rc string, direction string, pools array<string>"
SPECIMEN_DDL = "spec_ord int, specimen_id string, pool string, b1 string, fw_primer string, b2 string, rv_primer string"


@dataclass
class Primer:
    file_index: int
    name: str
    primer: str
    direction: str
    pools: list[str]

    @property
    def row(self) -> tuple:
        return self.file_index, self.name, self.primer, complement(self.primer), self.direction, self.pools


@dataclass
class Specimen:
    spec_ord: int
    specimen_id: str
    pool: str
    b1: str
    fw_primer: str
    b2: str
    rv_primer: str

    @property
    def row(self) -> tuple:
        return self.spec_ord, self.specimen_id, self.pool, self.b1, self.fw_primer, self.b2, self.rv_primer


def parse_primers(path: str) -> list[Primer]:
    """FASTA with `pool=a,b position=forward|reverse` in each header, fields in any order."""
    out: list[Primer] = []
    for n, (name, description, seq, _) in enumerate(records(path, "fasta")):
        fields = dict(x.split("=", 1) for x in description.split() if "=" in x)
        pools = [p.strip() for p in re.split("[,;]", fields.get("pool", "")) if p.strip()]
        if not pools:
            raise ValueError(f"primer {name} has no pool")
        if "position" not in fields:
            raise ValueError(f"primer {name} has no position")
        direction = fields["position"].lower()
        if direction not in (FORWARD, REVERSE):
            raise ValueError(f"primer {name} has the position {fields['position']!r}, not forward or reverse")
        out.append(Primer(n, name, seq.upper(), direction, pools))
    check_primers(out)
    return out


def check_primers(primers: list[Primer]) -> None:
    seen: set[str] = set()
    for p in primers:
        if p.name in seen:
            raise ValueError(f"there are two primers named {p.name}")
        seen.add(p.name)
    for pool in sorted({x for p in primers for x in p.pools}):
        for direction in (FORWARD, REVERSE):
            if not any(pool in p.pools and p.direction == direction for p in primers):
                raise ValueError(f"pool {pool} has no {direction} primer")


def parse_specimens(path: str) -> list[Specimen]:
    """Tab-separated, with a header; other columns are ignored."""
    with open(path, newline="") as f:
        rows = csv.DictReader(f, delimiter="\t")
        missing = sorted(set(COLUMNS) - set(rows.fieldnames or ()))
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        out, empty = [], []
        for n, row in enumerate(rows):
            own = {c: (row[c] or "").strip() for c in COLUMNS}
            if not own["FwIndex"] or not own["RvIndex"]:
                empty.append(own["SampleID"])
            out.append(Specimen(n, own["SampleID"], own["PrimerPool"], own["FwIndex"].upper(), own["FwPrimer"], own["RvIndex"].upper(), own["RvPrimer"]))
    if empty:
        raise ValueError(f"{len(empty)} specimens have an empty barcode: {', '.join(empty[:10])}")
    if not out:
        raise ValueError(f"{path} has no specimens")
    check_specimens(out)
    return out


def check_specimens(specimens: list[Specimen]) -> None:
    seen: set[str] = set()
    for s in specimens:
        if s.specimen_id in seen:
            raise ValueError(f"there are two specimens named {s.specimen_id}")
        seen.add(s.specimen_id)


@dataclass
class Design:
    """Primers and specimens that belong together. ordered: the primers in the order in which specimens first use them, which fixes
    the order of candidates; pairs: (forward, reverse) places in it that share a specimen."""

    primers: list[Primer]
    specimens: list[Specimen]
    ordered: list[Primer] = field(default_factory=list)
    uses: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    pairs: list[tuple[int, int, str | None]] = field(default_factory=list)
    barcodes: dict[str, list[str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        by_name, by_sequence = {p.name: p for p in self.primers}, {}
        own: dict[str, dict[str, None]] = {}  # in order, each once
        used = {s.pool for s in self.specimens}
        for s in self.specimens:
            named = []
            for direction, name in ((FORWARD, s.fw_primer), (REVERSE, s.rv_primer)):
                named.append([p.name for p in self._resolved(by_name, s, direction, name)])
            self.uses[s.specimen_id] = (named[0], named[1])
            for names, barcode in ((named[0], s.b1), (named[1], s.b2)):
                for name in names:
                    p = by_name[name]
                    first = by_sequence.setdefault((p.direction, p.primer), p)
                    if first is not p:
                        self.warnings.append(f"primers {first.name} and {p.name} have one sequence; only {first.name} is searched")
                        continue
                    if name not in own:
                        own[name] = {}
                        self.ordered.append(p)
                    own[name][barcode] = None
        self.barcodes |= {name: list(barcodes) for name, barcodes in own.items()}
        for p in self.ordered:
            p.pools = [x for x in p.pools if x in used]
        at = {p.name: n for n, p in enumerate(self.ordered)}
        linked = {(f, r) for fw, rv in self.uses.values() for f in fw for r in rv if f in at and r in at}
        for f in (p for p in self.ordered if p.direction == FORWARD):
            for r in (p for p in self.ordered if p.direction == REVERSE):
                if (f.name, r.name) in linked:
                    self.pairs.append((at[f.name], at[r.name], self.pool_of(f, r)))
        self._compare({s.b1 for s in self.specimens}, {s.b2 for s in self.specimens})

    def _compare(self, b1: set[str], b2: set[str]) -> None:
        if b1 & b2:
            self.warnings.append(f"barcodes of both directions: {', '.join(sorted(b1 & b2))}")
        for name, side in ((FORWARD, b1), (REVERSE, b2)):
            if len({len(b) for b in side}) > 1:
                self.warnings.append(f"{name} barcodes differ in length")

    @staticmethod
    def _resolved(by_name: dict[str, Primer], s: Specimen, direction: str, name: str) -> list[Primer]:
        if name in WILDCARDS:
            return [p for p in by_name.values() if p.direction == direction and s.pool in p.pools]
        if name not in by_name:
            raise ValueError(f"specimen {s.specimen_id}: there is no primer {name}")
        p = by_name[name]
        if p.direction != direction:
            raise ValueError(f"specimen {s.specimen_id}: primer {name} is a {p.direction} primer")
        if s.pool not in p.pools:
            raise ValueError(f"specimen {s.specimen_id}: primer {name} isn't in pool {s.pool}")
        return [p]

    @staticmethod
    def pool_of(f: Primer | None, r: Primer | None) -> str | None:
        """The first common pool by name, or of one primer its own first one."""
        pools = set(f.pools) & set(r.pools) if f and r else set((f or r).pools) if f or r else set()
        return min(pools, default=None)

    @property
    def barcode_length(self) -> int:
        return max(max(len(s.b1), len(s.b2)) for s in self.specimens)

    @property
    def ids(self) -> pa.Array:
        """Ids of all specimens, in file order."""
        return pa.array([s.specimen_id for s in self.specimens], pa.string())

    @property
    def pools(self) -> pa.Array:
        """Their pools."""
        return pa.array([s.pool for s in self.specimens], pa.string()).dictionary_encode()

    def keyed(self) -> list[tuple[list[str], list[str], np.ndarray, pa.Array, pa.Array]]:
        """Specimens by the primers they use: forward and reverse primers, places in file order, and their b1 and b2."""
        parts: dict[tuple, list[int]] = {}
        for n, s in enumerate(self.specimens):
            parts.setdefault(tuple(map(tuple, self.uses[s.specimen_id])), []).append(n)
        bars = lambda at, name: pa.array([getattr(self.specimens[n], name) for n in at], pa.string())
        return [(list(f), list(r), np.array(at), bars(at, "b1"), bars(at, "b2")) for (f, r), at in parts.items()]

    def primer_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([p.row for p in self.primers], PRIMER_DDL)

    def specimen_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([s.row for s in self.specimens], SPECIMEN_DDL)

    def key_table(self, spark: SparkSession) -> DataFrame:
        """(p1, p2, b1, b2) to the first specimen with them in file order, its pool, and all of them."""
        rows = [(s.spec_ord, s.specimen_id, s.pool, f, r, s.b1, s.b2) for s in self.specimens for f in self.uses[s.specimen_id][0] for r in self.uses[s.specimen_id][1]]
        keys = spark.createDataFrame(rows, "spec_ord int, specimen_id string, specimen_pool string, p1 string, p2 string, b1 string, b2 string")
        one = F.min_by(F.struct("specimen_id", "specimen_pool"), "spec_ord").alias("s")
        return keys.groupBy("p1", "p2", "b1", "b2").agg(one, F.min("spec_ord").alias("spec_ord")).select("p1", "p2", "b1", "b2", "s.*", "spec_ord")


class SheetDesign(Design):
    """A design of a table of specimens in file order, with the columns of SPECIMEN_DDL: some fifty bytes of each, where objects take more
    than a kilobyte. specimens are only the first ones of those that use the same primers in the same pool."""

    def __init__(self, primers: list[Primer], table: pa.Table):
        self.table, self._keys = table, ["pool", "fw_primer", "rv_primer"]
        numbered = table.select(self._keys).append_column("at", pa.array(np.arange(table.num_rows)))
        at = numbered.group_by(self._keys).aggregate([("at", "min")]).sort_by("at_min")["at_min"]
        super().__init__(primers, [Specimen(**r) for r in table.take(at).to_pylist()])
        self.parts = [(*self.uses[s.specimen_id], *self._own(s)) for s in self.specimens]
        self.barcodes = {p.name: pc.unique(pa.chunked_array([part[3 + side] for part in self.parts for side in (0, 1) if p.name in part[side]])) for p in self.ordered}

    def _compare(self, b1: set[str], b2: set[str]) -> None:
        both = pc.sum(pc.is_in(pc.unique(self.table["b1"]), pc.unique(self.table["b2"]))).as_py()
        if both:
            self.warnings.append(f"{both} barcodes are of both directions")
        for name, side in ((FORWARD, "b1"), (REVERSE, "b2")):
            if len(pc.unique(pc.utf8_length(self.table[side]))) > 1:
                self.warnings.append(f"{name} barcodes differ in length")

    def _own(self, first: Specimen) -> tuple[np.ndarray, pa.Array, pa.Array]:
        same = np.ones(self.table.num_rows, bool)
        for key in self._keys:
            same &= pc.equal(self.table[key], getattr(first, key)).to_numpy()
        at = np.flatnonzero(same)
        return at, *(self.table[b].take(pa.array(at)).combine_chunks() for b in ("b1", "b2"))

    @property
    def barcode_length(self) -> int:
        return max((pc.max(pc.utf8_length(self.table[b])).as_py() or 0 for b in ("b1", "b2")), default=0)

    @property
    def ids(self) -> pa.Array:
        return self.table["specimen_id"].combine_chunks()

    @property
    def pools(self) -> pa.Array:
        pools = self.table["pool"].combine_chunks()
        return pools if pa.types.is_dictionary(pools.type) else pools.dictionary_encode()

    def keyed(self) -> list[tuple[list[str], list[str], np.ndarray, pa.Array, pa.Array]]:
        return self.parts


def used_combined(design: Design) -> list[str]:
    """Forward barcodes and reverse complements of reverse ones, as often as they occur among the distinct ones of each side."""
    parts = design.keyed()
    return [*dict.fromkeys(b for p in parts for b in p[3].to_pylist()), *(complement(b) for b in dict.fromkeys(b for p in parts for b in p[4].to_pylist()))]


#: Words that are compared with as many others at a time.
BLOCK = 2048


def distance_counts(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """How many pairs of words (column w; a word that occurs twice is a pair) have each edit distance: distance, n.

    Words lie in blocks by the alphabet, and each block meets itself and half of the others, those after it in a ring, so that each pair of
    blocks is compared once and all blocks have as much to do. What a task holds are its block and the other words as they come."""
    blocks = max(1, -(-words.count() // block))
    own = words.repartitionByRange(blocks, "w").select(F.spark_partition_id().alias("i"), "w").groupBy("i").agg(F.collect_list("w").alias("own"))
    own = own.localCheckpoint()  # a range is sampled: both sides need the same blocks
    ahead = F.pmod(F.col("j") - F.col("i"), F.lit(blocks))
    meets = (ahead * 2 < blocks) | ((ahead * 2 == blocks) & (F.col("i") < F.col("j")))
    pairs = own.repartitionByRange(blocks, "i").join(F.broadcast(own.toDF("j", "others")), meets)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for i, own, j, others in zip(*(c for c in batch.columns), strict=True):
                found = distances_of(own.as_py(), others.as_py())
                if i == j:  # each word has met itself, and each pair both ways
                    found[0] -= len(own)
                    found //= 2
                total = np.pad(total, (0, max(0, len(found) - len(total))))
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["distance", "n"])

    return pairs.mapInArrow(compare, "distance int, n long").groupBy("distance").agg(F.sum("n").alias("n"))


def pool_statistics(primers: DataFrame) -> DataFrame:
    """primers (pools, direction): for each pool n_forward, n_reverse, n."""
    rows = primers.select(F.explode("pools").alias("pool"), "direction")
    return rows.groupBy("pool").agg(F.count_if(F.col("direction") == FORWARD).alias("n_forward"), F.count_if(F.col("direction") == REVERSE).alias("n_reverse"), F.count("*").alias("n"))


def barcode_threshold(spark: SparkSession, design: Design) -> int:
    """Half the least distance of the barcodes, rounded up."""
    words = spark.createDataFrame([(w,) for w in used_combined(design)], "w string")
    least = distance_counts(words).agg(F.min("distance")).first()[0]
    return 0 if least is None else -(-least // 2)


def primer_thresholds(spark: SparkSession, design: Design) -> dict[str, int]:
    return {r["name"]: r["k"] for r in design.primer_table(spark).select("name", primer_threshold(F.col("primer")).alias("k")).collect()}


def load_design(primer_file: str, specimen_file: str) -> Design:
    return Design(parse_primers(primer_file), parse_specimens(specimen_file))
