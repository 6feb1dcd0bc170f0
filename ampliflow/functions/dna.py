"""Column functions on reads: strands, qualities, thresholds, names."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which plain bases an ambiguity code equals. Codes equal no other code but themselves.
IUPAC = {
    "Y": "CT", "R": "AG", "N": "ACGT", "W": "AT", "M": "AC", "S": "CG", "K": "GT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG",
}
COMPLEMENT = ("ACGTURYKMBDHVSWNacgturykmbdhvswn", "TGCAAYRMKVHDBSWNtgcaayrmkvhdbswn")
FASTA_QUALITY = 40
_OTHER = str.maketrans(*COMPLEMENT)


def complement(seq: str) -> str:
    """Reverse complement of a plain string."""
    return seq.translate(_OTHER)[::-1]


def complements(words: pa.Array, step: int = 1 << 16) -> pa.Array:
    """Reverse complements of plain strings."""
    return pa.concat_arrays([pa.array([complement(w) for w in words.slice(i, step).to_pylist()], pa.string()) for i in range(0, max(1, len(words)), step)])


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def phred(qual: Column) -> Column:
    """Quality string to scores."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def phred_string(scores: Column) -> Column:
    return F.array_join(F.transform(scores, lambda q: F.char(q + 33)), "")


def average_quality(qual: Column) -> Column:
    """Mean score of a quality string, 0 for an empty one."""
    scores = phred(qual)
    total = F.aggregate(scores, F.lit(0), lambda a, q: a + q)
    return F.when(F.length(qual) > 0, total / F.length(qual)).otherwise(0.0)


@F.arrow_udf(T.DoubleType())
def mean_quality(qual: pa.Array) -> pa.Array:
    """What average_quality gives, over the bytes of a batch of quality strings at once: for long strings in a hot path."""
    qual = qual.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = qual.buffers()
    at = np.frombuffer(offsets, np.int64)[qual.offset : qual.offset + len(qual) + 1] if len(qual) else np.zeros(1, np.int64)
    letters = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    # Row by row: running totals of a whole batch would take eight bytes a letter.
    sums = np.array([int(letters[a:b].sum(dtype=np.int64)) for a, b in itertools.pairwise(at.tolist())], np.int64)
    size = np.diff(at)
    return pa.array(np.where(size > 0, (sums - 33 * size) / np.maximum(size, 1), 0.0))


def adjusted_length(primer: Column) -> Column:
    """Length with ambiguity codes counted by what they tell: a base 3, two bases 2, three bases 1, N nothing; in thirds."""
    count = lambda letters: F.length(F.regexp_replace(F.upper(primer), f"[^{letters}]", ""))
    return (count("ACGT") * 3 + count("YRWMSK") * 2 + count("BDHV")) / 3


def primer_threshold(primer: Column) -> Column:
    return F.floor(adjusted_length(primer) / 3).cast("int")


def safe_name(name: Column) -> Column:
    """Letters, digits and ._-$# stay."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._\-$#]", "_")


def distance_code(p1: Column, b1: Column, b2: Column, p2: Column) -> Column:
    return F.concat_ws(",", *[F.coalesce(d.cast("string"), F.lit("X")) for d in (p1, b1, b2, p2)])


def sequence_number_id(name: str, number: Column, worker: Column) -> Column:
    return F.format_string("%s#%08d#%s", F.lit(name), number, worker)
