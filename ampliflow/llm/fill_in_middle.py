"""Fill-in-middle: texts cut in three and put in another order, by rank and select over the ends of their tokens.

A token is white space and the word after it, or the white space at a text's end. The ends of the tokens of a batch of texts are one
packed bit vector over the bytes of the batch (a bit for each byte after which a token ends), with the number of ones before each
block of 512 bits as its directory. A text's number of tokens is the rank at its end less the rank at its start, and the cut after
token k is a select: the directory gives the block, popcounts the word and the byte in it. A second bit vector over the first bytes of
code points turns cuts in bytes to places in code points.

Forms: plain (the text as it is), psm (prefix, suffix, middle, with a mark before each) and spm (suffix, prefix, middle). A text that is
empty or holds one of the marks stays plain, so that every output can be turned back.

Nulls: a null text counts as empty, so it is plain, with 0 tokens; a null doc_id is hashed as an empty one. Repeated rows are cut alike,
each on its own. Very long texts are cut whole; texts are taken in slices of BYTES, and a longer text is a slice of its own. Other columns
stay; those that have the names of new ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import free, table

SEED, RATE, SPM_RATE = 42, 50, 80
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of texts that one bit vector covers.
BYTES = 8 << 20
_WORDS = 8  # words of 64 bits in a block


class BitVector:
    """Packed bits with a directory of the ones before each block. All queries take arrays."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.bytes = np.zeros(-(-(len(packed) + 1) // (8 * _WORDS)) * 8 * _WORDS, np.uint8)
        self.bytes[: len(packed)] = packed
        self.words = self.bytes.view("<u8").reshape(-1, _WORDS)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before the place `at`."""
        block, rest = at // (64 * _WORDS), at % (64 * _WORDS)
        # Of the block's words those below the place count whole, the one with the place by its lower bits.
        below = np.clip(rest[:, None] - 64 * np.arange(_WORDS), 0, 64).astype(np.uint64)
        mask = np.where(below == 64, np.uint64(2**64 - 1), (np.uint64(1) << (below & np.uint64(63))) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.words[block] & mask).sum(1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, from 0; there must be one."""
        block = np.searchsorted(self.before, k, "right") - 1
        rest = k - self.before[block]
        # From the block to one of its bytes, and from the byte to one of its bits.
        own = self.bytes.reshape(-1, 8 * _WORDS)[block]
        counts = np.cumsum(np.bitwise_count(own), 1, dtype=np.int64)
        byte = (counts <= rest[:, None]).sum(1)
        rows = np.arange(len(k))
        rest = rest - np.where(byte > 0, counts[rows, byte - 1], 0)
        bits = np.cumsum(np.unpackbits(own[rows, byte][:, None], axis=1, bitorder="little"), 1)
        return block * 64 * _WORDS + byte * 8 + (bits <= rest[:, None]).sum(1)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most BYTES, or of one row."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BYTES, "right")) - 1)
        yield start, stop
        start = stop


def cut_points(data: np.ndarray, offsets: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Of texts that lie at data[offsets[i]:offsets[i + 1]]: number of tokens, the two cuts in bytes, and in code points. The cuts
    stand after the smaller and the larger of r1 and r2 modulo the number of tokens and one."""
    first, last = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    own = data[offsets[0] : offsets[-1]]
    space = (own == 0x20) | ((own >= 0x09) & (own <= 0x0D))
    end = np.zeros(len(own), bool)
    end[:-1] = ~space[:-1] & space[1:]
    end[last[last > first] - 1] = True  # of a text's last token, whatever it is made of
    ends, points = BitVector(end), BitVector((own & 0xC0) != 0x80)
    before = ends.rank(first)
    n = ends.rank(last) - before
    a, b = r1 % (n + 1), r2 % (n + 1)

    def cut(units: np.ndarray) -> np.ndarray:
        out, some = first.copy(), units > 0
        out[some] = ends.select((before + units - 1)[some]) + 1
        return out

    low, high = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    at = points.rank(first)
    return np.stack([n, low - first, high - first, points.rank(low) - at, points.rank(high) - at], 1)


_CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "low", "high", "low_chars", "high_chars")])


def _cutter():  # noqa: ANN202
    def cuts(texts: pa.Array, r1: pa.Array, r2: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, places, values = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        r1, r2 = r1.to_numpy(zero_copy_only=False), r2.to_numpy(zero_copy_only=False)
        parts = [cut_points(data, offsets[i : k + 1], r1[i:k], r2[i:k]) for i, k in _slices(offsets)]
        found = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
        return pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(found.T)], fields=list(to_arrow_type(_CUTS)))

    return F.arrow_udf(cuts, _CUTS)


def random_numbers(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits for an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def with_fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs (doc_id, text) with n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and output.
    rate: of 100 texts so many are cut; spm_rate: of 100 cut texts so many are spm. marks: before prefix, suffix and middle; none may
    be part of another or begin inside another."""
    cuts, h1, h2, h3, h4 = (free(docs, f"fim_{c}") for c in ("cuts", "h1", "h2", "h3", "h4"))
    rows = docs.withColumns(dict(zip((h1, h2, h3, h4), random_numbers(docs["doc_id"], seed), strict=True)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.withColumn(cuts, _cutter()(F.col("text").cast("string"), F.col(h1), F.col(h2)))
    of = lambda f: F.col(f"{cuts}.{f}")
    held = F.lit(False)
    for mark in marks:
        held = held | F.contains(text, F.lit(mark))
    plain = (text == "") | held | (F.col(h3) % 100 >= rate)
    form = F.when(plain, "plain").when(F.col(h4) % 100 < spm_rate, "spm").otherwise("psm")
    whole = text.cast("binary")
    piece = lambda start, stop: F.substring(whole, start.cast("int") + 1, (stop - start).cast("int"))
    prefix, middle, suffix = piece(F.lit(0), of("low")), piece(of("low"), of("high")), piece(of("high"), F.octet_length(text))
    p, s, m = (F.lit(x).cast("binary") for x in marks)
    output = F.when(plain, text).when(F.col(h4) % 100 < spm_rate, F.concat(s, suffix, p, prefix, m, middle).cast("string")).otherwise(F.concat(p, prefix, s, suffix, m, middle).cast("string"))
    rows = rows.withColumns({"n": of("n"), "form": form, "prefix_chars": F.when(~plain, of("low_chars")), "middle_chars": F.when(~plain, of("high_chars") - of("low_chars")), "output": output})
    return rows.drop(cuts, h1, h2, h3, h4)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    p, s, m = marks
    after = lambda c, mark: F.substring(c, F.instr(c, mark) + len(mark), F.length(c))
    before = lambda c, mark: F.substring(c, F.lit(1), F.instr(c, mark) - 1)
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    own = [digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *own)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, concat('0x', substr(h, 1, 8))::BIGINT AS h1, concat('0x', substr(h, 9, 8))::BIGINT AS h2,
    concat('0x', substr(h, 17, 8))::BIGINT AS h3, concat('0x', substr(h, 25, 8))::BIGINT AS h4 FROM d),
cut AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 AS plain FROM units),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix,
    CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN plain THEN NULL ELSE length(prefix)::BIGINT END AS prefix_chars, CASE WHEN plain THEN NULL ELSE length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle) ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE concat(prefix, middle, suffix) END) AS restored_sha256
FROM parts"""
