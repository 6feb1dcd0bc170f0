"""Token ids in ORC shards.

Documents are dealt out by ranges of doc_id and sorted; each range is tokenised and written as one shard in the same pass. A shard is
an ORC file with the columns

    doc_id     its Bloom filter and row index let a reader skip stripes
    shard      number of the range; ascending shards hold ascending doc_ids
    shard_pos  ids in the shard before this document
    n_tokens   with the end id
    tokens     array<int>: integer run-length encoding

Stripes can be read in parallel: each row holds its place in the shard, and where a shard begins in the whole corpus follows from
one sum for each shard. Reading uses the shared folder through Spark only.

Tokenising: the pre-tokeniser of byte-level BPE never joins two words over a single space or line feed, so a text is cut there, and
each distinct piece is encoded once by the tokenizers library and then looked up (in a bounded table for each Python worker). Added
tokens of the file (such as <|endoftext|>) that stand in a text become their ids, as the library has it.

Nulls: a null text counts as empty and yields the end id alone; null doc_ids come first. Rows with equal doc_ids (or without any) are
ordered by text and share a shard, which streams through its task. A very long text is one row and one chunk of work. Only doc_id and text are read, so other columns can have any names. Empty input: no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, small, table, written

END_ID = 0
#: Characters that are tokenised at a time, and pieces kept by a Python worker.
CHUNK_CHARS, KEPT_PIECES, JOINED = 4_000_000, 450_000, 40
#: Bytes of text to a shard, at most about.
SHARD_BYTES = 256 << 20
ORC = {
    "compression": "lz4", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


class _Numbers(dict):
    """Numbers pieces as they come; new ones wait in fresh."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


class Encoder:
    """Encodes many texts with one tokenizers file; distinct pieces once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        #: Strings in a text that the library takes for tokens of their own, before any other rule.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uncut = [a for a in self.added if not set(a).isdisjoint(" \n\0")]
        breaks = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_feed = breaks[0] if len(breaks) == 1 else None
        self._start(_Numbers(), np.empty(0, np.int32), np.empty(0, np.int64))

    def _start(self, numbers: _Numbers, flat: np.ndarray, size: np.ndarray) -> None:
        self.numbers, self.flat, self.size = numbers, flat, size
        self.start, self.used = np.cumsum(size) - size, np.zeros(len(size), np.int64)
        self.numbers.fresh = []

    def _evict(self) -> None:
        """Keeps the half of the pieces that was used most."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: KEPT_PIECES // 2])
        names = list(self.numbers)
        self._start(_Numbers((names[k], n) for n, k in enumerate(kept)), self._ids(kept), self.size[kept])

    def _ids(self, pieces: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces, one after the other."""
        size = self.size[pieces]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[pieces] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def _encoded(self, pieces: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has. A line feed between two other characters is a token of its
        own, so plain pieces (without one, and without white space at their ends) are encoded many at a time."""
        ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        whole = ["\n".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)] if plain else pieces
        for i in range(0, len(whole), 64):
            got = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(whole[i : i + 64], add_special_tokens=False)]
            if plain:
                together = np.concatenate([x for g in got for x in (g, [self.line_feed])])
                breaks = np.flatnonzero(together == self.line_feed)
                ids.append(together[together != self.line_feed].astype(np.int32))
                sizes.append(np.diff(np.concatenate([[-1], breaks])) - 1)
            else:
                ids += got
                sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        out = np.concatenate(sizes)
        if len(out) != len(pieces):
            raise RuntimeError("this tokenizer doesn't keep line feeds apart")
        return np.concatenate(ids), out

    def _append(self, at: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.size[at] = sizes
        self.start[at] = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self) -> None:
        """Gives the fresh pieces their ids. Marks after a letter are always tokens apart: such a piece is made of two others."""
        new, first = self.numbers.fresh, len(self.size)
        plain, other, made, parts, k = [], [], [], [], 0
        together = "\0".join(new)
        added = [a for a in self.added if a in together]
        while k < len(new):  # pieces that others are made of come in at the end
            piece = new[k]
            core = piece.rstrip(_MARKS)
            odd = bool(added) and any(a in piece for a in added)
            if core and len(core) < len(piece) and core[-1].isalpha() and not odd:
                made.append(first + k)
                parts += [self.numbers[core], self.numbers[piece[len(core) :]]]
            elif odd or self.line_feed is None or not _PLAIN.match(piece):
                other.append(first + k)
            else:
                plain.append(first + k)
            k += 1
        more = np.zeros(len(new), np.int64)
        self.size, self.start, self.used = (np.concatenate([x, more]) for x in (self.size, self.start, self.used))
        for at, one_by_one in ((plain, False), (other, True)):
            self._append(at, *self._encoded([new[k - first] for k in at], not one_by_one))
        parts = np.array(parts, np.int64)
        self._append(made, self._ids(parts), self.size[parts].reshape(-1, 2).sum(1))
        self.numbers.fresh = []

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in order (some may be empty), and how many each text has."""
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        odd = pc.match_substring_regex(texts, _ODD)
        for added in self.uncut:
            odd = pc.or_(odd, pc.match_substring(texts, added))
        if pc.any(odd).as_py():
            cut = [[t] if any(a in t for a in self.uncut) else cut_slowly(t) for t in texts.filter(odd).to_pylist()]
            lists = _replaced(lists, odd, pa.array(cut, lists.type))
        return lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if len(self.numbers) > KEPT_PIECES:
            self._evict()
        pieces, counts = self._pieces(texts)
        if not len(pieces):
            return np.empty(0, np.int32), counts
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        own = np.fromiter(map(self.numbers.__getitem__, names), np.int64, len(names))
        if self.numbers.fresh:
            self._learn()
        at = own[np.asarray(coded.indices)]
        self.used += np.bincount(at, minlength=len(self.used))
        upto = np.concatenate([[0], np.cumsum(self.size[at])])[np.concatenate([[0], np.cumsum(counts)])]
        return self._ids(at), np.diff(upto)


def _replaced(lists: pa.ListArray, where: pa.BooleanArray, other: pa.ListArray) -> pa.ListArray:
    """lists with the rows of other in their order where `where` is true."""
    mask = np.asarray(where)
    at = np.arange(len(lists))
    at[mask] = len(lists) + np.arange(int(mask.sum()))
    return pa.concat_arrays([lists, other]).take(pa.array(at))


#: White space as Unicode and the tokenizers have it, and more: texts with two in a row or one at the end are cut by cut_slowly.
_SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\p{Z}]"
_ODD = rf"\x00|{_SPACE}{_SPACE}|{_SPACE}\z"
_PLAIN = re.compile(r" ?\S(?:[^\n]*\S)?\Z")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CUTS = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def cut_slowly(text: str) -> list[str]:
    """Pieces that the pre-tokeniser treats independently: a text is cut before single spaces and around single line feeds, where these
    stand between two other characters that aren't white space, and stays whole elsewhere."""
    return [p for p in _CUTS.split(text) if p]


def chunks(sizes: list[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters together; a longer text is alone."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, n_shards: int | None = None, end_id: int = END_ID) -> None:
    """Tokenises docs (doc_id, text) and writes ORC shards to path. tokenizer: a file of the tokenizers library that all executors have."""
    name = tokenizer
    kind = docs.schema["doc_id"].dataType
    kind = T.LongType() if isinstance(kind, T.NullType) else kind
    schema = T.StructType().add("doc_id", kind).add("shard", T.IntegerType()).add("shard_pos", T.LongType()).add("n_tokens", T.LongType()).add("tokens", T.ArrayType(T.IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(name or tokenizer_path())
        shard, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1).fill_null("")
            for i, j in chunks(pc.utf8_length(texts).to_pylist()):
                ids, sizes = own.encode(texts.slice(i, j - i))
                ends = np.cumsum(sizes)
                tokens = np.insert(ids, ends, end_id).astype(np.int32)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                arrays = [
                    ids_of.slice(i, j - i), pa.array(np.full(j - i, shard, np.int32)), pa.array(pos + ends - sizes), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens)),
                ]
                pos += int(ends[-1])
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast(kind).alias("doc_id"), docs["text"].cast("string").alias("text"))
    if n_shards is None:  # as many as Spark would shuffle to, more if these got too large
        n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))
    dealt = rows.repartitionByRange(n_shards, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(encode, schema).write.options(**ORC).orc(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder of shards: the file's columns, and start, the ids of all documents before this one."""
    rows = spark.read.orc(path)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = F.sum("shard_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    starts = written(shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start")), "token-starts")
    return rows.join(small(starts), "shard").withColumn("start", F.col("shard_start") + F.col("shard_pos")).drop("shard_start")


@F.arrow_udf(T.LongType())
def ids_crc32(tokens: pa.Array) -> pa.Array:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    at, ids = tokens.offsets.to_numpy(), np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<u4")
    return pa.array([zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64())


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows of read_shards."""
    return rows.select("doc_id", "start", "n_tokens", ids_crc32("tokens").alias("ids_crc32"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_shards(table(spark, sf_dir, "documents"), path)
    return digest(read_shards(spark, path))
