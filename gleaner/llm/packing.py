"""Packing of token pieces into sequences by bounded-space online best-fit."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, read_table

CAPACITY = 1024
#: Open bins of one packer. With best-fit more open bins waste less; the bitset makes each step as cheap for many.
OPEN_BINS = 4096
#: Pieces that one task packs; what its last bins leave unfilled is small against them.
PIECES_A_TASK = 50_000
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins; the fullest closes first.

    ``bits`` has bit f set if an open bin has f tokens free, so the bin that an item fits best is the lowest set bit at
    or above the item's length, and the fullest open bin is the lowest set bit of all.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def _put(self, number: int, free: int) -> None:
        if free == 0:
            return
        self.free[free].append(number)
        self.bits |= 1 << free
        self.count += 1
        if self.count > self.open_bins:
            self._take((self.bits & -self.bits).bit_length() - 1)

    def add(self, length: int) -> tuple[int, int]:
        """The bin that the item goes to and its place there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        self._put(number, free - length)
        return number, self.capacity - free


def encoder(name: str = VOCABULARY):
    """Encodes a text to the same ids as the tokenizers library from the .json file of that name, its special string
    included, none added: the same vocabulary as ranks, which another library encodes several times as fast."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    return lambda text: made.encode_to_numpy(text, allowed_special="all")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece: all have ``capacity`` tokens but for the first, which may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder()
    end = np.array([END_ID], dtype="<u4")
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.concatenate([np.asarray(encode(text.as_py() or ""), dtype="<u4"), end])
            raw = ids.tobytes()
            for number, (start, length) in enumerate(cut(len(ids))):
                rows.append((doc_id, number, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document; a null text is empty."""
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_pieces, PIECES)


def _packer(capacity: int, open_bins: int, size: str):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = BestFit(capacity, open_bins)
        for batch in batches:
            placed = [packer.add(n) for n in batch[size].tolist()]
            batch["bin"] = np.array([b for b, _ in placed], dtype=np.int64)
            batch["offset"] = np.array([o for _, o in placed], dtype=np.int64)
            yield batch

    return pack


def pack_items(items: DataFrame, size: str, order: list[str], capacity: int = CAPACITY, open_bins: int = OPEN_BINS, items_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Add ``bin`` (long) and ``offset`` (long) to every item of 1 to ``capacity`` tokens.

    Items are dealt to tasks by a hash of ``order`` and their row in ``items``, which is a checkpointed or written table,
    so that rows that are equal in all columns are spread as well; each task packs its items in one pass with a bounded
    number of open bins, whatever their number. They are sorted within a task, so that a task that runs again packs the
    same.
    """
    tasks = max(1, -(-items.count() // items_a_task))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    dealt = items.withColumn("__deal", F.xxhash64(*order, F.monotonically_increasing_id())).repartition(tasks, "__deal").sortWithinPartitions("__deal", *order).drop("__deal")
    placed = dealt.mapInPandas(_packer(capacity, open_bins, size), f"{kinds}, bin long, offset long")
    return placed.withColumn("bin", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("bin"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row for each piece of each document with its place in a sequence of at most 1024 tokens.

    Full pieces are sequences of their own; the others are packed twice: pieces into bins, then the bins that have room
    left into sequences, which joins what the tasks of the first pass left half empty. Empty and null texts are one
    end token. Rows that share an id, and rows without one, are packed each on its own; long texts are read whole and cut.
    Only ``doc_id`` and ``text`` are read: other columns are not carried along, whatever they are called. An empty table
    gives no rows.
    """
    pieces = checkpointed(token_pieces(docs))
    return pack_pieces(pieces, capacity, open_bins)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    full = pieces.filter(F.col("length") >= capacity)
    rest = pieces.filter(F.col("length") < capacity)
    first = checkpointed(pack_items(rest, "length", ["doc_id", "piece", "start", "length", "ids_crc32"], capacity, open_bins, pieces_a_task))
    bins = checkpointed(first.groupBy("bin").agg(F.sum("length").alias("filled")))
    second = checkpointed(pack_bins(bins, capacity, open_bins, pieces_a_task))
    packed = first.join(second, "bin").select(*pieces.columns, "sequence_id", (F.col("base") + F.col("offset")).alias("offset"))
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_bins(bins: DataFrame, capacity: int, open_bins: int, bins_a_task: int) -> DataFrame:
    """Pack whole bins of the first pass into sequences: ``bin, sequence_id, base``."""
    items = bins.select(F.col("bin").alias("first_bin"), "filled")
    packed = pack_items(items, "filled", ["first_bin"], capacity, open_bins, bins_a_task)
    return packed.select(F.col("first_bin").alias("bin"), F.col("bin").alias("sequence_id"), F.col("offset").alias("base"))


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
