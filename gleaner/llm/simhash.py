"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 3 or less have a block (of three) outside which they differ in 2 bits or less, so
the balls of half that radius around their other bits meet. Every distinct fingerprint emits the 43 to 44 variants of
each of those balls, variants are shuffled, and what meets in a variant is linked in time linear in its rows and
verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from gleaner.llm.common import checkpointed, join_spread, read_table, shuffle_partitions
from gleaner.llm.components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
#: The blocks of bits that are left out in turn: first bit and size.
BLOCKS = ((0, 22), (22, 21), (43, 21))
SHIFT = 44  # a variant has the block's number above its bits
#: The ball of radius 1: the bits themselves first.
BALL_1 = np.array([0] + [1 << i for i in range(SHIFT)], dtype=np.uint64)
#: Within a block, the balls of radius 1 and the sphere of radius 2.
WIDE = 22
NEAR_1 = np.array([0] + [1 << i for i in range(WIDE)], dtype=np.int64)
NEAR_2 = np.array([(1 << i) | (1 << j) for i in range(WIDE) for j in range(i)], dtype=np.int64)
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of the text's word shingles, repeats included: none where there is no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], dtype="<u8")
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(width))))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash: a bit is set if it is in over half of the hashes; 0 for none."""
    n, total = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


@pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        found = np.fromiter((fingerprint(shingle_hashes(t if isinstance(t, str) else None)) for t in batch), dtype=np.uint64, count=len(batch))
        yield pd.Series(found.view(np.int64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (as a signed long) for each row; null and wordless texts get 0."""
    return docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fingerprint"))


def _rest(fp: np.ndarray, block: int) -> np.ndarray:
    """The bits of a fingerprint outside a block."""
    first, size = BLOCKS[block]
    under = fp & np.uint64((1 << first) - 1)
    if first + size == 64:
        return under
    return ((fp >> np.uint64(first + size)) << np.uint64(first)) | under


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for block, (_, size) in enumerate(BLOCKS):
            ball = BALL_1[: 65 - size]
            keys = ((_rest(fp, block)[:, None] ^ ball[None, :]) | np.uint64(block << SHIFT)).reshape(-1)
            owners = np.repeat(fp, len(ball))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64))], names=["variant", "fp"])


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted ``keys`` of the ``wanted`` that are there, and which those are."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == wanted)
    return at[hit], hit


def link_buckets(variant: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints of each variant that are within 3 bits; ``variant`` is sorted.

    In a variant of one block all members are within 2 bits outside it. Members that agree inside the block are within
    2 bits: a star. Members that differ there in one bit are within 3: looked up by flipping each of its bits.
    What lies within 3 bits inside a block and agrees outside it is found in the variant that equals their own bits, by
    the same ball hashing inside the block. Every other pair meets in the variants of another block. Pairs that are
    farther apart than 3 bits are left out.
    """
    starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    sizes = np.diff(np.r_[starts, len(variant)])
    run = np.repeat(np.arange(len(starts), dtype=np.int64), sizes)
    keep = sizes[run] > 1
    variant, fp, run = variant[keep], fp[keep], run[keep]
    if not len(fp):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    block = (variant >> np.uint64(SHIFT)).astype(np.int64)
    first_bit, size = np.array(BLOCKS, dtype=np.uint64)[block].T
    inside = ((fp >> first_bit) & ((np.uint64(1) << size) - np.uint64(1))).astype(np.int64)
    composite = (run << WIDE) | inside
    order = np.lexsort((fp, composite))
    composite, fp, variant, block, run, inside = (x[order] for x in (composite, fp, variant, block, run, inside))
    first = np.r_[True, composite[1:] != composite[:-1]]
    heads = np.flatnonzero(first)
    head_of = heads[np.cumsum(first) - 1]
    lefts, rights = [fp[head_of][~first]], [fp[~first]]
    keys = composite[heads]
    for bit in range(WIDE):
        up = np.flatnonzero((keys >> bit) & 1 == 0)
        at, hit = _lookup(keys, keys[up] | (1 << bit))
        lefts.append(fp[heads[up[hit]]])
        rights.append(fp[heads[at]])
    rest = np.zeros(len(fp), dtype=np.uint64)
    for b in range(len(BLOCKS)):
        mine = block == b
        rest[mine] = _rest(fp[mine], b)
    own = np.flatnonzero(rest == (variant & np.uint64((1 << SHIFT) - 1)))
    if len(own):
        counts = np.bincount(run[own], minlength=0)
        own = own[counts[run[own]] > 1]
    if len(own):
        bounds = np.flatnonzero(np.r_[True, run[own][1:] != run[own][:-1]])
        ends = np.r_[bounds[1:], len(own)]
        lo = 0
        while lo < len(bounds):
            hi = lo + 1
            while hi < len(bounds) and ends[hi] - bounds[lo] <= 1 << 14:
                hi += 1
            part = own[bounds[lo] : ends[hi - 1]]
            near = ((run[part] << WIDE) | inside[part])[:, None] ^ NEAR_1[None, :]
            near, owner = near.reshape(-1), np.repeat(fp[part], len(NEAR_1))
            by = np.argsort(near, kind="stable")
            near, owner = near[by], owner[by]
            for flip in NEAR_2:
                found, hit = _lookup(near, ((run[part] << WIDE) | inside[part]) ^ flip)
                lefts.append(owner[found])
                rights.append(fp[part][hit])
            lo = hi
    left, right = np.concatenate(lefts), np.concatenate(rights)
    apart = left != right
    left, right = left[apart], right[apart]
    both = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1), axis=0)
    both = both[np.bitwise_count(both[:, 0] ^ both[:, 1]) <= RADIUS]
    return both[:, 0], both[:, 1]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by variant; a variant that a batch cuts is carried over to the next one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(variant: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        left, right = link_buckets(variant.view(np.uint64), fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], schema=EDGES)

    for batch in batches:
        if not batch.num_rows:
            continue
        variant, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cut = int(np.searchsorted(variant, variant[-1]))
        if cut == 0 and held and held[-1][0][-1] == variant[0]:
            held.append((variant, fp))
            continue
        held.append((variant[:cut], fp[:cut]))
        whole = [np.concatenate(x) for x in zip(*held)]
        if len(whole[0]):
            yield emit(*whole)
        held = [(variant[cut:], fp[cut:])]
    if held:
        yield emit(*(np.concatenate(x) for x in zip(*held)))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints (column ``fingerprint``) within 3 bits."""
    met = distinct.select("fingerprint").mapInArrow(_variants, "variant long, fp long")
    met = met.repartition(shuffle_partitions(distinct.sparkSession), "variant").sortWithinPartitions("variant")
    return met.mapInArrow(_links, "a long, b long").distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint (long), component_id`` for each row of ``docs``.

    Equal fingerprints are folded to one before anything is shuffled by variant, so a group of copies costs one row.
    Null and wordless texts share fingerprint 0 and are linked like any other; repeated rows come back repeated;
    rows with a null id take part but give no id to a component; columns of other names play no part, whatever they are
    called; long texts are read whole; an empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, doc_id, text))
    distinct = checkpointed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows")))
    parts = connected_components(fingerprint_links(distinct), "a", "b")
    labelled = distinct.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("component", "fingerprint"))
    labelled = checkpointed(labelled.select("fingerprint", "label", "least_id", "rows"))
    least = checkpointed(labelled.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = checkpointed(join_spread(labelled.select("fingerprint", "label", "rows"), least, "label", "members").select("fingerprint", "component_id", "rows"))
    return join_spread(prints, named, "fingerprint", "rows").select("doc_id", "fingerprint", "component_id")


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
