"""Vector codes by product quantisation, trained by Lloyd rounds that are maintained by differences.

Each part's previous assignment is kept with its row, and the integer sums and counts of every codebook entry run on
from round to round: a round shuffles only what the parts whose assignment changed add to one entry and take from
another, summed in each task first. Codebooks (a few entries of a part's width) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from gleaner.llm.common import checkpointed, join_spread, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 2**63 - 1


def whole(vector: str, scale: int = SCALE) -> Column:
    """floor(scale x) of each component; null if the vector is null or has a null or non-finite component."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Codebooks:
    """Entries (part, entry, component) as whole numbers, and whether doubles hold all squared distances to them."""

    def __init__(self, entries: np.ndarray, largest: int):
        self.entries, self.small = entries, 4 * max(1, entries.shape[2]) * (largest + 1) ** 2 < 2**53
        self.kind = np.float64 if self.small else object

    def parts_of(self, column: pa.Array) -> np.ndarray:
        count, _, width = self.entries.shape
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), count, width).astype(self.kind)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each part (the first of equals) and the squared distance to it."""
        codes, errors = [], []
        for part, entries in zip(x.transpose(1, 0, 2), self.entries.astype(self.kind)):
            gaps = np.stack([((part - e) ** 2).sum(axis=1) for e in entries], axis=1)
            codes.append(gaps.argmin(axis=1))
            errors.append(gaps[np.arange(len(part)), codes[-1]])
        return np.stack(codes, axis=1).astype(np.uint8), np.stack(errors, axis=1)


def _binary(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes], pa.binary())


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [columns.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)]
    return pa.RecordBatch.from_arrays(kept, names=batch.schema.names)


def _assign(books: Codebooks) -> Callable:
    """The codes so far become ``was``; ``codes`` are those by these codebooks."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _ = books.nearest(books.parts_of(batch.column("v")))
            yield _with(batch, codes=_binary(codes), was=batch.column("codes").cast(pa.binary()))

    return assign


def _differences(books: Codebooks) -> Callable:
    """What the changed parts of a task's rows add to entries and take from them: ``slot, place, high, low``.

    A place is a component or, last, the count; sums are split, so that their sums over any number of tasks fit.
    """

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, entries, width = books.entries.shape
        sums = np.zeros((count, entries, width + 1), dtype=object)
        for batch in batches:
            x = books.parts_of(batch.column("v"))
            now, was = (batch.column(c).to_pylist() for c in ("codes", "was"))
            for p in range(count):
                new = np.array([c[p] for c in now], dtype=np.int64)
                old = np.array([-1 if c is None else c[p] for c in was], dtype=np.int64)
                for codes, sign in ((new, 1), (old, -1)):
                    for e in np.unique(codes[(new != old) & (codes >= 0)]):
                        mine = x[(new != old) & (codes == e), p]
                        sums[p, e] += sign * np.array([*(int(s) for s in mine.sum(axis=0)), len(mine)], dtype=object)
        found = [(p * entries + e, j, int(s) >> 32, int(s) & 0xFFFFFFFF) for (p, e, j), s in np.ndenumerate(sums) if s]
        columns = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "place", "high", "low"])

    return differences


def _errors(books: Codebooks) -> Callable:
    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, gaps = books.nearest(books.parts_of(batch.column("v")))
            total = pa.array([min(int(g), LARGEST) for g in gaps.sum(axis=1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _binary(codes), total], names=["vec_id", "label", "codes", "error"])

    return errors


def trained(rows: DataFrame, books: Codebooks, rounds: int = ROUNDS, trace: list[int] | None = None) -> tuple[DataFrame, Codebooks]:
    """The rows with their last codes, and the codebooks after ``rounds`` rounds; ``trace`` is told how many rows had a
    changed part in each round. Rounds after one without a change are the same and are left out."""
    entries = books.entries.copy()
    sums = np.zeros((*entries.shape[:2], entries.shape[2] + 1), dtype=object)
    for _ in range(rounds):
        rows = checkpointed(rows.mapInArrow(_assign(books), rows.schema))
        changed = rows.filter(~F.col("codes").eqNullSafe(F.col("was")))
        told = changed.mapInArrow(_differences(books), "slot long, place long, high long, low long").groupBy("slot", "place").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        moved = told.collect()  # at most a row for each number of the codebooks
        if trace is not None:
            trace.append(changed.count())
        if not moved and (sums != 0).any():
            break
        for slot, place, high, low in moved:
            sums[slot // entries.shape[1], slot % entries.shape[1], place] += (high << 32) + low
        used = sums[:, :, -1] > 0
        entries[used] = sums[used][:, :-1] // sums[used][:, -1:]
        books.entries = entries.copy()
    return rows, books


def product_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each row whose vector is whole.

    Rows with a null vector or a null or non-finite component are left out. Shorter vectors, and lengths that 8 does not
    divide, count as filled with zeros. Rows that share an id are rows of their own, in the order of their vectors; rows
    without an id are coded, and come last where codebooks start. With fewer than 16 rows codebooks start with as many
    entries. Components beyond 64 bits count as the largest or smallest such number, and so does an error; all else is
    exact. Null labels are one group, a label with a third of all rows is spread; other columns play no part, whatever
    they are called; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(vector).alias("v")).filter("v is not null")
    ends = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    kinds = {f.name: f for f in rows.schema}
    if not ends[0]:
        return spark.createDataFrame([], StructType([kinds["vec_id"]])).selectExpr("*", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    width = -(-ends[1] // PARTS)
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width * PARTS) - F.size("v")))
    rows = rows.select("vec_id", "label", filled.alias("v"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("was"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    start = np.array([r["v"] for r in first], dtype=object).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    rows, books = trained(rows, Codebooks(start, max(abs(ends[2] or 0), abs(ends[3] or 0))))
    digest = hashlib.sha256(",".join(str(x) for x in books.entries.reshape(-1)).encode()).hexdigest()
    coded = checkpointed(rows.select("vec_id", "label", "v").mapInArrow(_errors(books), StructType([kinds["vec_id"], kinds["label"], StructField("codes", BinaryType()), StructField("error", LongType())])))
    name = F.concat(F.when(F.col("label").isNull(), "n").otherwise("v"), F.coalesce(F.col("label").cast("string"), F.lit("")))
    coded = coded.withColumn("named", name)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long")
    sums = checkpointed(coded.groupBy("named").agg(total.alias("label_error"), F.count(F.lit(1)).alias("copies")))
    return join_spread(coded, sums, "named", "copies").select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(read_table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    gap = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""v as materialized (select vec_id, label, v, row_number() over (order by vec_id) as r from (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
x as materialized (select r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] as x from v, range({PARTS}) t(p)),
c0 as materialized (select p, r - 1 as e, x as c from x where r <= {ENTRIES})"""]
    for k in range(ROUNDS):
        steps.append(f"""a{k} as materialized (select r, p, any_value(x) as x, min({gap} * {ENTRIES} + e) % {ENTRIES} as e from x join c{k} using (p) group by r, p),
s{k} as (select p, e, j, sum(x[j]) as s, count(*) as n from a{k}, range(1, (select max(len(x)) + 1 from x)) t(j) group by all),
m{k} as (select p, e, list(((s - (s % n + n) % n) // n)::bigint order by j) as m from s{k} group by p, e),
c{k + 1} as materialized (select p, e, coalesce(m, c) as c from c{k} left join m{k} using (p, e))""")
    last = f"c{ROUNDS}"
    return f"""with {", ".join(steps)}, g as materialized (select r, p, min({gap} * {ENTRIES} + e) as g from x join {last} using (p) group by r, p),
o as (select r, string_agg(printf('%02x', (g % {ENTRIES})::int), '' order by p) as code, sum(g // {ENTRIES})::bigint as error from g group by r),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as digest from {last})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256 from v join o using (r), h"""


OP12_SQL = _oracle()
