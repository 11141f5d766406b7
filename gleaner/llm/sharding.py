"""Sharding by a Feistel permutation of global row numbers; DataFrame functions only."""

from __future__ import annotations

from functools import lru_cache
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import read_table, with_row_number

#: Primes just under 2^31, so that every product below fits in a signed 64-bit integer.
P1, P2, P3 = 2147483647, 2147483629, 2147483587
ROUNDS = 6
SEED = 20240501
SHARDS = 8


@lru_cache
def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    """Four keys below 2^31 for each round, from a linear congruential sequence that starts at the seed."""
    out, state = [], seed
    for _ in range(rounds):
        keys = []
        for _ in range(4):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            keys.append((state >> 33) % (P3 - 1) + 1)
        out.append(tuple(keys))
    return out


def sides(n: int) -> tuple[int, int]:
    """The sides of the smallest near-square grid that holds ``n`` numbers: a * b >= n and a * b - n < a."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mix(x: Column, keys: tuple[int, int, int, int]) -> Column:
    """The round function: affine maps modulo three primes."""
    c, d, e, f = keys
    x = ((x % P1) * c + d) % P1
    x = ((x % P2) * e + f) % P2
    return ((x % P3) * (c ^ 0x2A2A2A2A) + e) % P3


def feistel(df: DataFrame, column: str, n: int, seed: int = SEED, where: Column | None = None) -> DataFrame:
    """Replace ``column`` by its image under a permutation of 0 .. a*b-1, in rows where ``where`` holds.

    An alternating Feistel network over Z_a x Z_b: each round adds a hash of one half to the other, so it can be undone
    whatever the hash. One projection a round keeps the expression small; Spark compiles all of them into one stage.
    """
    a, b = sides(n)
    df = df.withColumns({"__l": F.expr(f"{column} div {b}"), "__r": F.col(column) % b})
    for i, keys in enumerate(round_keys(seed)):
        side = a if i % 2 == 0 else b
        df = df.withColumns({"__l": F.col("__r"), "__r": (F.col("__l") + _mix(F.col("__r"), keys)) % side})
    image = F.col("__l") * b + F.col("__r") if ROUNDS % 2 == 0 else F.col("__r") * b + F.col("__l")
    return df.withColumn(column, image if where is None else F.when(where, image).otherwise(F.col(column))).drop("__l", "__r")


def image(number: int, n: int, seed: int = SEED) -> int:
    """The image of one number of the grid, as ``feistel`` has it."""
    a, b = sides(n)
    left, right = divmod(number, b)
    for i, (c, d, e, f) in enumerate(round_keys(seed)):
        x = (right % P1 * c + d) % P1
        x = (x % P2 * e + f) % P2
        x = (x % P3 * (c ^ 0x2A2A2A2A) + e) % P3
        left, right = right, (left + x) % (a if i % 2 == 0 else b)
    return left * b + right


def locate(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of the row with this number among ``n``, without any table."""
    number = image(number, n, seed)
    while number >= n:
        number = image(number, n, seed)
    return number % shards, number // shards


def walk_length(n: int, seed: int = SEED) -> int:
    """Steps after which every cycle walk has come back below ``n``.

    Only the fewer than sqrt(n) + 1 numbers of the grid that are not row numbers can prolong a walk; following them
    needs no data, only the count and the seed.
    """
    a, b = sides(n)
    outside, steps = range(n, a * b), 1
    while outside and steps <= a * b - n:
        outside = [q for q in (image(p, n, seed) for p in outside) if q >= n]
        steps += 1
    return steps


def permute(df: DataFrame, column: str, n: int, seed: int = SEED) -> DataFrame:
    """Replace the numbers 0 .. n-1 in ``column`` by their image under a keyed permutation of 0 .. n-1."""
    if n == 0:
        return df
    df = feistel(df, column, n, seed)
    for _ in range(walk_length(n, seed) - 1):
        df = feistel(df, column, n, seed, where=F.col(column) >= n)
    return df


def shard_rows(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``position``, ``shard`` and ``slot`` to each row: a reproducible shuffle under the law ``rows``.

    The row number is the row's place in the order of ``keys`` (nulls first); the permutation sends it to a position,
    and ``shard = position mod shards``, ``slot = position div shards``. So counts differ by one at most, slots have no
    gaps, and any row's shard can be computed from its number and the row count alone. Rows equal in all keys are
    interchangeable, null and very long texts are values like others. Columns of the names ``position``, ``shard`` and
    ``slot`` that the input has are replaced, all others stay as they are. An empty table gives no rows.
    """
    n = rows.count()
    placed = permute(with_row_number(rows, keys, "position"), "position", n, seed)
    return placed.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.expr(f"position div {shards}")})


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = shard_rows(sized, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
