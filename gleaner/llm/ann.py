"""Approximate nearest neighbours: inverted lists whose vectors are scanned adaptively by dimensions.

Vectors are centred, rotated by a random orthogonal matrix and dealt to the list of the nearest centroid; they lie in
column blocks. A query scans its own list first, which bounds its k-th nearest distance, and then its other lists under
that bound. In a list partial distances grow block by block, and after each block a hypothesis test abandons candidates
whose whole distance can hardly be within the bound (Gao and Long, 2023): the first dimensions of a rotated vector are a
random sample of all. What is left is measured exactly on the original vectors.

Centroids are fitted on a bounded sample. How many lists a query scans is measured: the exact neighbours of a bounded
sample of rows among all rows tell in how many lists the wanted share of them lies. Every row is indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, read_table

NEIGHBOURS = 10
QUERY_STEP = 100
#: Bounds: lists, rows (and numbers) that centroids are fitted on, rows whose exact neighbours are asked for.
MAX_LISTS, SAMPLE_ROWS, SAMPLE_VALUES, TRIED_ROWS = 1024, 16384, 1 << 22, 128
#: The share of exact neighbours of the tried rows that must lie in the lists scanned.
TARGET = 0.98
FIT_ROUNDS = 8
COLUMNS = 8
#: Width of the hypothesis tests, of which a neighbour within the bound passes one after each block of columns.
EPSILON = 3.0
#: Rows of a list that are scanned in one task are the mean list's, between these; queries in a group.
LEAST_BLOCK, MOST_BLOCK, GROUP_ROWS = 256, 8192, 4096


def whole(vector: str) -> Column:
    """The vector in double precision; null if it is null, zero or has a null or non-finite component."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad & F.exists(v, lambda x: x != 0), v)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both, up to a rounding."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


class Index:
    """How vectors are centred, scaled and rotated, and the centroids of the lists (rotated)."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        self.width = sample.shape[1]
        self.centre, self.scale = sample.mean(axis=0), np.abs(sample).max() or 1.0
        self.rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.width, self.width)))[0]
        rotated = self.rotated(sample)
        centroids = np.unique(rotated[:lists], axis=0)
        for _ in range(FIT_ROUNDS):
            near = _gaps(rotated, centroids).argmin(axis=1)
            counts = np.bincount(near, minlength=len(centroids))
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, rotated)
            centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        self.centroids = centroids

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -1e15, 1e15) @ self.rotation

    def order(self, rotated: np.ndarray) -> np.ndarray:
        """The lists of each vector, the nearest first."""
        return _gaps(rotated, self.centroids).argsort(axis=1, kind="stable")

    def blocks(self, rotated: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(rotated[:, i : i + COLUMNS]) for i in range(0, self.width, COLUMNS)]


def exact(query: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares summed in the order of components."""
    total = np.zeros(len(data))
    with np.errstate(over="ignore"):
        for j in range(data.shape[1]):
            total += (data[:, j] - query[j]) ** 2
        return np.sqrt(total)


def adaptive_scan(blocks: list[np.ndarray], query: list[np.ndarray], bound: float, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, int]:
    """Positions that may be among the k nearest within ``bound`` (a squared distance), and how many numbers were read."""
    width = sum(b.shape[1] for b in blocks)
    alive, read = np.arange(len(blocks[0])), 0
    if bound == np.inf and len(alive) > k:  # nothing is known yet: the first rows tell a bound
        first = sum(((b[: 4 * k] - q) ** 2).sum(axis=1) for b, q in zip(blocks, query))
        read, bound = first.size * width, float(np.partition(first, k - 1)[k - 1])
    slack, total, done = bound * (1 + 1e-5) + 1e-12, np.zeros(len(alive)), 0
    for block, q in zip(blocks, query):
        part = block if len(alive) == len(block) else block[alive]
        total, done, read = total + ((part - q) ** 2).sum(axis=1), done + block.shape[1], read + part.size
        most = slack if done == width else min(slack, slack * done / width * (1 + epsilon / np.sqrt(done)) ** 2)
        keep = total <= most
        alive, total = alive[keep], total[keep]
    if len(alive) > k:
        keep = total <= np.partition(total, k - 1)[k - 1] * (1 + 1e-5) + 1e-12
        alive = alive[keep]
    return alive, read


def _placed(index: Index) -> Callable:
    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rotated = index.rotated(_matrix(batch["v"], index.width))
            batch["cell"] = _gaps(rotated, index.centroids).argmin(axis=1).astype(np.int32)
            batch["r"] = [row.tobytes() for row in rotated.astype(np.float32)]
            yield batch

    return placed


def _tried(index: Index, ids: np.ndarray, tried: np.ndarray, k: int) -> Callable:
    """The k nearest in each task of every tried row, with their lists."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"query_id": [], "gap": [], "cell": []})
        for batch in batches:
            gaps = _gaps(tried, _matrix(batch["v"], index.width))
            gaps[ids[:, None] == batch["vec_id"].to_numpy()[None, :]] = np.inf
            at = gaps.argsort(axis=1)[:, :k]
            found = pd.DataFrame({"query_id": np.repeat(ids, at.shape[1]), "gap": np.take_along_axis(gaps, at, 1).reshape(-1), "cell": batch["cell"].to_numpy()[at].reshape(-1)})
            best = pd.concat([best, found[np.isfinite(found["gap"])]]).sort_values("gap", kind="stable").groupby("query_id").head(k)
        yield best.astype({"query_id": "int64", "gap": "float64", "cell": "int32"})

    return near


def _routed(index: Index, probes: int, sizes: np.ndarray, k: int) -> Callable:
    """The lists that a query scans: so many, and more where these hold too few rows."""

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order = index.order(index.rotated(_matrix(batch["v"], index.width)))
            enough = np.array([np.searchsorted(np.cumsum(sizes[o]), k + 1) + 1 for o in order], dtype=np.int64)
            batch["cells"] = [o[: max(probes, e)].astype(np.int32) for o, e in zip(order, enough)]
            yield batch

    return routed


def _scanned(index: Index, k: int) -> Callable:
    def scanned(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of a block for each query of a group; what lies beyond its bound is left out."""
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})]
        if len(queries) and len(data):
            ids, vectors = data["vec_id"].to_numpy(), _matrix(data["v"], index.width)
            rows = lambda column: np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, index.width)
            blocks, asked = index.blocks(rows(data["r"])), _matrix(queries["v"], index.width)
            for n, (query, bound) in enumerate(zip(queries["query_id"], queries["bound"])):
                part = [q[0] for q in index.blocks(rows(queries["r"].iloc[n : n + 1]))]
                at, _ = adaptive_scan(blocks, part, (bound / index.scale) ** 2 if np.isfinite(bound) else np.inf, k + 1)
                at = at[ids[at] != query]
                score = exact(asked[n], vectors[at])
                first = np.lexsort((ids[at], score))[:k]
                first = first[score[first] <= bound]
                found.append(pd.DataFrame({"query_id": np.full(len(first), query), "vec_id": ids[at[first]], "score": score[first]}))
        return pd.concat(found)

    return scanned


def _scan(queries: DataFrame, data: DataFrame, sizes: dict[int, int], index: Index, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of queries (one row for each list of a query, with its bound) in blocks of those lists."""
    spark = data.sparkSession
    asked = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    block = min(MOST_BLOCK, max(LEAST_BLOCK, sum(sizes.values()) // len(sizes)))
    dealt = F.broadcast(spark.createDataFrame([(c, -(-sizes.get(c, 1) // block), -(-n // GROUP_ROWS)) for c, n in asked.items()], "cell int, blocks int, groups int"))
    some = lambda column, count, seed: F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    key = ["cell", "block", "grp"]
    left = queries.join(dealt, "cell").withColumn("grp", some("query_id", "groups", 1)).withColumn("block", every("blocks")).select(*key, "query_id", "v", "r", "bound")
    right = data.join(dealt, "cell").withColumn("block", some("vec_id", "blocks", 2)).withColumn("grp", every("groups")).select(*key, "vec_id", "v", "r")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_scanned(index, k), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def adaptive_neighbours(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, vec_id: str = "vec_id", vector: str = "embedding", told: dict | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query among all other rows, nearest first.

    Vectors that are null or zero or have a null or non-finite component, and rows without an id, take no part. Rows that
    repeat an id count once (the smallest vector). Shorter vectors count as filled with zeros. Ties go to the smaller id;
    with fewer than k candidates all are returned; distances beyond a double are infinite; other columns play no part,
    whatever they are called; an empty table gives no rows. ``told`` is given the numbers of rows, lists and lists scanned.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole(vector).alias("v")).filter("vec_id is not null and v is not null")
    rows = checkpointed(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    most = max(TRIED_ROWS, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    mixed = F.xxhash64("vec_id", F.lit(3))
    some = rows if n <= 2 * most else rows.filter(F.pmod(mixed, F.lit(1 << 40)) < F.lit(int((1 << 40) * 1.5 * most / n)))
    sample = some.orderBy(mixed, "vec_id").limit(most).collect()  # bounded by SAMPLE_ROWS and SAMPLE_VALUES
    drawn = _matrix(pd.Series([r["v"] for r in sample]), width)
    tried = drawn[:TRIED_ROWS]
    rest = drawn[TRIED_ROWS:] if len(drawn) > 4 * TRIED_ROWS else drawn  # rows that centroids are fitted to lie too near to them
    index = Index(rest, min(MAX_LISTS, max(1, isqrt(n)), max(1, len(rest) // 8)))
    placed = checkpointed(rows.withColumn("is_query", is_query).mapInPandas(_placed(index), "vec_id long, v array<double>, is_query boolean, cell int, r binary"))
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    ids = np.array([r["vec_id"] for r in sample[:TRIED_ROWS]])
    near = placed.select("vec_id", "v", "cell").mapInPandas(_tried(index, ids, tried, k), "query_id long, gap double, cell int")
    by = Window.partitionBy("query_id").orderBy("gap")
    near = near.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).select("query_id", "cell").collect()  # TRIED_ROWS x k rows
    places = {int(q): np.argsort(o) for q, o in zip(ids, index.order(index.rotated(tried)))}
    ranks = sorted(int(places[q][c]) for q, c in near)
    probes = 1 + (ranks[min(len(ranks) - 1, int(TARGET * len(ranks)))] if ranks else 0)
    if told is not None:
        told.update(rows=n, lists=len(index.centroids), probes=probes)
    counts = np.array([sizes.get(c, 0) for c in range(len(index.centroids))])
    queries = placed.filter("is_query").select(F.col("vec_id").alias("query_id"), "v", "r")
    queries = checkpointed(queries.mapInPandas(_routed(index, probes, counts, k), "query_id long, v array<double>, r binary, cells array<int>"))
    if queries.isEmpty():
        return empty
    first = queries.select("query_id", "v", "r", F.col("cells")[0].alias("cell"), F.lit(float("inf")).alias("bound"))
    own = checkpointed(_best(_scan(first, placed, sizes, index, k), k).drop("rank"))
    bounds = own.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    rest = queries.join(bounds, "query_id", "left").select("query_id", "v", "r", F.explode(F.slice("cells", F.lit(2), F.size("cells"))).alias("cell"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    others = _scan(rest, placed, sizes, index, k)
    return _best(own.unionByName(others), k).select("query_id", "rank", "vec_id", "score")


def op11_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
