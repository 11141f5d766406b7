"""Exact top-k search as a Voronoi kNN join.

Queries and data are assigned to the nearest of some pivots. Queries first meet the data of their own cells, which gives
each group of queries a lower bound of its k-th best score; summaries of groups and cells (largest products with the
pivots, largest norms) then bound what any other vector can score, and only vectors whose bound reaches a group's are
sent there. Blocks of vectors and groups of queries have bounded sizes, so a cell that holds a third of all rows is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, read_table

TOP_K = 5
QUERY_STEP = 50
#: Bounds: pivots, queries in a group, vectors in a block.
MAX_PIVOTS = 256
GROUP_ROWS = 2048
BLOCK_ROWS = 4096


def quantised(vector: str) -> Column:
    """floor(256 x) of each component; null if the vector is null, empty or has a null or non-finite component."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of numbers as doubles, in which the integers here are exact; shorter vectors are filled with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products_of(queries: pd.Series, data: pd.Series, width: int) -> np.ndarray:
    """Inner products of all rows of both, exact: in doubles where these hold them, else in whole numbers of any size, of
    which those beyond 64 bits count as the largest or smallest such number."""
    x, y = _matrix(queries, width), _matrix(data, width)
    if width * np.abs(x).max(initial=0) * np.abs(y).max(initial=0) < 2**53:
        return x @ y.T
    whole = lambda column: np.array([[int(c) for c in v] + [0] * (width - len(v)) for v in column], dtype=object)
    return np.clip(whole(queries) @ whole(data).T, -(2**63), 2**63 - 1)


def _assign(pivots: np.ndarray, width: int):
    half = (pivots**2).sum(axis=1) / 2

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["v"], width)
            cell = (x @ pivots.T - half).argmax(axis=1)
            batch["cell"] = cell.astype(np.int32)
            batch["reach"] = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            batch["norm"] = np.sqrt((x**2).sum(axis=1))
            yield batch

    return assign


def grouped(asked: dict[int, int], pivots: np.ndarray) -> dict[int, tuple[int, int]]:
    """The first group of each cell and how many groups share its queries: near cells form groups of a bounded size."""
    left, now, group, filled, out = set(asked), min(asked), 0, 0, {}
    while left:
        now = min(left, key=lambda c: (((pivots[c] - pivots[now]) ** 2).sum(), c))
        left.remove(now)
        if filled and filled + asked[now] > GROUP_ROWS:
            group, filled = group + 1, 0
        parts = max(1, -(-asked[now] // GROUP_ROWS))
        out[now] = group, parts
        group, filled = (group + parts, 0) if parts > 1 else (group, filled + asked[now])
    return out


def _products(pivots: np.ndarray, width: int):
    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each group in a batch its largest product with each pivot: merged by an aggregate."""
        for batch in batches:
            found = pd.DataFrame(_matrix(batch["v"], width) @ pivots.T).groupby(batch["grp"].to_numpy()).max()
            yield pd.DataFrame({
                "grp": np.repeat(found.index.to_numpy(), len(pivots)), "cell": np.tile(np.arange(len(pivots), dtype=np.int32), len(found)), "product": found.to_numpy().reshape(-1),
            })

    return largest


def _solve(k: int, width: int):
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        """The k best of a block for each query of a group; equal scores in the order of ids."""
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        data = data.sort_values("vec_id", kind="stable")
        ids, asked = data["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        found = []
        for at in range(0, len(queries), 256):
            mine = asked[at : at + 256]
            scores = _products_of(queries["v"].iloc[at : at + 256], data["v"], width)
            scores[mine[:, None] == ids[None, :]] = -np.inf
            rows = np.arange(len(mine))
            for _ in range(min(k, len(ids))):
                best = scores.argmax(axis=1)  # the first of equals
                top = scores[rows, best]
                ok = top > -np.inf
                found.append(pd.DataFrame({"query_id": mine[ok], "vec_id": ids[best[ok]], "score": np.array([int(t) for t in top[ok]], dtype=np.int64)}))
                scores[rows, best] = -np.inf
        return pd.concat(found)

    return solve


def _tiles(queries: DataFrame, data: DataFrame, blocks: int, k: int, width: int) -> DataFrame:
    """Solve each (group, block): ``data`` has ``grp``, the group it is sent to; queries go to all blocks of theirs."""
    here = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    met = here.select("grp", "block").distinct()
    there = queries.join(met, "grp")
    columns = ("grp", "block", "vec_id", "v")
    asked = there.select(*(F.col(c).alias(f"{c}_") for c in columns)).toDF(*columns)
    joined = asked.groupBy("grp", "block").cogroup(here.select(*columns).groupBy("grp", "block"))
    return joined.applyInPandas(_solve(k, width), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = TOP_K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each query with all other vectors.

    Vectors are quantised first; null ones, empty ones and those with a null or non-finite component, and rows without
    an id, take no part. Rows that repeat an id count once (the smallest vector). Shorter vectors count as filled with
    zeros. Products are exact whatever their size; a score beyond 64 bits counts as the largest or smallest such number, and
    so does a component. Ties go to the smaller id; with fewer than k candidates all are returned; other columns play
    no part, whatever they are called; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(vector).alias("v")).filter("vec_id is not null and v is not null")
    rows = checkpointed(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    wanted = min(MAX_PIVOTS, max(1, isqrt(n) // 4))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("v").collect()  # at most MAX_PIVOTS vectors
    pivots = np.unique(_matrix(pd.Series([r["v"] for r in picked]), width), axis=0)
    placed = checkpointed(rows.withColumn("is_query", is_query).mapInPandas(_assign(pivots, width), "vec_id long, v array<long>, is_query boolean, cell int, reach double, norm double"))
    counts = placed.filter("is_query").groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).collect()  # a row a pivot
    if not counts:
        return empty
    dealt = grouped({r["cell"]: r["asked"] for r in counts}, pivots)
    parts = spark.createDataFrame([(c, g, n) for c, (g, n) in dealt.items()], "cell int, first int, parts int")
    queries = placed.filter("is_query").join(F.broadcast(parts), "cell")
    queries = checkpointed(queries.withColumn("grp", F.col("first") + F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.col("parts")).cast("int")).drop("first", "parts"))
    groups = checkpointed(queries.select("grp", "cell").distinct())
    blocks = max(1, -(-n // BLOCK_ROWS))
    # Every group against its own cells: a lower bound of the k-th best score of each of its queries.
    own = checkpointed(_best(_tiles(queries, placed.join(groups, "cell"), blocks, k, width), k).drop("rank"))
    kth = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("least"))
    bounds = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").groupBy("grp").agg(
        F.min(F.when(F.col("have") >= k, F.col("least")).otherwise(F.lit(float("-inf")))).alias("floor"), F.max("norm").alias("most")
    )
    # One row a group and pivot: q.x = q.p + q.(x - p) <= max q.p + max |q| |x - p|.
    products = queries.select("grp", "v").mapInPandas(_products(pivots, width), "grp int, cell int, product double").groupBy("grp", "cell").agg(F.max("product").alias("product"))
    needs = checkpointed(products.join(bounds, "grp").join(groups, ["grp", "cell"], "left_anti"))
    sent = placed.join(needs, "cell").filter(F.col("product") + F.col("most") * F.col("reach") >= F.col("floor") - 1e-6 * (1 + F.abs(F.col("product"))))
    others = _tiles(queries, sent, blocks, k, width)
    return _best(own.unionByName(others), k).select("query_id", "rank", "vec_id", "score")


def op6_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


OP6_SQL = f"""
with v as (
  select vec_id, min(list_transform(embedding, lambda x: floor(256 * x::double)::bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id
), s as (
  select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % {QUERY_STEP} = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {TOP_K}
"""
