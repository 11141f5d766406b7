"""Top-k, fusion, deduplication, thresholds, gates and budgets of scored rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import estimated_tokens, two_places
from gleaner.functions.vectors import dot
from gleaner.operators.ordering import checkpoint_folder, checkpointed, with_row_number

#: So many query vectors are sent to the tasks at once.
QUERY_BLOCK = 4096
RRF_K = 2


def ranked(rows: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(rows: DataFrame, by: list[str], k: int | Column, *order: Column) -> DataFrame:
    """The first k rows of each group with their ``rank``; Spark prunes each task's groups before the shuffle."""
    return ranked(rows, by, *order).filter(F.col("rank") <= k)


def dense_scores(vectors: DataFrame, query: DataFrame, condition: Column | None = None) -> DataFrame:
    """``query_id, vec_id, score`` of one query (a row ``query_id, query, ...``) and every vector, in one scan; the filter
    holds before any limit."""
    length = lambda v: F.sqrt(dot(F.col(v), F.col(v)))  # noqa: E731  once a row, not once a pair
    pairs = vectors.withColumn("__v", length("embedding")).crossJoin(F.broadcast(query.limit(1).withColumn("__q", length("query"))))
    if condition is not None:
        pairs = pairs.filter(condition)
    sizes = F.col("__v") * F.col("__q")
    score = F.when(sizes > 0, F.round(dot(F.col("embedding"), F.col("query")) / sizes, 6))
    return pairs.select("query_id", "vec_id", score.alias("score")).filter("score is not null")


def _units(column: pd.Series) -> np.ndarray:
    """Rows scaled to length 1; not a number where the length is 0."""
    x = np.array(column.tolist(), dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _block_scores(asked: list[tuple[int, list[float]]], k: int | None, by: list[str], least: float | None):
    ids = np.array([i for i, _ in asked], dtype=np.int64)
    units = _units(pd.Series([q for _, q in asked]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values("vec_id", kind="stable").reset_index(drop=True)
            found = _units(batch["embedding"]).T
            groups = batch.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(batch), dtype=np.int64)
            large = [held for held in (np.flatnonzero(groups == g) for g in np.unique(groups)) if k is not None and k < len(held)]
            for at in range(0, len(ids), 128):
                scores = np.round(units[at : at + 128] @ found, 6) + 0.0
                known = ~np.isnan(scores) if least is None else scores >= least
                for held in large:
                    part = np.where(known[:, held], scores[:, held], -np.inf)
                    known[:, held] &= part >= np.partition(part, -k, axis=1)[:, -k][:, None]  # ties of the k-th are settled by the caller
                q, v = np.nonzero(known)
                told = batch[["vec_id", *by]].iloc[v].reset_index(drop=True)
                yield told.assign(query_id=ids[at : at + 128][q], score=scores[q, v])[["query_id", "vec_id", *by, "score"]]

    return score


def dense_each(vectors: DataFrame, queries: DataFrame, finish: Callable[[DataFrame], DataFrame], k: int | None = None, by: tuple[str, ...] = (), least: float | None = None) -> DataFrame:
    """What ``finish`` makes of ``query_id, vec_id, *by, score``: all vectors with each of a stated set of queries
    (``query_id, query``); it must treat each query on its own.

    Queries go to the tasks in blocks of about ``QUERY_BLOCK``, each block with one scan of the vectors as matrix
    products; nothing is paired by a join. With ``k`` each batch of vectors keeps what may be among the k best of a query
    in each group of ``by``, with ``least`` what scores so much; both only leave out what ``finish`` drops. The driver
    holds one block at a time: where there are more, what each came to is written to the shared folder before the next is
    read, and plans don't grow with the number of queries. Vectors and queries without length have no scores.
    """
    spark, columns = vectors.sparkSession, vectors.select("vec_id", *by)
    asked = queries.filter("query is not null").select("query_id", "query")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    dealt = checkpointed(dealt) if blocks > 1 else dealt
    schema = ", ".join(["query_id long", "vec_id long", *(f"{n} {t}" for n, t in columns.drop("vec_id").dtypes), "score double"])

    def best(block: int) -> DataFrame:
        mine = [(r["query_id"], r["query"]) for r in dealt.filter(F.col("block") == block).collect()]  # about QUERY_BLOCK rows
        if not mine:
            return finish(spark.createDataFrame([], schema))
        return finish(vectors.filter("embedding is not null").select("vec_id", *by, "embedding").mapInPandas(_block_scores(mine, k, list(by), least), schema))

    if blocks == 1:
        return best(0)
    folder = f"{checkpoint_folder(spark)}/dense-{uuid.uuid4().hex}"
    for block in range(blocks):
        best(block).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def dense_pairs(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score, rank``: the k best vectors of each of a stated set of queries (``query_id, query``)."""
    return dense_each(vectors, queries, lambda found: top_k(found, ["query_id"], k, F.desc("score"), F.col("vec_id")), k)


def fused(lists: list[DataFrame], by: str, item: str, k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``by, item, rank`` from 1): the k items with the highest sums."""
    parts = lists[0].select(by, item, "rank")
    for more in lists[1:]:
        parts = parts.unionByName(more.select(by, item, "rank"))
    scores = parts.groupBy(by, item).agg(F.round(F.sum(1.0 / (constant + F.col("rank") - 1)), 6).alias("score"))
    return top_k(scores, [by], k, F.desc("score"), F.col(item))


def dedup_best(rows: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Of the rows with equal keys the one with the highest score, the first of equals."""
    return top_k(rows, keys, 1, F.desc(score), F.col(order)).drop("rank")


def above_dynamic_threshold(rows: DataFrame, by: list[str], score: str, least: float = 0.45, ratio: float = 0.75) -> DataFrame:
    """Rows that reach both the fixed threshold and a share of their group's best score.

    The best scores are aggregated before the shuffle and joined back, so a large group is not held in one task. Rows
    under the fixed threshold are not joined.
    """
    best = rows.groupBy(*(F.col(b).alias(f"__{b}") for b in by)).agg(F.max(score).alias("__best"))
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    high = rows.filter(F.col(score) >= least).join(best, same)
    return high.filter(F.col(score) >= F.col("__best") * ratio).drop("__best", *(f"__{b}" for b in by))


def relevance_gate(rows: DataFrame, by: list[str], score: str, least: float = 0.5, count: int = 1) -> DataFrame:
    """``by, chunks, best, accepted, reason`` of each group."""
    got = rows.groupBy(*by).agg(F.count(score).alias("chunks"), F.max(score).alias("best"))
    reason = (
        F.when(F.col("chunks") == 0, "nothing found")
        .when(F.col("best") < least, F.concat(F.lit("best score "), two_places(F.col("best")), F.lit(" is below "), two_places(F.lit(least))))
        .when(F.col("chunks") < count, F.format_string("%d of at least %d", F.col("chunks"), F.lit(count)))
    )
    return got.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def within_budget(rows: DataFrame, by: list[str], text: str, budget: int | Column, *order: Column) -> DataFrame:
    """Rows in order until their estimated tokens exceed the budget; the first of each group stays in any case."""
    over = Window.partitionBy(*by).orderBy(*order)
    counted = rows.withColumn("tokens", estimated_tokens(F.col(text)))
    running = counted.withColumns({"rank": F.row_number().over(over), "used": F.sum("tokens").over(over.rowsBetween(Window.unboundedPreceding, 0))})
    return running.filter((F.col("rank") == 1) | (F.col("used") <= budget))


def within_budget_spread(rows: DataFrame, by: list[str], text: str, budget: int, *order: Column) -> DataFrame:
    """``within_budget`` for groups of any size: one group may hold most of the rows without landing in one task.

    All rows are range-partitioned by group and order, with running sums over the partitions; where a group begins is
    an aggregate that is joined back. The text is left out once its tokens are counted.
    """
    counted = rows.withColumn("tokens", estimated_tokens(F.col(text))).drop(text)
    placed = with_row_number(counted, [*by, *order], "__row", weight="tokens", total="__sum")
    first = placed.groupBy(*(F.col(b).alias(f"__{b}") for b in by)).agg(F.min("__row").alias("__first"), F.min("__sum").alias("__base"))
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    running = placed.join(first, same).withColumns({"rank": F.col("__row") - F.col("__first") + 1, "used": F.col("__sum") - F.col("__base") + F.col("tokens")})
    return running.filter((F.col("rank") == 1) | (F.col("used") <= budget)).drop("__row", "__sum", "__first", "__base", *(f"__{b}" for b in by))
