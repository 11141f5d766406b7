"""Near-duplicate texts by verified similarity: five words, Jaccard similarity of 0.8 or more.

Candidates come from ball hashing of SimHash fingerprints, as in ``simhash``, and, because texts at 0.8 lie 5 to 11 bits
apart and no ball that can be emitted reaches so far, from bands of minimum hashes too. The texts of a small bucket are
paired with each other. Those of a larger one are first paired with the bucket's centres; buckets that are then in more
than one component go through an exact set join by prefixes, in which texts already linked are not compared again.
Each candidate pair is verified on the two whole sets of shingles; verified links make components, of which one row
stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gleaner.llm.common import checkpointed, join_spread, stored
from gleaner.llm.components import connected_components
from gleaner.llm.simhash import fingerprint, fingerprint_links, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
#: A pair at 0.8 shares one of 16 bands of 5 minimum hashes with probability 0.998.
BANDS, BAND_ROWS = 16, 5
#: Buckets of at most so many texts are paired out; a set has a copy for so many of its pairs.
SMALL, PAIRS_A_COPY = 16, 500
#: So many texts with a candidate partner are picked from the documents by a broadcast, more by a shuffle.
BROADCAST_KEYS = 500_000
ODD = np.random.default_rng(20240607).integers(0, 1 << 63, size=(2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEY, ROW = "__text_key", "__row"


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band of minimum hashes; texts without a word share all bands."""
    least = np.full(BANDS * BAND_ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[at : at + (1 << 12), None] * ODD[0] + ODD[1]).min(axis=0), out=least)
    mixed = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        mixed = (mixed ^ (column >> np.uint64(29)) ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(32))


@pandas_udf(StructType([StructField("fingerprint", LongType()), StructField("bands", ArrayType(LongType()))]))
def _sketches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        prints, found = [], []
        for t in batch:
            hashes = shingle_hashes(t if isinstance(t, str) else None, WORDS)
            prints.append(fingerprint(hashes))
            found.append(bands(hashes).view(np.int64))
        yield pd.DataFrame({"fingerprint": np.array(prints, dtype=np.uint64).view(np.int64), "bands": found})


@pandas_udf(ArrayType(LongType()))
def _shingle_sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([np.unique(shingle_hashes(t if isinstance(t, str) else None, WORDS)).view(np.int64) for t in batch])


def _text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def bucket_members(texts: DataFrame) -> DataFrame:
    """``bucket, node, members``: the texts (``node, fingerprint, bands``) that share a band or a fingerprint with others."""
    every = F.concat("bands", F.array(F.xxhash64(F.lit(-1), "fingerprint")))
    rows = texts.select("node", F.explode(every).alias("bucket"))
    shared = checkpointed(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    return stored(join_spread(rows, shared.withColumn("copies", F.col("members")), "bucket", "copies"))


def _ordered(left: str, right: str) -> list[Column]:
    return [F.greatest(left, right).alias("u"), F.least(left, right).alias("v")]


def small_pairs(members: DataFrame) -> DataFrame:
    """``u, v``: all pairs of buckets of at most ``SMALL`` texts."""
    few = members.filter(F.col("members") <= SMALL)
    return few.alias("a").join(few.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") > F.col("b.node"))).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def _star(members: DataFrame, weights: DataFrame) -> DataFrame:
    """``u, v``: each member of a bucket with the heaviest (``node, weight``); buckets are never paired out."""
    weighed = members.join(weights, "node", "left")
    rank = F.struct(F.coalesce("weight", F.lit(0)).cast("long"), F.xxhash64(F.lit(3), "node"))
    centres = checkpointed(weighed.groupBy("bucket").agg(F.max_by("node", rank).alias("centre"), F.count(F.lit(1)).alias("rows")))
    return join_spread(members.select("bucket", "node"), centres, "bucket", "rows").filter("node <> centre").select(*_ordered("node", "centre"))


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``label``, the component of each node by the links so far."""
    return nodes.join(connected_components(links, "u", "v"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def open_texts(members: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label``: the texts of buckets that the links leave in more than one component."""
    labelled = stored(_labelled(members.select("bucket", "node"), links))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("rows")).filter("a <> b")
    return stored(join_spread(labelled, checkpointed(split.select("bucket", "rows")), "bucket", "rows").select("node", "label").distinct())


def prefix_pairs(texts: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``u, v``: every pair of ``texts`` (``node, label``) of different labels that can reach the similarity.

    Shingles are in one order, the rarest among these texts first. Of a pair at ``similarity`` the smaller set's first
    shingles beyond a share of 2t / (1 + t) and the larger set's beyond t have one in common, and from their first common
    one on enough are left in both; only what meets so is paired. In a shingle's list the texts of its most frequent
    label are compared with those of other labels alone.
    """
    t = similarity
    tokens = stored(texts.join(sets, "node").select("node", "label", F.explode("shingles").alias("shingle")))
    shared = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "shingle")))
    lists = tokens.join(shared, "shingle").groupBy("node", "label").agg(order.alias("tokens")).withColumn("n", F.size("tokens"))
    probed = F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1
    lists = lists.select("node", "label", "n", F.posexplode(F.slice("tokens", F.lit(1), probed.cast("int"))).alias("at", "token")).filter("token.df > 1")
    lists = stored(lists.select("node", "label", "n", "at", "token.shingle"))
    counts = lists.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("k"))
    main = checkpointed(counts.groupBy("shingle").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("k").alias("rows")).filter("labels > 1").drop("labels"))
    met = stored(join_spread(lists, main, "shingle", "rows").withColumn("minor", F.col("label") != F.col("main")).drop("main"))
    indexed = met.filter(F.col("at") < F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - 1e-9) + 1)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    apart = (a("shingle") == b("shingle")) & (a("label") != b("label")) & (F.struct(a("n"), a("node")) < F.struct(b("n"), b("node"))) & (a("n") >= b("n") * t - 1e-9)
    enough = F.least(a("n") - a("at"), b("n") - b("at")) >= (a("n") + b("n")) * (t / (1 + t)) - 1e-9
    pairs = [x.alias("a").join(y.alias("b"), apart & enough).select(*_ordered("a.node", "b.node")) for x, y in ((indexed.filter("minor"), met), (indexed.filter("not minor"), met.filter("minor")))]
    return pairs[0].unionByName(pairs[1]).distinct()


def ball_pairs(texts: DataFrame) -> DataFrame:
    """``u, v``: a text of each of two fingerprints within the ball's reach."""
    owner = checkpointed(texts.groupBy("fingerprint").agg(F.min("node").alias("node")))
    ends = lambda side, name: owner.select(F.col("fingerprint").alias(side), F.col("node").alias(name))
    near = fingerprint_links(owner).join(ends("a", "u"), "a").join(ends("b", "v"), "b")
    return near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _salted(pairs: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
    """The pairs with the copy (``end`` + ``_copy``) that they meet of one end's set, and how many copies it has: one for
    ``PAIRS_A_COPY`` pairs."""
    copies = checkpointed(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("rows")).withColumn("parts", F.ceil(F.col("rows") / PAIRS_A_COPY).cast("int")))
    dealt = join_spread(pairs, copies, end, "rows").withColumn(f"{end}_copy", F.pmod(F.xxhash64("u", "v"), F.col("parts")).cast("int")).drop("parts")
    return stored(dealt), copies.select(end, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"{end}_copy"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (``u, v``) whose sets of shingles (``node, shingles``) have at least this Jaccard similarity.

    Sizes are compared first, and what is left is dealt to copies of the sets before any set is joined to it.
    """
    sizes = lambda end: sets.select(F.col("node").alias(end), F.size("shingles").alias(f"n{end}"))
    near = pairs.join(sizes("u"), "u").join(sizes("v"), "v").filter(F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - 1e-9)
    dealt, copies_u = _salted(checkpointed(near), "u")
    dealt, copies_v = _salted(dealt, "v")
    both = dealt
    for end, copies in (("u", copies_u), ("v", copies_v)):
        both = both.join(copies.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}")), end), [end, f"{end}_copy"])
    both = both.select("u", "v", "nu", "nv", F.size(F.array_intersect("su", "sv")).alias("shared"))
    same = (F.col("shared") >= similarity * (F.col("nu") + F.col("nv") - F.col("shared"))) | ((F.col("nu") == 0) & (F.col("nv") == 0))
    return stored(both.filter(same).select("u", "v"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of similar texts one row: the smallest id's; all columns as they are.

    Similar are texts whose sets of five-word shingles (lower case; a shorter text is one shingle) have a Jaccard
    similarity of at least ``similarity``, and what is linked through others; null, empty and wordless texts are one
    group. Rows without an id come after all others and are judged like them; rows that share an id are judged each by
    its text; of rows equal in id and text one stays. Long texts are read whole. An empty table gives an empty one.
    """
    columns = docs.columns
    keyed = docs.withColumn(KEY, _text_key(text))
    name = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"))
    sketched = keyed.select(name.alias("name"), KEY, _sketches(F.col(text)).alias("s")).select(KEY, "name", "s.fingerprint", "s.bands")
    texts = sketched.groupBy(KEY).agg(F.min("name").alias("name"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    texts = checkpointed(texts.withColumn("node", F.monotonically_increasing_id()))
    members = bucket_members(texts)
    large = checkpointed(members.filter(F.col("members") > SMALL))
    # Near copies are often like their original and not like each other, so that the centre matters: the text with most
    # copies, the one a hash puts first, and in a second round the one with most verified links.
    pairs = _star(large, texts.select("node", F.col("copies").alias("weight"))).unionByName(_star(large, texts.select("node", F.lit(0).alias("weight"))))
    pairs = stored(pairs.unionByName(small_pairs(members)).unionByName(ball_pairs(texts)).distinct())
    wanted = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(texts.select("node", KEY, F.col("name.id").alias("id")), "node"))
    # One row has each of these texts: that of the smallest id.
    picked = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    found = keyed.select(F.col(doc_id).alias("mine"), KEY, F.col(text).alias("text")).join(picked, KEY).filter(F.col("mine").eqNullSafe(F.col("id")))
    sets = stored(found.select("node", _shingle_sets(F.col("text")).alias("shingles")).dropDuplicates(["node"]))
    links = verified(pairs, sets, similarity)
    degrees = checkpointed(links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("weight")))
    more = stored(_star(large, degrees).distinct().join(pairs, ["u", "v"], "left_anti"))
    links = links.unionByName(verified(more, sets, similarity))
    rest = open_texts(large, links)
    if not rest.isEmpty():
        last = stored(prefix_pairs(rest, sets, similarity).join(pairs.unionByName(more), ["u", "v"], "left_anti"))
        links = links.unionByName(verified(last, sets, similarity))
    parts = connected_components(links, "u", "v")
    labelled = texts.select("node", KEY, "name").join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("label")).agg(F.min(F.struct("name", KEY)).alias("kept"))
    row = lambda i, k: F.concat_ws(":", i.cast("string"), k)
    kept = checkpointed(labelled.select(row(F.col("kept.name.id"), F.col(f"kept.{KEY}")).alias(ROW)))
    marked = keyed.withColumn(ROW, row(F.col(doc_id), F.col(KEY)))
    return marked.join(kept, ROW, "left_semi").dropDuplicates([ROW]).select(*columns)
