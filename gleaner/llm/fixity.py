"""Fixity audit of archive replicas by Merkle trees; DataFrame functions only.

Records are WARC response records, held in volumes by ranges of their keys and, in a volume, one after the other in the
order of keys. Each replica is laid out and hashed on its own: a leaf is the hash of an ordered range of records with
their offsets, lengths and digests, a node above it that of its children with the offsets they cover. Roots are compared
first, and only the children of nodes that differ are read, down to the records of ranges that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, read_table

#: Keys of a volume, records of a leaf's range and children of a node: a volume is a node.
VOLUME, FANOUT = 256, 16
#: Hexadecimal digits of a digest that are summed together.
PART = 15
#: So many differing nodes are sent to all tasks that read the next level; more are joined by a shuffle.
BROADCAST_NODES = 200_000
#: The head of a WARC response record.
HEAD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{id}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {length}\r\n\r\n"
TAIL = "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a page's record; null fields are empty."""
    body = F.coalesce(html, F.lit(""))
    fills = {"{id}": page_id.cast("string"), "{url}": F.coalesce(url, F.lit("")), "{length}": F.octet_length(body).cast("string")}
    parts, rest = [], HEAD
    for mark, value in fills.items():
        before, rest = rest.split(mark)
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest), body, F.lit(TAIL))


def _folded(digest: Column) -> Column:
    """The digest of all records of a key: that of the one there is, or one of their number and of the sums of parts of
    their digests, in which no record's change or loss is hidden and which combines before the shuffle."""
    sums = (F.sum(F.conv(F.substring(digest, at, PART), 16, 10).cast("decimal(20,0)")).cast("string") for at in range(1, 64 - PART, PART))
    return F.when(F.count(F.lit(1)) == 1, F.min(digest)).otherwise(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256))


def record_table(pages: DataFrame) -> DataFrame:
    """``key, digest, length`` of each page's records: the records themselves are not shuffled.

    All records of a repeated ``page_id`` count, the same ones too: as one entry with their folded digest and all their
    bytes. Pages without an id are left out.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.filter("page_id is not null").select(F.col("page_id").alias("key"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("length"))
    return rows.groupBy("key").agg(_folded(F.col("digest")).alias("digest"), F.sum("length").alias("length"))


def laid_out(records: DataFrame) -> DataFrame:
    """A replica as it lies in its volumes: ``key, volume, ordinal, start, digest, length``.

    A volume has at most ``VOLUME`` records, whatever the data, so it is laid out in one place.
    """
    volume = F.floor(F.col("key") / VOLUME)
    order = Window.partitionBy("volume").orderBy("key")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = records.filter("key is not null").withColumn("volume", volume)
    return placed.select("key", "volume", (F.row_number().over(order) - 1).alias("ordinal"), before.alias("start"), "digest", "length")


def _range(ordinal: str = "ordinal") -> Column:
    """The leaf of a record: ranges of a volume are numbered within the volume's number."""
    return F.col("volume") * (VOLUME // FANOUT) + F.expr(f"{ordinal} div {FANOUT}")


def _hash_of(order: str, *parts: str) -> Column:
    row = F.struct(order, F.concat_ws(":", *(F.col(p).cast("string") for p in parts)).alias("t"))
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), "|"), 256)


def merkle_levels(replica: DataFrame, height: int) -> list[DataFrame]:
    """The tree of a laid-out replica, from the leaves up: ``node, digest, start, stop`` at each of ``height`` levels.

    A node has at most ``FANOUT`` children, whatever the data; offsets are those in the volume, and above volumes the
    bytes that a node's children hold.
    """
    end = F.col("start") + F.col("length")
    leaves = replica.groupBy(_range().alias("node")).agg(_hash_of("ordinal", "key", "start", "length", "digest").alias("digest"), F.min("start").alias("start"), F.max(end).alias("stop"))
    levels = [checkpointed(leaves)]
    while len(levels) < height:
        whole = len(levels) == 1
        covers = (F.min("start"), F.max("stop")) if whole else (F.lit(0).cast("long"), F.sum(F.col("stop") - F.col("start")))
        above = levels[-1].withColumn("child", F.col("node")).groupBy(F.shiftright("child", 4).alias("node"))
        grouped = above.agg(_hash_of("child", "child", "start", "stop", "digest").alias("digest"), covers[0].alias("start"), covers[1].alias("stop"))
        levels.append(checkpointed(grouped))
    return levels


def _height(*replicas: DataFrame) -> int:
    """Levels up to where all nodes of all replicas are one (two where keys are negative too)."""
    ends = [replica.agg(F.min(_range()), F.max(_range())).first() for replica in replicas]
    nodes = [n for pair in ends for n in pair if n is not None]
    height = 1
    while any(n not in (0, -1) for n in nodes):
        nodes, height = [n >> 4 for n in nodes], height + 1
    return height


def audit(manifest: DataFrame, replica: DataFrame, trace: list[tuple[int, int]] | None = None) -> DataFrame:
    """Records of ``manifest`` that ``replica`` (both laid out) lacks or has otherwise, and those it has besides:
    ``key, volume, ordinal, start, length, status``.

    ``status`` is altered (same length), resized, missing or extra; the place is the manifest's, of an extra record the
    replica's. A lost or added record moves the later ones of its volume: these are read, and are no fault if their
    bytes are the same. Keys must be unique; rows without a key are left out. An empty replica lacks every record, and
    an empty manifest has none to lack. ``trace`` is told how many nodes were read at each level.
    """
    height = _height(manifest, replica)
    ours, theirs = merkle_levels(manifest, height), merkle_levels(replica, height)
    suspects = None
    for level in range(height - 1, -1, -1):
        sides = []
        for tree in (ours, theirs):
            nodes = tree[level].select("node", F.concat_ws(":", "start", "stop", "digest").alias("digest"))
            sides.append(nodes if suspects is None else nodes.join(suspects, F.shiftright("node", 4) == F.col("parent"), "left_semi"))
        a, b = sides
        met = checkpointed(a.withColumnRenamed("digest", "a").join(b.withColumnRenamed("digest", "b"), "node", "full_outer"))
        if trace is not None:
            trace.append((level, met.count()))
        suspects = met.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("node").alias("parent"))
        suspects = F.broadcast(suspects) if suspects.count() <= BROADCAST_NODES else suspects
    here = lambda df: df.join(suspects, _range() == F.col("parent"), "left_semi")
    other = here(replica).select("key", *(F.col(c).alias(f"their_{c}") for c in ("volume", "ordinal", "start", "length", "digest")))
    met = here(manifest).join(other, "key", "full_outer")
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("their_digest").isNull(), "missing").when(F.col("length") != F.col("their_length"), "resized").when(F.col("digest") != F.col("their_digest"), "altered")
    place = [F.coalesce(c, f"their_{c}").alias(c) for c in ("volume", "ordinal", "start", "length")]
    return met.select("key", *place, status.alias("status")).filter("status is not null")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults, by the page's number: lost, cut short, or one character changed."""
    html = F.coalesce("html", F.lit(""))
    return pages.filter("page_id % 101 <> 3").withColumn(
        "html", F.when(F.col("page_id") % 89 == 5, F.expr("substring(coalesce(html, ''), 1, length(coalesce(html, '')) div 2)")).when(F.col("page_id") % 83 == 7, F.concat(F.lit("#"), F.substring(html, 2, 1 << 30))).otherwise(F.col("html"))
    )


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = audit(checkpointed(laid_out(record_table(pages))), checkpointed(laid_out(record_table(damaged(pages)))))
    return found.select(F.col("key").alias("page_id"), "volume", "ordinal", F.col("start").alias("offset"), "length", "status")


def _sql_record(html: str) -> str:
    text, values = HEAD, {"{id}": "page_id", "{url}": "coalesce(url, '')", "{length}": f"strlen({html})"}
    for mark, value in values.items():
        text = text.replace(mark, f"' || {value} || '")
    return ("'" + text + f"' || {html} || '" + TAIL + "'").replace("\r\n", "' || chr(13) || chr(10) || '")


_DAMAGED = "case when page_id % 89 = 5 then substring(coalesce(html, ''), 1, length(coalesce(html, '')) // 2) when page_id % 83 = 7 then '#' || substring(coalesce(html, ''), 2) else coalesce(html, '') end"

_FOLD = "case when count(*) = 1 then min(digest) else sha256(concat_ws(':', count(*)::varchar, " + ", ".join(f"sum(('0x' || substring(digest, {at}, {PART}))::bigint)::varchar" for at in range(1, 64 - PART, PART)) + ")) end"


def _sql_table(html: str, where: str) -> str:
    text = _sql_record(html)
    return f"select page_id, {_FOLD} as digest, sum(length)::bigint as length from (select page_id, sha256({text}) as digest, strlen({text}) as length from pages where page_id is not null and {where}) group by page_id"


OP7_SQL = f"""
with a as ({_sql_table("coalesce(html, '')", "true")}),
m as (select *, floor(page_id / {VOLUME})::bigint as volume, (row_number() over v - 1)::int as ordinal, coalesce(sum(length) over (v rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from a
  window v as (partition by floor(page_id / {VOLUME}) order by page_id)),
b as ({_sql_table(_DAMAGED, "page_id % 101 <> 3")})
select m.page_id, m.volume, m.ordinal, m."offset", m.length, case when b.page_id is null then 'missing' when b.length <> m.length then 'resized' else 'altered' end as status
from m left join b using (page_id) where b.page_id is null or b.digest <> m.digest
"""
