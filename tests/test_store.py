"""The collection: changes touch the buckets of their keys alone."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import embedding
from gleaner.sources.store import Collection


def files(spark, store):
    """The files of each bucket."""
    rows = spark.read.parquet(f"{store.folder}/rows").select("__bucket", F.input_file_name().alias("f")).distinct().collect()
    return {b: {r["f"] for r in rows if r["__bucket"] == b} for b in {r["__bucket"] for r in rows}}


def test_upsert_and_delete_write_their_buckets_only(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"), buckets=32)
    assert not store.healthy() and store.schema() is None
    store.upsert(spark.range(1000).withColumn("x", F.lit("old")))
    before = files(spark, store)
    changed = spark.range(0, 1000, 100).withColumn("x", F.lit("new")).union(spark.createDataFrame([(None, "no key")], "id long, x string"))
    for _ in range(2):  # the second time changes nothing
        store.upsert(changed)
        assert store.count() == 1000 and store.count(x="new") == 10
    after, other = files(spark, store), Collection(spark, str(tmp_path / "c"))  # which finds the number of buckets
    touched = {r[0] for r in changed.filter("id is not null").select(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(32)).cast("int")).collect()}
    assert len(touched) < 12 and {b for b in before if before[b] != after[b]} == touched
    assert other.delete(spark.createDataFrame([(0,), (5000,)], "id long")) == 2 and store.count() == 999 and other.buckets == 32
    assert store.delete(spark.range(1000)) == 1000 and store.count() == 0  # buckets that lose all rows too
    store.upsert(spark.createDataFrame([(7, "x", 1.5)], "id long, x string, y double"))
    store.upsert(spark.createDataFrame([(8, "z")], "id long, x string"))
    assert sorted(map(tuple, store.read().select("id", "x", "y").collect())) == [(7, "x", 1.5), (8, "z", None)]


def test_migrate_keeps_ids_and_counts(spark, tmp_path):
    source, target = Collection(spark, str(tmp_path / "a")), Collection(spark, str(tmp_path / "b"), buckets=8)
    source.write(spark.range(50).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")))
    assert source.migrate(target, lambda rows: embedding.embedded(rows, "text")) == 50
    assert target.count() == 50 and target.ids().exceptAll(source.ids()).isEmpty() and target.read().filter("size(embedding) = 32").count() == 50
    with pytest.raises(ValueError):
        source.migrate(target, lambda rows: rows.withColumn("id", F.col("id") % 49))
    with pytest.raises(FileNotFoundError):
        Collection(spark, str(tmp_path / "none")).read()
    empty = Collection(spark, str(tmp_path / "e"))
    empty.ensure("id long, text string")
    assert empty.migrate(target) == 0 and target.count() == 0
