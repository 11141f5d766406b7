"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import chat, common, decontam, fixity, html_main, knn, packing, quality, sharding, similar, simhash, tokens

LONG = "word " * 60_000
ROWS = [(1, "a b c d"), (2, None), (3, ""), (4, " \n"), (5, "a b c d"), (5, "a b c d"), (None, "lost"), (6, LONG), (7, "é　日本 x\x00y")]
CLASH = ["hash", "size", "position", "label", "fingerprint", "score", "v", "cell", "block", "bin", "width", "start", "u", "component", "hashes", "pos", "piece"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return rows.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").alias("n_chars"), *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


ALL = sorted((i for i, _ in ROWS), key=lambda x: (x is not None, x))


def test_simhash(docs, none):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()]
    assert sorted((i for i, *_ in got), key=lambda x: (x is not None, x)) == ALL
    assert {(f, c) for i, f, c in got if i in (2, 3, 4)} == {(0, 2)} and {c for i, _, c in got if i in (1, 5)} == {1}
    assert simhash.simhash_components(none).count() == 0


def test_similar_texts(spark, docs, none):
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns and ids(kept) == [None, 1, 2, 6, 7]
    assert similar.keep_one(none).count() == 0
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (1, "another text of the same id, which stays as it is"), (None, " ".join(base[:-1])), (2, " ".join(base).upper()), (3, " ".join(base[:30])), (None, "alone"), (4, "alone")]
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([rows[0], rows[1], rows[4], rows[6]], key=repr)


def test_a_third_of_all_rows_are_copies(spark):
    """The group of copies is joined by a broadcast of its one row: no task gets it whole."""
    common.HOT_ROWS, old = 50, common.HOT_ROWS
    try:
        rows = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in very many rows").otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
        found = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(rows).collect()}
        assert found == {i: 0 if i % 3 == 0 else i for i in range(900)}
        assert sorted(r["doc_id"] for r in similar.keep_one(rows).collect()) == [i for i in range(900) if i % 3 or not i]
    finally:
        common.HOT_ROWS = old


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "word word word word word word word word"), (2, None), (3, ""), (4, "a b c d"), (1, "word word word word word word word word")], "item_id long, text string")
    found = decontam.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["matched"], r["changed"]) for r in found) == [(1, 4, 1, 0), (5, 4, 1, 0), (6, 1, 1, 0)]
    assert decontam.leaks(none, items).count() == 0 and decontam.leaks(docs, items.filter("false")).count() == 0
    kept = decontam.keep_clean(docs, items)
    assert kept.columns == docs.columns and ids(kept) == [i for i in ALL if i not in (1, 5, 6)]
    same_id = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a b c d"), (6, "not that one")], "doc_id long, text string"))
    assert ids(decontam.keep_clean(same_id, items)) == [None, 2, 3, 4, 6, 7]  # judged row by row, ids aside
    assert decontam.keep_clean(none, items).count() == 0 and decontam.keep_clean(docs, items.filter("false")).count() == len(ROWS)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (99, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    texts, found = quality.training_sample(docs, labels)
    assert len(texts) == len(found) <= 2
    net = quality.fit([b"good text", b"!!"] * 4, np.array([1, 0] * 4), steps=30)
    scored = quality.quality_scores(docs, net).collect()
    assert sorted((r["doc_id"] for r in scored), key=lambda x: (x is not None, x)) == ALL
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (2, 3)}) == 1
    assert {r["doc_id"]: r["held_out"] for r in scored} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in ROWS}
    assert quality.quality_scores(none, net).count() == 0
    assert quality.keep_good(docs, net).columns == docs.columns
    assert quality.fit([], np.array([])).scores([b""]).shape == (1,)


def test_sharding(docs, none):
    rows = docs.select("doc_id", "text")
    got = sharding.shard_rows(rows, ["doc_id", "text"], shards=4).collect()
    assert sorted(r["position"] for r in got) == list(range(len(ROWS)))
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    assert sharding.shard_rows(none.select("doc_id"), ["doc_id"]).count() == 0
    clashing = sharding.shard_rows(docs.withColumns({"shard": F.lit("x"), "slot": F.lit("x")}), ["doc_id", "text"], shards=4)
    assert sorted(r["position"] for r in clashing.collect()) == list(range(len(ROWS))) and set(docs.columns) <= set(clashing.columns)
    assert {r["label"] for r in clashing.collect()} == {"x"}


def test_token_counts(docs, none):
    got = {r["doc_id"]: r for r in tokens.token_counts(docs).collect()}
    assert (got[2]["n_bytes"], got[2]["n_tokens"], got[3]["n_tokens"]) == (0, 0, 0)
    assert got[6]["over_limit"] and not got[1]["over_limit"] and tokens.token_counts(docs).count() == len(ROWS)
    assert tokens.token_counts(none).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs).collect()
    assert len({(r["doc_id"], r["piece"]) for r in got}) == len(got) - 1  # the repeated row
    assert {r["length"] for r in got if r["doc_id"] in (2, 3)} == {1}
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(none).count() == 0


def test_main_text(spark):
    rows = [(1, None), (2, ""), (3, "no markup at all"), (4, "<article><p>" + "x " * 200_000), (5, "<" * 50), (6, "<!-- open"), (1, None), (7, "<div>" * 5000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_main.main_texts(pages).collect()]
    assert len(got) == len(rows) and {t for i, t, _ in got if i in (1, 2, 6)} == {""}
    assert all(n == len(t) for _, t, n in got) and next(n for i, _, n in got if i == 4) == 399_999
    assert html_main.main_texts(pages.filter("false")).count() == 0


def test_top_products(spark):
    inf = float("inf")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [inf, 0.0]), (6, [float("nan"), 0.0]), (7, []), (8, [1.0]), (0, [0.9, 0.9]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("cell", F.lit(1))
    got = sorted(map(tuple, knn.top_products(vectors, F.col("vec_id") == 0, k=2).collect()))
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768)]  # of id 0 the smaller vector; ties by id
    huge = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, 1.0]), (2, [1e8, 2.0]), (3, [-1e15, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.top_products(huge, F.col("vec_id") == 0, k=3).collect())) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1), (0, 3, 3, -(2**63))]
    large = spark.createDataFrame([(0, [4e5, 1.0]), (1, [4e5, 1.0]), (2, [4e5, 2.0])], "vec_id long, embedding array<double>")
    first = 256**2 * 16 * 10**10
    assert sorted(map(tuple, knn.top_products(large, F.col("vec_id") == 0, k=2).collect())) == [(0, 1, 2, first + 2 * 256**2), (0, 2, 1, first + 256**2)]
    assert knn.top_products(vectors.filter("false"), F.col("vec_id") == 0).count() == 0
    assert knn.top_products(vectors, F.col("vec_id") == 77).count() == 0


def test_preferences(spark):
    turns = [
        (1, "chosen", 0, "user", "q"), (1, "chosen", 1, "assistant", "yes"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "q"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "why"),
        (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 0, "user", "alone"), (4, "chosen", 0, None, None), (4, "rejected", 0, "user", None),
        (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x"), (1, "chosen", None, "user", "x"), (6, "chosen", 0, "user", "a"), (6, "rejected", 0, "user", "a"), (6, "rejected", 1, "assistant", LONG),
    ]
    table = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").withColumn("item", F.lit(1))
    got = {r["pair_id"]: r for r in chat.format_preferences(table).collect()}
    assert sorted(got) == [1, 2, 4, 6]
    assert got[1]["prompt"] == "<|user|>\nq<|end|>\n" and got[1]["prompt_turns"] == 1
    for side in ("chosen", "rejected"):
        learned = "".join(got[1][side][s["start"] : s["end"]] for s in got[1][f"{side}_mask"])
        assert learned == {"chosen": "yes<|end|>\n", "rejected": "no<|end|>\n"}[side]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["prompt_turns"] == 1
    assert got[4]["prompt"] == "" and got[4]["chosen"] == "<|" + "|>\n<|end|>\n"
    assert got[6]["chosen"] == "" and LONG in got[6]["rejected"]
    assert chat.format_preferences(table.filter("false")).count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * i if i % 5 else None) for i in range(40)] + [(None, "u", "x"), (3, "u3", "xxx")], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    lay = lambda df: fixity.laid_out(fixity.record_table(df))
    manifest = lay(pages)
    assert fixity.audit(manifest, lay(pages)).count() == 0
    other = pages.filter("page_id is null or page_id <> 7").withColumn("html", F.when(F.col("page_id") == 9, F.lit("y" * 9)).when(F.col("page_id") == 11, F.lit("z")).otherwise(F.col("html")))
    other = other.unionByName(spark.createDataFrame([(99, "new", "n", "clash"), (-5, "low", "n", "clash"), (5000, "far", "n", "clash")], "page_id long, url string, html string, digest string"))
    got = {r["key"]: r["status"] for r in fixity.audit(manifest, lay(other)).collect()}
    assert got == {7: "missing", 9: "altered", 11: "resized", 99: "extra", -5: "extra", 5000: "extra"}
    assert fixity.audit(manifest, lay(pages.filter("false"))).count() == 40
    assert {r["status"] for r in fixity.audit(manifest.filter("false"), lay(pages)).collect()} == {"extra"}
    assert fixity.audit(manifest.filter("false"), manifest.filter("false")).count() == 0


def test_fixity_of_repeated_records(spark):
    """All records of an id are audited: a changed, lost or added copy shows, their order doesn't."""
    rows = [(1, "u", "a" * 9), (1, "u", "b" * 9), (1, "u", "b" * 9), (2, "u", "c")]
    lay = lambda rows: fixity.laid_out(fixity.record_table(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)))
    told = lambda rows: {r["key"]: r["status"] for r in fixity.audit(lay(ROWS_OF_PAGES), lay(rows)).collect()}
    ROWS_OF_PAGES = rows
    assert told(rows[::-1]) == {}
    assert told([rows[0], (1, "u", "x" * 9), *rows[2:]]) == {1: "altered"} and told([rows[0], *rows[2:]]) == {1: "resized"}
    assert told([rows[0], rows[0], *rows[2:]]) == {1: "altered"} and told([*rows, rows[3]]) == {2: "resized"} and told(rows[:3]) == {2: "missing"}


def test_equal_branches_are_not_read(spark):
    """One changed record among 20,000: at each level only the children of the one differing node are read."""
    rows = spark.range(20_000).select(F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(10).cast("long").alias("length"))
    changed = rows.withColumn("digest", F.when(F.col("key") == 12_345, "x").otherwise(F.col("digest")))
    trace = []
    got = [tuple(r) for r in fixity.audit(fixity.laid_out(rows), fixity.laid_out(changed), trace).collect()]
    assert got == [(12_345, 48, 57, 570, 10, "altered")]
    assert len(trace) == 4 and all(n <= 16 for _, n in trace)
    trace.clear()
    assert fixity.audit(fixity.laid_out(rows), fixity.laid_out(rows), trace).count() == 0 and [n for _, n in trace] == [1, 0, 0, 0]


def test_pipeline_of_an_empty_table(spark, none, sf_dir):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name
