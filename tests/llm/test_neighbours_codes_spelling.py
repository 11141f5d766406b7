"""Approximate neighbours, product codes, spelling variants and similar texts of boilerplate, against plain versions."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ann, pq_codes, queries, similar, simhash, spelling


def brute_neighbours(rows, step, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[int(ids[i])] = [(int(ids[j]), float(far[j])) for j in np.lexsort((ids, far)) if j != i][:k]
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def by_query(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = by_query(queries.QUERIES["op11_adaptive_scan"](spark, sf_dir)), brute_neighbours(rows, 100, 10)
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in got) and recall(got, want) >= 0.9
    at = dict(rows)
    for q, found in got.items():
        for v, score in found:
            assert score == pytest.approx(float(np.linalg.norm(np.array(at[q], float) - np.array(at[v], float))), rel=1e-12)


def test_recall_on_clusters_and_copies(spark):
    """Clusters, one with a third of all rows at nearly one place: some lists are scanned, not all."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24)) * 4
    x = np.concatenate([centres[rng.integers(0, 40, 2000)] + rng.standard_normal((2000, 24)), centres[0] + 0.01 * rng.standard_normal((1000, 24))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    told = {}
    got = by_query(ann.adaptive_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, told=told))
    assert recall(got, brute_neighbours(rows, 50, 10)) >= 0.95
    assert told["lists"] == 54 and told["probes"] < 27


def test_candidates_are_abandoned_early():
    rng = np.random.default_rng(1)
    near, far = rng.standard_normal((20, 64)) * 0.1, rng.standard_normal((4000, 64))
    data = np.concatenate([near, far])
    blocks = [data[:, i : i + 8] for i in range(0, 64, 8)]
    at, read = ann.adaptive_scan(blocks, [np.zeros(8)] * 8, 1.0, 5)
    assert set(at) <= set(range(20)) and len(at) == 5 and read < 0.3 * data.size


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 1.0]), (7, [1.0, -1.0]), (8, [2.0]), (None, [1.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in ("v", "r", "cell", "rank", "score", "block", "is_query")))
    got = ann.adaptive_neighbours(df, F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 8, 1.0)]
    assert ann.adaptive_neighbours(df.filter("false"), F.col("vec_id") == 0).count() == 0
    assert ann.adaptive_neighbours(df, F.col("vec_id") == 77).count() == 0
    assert ann.adaptive_neighbours(df.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """``rows``: (id, label, whole numbers) in the order of ids."""
    width = len(rows[0][2]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = collections.defaultdict(list)
            for c in cut:
                mine[nearest(p, c[p])[1]].append(c[p])
            for i, xs in mine.items():
                books[p][i] = tuple(sum(col) // len(xs) for col in zip(*xs))
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    return {(i, "".join(f"{e:02x}" for _, e in f), sum(g for g, _ in f)) for (i, _, _), f in zip(rows, found)}


@pytest.mark.parametrize("size", [1.0, 1e4])
def test_codes_are_those_of_plain_rounds(spark, size):
    """Small components go through doubles, large ones through whole numbers of any size."""
    rng = random.Random(3)
    rows = [(i, i % 3 or None, [rng.gauss(i % 5, 1) * size for _ in range(16)]) for i in range(120)]
    whole = [(i, label, [int(np.floor(4096 * x)) for x in v]) for i, label, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    got = pq_codes.product_codes(df).collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in got} == plain_codes(whole)
    sums = collections.Counter()
    for r in got:
        sums[r["vec_id"] % 3] += r["error"]
    assert all(r["label_error"] == sums[r["vec_id"] % 3] for r in got) and len({r["codebooks_sha256"] for r in got}) == 1


def test_later_rounds_move_fewer_rows(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, None, [rng.gauss(i % 20, 1) for _ in range(8)]) for i in range(400)], "vec_id long, label int, embedding array<double>")
    rows = df.select("vec_id", "label", pq_codes.whole("embedding").alias("v"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("was"))
    first = rows.orderBy("vec_id").limit(16).collect()
    start = np.array([r["v"] for r in first], dtype=object).reshape(16, 8, 1).transpose(1, 0, 2)
    trace = []
    pq_codes.trained(rows, pq_codes.Codebooks(start, 1 << 20), trace=trace)
    assert trace[0] == 400 and trace[-1] < 300 and len(trace) == 6


def test_codes_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, 1, [0.5, -0.5, 1.0]), (1, None, [0.25, 1.0, 1.0]), (2, 1, None), (3, 1, [nan, 1.0, 1.0]), (4, 1, [None, 1.0, 1.0]), (None, None, [9.0]), (5, 2, []), (6, 2, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in ("v", "codes", "was", "error", "named", "copies")))
    got = pq_codes.product_codes(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in got) == [(False, 1), (False, 1), (False, 5), (False, 6), (True, None)]
    assert all(r["error"] == 0 and len(r["code"]) == 16 for r in got)
    empty = pq_codes.product_codes(df.filter("false"))
    assert empty.count() == 0 and empty.columns == pq_codes.product_codes(df).columns
    assert pq_codes.product_codes(df.filter("vec_id = 2")).count() == 0


def plain_variants(docs):
    import re

    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {}
    for w, n in words.items():
        others = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        found[w] = (best if best and words[best] >= 2 * n else None, n, len(others))
    out = set()
    for w, (form, n, k) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, n, k, words[form] if form else None))
    return out


def test_spelling_variants(spark, monkeypatch):
    """Small tries in small lots: neighbours lie in other tries than their words."""
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 7))) for _ in range(40)] + ["ÀBcde", "àbcde", "x×y÷zabc", "aaaaa", "aaaaaa", "aaaaaaa"]

    def typo(w):
        at, kind = rng.randrange(len(w)), rng.randrange(4)
        return (w, w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdé") + w[at:], w[:at] + rng.choice("abcdé") + w[at + 1 :])[kind]

    docs = [(i, " ".join(typo(rng.choice(stems)).title() for _ in range(rng.randint(0, 60))) + "7") for i in range(200)]
    docs += [(None, "Straße straße straße Nulls_nulls-nulls"), (900, None), (901, ""), (902, "z" * 50_000), (902, "z" * 50_000), (902, "z" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("word", "n", "run", "h", "form", "root", "id")))
    monkeypatch.setattr(spelling, "SHARD_WORDS", 50)
    monkeypatch.setattr(spelling, "LOT_BYTES", 3000)
    got = {tuple(r) for r in spelling.spelling_variants(df).collect()}
    assert len(got) > 100 and got == plain_variants(docs)
    assert spelling.spelling_variants(df.filter("false")).count() == 0


def test_tries_are_cut_and_dealt_in_lots():
    words = sorted({"apple", "apples", "appla", "zebra"})
    trie = spelling.Trie.load(spelling.Trie.of(words, [1, 2, 3, 4]).dump())
    assert trie.near("apple") == {"appla": 1, "apples": 3} and trie.near("zebras") == {"zebra": 4} and trie.near("") == {}
    assert spelling.lots([(0, spelling.LOT_BYTES), (1, 1), (2, 1)]) == [[0], [1, 2]]


def families(count, common, own, shared, rng):
    """Pairs of texts that share ``common`` words with all and ``shared`` of their ``own`` words with each other."""
    base, out = [f"c{i}" for i in range(common)], []
    for f in range(count):
        mine = [f"f{f}x{i}" for i in range(shared)]
        out += [" ".join(base + mine + [f"f{f}t{t}x{i}" for i in range(own - shared)]) for t in range(2)]
    rng.shuffle(out)
    return list(enumerate(out))


def similar_groups(rows):
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted({root(i) for i in ids})


def test_families_of_boilerplate(spark):
    """All texts share most words, and only the two of a family are similar: every pair is found."""
    rows = families(60, 600, 99, 36, random.Random(2))
    got = sorted(r["doc_id"] for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = similar_groups(rows)
    assert len(want) == 60 and got == want


def test_prefix_pairs_are_all_pairs(spark):
    rng = random.Random(9)
    texts = {}
    for i in range(150):
        words = [f"g{i % 12}w{j}" for j in range(rng.randint(20, 60))]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(300)}"
        texts[i] = words
    sets = {i: sorted(set(w)) for i, w in texts.items()}
    df = spark.createDataFrame([(i, [zlib.crc32(x.encode()) for x in s]) for i, s in sets.items()], "node long, shingles array<long>")
    labels = df.select("node", (F.col("node") % 40).alias("label"))
    got = {(r["u"], r["v"]) for r in similar.verified(similar.prefix_pairs(labels, df), df).collect()}
    jaccard = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    want = {(a, b) for a in sets for b in sets if a > b and a % 40 != b % 40 and jaccard(a, b) >= 0.8}
    assert want and got == want
