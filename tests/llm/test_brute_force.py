"""The operators against plain versions and the tokenizers' own libraries, on the small tables."""

import collections
import os
import random
import re
import zlib
from html import unescape

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from gleaner.llm import decontam, html_main, knn, packing, quality, queries, sharding, similar, simhash, tokens


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.execute("select doc_id, text from documents").fetchall())


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op8_simhash_ball"](spark, sf_dir).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert links
    root = components(ids, links)
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in ids}


@pytest.mark.parametrize("low", [21, 22, 64])
def test_balls_lose_no_link(spark, low):
    """Dense groups, some of them inside one block, where every distance from 1 to 6 occurs."""
    rng = random.Random(low)
    prints = set()
    for base in (rng.getrandbits(64) for _ in range(20)):
        prints |= {base} | {base ^ sum(1 << b for b in rng.sample(range(low), rng.randint(1, 6))) for _ in range(25)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    found = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed.values()], "fingerprint long")).collect()
    ids = sorted(signed.values())
    near = [(signed[a], signed[b]) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    assert components(ids, [tuple(r) for r in found]) == components(ids, near)


def plain_similar(texts):
    """The group (its smallest id) of each text: five-word shingles, Jaccard of 0.8 or more, all pairs that share one."""
    sets, index, shared = {}, collections.defaultdict(list), collections.Counter()
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else {()})
        for shingle in sets[i]:
            index[shingle].append(i)
    for rows in index.values():
        shared.update((a, b) for n, a in enumerate(rows) for b in rows[:n])
    return components(sorted(texts), [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)])


def test_similar_texts():
    """Every pair at 0.8 or more shares a band or lies within the ball: recall of the candidates on made pairs."""
    rng, caught, pairs = random.Random(4), 0, 0
    for _ in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
        other = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 45))):
            other[rng.randrange(len(other))] = "changed"
        a, b = (simhash.shingle_hashes(" ".join(w), 5) for w in (words, other))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            pairs += 1
            caught += bool((similar.bands(a) == similar.bands(b)).any())
    assert pairs > 200 and caught >= 0.99 * pairs


def test_row_numbers_and_shards(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_feistel_shards"](spark, sf_dir).collect()}
    n, (a, b) = len(texts), sharding.sides(len(texts))
    assert sorted((r["shard"], r["slot"]) for r in got.values()) == sorted((p % 8, p // 8) for p in range(n))
    for row, i in enumerate(sorted(texts)):
        p = row
        while True:
            left, right = divmod(p, b)
            for k, keys in enumerate(sharding.round_keys(sharding.SEED)):
                c, d, e, f = keys
                x = (right % sharding.P1 * c + d) % sharding.P1
                x = (x % sharding.P2 * e + f) % sharding.P2
                x = (x % sharding.P3 * (c ^ 0x2A2A2A2A) + e) % sharding.P3
                left, right = right, (left + x) % (b if k % 2 else a)
            p = left * b + right
            if p < n:
                break
        raw = (texts[i] or "").encode()
        assert (got[i]["shard"], got[i]["slot"], got[i]["size"], got[i]["text_crc32"]) == (p % 8, p // 8, len(raw) + 1, zlib.crc32(raw))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 90, 1000, 1001])
def test_permutation(spark, n):
    got = [r[0] for r in sharding.permute(spark.range(n).withColumnRenamed("id", "p"), "p", n).collect()]
    assert sorted(got) == list(range(n))
    assert [sharding.locate(i, n) for i in range(n)] == [(p % 8, p // 8) for p in got]


def test_token_counts(spark, sf_dir, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in queries.QUERIES["op5_fst_token_counts"](spark, sf_dir).collect()}
    assert got == {i: (len(t.encode()), len(model.encode(t))) for i, t in texts.items()}


def test_chunk_maps_compose(texts):
    model, counter = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL)), tokens.Counter()
    rng = random.Random(3)
    odd = ["", " ", "  ", "   a  b   ", "a\n b", "▁▁x ▁", "<s></s><unk>", "1234 56", "ﬁ①\x00z", " " * 99, "x" * 900, "日本語 テスト 😀"]
    odd += ["".join(rng.choice("abethin  .,\n▁é日") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    for chunk in (1 << 15, 7, 2, 1):
        assert [counter.count(t, chunk) for t in odd] == [len(model.encode(t)) for t in odd]


@pytest.mark.parametrize("alphabet", ["日本語漢字仮名東京中国人大小上下", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "ab", "(){};=.,+function return var"])
def test_texts_without_breaks(alphabet, monkeypatch):
    """Chunks without a word break have maps too: composing runs over few characters, and states stay bounded."""
    monkeypatch.setattr(tokens, "MAX_STATES", 3000)
    model, counter, rng = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL)), tokens.Counter(), random.Random(9)
    text = "".join(rng.choice(alphabet.replace(" ", "")) for _ in range(60_000))
    assert counter.count(text, 2000) == len(model.encode(text))
    assert counter.composed < 0.1 * len(text) and len(counter.machine.meanings) <= 3000 + 1


def test_packing(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.QUERIES["op9_bestfit_packing"](spark, sf_dir).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want, total = {}, 0
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        first, total = len(ids) % 1024 or 1024, total + len(ids)
        bounds = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert got == want
    assert len({r["sequence_id"] for r in rows}) <= 1.03 * total / 1024 + 2


def test_special_strings_are_one_token():
    tokenizer, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    for t in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endo", "x\x00\t  \n y", "don't 123 日本"):
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_best_fit_is_best_fit():
    rng, packer, free = random.Random(1), packing.BestFit(64, 5), []
    for _ in range(3000):
        n = rng.randint(1, 64)
        fits = [f for f, _ in free if f >= n]
        number, offset = packer.add(n)
        if fits:
            assert 64 - offset == min(fits) and (min(fits), number) in free
            free.remove((min(fits), number))
        else:
            assert offset == 0
        if 64 - offset - n:
            free.append((64 - offset - n, number))
            if len(free) > 5:
                least = min(f for f, _ in free)
                kept = {x for bins in packer.free for x in bins}
                free.remove(next((f, b) for f, b in free if f == least and b not in kept))
        assert sorted(b for _, b in free) == sorted(x for bins in packer.free for x in bins)


def test_decontamination(spark, sf_dir, texts, tables):
    items = dict(tables.execute("select item_id, text from benchmark").fetchall())
    index = collections.defaultdict(set)
    windows = lambda t: zip(*(re.findall(r"\w+", t.lower())[k:] for k in range(8)))
    for i, t in items.items():
        for w in windows(t):
            index[w].add(i)
    want = {(d, i) for d, t in texts.items() for w in windows(t) for i in index.get(w, ())}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op2_template_decontam(spark, sf_dir).collect()}
    assert want and got == want


def test_reparameterised_questions(spark):
    items = spark.createDataFrame([(1, "Anna and Boris have 12 apples each, so how many apples do Anna and Boris have in 3 km of road?")], "item_id long, text string")
    docs = [
        (1, "x y. Carla and Dora have 7 apples each, so how many apples do Carla and Dora have in 9 km of road?"),
        (2, "Carla and Dora have 7 apples each, so how many apples do Erik and Fina have in 9 miles of road?"),
        (3, "Nothing of that kind is in this text, which has words enough."),
    ]
    got = [(r["doc_id"], r["changed"] > 0) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()]
    assert got == [(1, True)]


def test_items_are_found_whatever_stands_before_them(spark):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Days of the week have which names in Latin?")], "item_id long, text string")
    docs = [
        (1, "Question: What is the capital of France?"),
        (2, "Here one reads (What is the capital of France?) in brackets"),
        (3, "list of 3: days of the week have which names in Latin?"),
        (4, "Question: Where is the capital of France?"),
    ]
    got = sorted((r["doc_id"], r["item_id"], r["changed"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 2, 0)]


def test_items_of_mostly_placeholders_are_found_as_they_stand(spark):
    items = [(1, "Solve 12 + 7 - 3 * 4 = x"), (2, "Anna and Boris have 12 apples each so how many do they have if 3 7 9 11 13 15 are lost?")]
    docs = [
        (1, "Question: Solve 12 + 7 - 3 * 4 = x"),
        (2, "Solve 12 + 7 - 3 * 5 = x"),
        (3, "Anna and Boris have 12 apples each so how many do they have if 3 7 9 11 13 15 are lost?"),
        (4, "Carla and Dora have 8 apples each so how many do they have if 1 1 9 11 13 15 are lost?"),
        (5, "We note they have if 3 7 9 11 13 15 only"),
        (5, "We note they have if 3 7 9 11 13 15 only"),
    ]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["windows"], r["changed"] > 0) for r in decontam.leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 2), (5, 2)} and got[1, 1] == (1, 1, False)
    assert got[3, 2][0] == got[3, 2][1] and not got[3, 2][2] and got[4, 2][2] and not got[5, 2][2]


@pytest.mark.parametrize(
    ("item", "text", "changed"),
    [
        ("Maria buys 12 apples for 3 dollars today.", "Here: Maria buys 12 apples for 3 dollars today.", 0),
        ("What is 12 + 7?", "Here: What is 12 + 7?", 0),
        ("Ana, Rui, Eva, Leo and Ida share 12 kg and 9 km and 8 cm of Oak.", "here: ana, rui, eva, leo and ida share 12 kg and 9 km and 8 cm of oak.", 0),
        ("we saw Kim and Lee run 5 miles along the river bank", "we saw Pat and Pat run 9 miles along the river bank", None),
        ("we saw Kim and Lee run 5 miles along the river bank", "we saw Pat and Tom run 9 miles along the river bank", 3),
        ("we saw Kim run 5 miles and then 6 miles to the mill", "we saw Kim run 8 miles and then 8 miles to the mill", 2),
        ("Der Hund und die Katze liegen auf dem Dach vom Haus.", "Er sagt: der Hund und die Katze liegen auf dem Dach vom Haus.", 0),
        ("yes", "He said YES.", 0),
    ],
)
def test_no_item_is_lost(spark, item, text, changed):
    frame = lambda name, t: spark.createDataFrame([(1, t)], f"{name} long, text string")
    got = [r["changed"] for r in decontam.leaks(frame("doc_id", text), frame("item_id", item)).collect()]
    assert got == ([] if changed is None else [changed])


def plain_leaks(docs, items):
    """The law of decontamination, text by text and window by window."""

    def parsed(text):
        words = re.findall(r"[^\W\d_]+|\d+(?:[.,:]\d+)*", (text or "").translate({39: None, 0x2019: None}))
        low, kinds = [w.lower() for w in words], []
        for i, w in enumerate(words):
            after = i > 0 and "0" <= words[i - 1][0] <= "9" and low[i] in decontam.UNITS
            name = w != low[i] and w[1:] == low[i][1:] and low[i] not in decontam.COMMON
            kinds.append(1 if "0" <= w[0] <= "9" else 2 if name else 3 if after else 0)
        return low, kinds

    def template(low, kinds):
        first = [0 if kinds[0] == 3 else kinds[0], *kinds[1:]]
        return first, tuple(k or w for k, w in zip(first, low))

    out = {}
    for d, text in docs.items():
        low, kinds = parsed(text)
        for item, wanted in items.items():
            ilow, ikinds = parsed(wanted)
            n = min(8, len(ilow))
            if not n:
                continue
            at, changed, usable, lines = set(), 0, 0, collections.defaultdict(lambda: (set(), set()))
            for i in range(len(ilow) - n + 1):
                first, tokens = template(ilow[i : i + n], ikinds[i : i + n])
                is_template = 1 <= sum(k > 0 for k in first) <= n - 4
                usable += is_template
                for p in range(len(low) - n + 1):
                    if low[p : p + n] == ilow[i : i + n]:
                        at.add(i)
                    if is_template and template(low[p : p + n], kinds[p : p + n])[1] == tokens:
                        lines[p - i][0].add(i)
                        lines[p - i][1].update((k, x, y) for k, x, y in zip(first, ilow[i : i + n], low[p : p + n]) if k)
            for places, pairs in lines.values():
                names = {x for x in pairs if x[0] != 1}
                one = len({x[:2] for x in pairs}) == len(pairs) and len({(k, y) for k, _, y in names}) == len(names)
                other = sum(x != y for _, x, y in pairs)
                if one and other and 3 * len(places) >= usable:
                    at |= places
                    changed = max(changed, other)
            if at:
                out[d, item] = (len(at), len(ilow) - n + 1, changed)
    return out


def test_templates_against_a_plain_version(spark):
    """Items of 1 to 60 words in four languages; verbatim, in another case, re-parameterised and shuffled copies."""
    rng = random.Random(11)
    words = ("the of and river bank saw house when runs der und Haus läuft Straße über nicht la rivière été où maison pendant el niño mañana casa después vio km miles kg hours "
             "Anna Boris Chloé Émile Jürgen Ñora 3 12 7.5 1,000").split()  # fmt: skip
    swap = {"Anna": "Carla", "Boris": "Tom", "Chloé": "Zoé", "Émile": "Ugo", "Jürgen": "Uwe", "Ñora": "Inés", "3": "9", "12": "40", "7.5": "2", "1,000": "64"}
    items, docs, whole = {}, {}, []
    for i in range(60):
        made = [rng.choice(words) for _ in range(i + 1)]
        items[i] = " ".join(w + rng.choice(["", "", "", ",", ".", "?", " -"]) for w in made)
        kind = rng.randrange(4)
        text = [items[i], items[i].upper() if "ß" not in items[i] else items[i].lower(), " ".join(swap.get(w, w) for w in made), " ".join(rng.sample(made, len(made)))][kind]
        docs[i] = " ".join(rng.choice(words) for _ in range(rng.randrange(6))) + rng.choice([": ", " (", " 3 ", ". ", "\n"]) + text + rng.choice([")", " km und", "", " 12"])
        if kind < 2:
            whole.append(i)
    docs[98], docs[99], items[98], items[99] = None, "", None, " ?!"
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} long, text string")
    want = plain_leaks(docs, items)
    assert all((i, i) in want and want[i, i][0] == want[i, i][1] for i in whole) and any(c for *_, c in want.values())
    for bound in (decontam.BROADCAST_HASHES, 0):
        decontam.BROADCAST_HASHES, old = bound, decontam.BROADCAST_HASHES
        try:
            got = {(r["doc_id"], r["item_id"]): (r["matched"], r["windows"], r["changed"]) for r in decontam.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
        finally:
            decontam.BROADCAST_HASHES = old
        assert got == want


def test_main_text(spark, sf_dir, tables):
    pages = dict(tables.execute("select page_id, html from pages").fetchall())
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op10_dom_graphical"](spark, sf_dir).collect()}

    def article(html):
        inner = re.sub("</?b>", "", re.search("<article>(.*?)</article>", html, re.S)[1]).replace("<br>", " ")
        return "\n\n".join(b for b in (" ".join(unescape(x).split()) for x in re.split("</?(?:h1|p)>", inner)) if b)

    assert got == {i: article(h) for i, h in pages.items()}


def test_main_text_of_held_out_layouts():
    """Twelve hand-labelled layouts that no training page has: F1 by characters of all of them, and of the worst."""
    from held_out_pages import PAGES

    model, scores, sums = html_main.fitted(), {}, np.zeros(3)
    for name, html in PAGES.items():
        page, labels = html_main.labelled(html)
        found, _ = model.marginals(page)
        rows = [(len(t), y, p > 0.5) for t, y, p in zip(page.text, labels, found) if t is not None]
        counts = np.array([sum(n for n, y, p in rows if test(y, p)) for test in (lambda y, p: y and p, lambda y, p: p and not y, lambda y, p: y and not p)])
        scores[name] = 2 * counts[0] / (2 * counts[0] + counts[1] + counts[2])
        sums += counts
    assert 2 * sums[0] / (2 * sums[0] + sums[1] + sums[2]) > 0.93 and min(scores.values()) > 0.75, scores


@pytest.mark.parametrize("unit", ["if a <b c ", '<a "', "<div>", "<svg>", "<a b='", "</x", "<!-", "<li><ul>", "<x>", "<x><li></div>"])
def test_broken_markup_is_read_in_linear_time(unit):
    import time

    began = time.perf_counter()
    html_main.Page(unit * (2_000_000 // len(unit)))
    assert time.perf_counter() - began < 30  # a quadratic scan would take hours


def test_text_beside_odd_markup_is_kept():
    model = html_main.fitted()
    assert model.main_text("<p>Let <math><mi>x</mi></math> be <noscript>seven</noscript> here.</p>") == "Let x be seven here."
    assert model.main_text("<article><h1>Signs</h1><p>If a < b and b <c then a is less than c, said the teacher.</p></article>") == "Signs\n\nIf a < b and b <c then a is less than c, said the teacher."
    assert model.main_text('<article><p title="a > b">One sentence is here.</p><p>Two &lt; three is a fact.</p></article>') == "One sentence is here.\n\nTwo < three is a fact."


def test_messages_give_exact_marginals():
    """Sum-product on the tree against the sum over all labellings."""
    import itertools
    from math import exp

    model, page = html_main.fitted(), html_main.Page("<article><h1>A title</h1><p>Some text.</p><div class=ad>Buy</div></article><footer>x</footer>")
    found, _ = model.marginals(page)
    n, unary, total, one = len(page.kind), model.unary(page), 0.0, [0.0] * len(page.kind)
    for y in itertools.product((0, 1), repeat=n):
        w = exp(sum(u * v for u, v in zip(unary, y)) + sum(model.pairs[page.text[v] is not None][2 * y[page.parent[v]] + y[v]] for v in range(1, n)))
        total += w
        one = [s + w * v for s, v in zip(one, y)]
    assert np.allclose(found, [s / total for s in one])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<main><h1>Title</h1><p>One.</p><aside class='sidebar'><p>Other stories of the day.</p></aside><p>Two &amp; three.</p><form><p>Sign up for letters</p></form></main><footer>f</footer>", "Title\n\nOne.\n\nTwo & three."),
        ("<div class='cookie-notice'><p>We use cookies.</p></div><article><p>a<br>b\n c</p><script>x</script><ul><li>i<li>j</ul></article><div id='comments'><p>Nice article, thanks.</p></div>", "a b c\n\ni\n\nj"),
    ],
)
def test_main_text_of_other_layouts(html, want):
    assert html_main.fitted().main_text(html) == want


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas", "select", "noscript", "template", "iframe"])
def test_elements_left_open_or_closed_at_once_lose_no_text(tag):
    model = html_main.fitted()
    for page in (f'<article><p>One one.</p><{tag} class="i"/><p>Two two.</p><p>Three.</p></article>', f"<article><p>One one.</p><{tag}><p>Two two.</p><p>Three.</p></article>"):
        assert model.main_text(page) == "One one.\n\nTwo two.\n\nThree.", page
    assert model.main_text("<article><p>One <svg class='i'><title>icon</title><path d='m'/></svg> two.</p></article>") == "One two."
    assert "The sum x + y is even." in model.main_text("<article><p>The sum <math><mi>x</mi> + <mi>y</mi></math> is even.</p></article>")


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = quality.op3_byte_cnn_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").select("score", "quality", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.98 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.96


def test_forward_pass_is_that_of_plain_loops_over_windows():
    rng, net = random.Random(7), quality.ByteNet.fresh(3)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 3, 7, 250, 252, 253, 256, 300, 900, 2000)]
    got = net.scores(texts)
    width, step, half = quality.WIDTH, quality.STRIDE, quality.HALF
    for text, score in zip(texts, got):
        padded = text + b"\0" * (-(len(text) + step) % half + step)
        tops = []
        for start in range(0, len(padded), half):
            windows = [padded[at : at + width] for at in range(start, start + half, step) if at + width <= len(padded)]
            tops.append(np.max([net.embed[list(w)].reshape(-1).astype(float) @ net.filters for w in windows], axis=0) + net.bias)
        chunks = [np.maximum(top, after) for top, after in zip(tops, [*tops[1:], tops[-1]])]
        hidden = np.array([np.maximum(np.maximum(c, 0) @ net.hidden + net.hidden_bias, 0) for c in chunks])
        want = np.concatenate([hidden.mean(axis=0), hidden.max(axis=0)]) @ net.out + net.out_bias[0]
        assert abs(want - score) < 1e-4 * max(1, abs(want))


def test_gradients():
    net = quality.ByteNet(*(p.astype(np.float64) for p in quality.ByteNet.fresh(3).params()))
    texts, labels = [b"abc def " * 90, b"", b"x!!y" * 40], np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.mean(np.log1p(np.exp(np.where(labels == 1, -1, 1) * net.scores(texts)))))
    for p, g in zip(net.params(), quality.gradients(net, texts, labels)):
        flat, i = p.reshape(-1), int(np.abs(g).argmax())
        old = flat[i]
        flat[i] = old + 1e-5
        up = loss()
        flat[i] = old - 1e-5
        assert np.isclose((up - loss()) / 2e-5, g.reshape(-1)[i], rtol=1e-3)
        flat[i] = old


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir, tables):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = tables.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=repr)


def test_pruning_keeps_the_best(spark):
    """Many pivots, small groups and blocks: vectors that a bound keeps away are never among the best."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.2).tolist()) for i in range(1500)] + [(5000 + i, centres[0].tolist()) for i in range(500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    old, knn.GROUP_ROWS, knn.BLOCK_ROWS = (knn.GROUP_ROWS, knn.BLOCK_ROWS), 20, 300
    try:
        got = sorted(map(tuple, knn.top_products(vectors, F.col("vec_id") % 10 == 0, k=7).collect()))
    finally:
        knn.GROUP_ROWS, knn.BLOCK_ROWS = old
    ids = np.array([i for i, _ in rows])
    x = np.floor(np.array([v for _, v in rows]) * 256)
    want = []
    for i in np.flatnonzero(ids % 10 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        for rank, j in enumerate(np.lexsort((ids, -s))[:7], 1):
            want.append((int(ids[i]), rank, int(ids[j]), int(s[j])))
    assert got == sorted(want)


def test_pipeline(spark, sf_dir, texts, tables):
    docs, step = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).persist()
        step[name] = docs
        if name != "packing":
            assert docs.columns == before.columns and docs.exceptAll(before).isEmpty()
    kept = lambda name: {r["doc_id"] for r in step[name].select("doc_id").collect()}
    net = quality.fitted(spark, sf_dir)
    good = {i for i, t in texts.items() if 1 / (1 + np.exp(-float(net.scores([t.encode()])[0]))) >= 0.7}
    assert kept("quality") == good
    root = plain_similar({i: texts[i] for i in good})
    assert kept("near_duplicates") == {i for i in good if root[i] == i}
    leaks = {r["doc_id"] for r in decontam.op2_template_decontam(spark, sf_dir).collect()}
    assert kept("decontamination") == kept("near_duplicates") - leaks
    assert kept("packing") == kept("decontamination")
    assert corpus_pipeline.run(spark, sf_dir).count() == step["packing"].count()
