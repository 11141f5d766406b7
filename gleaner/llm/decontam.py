"""Benchmark decontamination by templates; DataFrame functions only.

Words of texts and benchmark items are hashed, and every window of 8 words (of a shorter item, all its words) is
hash-joined twice: as it stands, which finds every verbatim passage whatever its case and what stands around it, and as
a template, with typed placeholders for numbers, units after numbers and names. Template windows count where what fills
the placeholders in the document is a function of what fills them in the item, for names and units one-to-one, along a
whole alignment that covers enough of the item: a re-parameterised question, not text that only has the same shape.

What a token is depends on nothing outside its window, so a passage has the same windows wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, read_table

WINDOW = 8
#: Of a template window's tokens so many at least are plain words; windows with fewer are found as they stand only.
LEAST_WORDS = 4
#: Of an item's template windows so many at least match along one alignment where values differ.
LEAST_SHARE = 1 / 3
#: Bounds of what is broadcast; beyond them the joins are shuffles. A window's hash has 8 bytes, a window with its words
#: about 500, a leak 100.
BROADCAST_HASHES = 1_000_000
BROADCAST_WINDOWS = 100_000
BROADCAST_LEAKS = 200_000
TOKEN = r"[a-zA-Z\p{L}\p{M}]++|[0-9\p{N}]++(?:[.,:][0-9\p{N}]++)*+"
#: Units of measure.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg lb lbs oz t ton tons gram grams kilogram kilograms pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "w kw mw v kv a ma hz khz mhz ghz j kj cal kcal pa kpa bar k c f percent degree degrees dollar dollars euro euros cent cents usd eur gbp "
    "b kb mb gb tb mph kmh kph rpm"
).split()
#: Function and question words of the four languages, which begin sentences and are never names.
COMMON = (
    "a an the this that these those it its he she they we i you my your his her their our who whom whose what which when where why how "
    "is are was were be do does did has have had can could will would shall should may might must if then else and or but not no of in on at "
    "to for from by with as so than there here all any each every some many much one two "
    "le la les un une des du de ce cet cette ces il elle ils elles nous vous je tu on et ou mais donc que qui quoi quel quelle quels quelles "
    "quand où comment pourquoi combien est sont si dans en sur pour par avec "
    "der die das den dem ein eine einen einem einer er sie es wir ihr ich du und oder aber nicht wer was wann wo warum wie welche welcher "
    "welches ist sind war wenn im in auf für mit von zu "
    "el los las una unos unas este esta estos estas lo él ella ellos ellas nosotros y o pero no quién qué cuál cuándo dónde cómo cuánto "
    "cuántos es son fue si en con por para"
).split()
NUMBER, NAME, UNIT = 1, 2, 3
KEY = "__text_key"
VALUES = "array<struct<kind:int,item:string,doc:string>>"


def _text_key(text: str) -> Column:
    """A text's digest: what a text holds depends on nothing else of its row."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _among(column: str, words: list[str]) -> str:
    return f"{column} in (" + ", ".join(f"'{w}'" for w in words) + ")"


def _parsed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, the ``words`` of ``text``, the hashes of the words in lower case (``raw``) and template tokens
    (``tok``): a plain word's hash, or minus the kind of a placeholder."""
    t = F.translate(F.coalesce(F.col(text), F.lit("")), "'’", "")
    out = df.select(*keep, F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)).alias("words"))
    out = out.select(*keep, "words", F.expr("transform(words, w -> xxhash64(lower(w)) & 9223372036854775807)").alias("raw"))
    unit = f"get(words, i - 1) < ':' and get(words, i - 1) >= '0' and {_among('lower(w)', UNITS)}"
    name = f"w <> lower(w) and substring(w, 2) = substring(lower(w), 2) and not {_among('lower(w)', COMMON)}"
    kinds = f"case when w >= 'a' and w < '{{' then case when {unit} then -{UNIT}L else get(raw, i) end when w >= '0' and w < ':' then -{NUMBER}L when {name} then -{NAME}L when {unit} then -{UNIT}L else get(raw, i) end"
    return out.select(*keep, "words", "raw", F.expr(f"transform(words, (w, i) -> {kinds})").alias("tok"))


def _windows(parsed: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """``keep``, ``pos, width, hash``: the windows of each width as they stand, and as templates (``width`` negative).

    A window's first word counts as a unit only by what stands before it, so it is plain here. A window's tokens come
    side by side from shifted arrays, so that hashing is compiled code.
    """
    most = max(widths)
    shifted = [F.expr(f"slice({c}, {k + 1}, size({c}))").alias(f"{c[0]}{k}") for c in ("raw", "tok") for k in range(most)]
    rows = parsed.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "z"))
    rows = rows.select(*keep, "pos", *(F.expr(f"z.r{k}") for k in range(most)), F.expr(f"if(z.t0 = -{UNIT}, z.r0, z.t0)").alias("t0"), *(F.expr(f"z.t{k}") for k in range(1, most)))
    hashes = {}
    for w in widths:
        listed = lambda c: ", ".join(f"{c}{k}" for k in range(w))
        hashes[w] = F.expr(f"if(r{w - 1} is null, null, xxhash64({w}, {listed('r')}))")
        if w > LEAST_WORDS:
            slots = " + ".join(f"int(t{k} < 0)" for k in range(w))
            hashes[-w] = F.expr(f"if(r{w - 1} is not null and {slots} between 1 and {w - LEAST_WORDS}, xxhash64({-w}, {listed('t')}), null)")
    rows = rows.select(*keep, "pos", *(h.alias(f"h{w}") for w, h in hashes.items()))
    every = ", ".join(f"named_struct('width', {w}, 'hash', `h{w}`)" for w in hashes)
    return rows.select(*keep, "pos", F.expr(f"explode(array({every}))").alias("h")).filter("h.hash is not null").select(*keep, "pos", "h.width", "h.hash")


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, variant, windows, usable, item_pos, width, hash, item_values, kinds``: the windows of each item's text.

    ``variant`` is the text's digest, ``windows`` the number of windows of the text and ``usable`` that of its template
    windows. Items without a word have none.
    """
    named = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct().select("item_id", _text_key("text").alias("variant"), "text")
    parsed = checkpointed(_parsed(named, "text", "item_id", "variant").filter(F.size("words") > 0))
    widths = sorted(r[0] for r in parsed.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())  # 8 at most
    if not widths:
        widths = [WINDOW]
    parsed = parsed.withColumn("kinds", F.expr("transform(tok, t -> if(t < 0, int(-t), 0))"))
    rows = _windows(parsed, widths, "item_id", "variant", "words", "kinds").filter(F.abs("width") == F.least(F.size("words"), F.lit(WINDOW)))
    rows = rows.withColumn("n", F.abs("width")).withColumn("windows", F.size("words") - F.col("n") + 1)
    first = F.transform(F.slice("kinds", F.col("pos") + 1, F.col("n")), lambda k, i: F.when((i == 0) & (k == UNIT), F.lit(0)).otherwise(k))
    rows = rows.select("item_id", "variant", "windows", F.col("pos").alias("item_pos"), "width", "hash", F.transform(F.slice("words", F.col("pos") + 1, F.col("n")), F.lower).alias("item_values"), first.alias("kinds"))
    usable = rows.groupBy("item_id", "variant").agg(F.sum((F.col("width") < 0).cast("int")).alias("usable"))
    return rows.join(usable, ["item_id", "variant"])


def _held(df: DataFrame, rows: int, bound: int) -> DataFrame:
    return F.broadcast(df) if rows <= bound else df


def text_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """As ``leaks``, by the text's digest in place of ``doc_id``."""
    bench = checkpointed(benchmark_windows(items))
    stats = bench.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.abs("width"))).alias("widths")).first()  # 8 widths at most
    if not stats["n"]:
        kind = dict(bench.dtypes)["item_id"]
        return docs.sparkSession.createDataFrame([], f"{KEY} string, item_id {kind}, matched int, windows int, changed int")
    texts = _parsed(docs.select(F.col(text).alias("text")).withColumn(KEY, _text_key("text")), "text", KEY)
    wanted = bench.select("hash").distinct()
    if stats["n"] <= BROADCAST_HASHES:
        hits = _windows(texts, stats["widths"], KEY, "words").join(F.broadcast(wanted), "hash", "left_semi")
    else:
        places = _windows(texts, stats["widths"], KEY).join(wanted, "hash", "left_semi")
        hits = checkpointed(places.distinct()).join(texts.select(KEY, "words").dropDuplicates([KEY]), KEY)
    # Only the window's words leave the compiled stage; a function with a lambda there would carry out the whole text.
    found = hits.select(KEY, "pos", "hash", F.slice("words", F.col("pos") + 1, F.abs("width")).alias("doc_values")).distinct()
    found = checkpointed(found.withColumn("doc_values", F.transform("doc_values", F.lower)))
    met = found.join(_held(bench, stats["n"], BROADCAST_WINDOWS), "hash")
    plain = met.filter("width > 0 and doc_values = item_values").select(KEY, "item_id", "variant", "windows", "item_pos", F.lit(0).alias("changed"))
    whole = plain.unionByName(_consistent(met.filter("width < 0")))
    told = whole.groupBy(KEY, "item_id", "variant").agg(F.countDistinct("item_pos").cast("int").alias("matched"), F.first("windows").cast("int").alias("windows"), F.max("changed").cast("int").alias("changed"))
    best = told.groupBy(KEY, "item_id").agg(F.max(F.struct("matched", "windows", "changed")).alias("b"))
    return best.select(KEY, "item_id", "b.matched", "b.windows", "b.changed")


def _consistent(met: DataFrame) -> DataFrame:
    """Template hits whose fillings agree along each alignment of a text and an item and differ from the item's.

    All of one alignment are at most an item's windows, whatever the corpus.
    """
    by = [KEY, "item_id", "variant", "windows", "usable", "diagonal"]
    pairs = F.filter(F.arrays_zip(F.col("kinds").alias("kind"), F.col("item_values").alias("item"), F.col("doc_values").alias("doc")), lambda z: z["kind"] > 0).cast(VALUES)
    met = met.withColumn("diagonal", F.col("pos") - F.col("item_pos")).withColumn("pairs", pairs)
    lined = met.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.collect_set("item_pos").alias("at"))
    strict = F.filter("pairs", lambda p: p["kind"] != NUMBER)  # two numbers may well become the same one
    sides = lambda c, side: F.size(F.array_distinct(F.transform(c, lambda p: F.struct(p["kind"], p[side]))))
    agrees = (sides(F.col("pairs"), "item") == F.size("pairs")) & (sides(strict, "doc") == F.size(strict))
    changed = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"]))
    kept = lined.filter(agrees & (changed > 0) & (F.size("at") >= F.col("usable") * LEAST_SHARE))
    return kept.select(KEY, "item_id", "variant", "windows", F.explode("at").alias("item_pos"), changed.alias("changed"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, matched, windows, changed``: the benchmark items that each document holds.

    ``matched`` of the item's ``windows`` windows are in the document, and ``changed`` counts the placeholders that are
    filled otherwise there (0: the passage itself). Items of any length are found as they stand, in any case: of items
    below 8 words all words, so an item of one common word is in every document with that word. Null and wordless texts
    and items match nothing, rows without an id are left out, repeated rows count once, of an item id with several texts
    the best matched counts, ties do not arise; other columns play no part, whatever their names. Empty tables give no
    rows. A text is split in the memory of one task: some 200 bytes a word.
    """
    found = checkpointed(text_leaks(docs, items, text))
    named = docs.select(F.col(doc_id).alias("doc_id"), _text_key(text).alias(KEY)).filter("doc_id is not null")
    told = named.join(_held(found, found.count(), BROADCAST_LEAKS), KEY).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "windows", "changed")).alias("b"))
    return told.select("doc_id", "item_id", "b.matched", "b.windows", "b.changed")


def op2_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, all their columns as they are.

    Each row is judged by its own text: rows without an id and rows that share one are no exception. Null and empty
    texts stay, repeated rows stay or go together, an empty table gives an empty one.
    """
    gone = checkpointed(text_leaks(docs, items, text).select(KEY).distinct())
    return docs.withColumn(KEY, _text_key(text)).join(_held(gone, gone.count(), BROADCAST_LEAKS), KEY, "left_anti").select(*docs.columns)
