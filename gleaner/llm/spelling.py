"""Spelling variants of a corpus: words within one edit of each other, found by tries and Levenshtein automata.

The counted vocabulary is cut into ranges of a bounded size, each of which becomes a compact trie: children of a node are
neighbours in one string of labels. Tries are broadcast in lots of a bounded number of bytes. Every task runs the
distance-one automaton of each of its words over every trie depth-first, and emits, reduced, how many neighbours the
word has and which is the most frequent. Lots are reduced by word, and forms are followed to their roots by doubling.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, read_table, shuffle_partitions

LEAST_LENGTH, LEAST_COUNT, TYPO_STEP, FACTOR = 5, 3, 97, 2
#: Bounds: words of a trie, bytes of the tries that are broadcast at a time.
SHARD_WORDS, LOT_BYTES = 1 << 15, 64 << 20
LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(run: Column, at: Column) -> Column:
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: runs of letters of all whole texts, some with a letter deleted as a hash of document and run tells."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    lowered = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    hashed = runs.select("id", lowered.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    word = F.when(F.col("h") % TYPO_STEP == 0, _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    kept = hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Trie:
    """Words with their counts; the children of node i are first[i] to first[i + 1], their letters there in ``labels``."""

    def __init__(self, labels: str, first: array, counts: array):
        self.labels, self.first, self.counts = labels, first, counts

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """``words`` are sorted and distinct; nodes are numbered level by level."""
        labels, first, ends = ["\0"], array("I"), array("q")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for lo, hi in level:
                ended = lo < hi and len(words[lo]) == depth
                ends.append(counts[lo] if ended else 0)
                first.append(len(labels))
                at = lo + ended
                while at < hi:
                    letter, since = words[at][depth], at
                    while at < hi and words[at][depth] == letter:
                        at += 1
                    labels.append(letter)
                    below.append((since, at))
            level, depth = below, depth + 1
        first.append(len(labels))
        return cls("".join(labels), first, ends)

    def dump(self) -> bytes:
        text = self.labels.encode()
        return b"".join((len(self.counts).to_bytes(8, "little"), self.first.tobytes(), self.counts.tobytes(), text))

    @classmethod
    def load(cls, blob: bytes) -> Trie:
        n, first, counts = int.from_bytes(blob[:8], "little"), array("I"), array("q")
        cut = 8 + (n + 1) * first.itemsize
        first.frombytes(blob[8:cut])
        counts.frombytes(blob[cut : cut + n * counts.itemsize])
        return cls(blob[cut + n * counts.itemsize :].decode(), first, counts)

    def near(self, word: str) -> dict[str, int]:
        """The words one edit away, with their counts: a run of the word's automaton over the trie, depth-first.

        A state is a place in the word and whether an edit was made; after the edit only the word's own letters lead on.
        """
        first, find, size, found = self.first, self.labels.find, len(word), {}
        stack: list[tuple[int, int, tuple[int, str, int] | None]] = [(0, 0, None)]
        while stack:
            node, at, edit = stack.pop()
            if edit:
                while at < size and node >= 0:
                    node, at = find(word[at], first[node], first[node + 1]), at + 1
                if node >= 0 and self.counts[node]:
                    cut, letter, rest = edit
                    found[word[:cut] + letter + word[rest:]] = self.counts[node]
                continue
            lo, hi = first[node], first[node + 1]
            own, then = word[at : at + 1], word[at + 1 : at + 2]
            for child in range(lo, hi):
                letter, more, end = self.labels[child], first[child], first[child + 1]
                if letter != own:  # a letter put before its like is put after it as well
                    if not own or find(own, more, end) >= 0:
                        stack.append((child, at, (at, letter, at)))
                    if own and (not then or find(then, more, end) >= 0):
                        stack.append((child, at + 1, (at, letter, at + 1)))
            if own:
                if own != then:  # of equal letters in a row the last is deleted
                    stack.append((node, at + 1, (at, "", at + 1)))
                if (same := find(own, lo, hi)) >= 0:
                    stack.append((same, at + 1, None))
        return found


def _tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows as tries of at most ``SHARD_WORDS`` words."""
    words, counts = [], []
    for batch in batches:
        words, counts = words + batch["word"].tolist(), counts + batch["n"].tolist()
        while len(words) >= SHARD_WORDS:
            yield pd.DataFrame({"trie": [Trie.of(words[:SHARD_WORDS], counts[:SHARD_WORDS]).dump()]})
            words, counts = words[SHARD_WORDS:], counts[SHARD_WORDS:]
    if words:
        yield pd.DataFrame({"trie": [Trie.of(words, counts).dump()]})


def _neighbours(lot):
    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = [Trie.load(blob) for blob in lot.value]
        for batch in batches:
            rows = []
            for word in batch["word"]:
                found = {}
                for trie in tries:
                    found |= trie.near(word)
                best = min(found, key=lambda w: (-found[w], w), default=None)
                rows.append((len(found), found.get(best, 0), best))
            near, most, form = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"word": batch["word"], "n": batch["n"], "near": near, "most": most, "form": form})

    return neighbours


def lots(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Numbers of tries, in lots of at most ``LOT_BYTES`` (a larger trie is a lot of its own)."""
    out, filled = [], 0
    for number, size in sizes:
        if not out or filled + size > LOT_BYTES:
            out, filled = [*out, []], 0
        out[-1].append(number)
        filled += size
    return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n`` of a vocabulary (distinct ``word`` with its count ``n``)."""
    spark = vocabulary.sparkSession
    ranges = max(1, -(-vocabulary.count() // SHARD_WORDS))
    tries = checkpointed(vocabulary.repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInPandas(_tries, "trie binary").withColumn("number", F.monotonically_increasing_id()))
    spread = vocabulary.repartition(shuffle_partitions(spark), F.xxhash64("word"))
    parts = []
    for numbers in lots([tuple(r) for r in tries.select("number", F.length("trie")).orderBy("number").collect()]):  # a row for 32,768 words
        lot = spark.sparkContext.broadcast([bytes(r["trie"]) for r in tries.filter(F.col("number").isin(numbers)).select("trie").collect()])
        parts.append(checkpointed(spread.mapInPandas(_neighbours(lot), "word string, n long, near long, most long, form string")))
        lot.unpersist()
    found = vocabulary.selectExpr("word", "n", "0L as near", "0L as most", "cast(null as string) as form").limit(0)
    for part in parts:
        found = found.unionByName(part)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("most")).alias("less"), "form")))
    reduced = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    more = -F.col("best.less") >= FACTOR * F.col("n")
    return reduced.select("word", "n", "n_near", F.when(more, F.col("best.form")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n"))


def rooted(found: DataFrame) -> DataFrame:
    """Add ``root``, the end of a word's chain of forms: counts at least double at each step, so the number of rounds is
    at most the logarithm of the chain, itself one of the largest count."""
    links = checkpointed(found.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = checkpointed(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            break
    return found.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of at least 5 code points and 3 occurrences.

    Null and empty texts have no words; a null id counts as the empty string; repeated rows count each; long texts and
    long runs of letters are read whole; of equal counts the smallest form in code-point order wins; other columns play
    no part, whatever they are called; an empty table gives no rows.
    """
    vocabulary = checkpointed(counted_words(docs, doc_id, text))
    found = checkpointed(near_words(vocabulary))
    return rooted(found).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


OP13_SQL = f"""
with recursive k as materialized (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as k),
runs as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '{LETTERS}{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') as run from documents),
r as (select id, run, count(*) as n from runs group by all),
h as materialized (select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a >> 8, k[(xor(a, b) & 255) + 1])), 4294967295) as h from r, k),
o as (select case when h % {TYPO_STEP} = 0 then substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) else run end as word, n from h),
v as materialized (select word, sum(n)::bigint as n from o where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
d as materialized (select word, n, i, substring(word, 1, i) || substring(word, i + 2) as less from (select *, unnest(range(length(word))) as i from v)),
p as (select a.word, a.n, b.word as near, b.n as m from d a join d b on a.less = b.less and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
  union select d.word, d.n, v.word, v.n from d join v on d.less = v.word union select v.word, v.n, d.word, d.n from d join v on d.less = v.word),
f as materialized (select word, count(*) as n_near, max(m) as m, arg_min(near, (-m, near)) as form from p group by word),
w as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= {FACTOR} * n then form end as form, case when m >= {FACTOR} * n then m end as form_n from v left join f using (word)),
c as (select word, form as root from w where form is not null union all select c.word, w.form from c join w on c.root = w.word where w.form is not null),
t as (select c.word, c.root from c join w on c.root = w.word where w.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from w left join t using (word)
"""
