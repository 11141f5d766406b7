"""Token counts from a finite-state compilation of a piece tokenizer.

After each prefix of a text, byte-pair merging has one last token, and a token may follow another exactly if the two
alone are not merged any further. So what the rest of a text can depend on is, for each suffix that a token could still
grow from, the trie node it has reached, the token before it and the token count there: a finite state. The transducer
reads one character a step; each transition is annotated with how many tokens it adds to the count (this can be
negative: characters that become one token). States are made when first reached.

The state map of a chunk of text is its run from the state at a word break: states and counts after its first characters,
the count of all and the state at its end. Whatever the state before the chunk is, its run meets that of the map after a
few characters, at a word break at the latest, and is the same from there on; so maps compose at the cost of these few
characters, associatively, and a text's maps are combined by a parallel prefix scan.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from gleaner.llm.common import read_table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
CHUNK = 1 << 15
#: When a worker holds so many states or words, it drops them and makes them anew as they come: only memory is bounded.
MAX_STATES = 200_000
MAX_WORDS = 300_000
MAX_PAIRS = 500_000
LONGEST_WORD = 64  # longer ones are not held
#: Characters of a chunk at which a run from another state is looked for.
MARKS = 256
INFINITE = float("inf")
#: Added to the tokens of a transition to store them as a number from 0 to 255; a piece has far fewer characters.
BIAS = 64


class Vocabulary:
    """The pieces of a sentencepiece BPE model with byte fallback, as text and merge order."""

    def __init__(self, name: str = MODEL):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.rank: dict[str, float] = {}
        self.pieces: list[str] = []
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            self.rank[piece] = -model.get_score(i)
            self.pieces.append(piece)
        self.alphabet = {p for p in self.pieces if len(p) == 1}
        assert all(c in self.alphabet for p in self.pieces for c in p), "a piece has a character that is no piece"
        assert not any(SPACE in p.lstrip(SPACE) for p in self.pieces), "a piece spans a word break"

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text: the pair of lowest rank is merged first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """The deterministic transducer of a vocabulary; state ``START`` is the one at a word break.

    States are numbers. ``steps`` holds a transition as one number too: under the state and the character, the next
    state and the tokens added, so a worker's machine is a few flat tables.
    """

    START = 0

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for number, piece in enumerate(vocabulary.pieces):
            node = 0
            for c in map(ord, piece):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][c]
            if vocabulary.merge(piece) == [piece]:
                self.token[node] = number
        self.alphabet = set(map(ord, vocabulary.alphabet))
        self.edges: dict[tuple[str, bool], list[tuple[str, float]] | None] = {}
        self.follows: dict[int, bool] = {}
        self.steps: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states; what a state means stays valid."""
        self.numbers: dict[tuple, int] = {}
        self.meanings: list[tuple] = []
        self.steps.clear()
        assert self._state((BIAS,)) == self.START

    def _state(self, meaning: tuple) -> int:
        found = self.numbers.setdefault(meaning, len(self.meanings))
        if found == len(self.meanings):
            self.meanings.append(meaning)
        return found

    def _edge(self, piece: str, right: bool) -> list[tuple[str, float]] | None:
        """The pieces that lie at one end of ``piece`` while it is merged, each with the rank at which it is replaced.

        None if a part of some merge has a higher rank than its result: order in time is not order of rank then.
        """
        known = self.edges.get((piece, right), 0)
        if known != 0:
            return known
        rank, parts, out, inner = self.vocabulary.rank, list(piece), [], {}
        monotone = True
        while len(parts) > 1:
            r, at = min((rank.get(x + y, INFINITE), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            monotone &= r >= max(inner.get(parts[at], -INFINITE), inner.get(parts[at + 1], -INFINITE))
            if at == (len(parts) - 2 if right else 0):
                out.append((parts[-1] if right else parts[0], r))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            inner[parts[at]] = r
        out.append((piece, INFINITE))
        self.edges[piece, right] = out if monotone else None
        return self.edges[piece, right]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether two tokens next to each other stay as they are: no merge across their border comes first."""
        if last < 0:
            return True
        known = self.follows.get(last << 20 | token)
        if known is not None:
            return known
        a, b = self.vocabulary.pieces[last], self.vocabulary.pieces[token]
        left, right = self._edge(a, True), self._edge(b, False)
        if left is None or right is None:
            known = self.vocabulary.merge(a + b) == [a, b]
        else:
            rank, i, j, known = self.vocabulary.rank, 0, 0, True
            while True:
                (x, before), (y, after) = left[i], right[j]
                across = rank.get(x + y)
                if across is not None and across < before and across <= after:
                    known = False
                    break
                if before == after == INFINITE:
                    break
                if before <= after:
                    i += 1
                else:
                    j += 1
        if len(self.follows) >= MAX_PAIRS:
            self.follows.clear()
        self.follows[last << 20 | token] = known
        return known

    def compile(self, state: int, c: int) -> int:
        """Make the transition of a state on a character; too many states are dropped but for the present one."""
        if len(self.meanings) >= MAX_STATES:
            meaning = self.meanings[state]
            self.forget()
            state = self._state(meaning)
        if c not in self.alphabet:  # one token for each byte; nothing merges with it
            step = len(chr(c).encode("utf-8", "surrogatepass")) + BIAS
        else:
            grown, last, added = [], -1, 0
            for item in self.meanings[state]:  # trie node, token before it plus 1, tokens since then plus BIAS
                node = self.children[item >> 28].get(c)
                if node is None:
                    continue
                token, before = self.token[node], (item >> 8 & 0xFFFFF) - 1
                if token >= 0 and self._may_follow(before, token):
                    last, added = token, 1 + BIAS - (item & 255)
                if self.children[node]:
                    grown.append(node << 28 | item & 0xFFFFFFF)
            assert last >= 0, "no token ends here"
            step = self._state((*(item + added for item in grown), last + 1 << 8 | BIAS)) << 8 | added + BIAS
        self.steps[state << 21 | c] = step
        return step

    def run(self, text: str, state: int) -> tuple[int, int]:
        """The state after a text and the tokens it adds."""
        total, get = 0, self.steps.get
        for c in map(ord, text):
            step = get(state << 21 | c) or self.compile(state, c)
            state = step >> 8
            total += step & 255
        return state, total - BIAS * len(text)


class ChunkMap(NamedTuple):
    """What the characters ``start`` to ``stop`` of a text do: from a word break they run through ``marks`` (what the
    state means and the tokens so far after each of the first characters) to ``count`` tokens and the state ``tail``."""

    start: int
    stop: int
    marks: list[tuple[tuple, int]]
    count: int
    tail: tuple


class Words(dict):
    """Tokens of each word from one break to the next, the space before it included."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        count = self.machine.run(SPACE + word, self.machine.START)[1]
        if len(word) <= LONGEST_WORD:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = count
        return count


class Counter:
    """Counts the tokens of texts through the transducer."""

    def __init__(self, vocabulary: Vocabulary | None = None):
        self.machine = Transducer(vocabulary or Vocabulary())
        self.words = Words(self.machine)
        self.composed = 0  # characters that compositions have run over

    def chunk_map(self, text: str, start: int, stop: int, marks: int = MARKS) -> ChunkMap:
        """``text`` has spaces as ``SPACE``. After the marks, whole words between breaks are counted at once."""
        machine, state, total, at, seen = self.machine, self.machine.START, 0, start, []
        while at < min(start + marks, stop):
            state, more = machine.run(text[at], state)
            total, at = total + more, at + 1
            seen.append((machine.meanings[state], total))
        found = max(at, start + 1)
        while True:  # a break is before a space that follows another character
            found = text.find(SPACE, found, stop)
            if found < 0 or text[found - 1] != SPACE:
                break
            found += 1
        state, more = machine.run(text[at : stop if found < 0 else found], state)
        total += more
        if found >= 0:
            rest, spaces = text[found + 1 : stop].split(SPACE), 1
            last = len(rest) - 1
            if "" not in rest:
                total += sum(map(self.words.__getitem__, rest[:-1]))
                state, more = machine.run(SPACE + rest[-1], machine.START)
                return ChunkMap(start, stop, seen, total + more, machine.meanings[state])
            for i, word in enumerate(rest):
                if not word and i < last:
                    spaces += 1
                elif i < last and spaces == 1:
                    total += self.words[word]
                else:
                    state, more = machine.run(SPACE * spaces + word, machine.START)
                    total, spaces = total + more, 1
        return ChunkMap(start, stop, seen, total, machine.meanings[state])

    def compose(self, text: str, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two chunks that follow each other: from the end of ``a``, ``b`` is run until it meets its map."""
        machine, total = self.machine, 0
        state = machine._state(a.tail)
        for i, (meaning, count) in enumerate(b.marks):
            self.composed += 1
            state, more = machine.run(text[b.start + i], state)
            total += more
            if machine.meanings[state] == meaning:
                return ChunkMap(a.start, b.stop, a.marks, a.count + total + b.count - count, b.tail)
        at = b.start + len(b.marks)  # not yet: run on to its end
        self.composed += b.stop - at
        state, more = machine.run(text[at : b.stop], state)
        return ChunkMap(a.start, b.stop, a.marks, a.count + total + more, machine.meanings[state])

    def scan(self, text: str, maps: list[ChunkMap]) -> ChunkMap:
        """Combine the maps of a text's chunks pairwise, in as many levels as the logarithm of their number."""
        while len(maps) > 1:
            maps = [self.compose(text, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        marks = MARKS if len(text) > chunk else 0
        return self.scan(text, [self.chunk_map(text, at, min(at + chunk, len(text)), marks) for at in range(0, len(text), chunk)]).count


@lru_cache(1)
def _counter() -> Counter:
    """One machine for all tasks of a Python worker."""
    made = Counter()
    gc.freeze()  # the trie stays: the garbage collector needn't look at it again
    return made


@pandas_udf(LongType())
def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    counter = _counter()
    for batch in batches:
        yield pd.Series(np.fromiter((counter.count(t) if isinstance(t, str) else 0 for t in batch), dtype=np.int64, count=len(batch)))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row; null and empty texts have no bytes and no tokens.

    Rows are kept as they come, repeated ones and those without an id included; other columns play no part, whatever they
    are called; an empty table gives no rows. Texts of any length are read whole, in chunks; the machine's states and
    words are bounded however odd the text is.
    """
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), _counts(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
