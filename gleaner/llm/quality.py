"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters read windows of 8 bytes, 4 bytes apart. Chunks of 512 bytes overlap by half and cover the whole text;
the filters are max-pooled in each chunk, a small hidden layer reads each chunk, its mean and its maximum over all
chunks are combined into one probability. It is trained on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from gleaner.llm.common import read_table

WIDTH, STRIDE = 8, 4
HALF = 256
EMBED, FILTERS, HIDDEN = 6, 24, 12
#: The bound of the sample that the network is fitted on: so many labelled documents, whole.
SAMPLE_ROWS = 3000
#: Longer texts are not trained on, and a step's texts are so long at most: both bound the driver's memory.
SAMPLE_TEXT_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
#: The steps of training, the same for small and large samples.
STEPS, BATCH, RATE = 600, 32, 0.01
THRESHOLD = 0.7
HELD_OUT = 2
SEED = 7
#: Bytes of text for which features are computed at once.
SLICE = 1 << 18


@dataclass
class ByteNet:
    embed: np.ndarray  # 256 x EMBED; byte 0 also pads
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # 2 * HIDDEN: for the mean and for the maximum over chunks
    out_bias: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int = SEED) -> ByteNet:
        rng = np.random.default_rng(seed)
        n = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            n(256, EMBED, scale=0.5), n(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), np.zeros(FILTERS, np.float32),
            n(FILTERS, HIDDEN, scale=FILTERS**-0.5), np.full(HIDDEN, 0.1, np.float32), n(2 * HIDDEN, scale=0.2), np.zeros(1, np.float32),
        )

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def halves(self, data: np.ndarray, ends: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter in each 256 bytes of ``data`` (a multiple of 256 bytes, and 4 more).

        ``ends`` are the last halves of texts: their last window, which is padding, would read the next text.
        """
        cols = STRIDE * EMBED
        x = self.embed[data].reshape(-1, cols)
        conv = x[:-1] @ self.filters[:cols]
        conv += x[1:] @ self.filters[cols:]
        conv = conv.reshape(-1, HALF // STRIDE, FILTERS)
        conv[ends, -1] = -np.inf
        at = conv.argmax(axis=1) if where else None
        top = np.take_along_axis(conv, at[:, None, :], 1)[:, 0] if where else conv.max(axis=1)
        return top + self.bias, at

    def scores(self, texts: list[bytes]) -> np.ndarray:
        data, sizes = pad(texts)
        counts = np.array(sizes) // HALF
        stops, tops = np.cumsum(counts), []
        for at in range(0, stops[-1], SLICE // HALF):
            to = min(at + SLICE // HALF, stops[-1])
            here = stops[(stops > at) & (stops <= to)] - 1 - at
            tops.append(self.halves(data[at * HALF : to * HALF + STRIDE], here)[0])
        starts = stops - counts
        chunks = self.hidden_layer(chunk_tops(np.concatenate(tops), starts, counts)[0])
        return self.logits(chunks, starts, counts)[0]

    def hidden_layer(self, tops: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(tops, 0) @ self.hidden + self.hidden_bias, 0)

    def logits(self, chunks: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean = np.add.reduceat(chunks, starts, axis=0) / counts[:, None]
        most = np.maximum.reduceat(chunks, starts, axis=0)
        return mean @ self.out[:HIDDEN] + most @ self.out[HIDDEN:] + self.out_bias[0], mean, most


def pad(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """All texts in one array, each with at least 4 zero bytes after it, up to a multiple of 256."""
    sizes = [-(-(len(t) + STRIDE) // HALF) * HALF for t in texts]
    return np.frombuffer(b"".join([*(t.ljust(n, b"\0") for t, n in zip(texts, sizes)), b"\0" * STRIDE]), dtype=np.uint8), sizes


def chunk_tops(tops: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-pool each half with the next half of the same text: chunks of 512 bytes that overlap by half."""
    after = np.arange(1, len(tops) + 1)
    after[starts + counts - 1] -= 1
    return np.maximum(tops, tops[after]), after


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> ByteNet:
    """Train a network by Adam on the whole texts; only the windows that win a maximum get a gradient."""
    net, rng = ByteNet.fresh(seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    labels = np.asarray(labels, np.float32)
    order: list[int] = []
    for step in range(1, steps + 1 if texts else 1):
        if len(order) < BATCH:
            order += rng.permutation(len(texts)).tolist()
        fits = max(1, int((np.cumsum([len(texts[i]) for i in order[:BATCH]]) <= BATCH_BYTES).sum()))
        rows, order = order[:fits], order[fits:]
        grads = gradients(net, [texts[i] for i in rows], labels[rows])
        rate = RATE * (1 - step / (steps + 1)) + 1e-4
        for p, g, (m, v) in zip(net.params(), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def gradients(net: ByteNet, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    data, sizes = pad(texts)
    counts = np.array(sizes) // HALF
    starts = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(texts)), counts)
    tops, won = net.halves(data, starts + counts - 1, where=True)
    pooled, after = chunk_tops(tops, starts, counts)
    active = np.maximum(pooled, 0)
    chunks = net.hidden_layer(pooled)
    z, mean, most = net.logits(chunks, starts, counts)
    dz = ((1 / (1 + np.exp(-z)) - labels) / len(texts)).astype(np.float32)
    d_out = np.r_[mean.T @ dz, most.T @ dz]
    d_chunks = (dz / counts)[of][:, None] * net.out[:HIDDEN]
    # The first chunk of each text that reaches the maximum gets its gradient.
    hit = chunks == most[of]
    before = np.cumsum(hit, axis=0)
    before -= (before[starts] - hit[starts])[of]
    d_chunks = d_chunks + (hit & (before == 1)) * (dz[of][:, None] * net.out[HIDDEN:])
    d_chunks = d_chunks * (chunks > 0)
    d_hidden, d_hidden_bias = active.T @ d_chunks, d_chunks.sum(axis=0)
    d_pooled = (d_chunks @ net.hidden.T) * (pooled > 0)
    d_tops = np.where(tops >= tops[after], d_pooled, 0)
    other = np.where(tops >= tops[after], 0, d_pooled)
    np.add.at(d_tops, after, other)
    at = (np.arange(len(tops))[:, None] * HALF + won * STRIDE)[:, :, None] + np.arange(WIDTH)
    seen = data[at]  # halves x FILTERS x WIDTH
    windows = net.embed[seen].reshape(len(tops), FILTERS, WIDTH * EMBED)
    d_filters = np.einsum("hf,hfk->kf", d_tops, windows, optimize=True)
    d_windows = (d_tops[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    flat = seen.reshape(-1)
    d_embed = np.stack([np.bincount(flat, d_windows[:, k], 256) for k in range(EMBED)], axis=1).astype(np.float32)
    return [d_embed, d_filters, d_tops.sum(axis=0), d_hidden, d_hidden_bias, d_out, np.array([dz.sum()], np.float32)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], np.ndarray]:
    """A bounded sample of whole labelled texts: the ``rows`` ids that a hash puts first, none of them held out.

    Of an id with several labels or texts the smallest counts; null labels and ids and texts over a megabyte are left
    out, null texts are empty.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    picked = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = sorted(((r["doc_id"], r["text"], r["quality"]) for r in picked.toLocalIterator()), key=lambda r: r[0])
    return [t.encode("utf-8", "replace") for _, t, _ in found], np.array([q for *_, q in found])


def scorer(net: ByteNet):
    """A vectorized function that gives each text its score from 0 to 1; a null text counts as empty."""

    @pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in batch]
            out, at = [], 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= SLICE:
                    size += len(texts[end])
                    end += 1
                out.append(net.scores(texts[at:end]))
                at = end
            z = np.concatenate(out).astype(np.float64) if out else np.empty(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def fitted(spark: SparkSession, sf_dir: str, rows: int = SAMPLE_ROWS, steps: int = STEPS) -> ByteNet:
    texts, quality = training_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), rows)
    return fit(texts, quality, steps)


def quality_scores(docs: DataFrame, net: ByteNet) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row, from its text alone.

    Null texts score as empty ones; long texts are read whole; repeated rows come back repeated; a null id is not held
    out; other columns play no part, whatever they are called; an empty table gives no rows. A network that had no label
    to learn from, or labels of one kind, scores all the same, without meaning.
    """
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(net)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), fitted(spark, sf_dir))


def keep_good(docs: DataFrame, net: ByteNet) -> DataFrame:
    """The documents that the network does not reject, all their columns as they are.

    Each row is judged by its own text: null texts as empty ones, rows without an id and repeated rows like all others;
    an empty table gives an empty one.
    """
    columns = docs.columns
    return docs.withColumn("__score", scorer(net)(F.col("text"))).filter(F.col("__score") >= THRESHOLD).select(*columns)
