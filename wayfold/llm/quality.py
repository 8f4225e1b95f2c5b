"""Document quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_columns, releasing, worker_state

CHUNK, STEP = 1024, 896
WIDTH, STRIDE, FILTERS = 8, 4, 12


def chunks(data: bytes) -> Iterator[bytes]:
    """Overlapping chunks that cover the whole document; the last one starts where it still has new bytes."""
    yield data[:CHUNK]
    at = STEP
    while at + CHUNK - STEP < len(data):
        yield data[at : at + CHUNK]
        at += STEP


def spots(data: np.ndarray) -> np.ndarray:
    """Byte pairs of every filter position: ``(positions, WIDTH // 2)`` values below 65536. Short data is padded with zeros."""
    if len(data) < WIDTH:
        data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
    pad = -(len(data) - WIDTH) % STRIDE
    if pad:
        data = np.concatenate([data, np.zeros(pad, np.uint8)])
    pairs = data.view("<u2") if len(data) % 2 == 0 else np.concatenate([data, np.zeros(1, np.uint8)]).view("<u2")
    n = (len(data) - WIDTH) // STRIDE + 1
    half = STRIDE // 2
    return np.stack([pairs[i : i + half * (n - 1) + 1 : half] for i in range(WIDTH // 2)], axis=1)


class ByteNet:
    """One convolution over byte positions with max and mean pooling per chunk, a logit per chunk, and their mean."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)

    def params(self) -> list[np.ndarray]:
        return [self.kernel, self.bias, self.out]

    def tables(self) -> np.ndarray:
        """Responses to byte pairs: ``(WIDTH // 2, 65536, FILTERS)``; the low byte comes first in the text."""
        low, high = np.arange(65536) & 255, np.arange(65536) >> 8
        return np.stack([self.kernel[2 * i][low] + self.kernel[2 * i + 1][high] for i in range(WIDTH // 2)])

    def fit(self, sample: list[tuple[bytes, int]], epochs: int = 12, rate: float = 0.02, short_share: float = 0.06, seed: int = 5) -> ByteNet:
        """Adam on log loss. ``sample`` has each document's whole bytes and label; an epoch visits every chunk of every document,
        and the chunks of one document weigh as much together as any other document."""
        rng = np.random.default_rng(seed)
        share = np.mean([y for _, y in sample])
        self.out_bias = np.float32(np.log((share + 1e-3) / (1 - share + 1e-3)))
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.params()]
        items = []
        for data, y in sample:
            cs = list(chunks(data))
            items += [(np.frombuffer(c, np.uint8), y, 1 / len(cs)) for c in cs]
        step, group = 0, 48
        for epoch in range(epochs):
            for batch in np.array_split(rng.permutation(len(items)), max(1, len(items) // group)):
                parts, labels, weights = [], [], []
                for d in batch:
                    c, y, w = items[d]
                    if y and rng.random() < short_share:  # clean documents come in any length
                        n = int(rng.integers(4, 200))
                        at = int(rng.integers(0, max(1, len(c) - n)))
                        c = c[at : at + n]
                    parts.append(windows(c))
                    labels.append(y)
                    weights.append(w)
                grads, bias_grad = self._gradients(parts, np.array(labels), np.array(weights) / np.sum(weights))
                step += 1
                lr = rate * (0.5 if epoch >= epochs * 2 // 3 else 1)
                self.out_bias -= np.float32(lr * bias_grad * 5)
                for p, g, (m, v) in zip(self.params(), grads, moments, strict=True):
                    g = g + 1e-5 * p
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, parts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the weighted log loss over chunks, given as their positions' bytes."""
        x = np.concatenate(parts).astype(np.intp)
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        z = self.kernel[0][x[:, 0]]
        for i in range(1, WIDTH):
            z += self.kernel[i][x[:, i]]
        z += self.bias
        hidden = np.maximum(z, 0)
        top = np.stack([hidden[a : a + n].argmax(axis=0) + a for a, n in zip(starts, sizes, strict=True)])
        every = np.arange(FILTERS)
        pooled = np.concatenate([hidden[top, every], np.add.reduceat(hidden, starts, axis=0) / sizes[:, None]], axis=1)
        p = 1 / (1 + np.exp(-(pooled @ self.out + self.out_bias)))
        g = ((p - labels) * weights).astype(np.float32)
        back = np.repeat(g[:, None] * self.out[FILTERS:] / sizes[:, None].astype(np.float32), sizes, axis=0) * (z > 0)
        peak = np.where(hidden[top, every] > 0, g[:, None] * self.out[:FILTERS], 0)
        np.add.at(back, (top, every), peak)
        at = (x + 256 * np.arange(WIDTH)).ravel()
        kernel = np.stack([np.bincount(at, np.repeat(back[:, f], WIDTH), 256 * WIDTH) for f in range(FILTERS)], axis=1)
        return [kernel.reshape(WIDTH, 256, FILTERS).astype(np.float32), back.sum(axis=0), (g[:, None] * pooled).sum(axis=0).astype(np.float32)], float(g.sum())


def windows(data: np.ndarray) -> np.ndarray:
    """Bytes under every filter position, zero-padded: ``(positions, WIDTH)``."""
    pad = WIDTH - len(data) if len(data) < WIDTH else -(len(data) - WIDTH) % STRIDE
    if pad:
        data = np.concatenate([data, np.zeros(pad, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(data, WIDTH)[::STRIDE]


class Scorer:
    """Scores whole texts with prepared pair tables."""

    def __init__(self, net: ByteNet):
        self.net, self.tables = net, net.tables()

    def logits(self, data: bytes) -> np.ndarray:
        return np.array([self._chunk(np.frombuffer(c, np.uint8)) for c in chunks(data)])

    def _pool(self, at: np.ndarray) -> np.ndarray:
        hidden = self.tables[0][at[:, 0]]
        for i in range(1, WIDTH // 2):
            hidden += self.tables[i][at[:, i]]
        hidden += self.net.bias
        return np.maximum(hidden, 0, out=hidden)

    def _chunk(self, data: np.ndarray) -> float:
        hidden = self._pool(spots(data))
        return float(np.concatenate([hidden.max(axis=0), hidden.mean(axis=0)]) @ self.net.out + self.net.out_bias)

    def score(self, text: str | None) -> float:
        """Mean chunk logit as a probability. Chunks that are whole share one pass of the filters over the document."""
        data = (text or "").encode("utf-8", "replace")
        n = len(data)
        whole = max(0, (n - CHUNK) // STEP + 1) if n >= CHUNK else 0
        logits: list[float] = []
        if whole:
            for first in range(0, whole, 256):  # bounded memory on very long texts
                count = min(256, whole - first)
                part = np.frombuffer(data, np.uint8, (count - 1) * STEP + CHUNK, first * STEP)
                hidden = self._pool(spots(part))
                per = (CHUNK - WIDTH) // STRIDE + 1
                block = np.lib.stride_tricks.sliding_window_view(hidden, per, axis=0)[:: STEP // STRIDE][:count]
                pooled = np.concatenate([block.max(axis=2), block.mean(axis=2)], axis=1)
                logits += (pooled @ self.net.out + self.net.out_bias).tolist()
        tail = whole * STEP
        if not whole or tail + CHUNK - STEP < n:
            logits.append(self._chunk(np.frombuffer(data, np.uint8)[tail:]))
        return 1 / (1 + float(np.exp(-np.clip(np.mean(logits), -40, 40))))


def learn_quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 3000, seed: int = 3) -> ByteNet:
    """Fit on a bounded sample: at most ``sample_rows`` labelled documents outside the held-out fifth, half of each label where there
    are so many, in hash order, each with its whole text. Null labels are left out; a document labelled more than once
    takes its smallest label; repeated rows count each; without labelled rows every score is one half."""
    ids = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(crc_mod("doc_id", 5) != 0)
    half = sample_rows // 2
    pick = F.broadcast(ids.where("quality = 0").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(half).union(ids.where("quality <> 0").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows - half)))
    chosen = docs.select("doc_id", "text").join(pick, "doc_id").select("doc_id", F.col("quality").cast("int").alias("label"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    # rows of one id could be any number: as many as the sample holds are taken, in hash order
    rows = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", F.xxhash64("data")).limit(sample_rows).toPandas()
    net = ByteNet()
    if not len(rows):
        net.out[:] = 0
        return net
    return net.fit([(bytes(d), int(y != 0)) for d, y in zip(rows["data"], rows["label"], strict=True)])


def score_quality(docs: DataFrame, net: ByteNet, *, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row from its whole text alone. Null and empty texts are scored as no
    bytes; repeated rows score alike; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = Scorer(shared.value)

        def fn(ids, held, texts):
            scores = [scorer.score(t) for t in texts]
            return ids, held, scores, [int(s >= threshold) for s in scores]

        return fn

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    return map_columns(rows, "doc_id long, held_out boolean, score double, predicted int", make)


def keep_quality(docs: DataFrame, net: ByteNet, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose whole text is predicted 1, all columns as they were. Null and empty texts are scored as no bytes;
    repeated rows stay or go alike; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def verdicts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_state("quality", bool)
        scorer = Scorer(shared.value)
        for column in texts:
            good: list[bool] = []
            for at in range(0, len(column), 512):
                good += [scorer.score(t) >= threshold for t in column.slice(at, 512).to_pylist()]
            yield pa.array(good, pa.bool_())

    @F.arrow_udf("boolean")
    def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from releasing(verdicts)(texts)

    return docs.where(passes(F.col("text")))
