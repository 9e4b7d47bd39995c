"""Quality classifier: a byte-level convolutional network in numpy.

Filters of `TAPS` bytes slide over the whole document. The document is covered by chunks
of `CHUNK` bytes that begin every `STRIDE` bytes, so neighbours share half their bytes; each chunk keeps each filter's
largest response (max pooling), and a logistic layer combines the mean and the maximum over
all chunks into one probability. Since a filter's input is one-hot bytes, its weights are
a table of 256 rows for each tap, and two taps are looked up at once by byte pairs.

The net is trained by Adam on a bounded sample of labelled rows (`per_class` ids of either label, the smallest hashes; of the rows
of an id one; of a text over `train_chars` code points `train_runs` evenly spaced runs, that many in all), with both labels weighted
alike. So at most 2 * per_class rows and 2 * per_class * train_chars code points come to the driver.
Training runs in one thread and in a fixed order, so a rerun gives the same net. Scores always read whole texts.

Defined cases: null text is empty; an empty text has all-zero features and scores like the
bias alone; labels other than 0 and 1 or null, and labels without a document, are not
learned from, and of several labels of an id the larger counts; without both labels every score is 0.5; rows that share an id or are
repeated are each scored; equal texts have equal scores; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAPS, FILTERS, CHUNK, STRIDE = 6, 24, 256, 128


def _pairs(data: np.ndarray) -> np.ndarray:
    """The byte pair that begins at each place; zeros stand beyond the end."""
    x = np.zeros(len(data) + TAPS, np.uint16)
    x[: len(data)] = data
    return (x[:-1] << 8) | x[1:]


class Net:
    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.w = (r.standard_normal((TAPS, 256, FILTERS)) * 0.05).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (r.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple((self.w[i][:, None, :] + self.w[i + 1][None, :, :]).reshape(65536, FILTERS) for i in range(0, TAPS, 2))

    def responses(self, data: np.ndarray, tables) -> np.ndarray:
        p = _pairs(data)
        y = tables[0].take(p[: len(data)], axis=0)
        for k, table in enumerate(tables[1:], 1):
            y += table.take(p[2 * k : len(data) + 2 * k], axis=0)
        return y

    def chunks(self, data: np.ndarray, tables, piece: int = 1 << 16) -> np.ndarray:
        """(chunks, filters): max-pooled responses over the whole document. piece: a multiple of STRIDE."""
        out = []
        for a in range(0, len(data), piece):  # a piece sees the bytes of the next one that its last filters reach
            n = min(piece, len(data) - a)
            y = self.responses(data[a : a + piece + TAPS], tables)[:n]
            out.append(np.maximum.reduceat(y, np.arange(0, n, STRIDE), axis=0))
        steps = np.concatenate(out) if out else np.zeros((0, FILTERS), np.float32)
        return np.maximum(steps[:-1], steps[1:]) if len(steps) > 1 else steps  # a chunk is two steps

    def features(self, pooled: np.ndarray) -> np.ndarray:
        if not len(pooled):
            return np.zeros(2 * FILTERS)
        h = np.maximum(pooled + self.bias, 0)
        return np.concatenate([h.mean(0), h.max(0)])

    def score(self, data: np.ndarray, tables) -> float:
        z = float(self.features(self.chunks(data, tables)) @ self.out + self.out_bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> Net | None:
    if not len(labels) or labels.min() == labels.max():
        return None
    net, r = Net(seed), np.random.default_rng(seed + 1)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    params = [net.w, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    data = [np.frombuffer(t, np.uint8) for t in texts]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(data))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            grads = [np.zeros_like(p) for p in params]
            for i in rows:
                _backward(net, data[i], labels[i], weight[i] / len(rows), grads)
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-3
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                g += decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def _backward(net: Net, data: np.ndarray, label: float, weight: float, grads: list[np.ndarray]) -> None:
    """Adds one document's gradient. Max pooling passes it to one place of a chunk for each filter."""
    if not len(data):
        z = net.out_bias[0]
        grads[3] += weight * (1 / (1 + np.exp(-z)) - label)
        return
    p = np.zeros(len(data) + TAPS, np.uint8)
    p[: len(data)] = data
    y = sum(net.w[t].take(p[t : t + len(data)], axis=0) for t in range(TAPS))
    starts = np.arange(0, len(data), STRIDE)
    pad = (-len(data)) % STRIDE
    blocks = np.concatenate([y, np.full((pad, FILTERS), -np.inf, np.float32)]).reshape(len(starts), STRIDE, FILTERS)
    where = blocks.argmax(1)
    pooled = np.take_along_axis(blocks, where[:, None], 1)[:, 0]
    place = where + starts[:, None]
    if len(starts) > 1:
        second = pooled[1:] > pooled[:-1]
        pooled, place = np.where(second, pooled[1:], pooled[:-1]), np.where(second, place[1:], place[:-1])
    h = np.maximum(pooled + net.bias, 0)
    top = h.argmax(0)
    f = np.concatenate([h.mean(0), h.max(0)])
    z = f @ net.out + net.out_bias[0]
    d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
    grads[2] += d * f
    grads[3] += d
    dh = np.tile(d * net.out[:FILTERS] / len(h), (len(h), 1)).astype(np.float32)
    dh[top, np.arange(FILTERS)] += d * net.out[FILTERS:]
    dh *= h > 0
    grads[1] += dh.sum(0)
    columns = np.broadcast_to(np.arange(FILTERS), place.shape)
    for t in range(TAPS):
        np.add.at(grads[0][t], (p[place + t], columns), dh)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 800, train_chars: int = 1 << 15, train_runs: int = 16) -> Net | None:
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("label"))
    chosen = None
    for x in (0, 1):  # at most per_class rows each
        part = known.where(F.col("label") == x).orderBy(F.xxhash64("k"), "k").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("k"))
    n, run = F.length("t"), train_chars // train_runs
    runs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(train_runs - 1)), lambda i: F.substr("t", (F.floor(i * (n - run) / (train_runs - 1)) + 1).cast("int"), F.lit(run))), "")
    part = F.when(n > train_chars, runs).otherwise(F.col("t"))
    rows = rows.groupBy("k", "label").agg(F.min_by(part, F.xxhash64("t")).alias("t")).collect()
    rows.sort(key=lambda r: r["k"])
    return train([r["t"].encode() for r in rows], np.array([float(r["label"]) for r in rows]))


def score(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches):
        tables = net.tables() if net else None
        for b in batches:
            s = [net.score(np.frombuffer((t.as_py() or "").encode(), np.uint8), tables) if net else 0.5 for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_net(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
