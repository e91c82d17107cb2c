"""A byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte is a
learned vector; learned filters slide over the bytes of a chunk, and the largest response
of each filter in the chunk is kept (max-pooling). The largest and the mean of these over
the chunks are combined by a logistic layer into one probability. All parameters are trained
here, from labelled rows outside the held-out fold, on a bounded sample of them
(``SAMPLE`` rows of each class, texts of at most ``SAMPLE_BYTES`` bytes; scoring takes every
text whole). Only the text enters a score.

Defined cases: null and empty texts are one chunk of padding and get a score like any other;
a null doc_id counts as held out; doc_ids with contradicting labels teach nothing; with no
labels, or of one class only, the score is the smoothed share of class 1; rows that repeat a
doc_id are each scored; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import common, text

SAMPLE, SAMPLE_BYTES, EPOCHS = 2000, 32768, 8
#: Steps of training at least, so that a small sample is gone through more often.
LEAST_STEPS = 600
CHUNK, OVERLAP = 512, 64
STEP = CHUNK - OVERLAP
DIM, FILTERS, WIDTH, STRIDE = 8, 32, 8, 4
THRESHOLD = 0.3
_SLAB = 128


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (rows of bytes, padded with 0) and for each text its first chunk (one more at the end)."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-(size - OVERLAP) // STEP))
    first = np.append(0, np.cumsum(count))
    rows = np.zeros((int(first[-1]) + 1, STEP), dtype=np.uint8)
    flat = rows.reshape(-1)
    tails = []
    for o, n, r, c in zip(offsets[:-1].tolist(), size.tolist(), first[:-1].tolist(), count.tolist()):
        body = min(n, c * STEP)
        flat[r * STEP : r * STEP + body] = data[o : o + body]
        tails.append((r + c - 1, o + body, n - body))
    out = np.zeros((len(rows) - 1, CHUNK), dtype=np.uint8)
    out[:, :STEP] = rows[:-1]
    out[:, STEP:] = rows[1:, :OVERLAP]
    for r, o, n in tails:  # a text's last chunk ends with the text, not with the next one
        out[r, STEP:] = 0
        if n > 0:
            out[r, STEP : STEP + n] = data[o : o + n]
    return out, first


class Model:
    """Parameters: byte vectors, filters over two strides, filter bias, logistic weights, bias."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "w": r.normal(0, 1 / np.sqrt(WIDTH * DIM), (2, STRIDE * DIM, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, dtype=np.float32),
            "v": np.zeros(2 * FILTERS, dtype=np.float32),
            "c": np.zeros(1, dtype=np.float32),
        }

    def respond(self, x: np.ndarray, where: bool = False):
        """Max-pooled responses of chunks (and the places of the maxima)."""
        p = self.p
        both = np.concatenate([p["w"][0], p["w"][1]], axis=1)
        top = np.empty((len(x), FILTERS), dtype=np.float32)
        at = np.empty((len(x), FILTERS), dtype=np.int64) if where else None
        for i in range(0, len(x), _SLAB):
            e = np.take(p["emb"], x[i : i + _SLAB], axis=0).reshape(-1, STRIDE * DIM)
            z = (e @ both).reshape(-1, CHUNK // STRIDE, 2 * FILTERS)
            z = z[:, :-1, :FILTERS] + z[:, 1:, FILTERS:]
            if where:
                at[i : i + _SLAB] = z.argmax(axis=1)
            top[i : i + _SLAB] = z.max(axis=1)
        top = np.maximum(top + p["b"], 0)
        return (top, at) if where else top

    def combine(self, top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.maximum.reduceat(top, first[:-1], axis=0)
        mean = np.add.reduceat(top, first[:-1], axis=0) / np.diff(first)[:, None]
        f = np.concatenate([most, mean], axis=1).astype(np.float64)
        return f, 1 / (1 + np.exp(-np.clip(f @ self.p["v"].astype(np.float64) + float(self.p["c"][0]), -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        x, first = chunks(data, offsets)
        return self.combine(self.respond(x), first)[1]

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01, seed: int = 11) -> Model:
        r = np.random.default_rng(seed)
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(texts)))
        share = float((labels * weights).sum() / weights.sum())
        self.p["c"][0] = np.log(share / (1 - share))
        self.p["v"] = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        m = {k: np.zeros_like(a) for k, a in self.p.items()}
        s = {k: np.zeros_like(a) for k, a in self.p.items()}
        t, steps = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                ids = order[i : i + batch]
                some = [texts[j] for j in ids]
                offsets = np.append(0, np.cumsum([len(x) for x in some]))
                x, first = chunks(np.frombuffer(b"".join(some), np.uint8), offsets)
                top, at = self.respond(x, where=True)
                f, y = self.combine(top, first)
                g = ((y - labels[ids]) * weights[ids] / len(ids)).astype(np.float32)
                grad = {"v": (f.T @ g).astype(np.float32) + 1e-4 * self.p["v"], "c": g.sum(keepdims=True)}
                # Back to the chunks: the mean reaches all of a text's chunks, the maximum its first best one.
                doc = np.repeat(np.arange(len(ids)), np.diff(first))
                n = np.diff(first).astype(np.float32)
                d = (g / n)[doc][:, None] * self.p["v"][FILTERS:]
                best = top == f[:, :FILTERS].astype(np.float32)[doc]
                d = d + best * (g[doc][:, None] * self.p["v"][:FILTERS])
                d = d * (top > 0)
                grad["b"] = d.sum(axis=0)
                c = np.arange(len(x))[:, None, None]
                window = x[c, (at * STRIDE)[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
                e = self.p["emb"][window].reshape(len(x), FILTERS, WIDTH * DIM)
                w = np.concatenate([self.p["w"][0], self.p["w"][1]], axis=0)  # byte and dimension, filter
                grad["w"] = np.einsum("cf,cfk->kf", d, e, optimize=True).reshape(2, STRIDE * DIM, FILTERS)
                back = (d[:, :, None] * w.T[None]).reshape(-1, DIM)
                flat = window.reshape(-1)
                grad["emb"] = np.stack([np.bincount(flat, back[:, k], 256) for k in range(DIM)], axis=1).astype(np.float32)
                t += 1
                lr = rate * (1 - 0.9 * t / steps)
                for k, a in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * a
                    s[k] = 0.99 * s[k] + 0.01 * a * a
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """From labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    known = common.stored(known.select("doc_id", F.col("q").cast("int").alias("q")), "labels")
    total = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}
    model = Model()
    if len(total) < 2:
        share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
        model.p["c"][0] = np.log(share / (1 - share))
        return model
    mark = F.xxhash64("doc_id", F.lit("sample"))
    picked = [known.where(F.col("q") == q).orderBy(mark, "doc_id").limit(sample) for q in (0, 1)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    # Two bounded lists of ids are broadcast; a doc_id that rows repeat counts once.
    rows = own.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").collect()
    rows = sorted({(r["doc_id"]): (r["q"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))}.items())
    y = np.array([q for _, (q, _) in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        model.p["c"][0] = np.log(share / (1 - share))
        return model
    weight = np.where(y == 1, total[1] / (y == 1).sum(), total[0] / (y == 0).sum())
    return model.fit([t.encode() for _, (_, t) in rows], y, weight / weight.mean(), epochs)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with a column of their scores, in place of any column of that name."""
    common.ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.p)  # some tens of kB

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text.let_go()
        own = Model()
        own.p = sent.value
        for t in texts:
            yield pa.array(own.score(*text.raw(t)), pa.float64())

    return docs.withColumn(name, score(F.col("text")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
