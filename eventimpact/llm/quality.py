"""Quality classifier: supervised subword embeddings (hashed word and character n-gram vectors, averaged, softmax)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, mix, slices, utf8, word_hashes

NGRAMS = (3, 4)
AGAIN = 2


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def features(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, text of every feature): the words, the byte n-grams inside each text, and the word
    pair "the same word again", which is one feature whatever the word is."""
    data = lower(data)
    n = len(off) - 1
    mask = np.uint64(buckets - 1)
    h, counts = word_hashes(data, off)
    ids, docs = [(h & mask).astype(np.int64)], [np.repeat(np.arange(n), counts)]
    again = np.flatnonzero((h[1:] == h[:-1]) & (docs[0][1:] == docs[0][:-1]))
    ids.append(np.full(len(again), int(mix(np.array([AGAIN], np.uint64))[0] & mask)))
    docs.append(docs[0][again])
    owner = np.repeat(np.arange(n), np.diff(off))
    code = data.astype(np.uint64)
    for g in range(2, max(NGRAMS) + 1):
        code = (code[:-1] << np.uint64(8)) | data[g - 1:] if len(code) > 1 else code[:0]
        if g in NGRAMS and len(code):
            inside = owner[:len(code)] == owner[g - 1:]
            k = (mix(code + np.uint64(g << 40)) & mask).astype(np.int64)
            ids.append(k[inside])
            docs.append(owner[:len(code)][inside])
    return np.concatenate(ids), np.concatenate(docs)


@dataclass
class Model:
    """``weight[bucket]``: the bucket's learned vector times the difference of the two softmax rows; since a
    document's vector is the mean of its features' vectors, its log odds are the mean of these plus ``bias``."""
    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        ids, docs = features(data, off, len(self.weight))
        total = np.bincount(docs, self.weight[ids], n)
        logit = total / np.maximum(np.bincount(docs, minlength=n), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, dim: int, epochs: int, rate: float,
        seed: int, batch: int = 16) -> Model:
    """Stochastic gradient descent over (label, bucket ids, shares of the mean) rows, with a falling step size.

    A step moves each vector by its share of the document's mean, so features that many documents have learn
    first and rare words are not learned by heart."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32) / dim
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    if not rows:
        return Model(np.zeros(buckets, np.float32), 0.0)
    done, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            some = [rows[i] for i in order[lo:lo + batch]]
            step = rate * (1 - done / steps)
            done += len(some)
            mean = np.stack([share @ emb[ids] for _, ids, share in some])
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), [r[0] for r in some]] -= 1
            back = p @ out.T
            out -= np.clip(step * mean.T @ p, -1, 1)
            bias -= 0.1 * step * p.mean(0)
            for (_, ids, share), g in zip(some, back):
                emb[ids] -= (step * share)[:, None] * g
    d = (out[:, 1] - out[:, 0]).astype(np.float64)
    return Model((emb @ d).astype(np.float32), float(bias[1] - bias[0]))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", buckets: int = 1 << 17,
          dim: int = 16, epochs: int = 5, rate: float = 2.0, seed: int = 7) -> Model:
    """Fits the classifier on ``labelled`` (a bounded sample; see ``sample_labels``).

    Features are hashed in parallel; the sparse rows of the sample meet in one task that runs the descent, and
    only the model returns to the driver. Rows with a label other than 0 or 1 are left out; an empty text
    teaches the bias alone. No rows at all: every score is 0.5.
    """
    def hashed():
        def f(texts):
            data, off = utf8(texts)
            ids, docs = features(data, off, buckets)
            key, count = np.unique(docs * buckets + ids, return_counts=True)
            row, n = key // buckets, np.bincount(docs, minlength=len(off) - 1)
            cut = np.searchsorted(row, np.arange(len(off)))
            share = (count / np.maximum(n[row], 1)).astype(np.float32)
            ids = (key % buckets).astype(np.int32)
            return [pa.array([ids[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([share[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())]
        return f

    def descend(parts):
        rows = []
        for b in parts:
            for y, i, s in zip(*(c.to_pylist() for c in b.columns)):
                rows.append((y, np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)))
        rows.sort(key=lambda r: (r[0], r[1].tobytes()))      # the same model whatever order the rows came in
        m = fit(rows, buckets, dim, epochs, rate, seed)
        yield pa.RecordBatch.from_arrays([pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.bias], pa.float64())],
                                         names=["weight", "bias"])

    label = F.col(f"`{label_col}`").cast("int")
    rows = labelled.filter(label.isin(0, 1)).select(label.alias("__y"), F.col(f"`{text_col}`").alias("__t"))
    sparse = map_text(rows, "__t", [("ids", "binary"), ("share", "binary")], hashed, ["__y"], 1 << 20)
    got = sparse.repartition(1).mapInArrow(descend, "weight binary, bias double").collect()
    if not got:
        return Model(np.zeros(buckets, np.float32), 0.0)
    return Model(np.frombuffer(bytes(got[0][0]), np.float32), got[0][1])


def sample_labels(docs: DataFrame, labels: DataFrame, most: int = 6000, id_col: str = "doc_id",
                  label_col: str = "quality", text_col: str = "text") -> DataFrame:
    """(text, label) of about ``most`` labelled documents, chosen by a hash of the id: the documented bound of
    the training sample (the label rows that remain, at most some thousands, are broadcast to the scan). A label that
    repeats counts once; an id with contradicting labels teaches nothing."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    agreed = known.groupBy("__id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(
        F.broadcast(agreed.select("__id", "label")), "__id").select("text", "label")


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score",
          keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the probability (0 to 1) of label 1 for every whole text.

    A null, empty or featureless text has the mean of no vectors, zero, and so the score of the bias. Texts of
    any length are hashed in one pass; repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(texts):
            data, off = utf8(texts)
            got = np.zeros(len(off) - 1)
            for i, j in slices(off, 1 << 20):
                got[i:j] = m.score(data[off[i]:off[j]], off[i:j + 1] - off[i])
            return [pa.array(got)]
        return f

    return map_text(docs, text_col, [(out, "double")], make, keep)


