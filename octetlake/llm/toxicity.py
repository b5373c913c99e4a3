"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one word between them;
each kind has its own range of the index, so frequent pairs cannot collide with words. FTRL-proximal
keeps per coordinate a gradient sum z and a squared-gradient sum n: the rate falls with n, and a
coordinate with |z| <= l1 has weight 0, so few weights are left to broadcast.

FTRL is a sequential learner, and averaging learners of separate shards was measured to lose a
third of the held-out hits. So the labelled texts are a bounded sample (max_rows ids, chosen by a
hash of the id), gathered by a broadcast of those ids, and one task streams over them in a fixed
order, once a round; only the weights that are not 0 leave it. Everything else, scoring above all,
is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.llm import wordscan
from octetlake.llm.common import checkpoint, held_out, labelled_texts, spare

#: Bits of the index ranges of words, pairs and skip pairs.
BITS = (20, 19, 19)
SIZE = sum(1 << b for b in BITS)
BIAS = SIZE


@dataclass(frozen=True)
class Settings:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    rounds: int = 3
    max_rows: int = 12_000


def _features(w: wordscan.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word, pair and skip pair of a slice, repeats included."""
    h, row = w.hashes, w.rows
    rows, feats, base = [], [], 0
    for bits, gap in zip(BITS, (0, 1, 2), strict=True):
        if gap:
            if len(h) <= gap:
                base += 1 << bits
                continue
            inside = row[gap:] == row[:-gap]
            g = wordscan.mix(h[:-gap] * np.uint64(0x9FB21C651E98DF25 + 2 * gap) + h[gap:])[inside]
            r = row[:-gap][inside]
        else:
            g, r = h, row
        rows.append(r)
        feats.append((g >> np.uint64(64 - bits)).astype(np.int64) + base)
        base += 1 << bits
    return np.concatenate(rows), np.concatenate(feats)


def _texts(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct features)."""
    for w in wordscan.words(off, data):
        row, feat = _features(w)
        order = np.argsort(row, kind="stable")
        row, feat = row[order], feat[order]
        cut = np.searchsorted(row, np.arange(w.last - w.first + 1))
        for k in range(w.last - w.first):
            yield w.first + k, np.unique(feat[cut[k] : cut[k + 1]])


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0.0)
    return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)


def _learn(z: np.ndarray, n: np.ndarray, idx: np.ndarray, y: int, s: Settings) -> None:
    zi, ni = z[idx], n[idx]
    w = _weights(zi, ni, s)
    p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + _bias(z, n, s), -35, 35)))
    g = p - y
    g2 = g * g
    z[idx] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / s.alpha * w
    n[idx] = ni + g2
    wb = _bias(z, n, s)
    z[BIAS] += g - (np.sqrt(n[BIAS] + g2) - np.sqrt(n[BIAS])) / s.alpha * wb
    n[BIAS] += g2


def _bias(z: np.ndarray, n: np.ndarray, s: Settings) -> float:
    """The bias is not shrunk."""
    return -z[BIAS] / ((s.beta + np.sqrt(n[BIAS])) / s.alpha + s.l2)


@dataclass(frozen=True)
class Model:
    """Nonzero weights by coordinate, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings(), seed: int = 2) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out.

    Nulls: ids or labels that are null teach nothing; a null text is an empty one. Without any
    labelled row, or with one class only, the weights are empty and the bias says what is known.
    """
    s = settings
    sample = labelled_texts(docs, labels, label, s.max_rows, seed)
    # bounded, so one partition; written once and in the same order for all rounds and reruns
    sample = checkpoint(sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(seed), F.col("doc_id")), "text").select("text", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
        for b in batches:
            y = b.column("y").to_pylist()
            for k, idx in _texts(*wordscan.string_buffers(b.column("text"))):
                _learn(z, n, idx, y[k], s)
        w = _weights(z[:SIZE], n[:SIZE], s)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BIAS)), pa.array(np.append(w[at], _bias(z, n, s)))], ["i", "w"])

    # one task reads the same partition once a round, one after the other, so that it holds no texts and sends weights only
    rounds = reduce(DataFrame.union, [sample] * s.rounds).coalesce(1)
    got = rounds.mapInArrow(run, "i bigint, w double").toArrow()
    if not len(got):
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    at, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    return Model(at[:-1], w[:-1], float(w[-1]))


def scorer(spark, model: Model):
    """A column function text -> probability. The weights are bounded by the number of coordinates."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        dense = np.zeros(SIZE)
        dense[m.index] = m.weight
        for col in texts:
            off, data = wordscan.string_buffers(col)
            total = np.full(len(off) - 1, m.bias)
            for w in wordscan.words(off, data):
                row, feat = _features(w)
                live = dense[feat] != 0
                pair = np.unique(row[live] * (SIZE + 1) + feat[live])  # each feature counts once a text
                np.add.at(total, w.first + pair // (SIZE + 1), dense[pair % (SIZE + 1)])
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))

    return score


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    return scorer(docs.sparkSession, model)(F.col(text_col))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), for every row of docs; labels are only learnt from."""
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(docs, model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those scored at threshold or above; columns stay as they are. Null and empty texts have the score of the bias."""
    tmp = spare(docs, "__toxicity")
    return docs.withColumn(tmp, score(docs, fit(docs, labels))).where(F.col(tmp) < threshold).select(*docs.columns)
