"""Quality: a generalised additive model with pairwise interactions.

Each feature has a lookup table over quantile bins. Boosting goes round the features in turn; every
step fits a tree of a few leaves to the logistic gradient over the bins of one feature and adds it to
the table. Then the pairs of features whose best four-quadrant cut gains most get tables of their
own over coarse bins, boosted in turn likewise. A score is a sum of table entries.

Features are computed by all tasks; the tables are fitted on a bounded sample of labelled documents
(max_rows rows of NAMES numbers, a few MB) and broadcast (bounded by features and bins).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.llm import wordscan
from octetlake.llm.common import held_out, labelled_texts

NAMES = (
    "log_words", "word_length", "upper", "digits", "marks", "exclamations", "bars", "symbols", "lines", "line_length", "distinct_words", "distinct_pairs",
    "stops", "short_words", "long_words", "non_ascii", "top_word",
)
MAX_ROWS, BINS, COARSE, PAIRS = 20_000, 32, 8, 8
_CLASS = np.zeros(256, dtype=np.int64)  # 0: lower-case letters and what is not named
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "|", "#$%&*+<=>@\\^_`{}~[]/", "\n", ".?", " \t\r", ",;:'\"()-"), 1):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = 10
_N = 11


def _classes(off: np.ndarray, data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bytes of each class in rows a..b."""
    out = np.zeros((b - a) * _N, dtype=np.int64)
    lo, hi = int(off[a]), int(off[b])
    for at in range(lo, hi, wordscan.SLICE):
        end = min(hi, at + wordscan.SLICE)
        row = np.repeat(np.arange(b - a), np.diff(np.clip(off[a : b + 1], at, end)))
        out += np.bincount(row * _N + _CLASS[data[at:end]], minlength=len(out))
    return out.reshape(b - a, _N).astype(np.float64)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of different values of each row, times of its most frequent one)."""
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    if not len(r):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
    times, most = np.diff(np.append(new, len(r))), np.zeros(n)
    np.maximum.at(most, r[new], times)
    return np.bincount(r[new], minlength=n).astype(float), most


def features(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text; an empty text has zeros."""
    out = np.zeros((len(off) - 1, len(NAMES)))
    for w in wordscan.words(off, data):
        a, b = w.first, w.last
        n, k, row = b - a, w.counts.astype(float), w.rows
        c = _classes(off, data, a, b)
        size, words = np.maximum(1, np.diff(off[a : b + 1])), np.maximum(1, k)
        lens = (w.ends - w.starts).astype(float)
        per = lambda x: np.bincount(row, weights=x, minlength=n)  # noqa: E731, B023
        kinds, top = _distinct(row, w.hashes, n)
        inside = row[1:] == row[:-1]
        pair_kinds, _ = _distinct(row[1:][inside], (w.hashes[:-1] * np.uint64(3) + w.hashes[1:])[inside], n)
        letters = np.maximum(1, c[:, 0] + c[:, 1])
        out[a:b] = np.stack(
            [
                np.log1p(k), per(lens) / words, c[:, 1] / letters, c[:, 2] / size, c[:, 9] / words, c[:, 3] / words, c[:, 4] / words, c[:, 5] / words, c[:, 6] / words,
                np.log1p(size / (c[:, 6] + 1)), kinds / words, pair_kinds / np.maximum(1, k - 1), c[:, 7] / words, per(lens <= 2) / words, per(lens > 12) / words, c[:, 10] / size, top / words,
            ],
            axis=1,
        ) * (k > 0)[:, None]
    return out


@dataclass
class Model:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, table in self.pairs:
            total += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def _value(g: np.ndarray | float, h: np.ndarray | float):
    return -g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The step for each bin: a tree of some leaves over ordered bins."""
    cuts = [(0, len(g))]
    while len(cuts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(cuts):
            if b - a > 1:
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gt, ht = g[a:b].sum(), h[a:b].sum()
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), (k, a + at + 1))
        if best[1] is None:
            break
        k, at = best[1]
        a, b = cuts[k]
        cuts[k : k + 1] = [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in cuts:
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best cut of a grid into four quadrants."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, c = gc[:-1, :-1], hc[:-1, :-1]
    parts = [(a, c), (gc[:-1, -1:] - a, hc[:-1, -1:] - c), (gc[-1:, :-1] - a, hc[-1:, :-1] - c)]
    parts.append((gc[-1, -1] - sum(p[0] for p in parts), hc[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(p**2 / (q + 1) for p, q in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.empty_like(g)
    for (p, q), where in zip(parts, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        step[where] = _value(p[i, j], q[i, j])
    return float(gain[i, j]), step


def fit_tables(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 30, rate: float = 0.15) -> Model:
    """Cyclic boosting of the tables. One class only, or no rows, gives a constant."""
    mean = (y.sum() + 1) / (len(y) + 2)
    m = Model(bias=float(np.log(mean / (1 - mean))))
    if len(y) < 2 or y.min() == y.max():
        return m
    n_f = x.shape[1]
    cut = lambda f, n: np.unique(np.quantile(x[:, f], np.arange(1, n) / n))
    m.edges, m.coarse = [cut(f, BINS) for f in range(n_f)], [cut(f, COARSE) for f in range(n_f)]
    fine = [np.searchsorted(m.edges[f], x[:, f], side="right") for f in range(n_f)]
    wide = [np.searchsorted(m.coarse[f], x[:, f], side="right") for f in range(n_f)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    total = np.full(len(y), m.bias)

    def moments() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f in range(n_f):
            g, h = moments()
            size = len(m.tables[f])
            step = rate * _tree(np.bincount(fine[f], g, size), np.bincount(fine[f], h, size))
            m.tables[f] += step
            total += step[fine[f]]
    g, h = moments()
    grid = lambda f, k, v: np.bincount(wide[f] * (len(m.coarse[k]) + 1) + wide[k], v, (len(m.coarse[f]) + 1) * (len(m.coarse[k]) + 1)).reshape(len(m.coarse[f]) + 1, -1)
    able = [(f, k) for f, k in combinations(range(n_f), 2) if len(m.coarse[f]) and len(m.coarse[k])]
    gains = sorted(((_quadrants(grid(f, k, g), grid(f, k, h))[0], f, k) for f, k in able), reverse=True)[:PAIRS]
    m.pairs = [(f, k, np.zeros((len(m.coarse[f]) + 1, len(m.coarse[k]) + 1))) for _, f, k in gains]
    for _ in range(pair_rounds):
        for f, k, t in m.pairs:
            g, h = moments()
            step = rate * _quadrants(grid(f, k, g), grid(f, k, h))[1]
            t += step
            total += step[wide[f], wide[k]]
    return m


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def feature_column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in texts:
        x = features(*wordscan.string_buffers(col))
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, seed: int = 7) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out; null ids and labels teach nothing."""
    sample = labelled_texts(docs, labels, label, max_rows, seed).select("doc_id", "y", feature_column("text").alias("x")).toArrow()
    if not len(sample):
        return Model()
    y, x = sample.column("y").to_numpy().astype(float), sample.column("x").combine_chunks().flatten().to_numpy().reshape(len(sample), -1)
    order = np.lexsort([*x.T, y])  # the order in which tasks answer must not matter
    return fit_tables(x[order], (y[order] > 0).astype(float))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The probability of label 1, from the whole text; null and empty texts are scored from zeros."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            yield pa.array(sent.value.score(features(*wordscan.string_buffers(col))))

    return run(F.col(text_col))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold), for every row of docs; a null id is not held out."""
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(docs, fit(docs, labels)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
