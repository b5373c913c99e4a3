"""Language identification by hierarchical discrimination.

A text is the square roots of its hashed byte trigrams (words lower-cased in ASCII, everything
between words one space), scaled to length 1. The language family is predicted first, by linear
support vector machines of each family against the rest; within the family, one machine for each pair
of its languages votes. Families come from a table of language codes; a code it lacks is a family of
its own.

The sample to fit on is bounded (max_rows documents of DIMS numbers) and broadcast; each machine is
fitted in a task of its own, and only weights come back. They are broadcast too (bounded by languages
and DIMS); scoring is spread over all tasks.
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
from octetlake.llm.common import held_out, positive, threshold

DIMS, MAX_ROWS, MAX_LANGUAGES, LEAST = 2048, 4_000, 200, 16
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "la"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"


def vectors(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, float32 vectors) of slices of the texts."""
    for a, b in wordscan.row_slices(off):
        out = np.zeros((b - a) * DIMS)
        lo, hi = int(off[a]), int(off[b])
        for at in range(lo, hi, wordscan.SLICE):
            end = min(hi, at + wordscan.SLICE + 2)  # trigrams that begin in this part
            low = wordscan.LOWER[data[at:end]]
            low = np.where(wordscan.IS_WORD[low], low, 32).astype(np.uint32)
            if len(low) < 3:
                continue
            row = np.repeat(np.arange(b - a), np.diff(np.clip(off[a : b + 1], at, end)))
            code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
            ok = (row[:-2] == row[2:]) & ((low[1:-1] != 32) | ((low[:-2] != 32) & (low[2:] != 32)))
            slot = ((code * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
            out += np.bincount((row[:-2] * DIMS + slot)[ok], minlength=len(out))
        x = np.sqrt(out.reshape(b - a, DIMS)).astype(np.float32)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield a, b, x / np.maximum(norm, 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights, the bias last, of a linear machine with squared hinge loss; y is -1 or 1. Accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)  # either side counts alike
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):  # the largest curvature
        v = x.T @ (weight * (x @ v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1.0 / (1.0 / (c * 100) + 2.2 * top)
    w, ahead, t = np.zeros_like(v), np.zeros_like(v), 1.0
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead / (c * 100) - 2 * (x.T @ (weight * y * slack)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if k % 10 == 9 and np.linalg.norm(new - w) < 1e-3 * np.linalg.norm(new):
            return new
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


@dataclass
class Model:
    families: list[list[str]] = field(default_factory=list)  # the languages of each
    family_weights: np.ndarray | None = None  # a column for each family
    duels: dict[tuple[int, int, int], np.ndarray] = field(default_factory=dict)  # (family, i, j): weights, positive for i

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        sure = lambda m: 1 / (1 + np.exp(-3 * m))
        one = np.hstack([x, np.ones((n, 1), dtype=np.float32)])
        if len(self.families) > 1:
            m = one @ self.family_weights
            fam = m.argmax(axis=1)
            score = sure(m[np.arange(n), fam])
        else:
            fam, score = np.zeros(n, dtype=int), np.ones(n)
        lang = np.empty(n, dtype=object)
        for f, codes in enumerate(self.families):
            rows = np.flatnonzero(fam == f)
            votes, margin = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
            for i, j in combinations(range(len(codes)), 2):
                m = one[rows] @ self.duels[f, i, j]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                margin[:, i] += m
                margin[:, j] -= m
            best = (votes + 1e-3 * np.tanh(margin)).argmax(axis=1)
            lang[rows] = np.array(codes, dtype=object)[best]
            if len(codes) > 1:
                score[rows] *= sure(margin[np.arange(len(rows)), best] / (len(codes) - 1))
        return lang.tolist(), np.clip(score, 0, 1)


@F.arrow_udf(T.BinaryType())
def _vector_bytes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in texts:
        out: list[bytes] = []
        for _, _, x in vectors(*wordscan.string_buffers(col)):
            out += [v.tobytes() for v in x]
        yield pa.array(out, pa.binary())


def _sample(docs: DataFrame, lang_col: str, max_rows: int, max_languages: int, seed: int) -> DataFrame:
    """(lang, h, text) of the rows to learn from, h being the hash by which they were chosen."""
    h = positive(F.xxhash64(F.lit(seed), "doc_id", "text"))
    rows = docs.select("doc_id", "text", F.col(lang_col).alias("lang")).where("doc_id is not null and text is not null and lang is not null").where(~held_out("doc_id"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    each = max(LEAST, max_rows / max(1, len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], threshold(min(1.0, each / r["count"]))) for r in counts], "lang string, share long")
    rows = rows.withColumn("h", h).join(F.broadcast(shares), "lang").where("h < share or share = 9223372036854775807")
    return rows.groupBy("lang", "h").agg(F.min("text").alias("text"))  # a row that repeats teaches once, so a hot one cannot break the bound


def fit(docs: DataFrame, lang_col: str = "lang", max_rows: int = MAX_ROWS, max_languages: int = MAX_LANGUAGES, seed: int = 9) -> Model:
    """Fit on texts and languages of a bounded sample of the documents that are not held out.

    Every language gets an equal part of max_rows (all its rows if fewer, LEAST where languages are
    many), chosen by a hash of id and text. Only the max_languages most frequent values are learnt.
    Null ids, texts and languages teach nothing. Without rows every text is 'und'.
    """
    spark = docs.sparkSession
    got = _sample(docs, lang_col, max_rows, max_languages, seed).select("h", "lang", _vector_bytes("text").alias("x")).toArrow()
    if not len(got):
        return Model()
    rows = sorted(zip(got.column("h").to_pylist(), got.column("lang").to_pylist(), range(len(got)), strict=True))
    lang = np.array([code for _, code, _ in rows], dtype=object)
    x = np.stack([np.frombuffer(got.column("x")[k].as_py(), dtype=np.float32) for _, _, k in rows])
    by: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        by.setdefault(FAMILY.get(code, code), []).append(code)
    m = Model([by[k] for k in sorted(by)])
    every = [code for codes in m.families for code in codes]
    duels = [(f, i, j) for f, codes in enumerate(m.families) for i, j in combinations(range(len(codes)), 2)]
    # a machine: (the languages it says 1 for, all languages it learns from)
    machines = [(codes, every) for codes in m.families] if len(m.families) > 1 else []
    machines += [([m.families[f][i]], [m.families[f][i], m.families[f][j]]) for f, i, j in duels]
    if not machines:
        return m
    sent = spark.sparkContext.broadcast((x, lang, machines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, lang, machines = sent.value
        for b in batches:
            for k in b.column("id").to_pylist():
                for_, of = machines[k]
                r = np.isin(lang, of)
                w = linear_svm(x[r], np.where(np.isin(lang[r], for_), 1, -1))
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([w.tolist()], pa.list_(pa.float32()))], ["k", "w"])

    n = len(machines)
    done = spark.range(0, n, 1, min(n, 1000)).mapInArrow(run, "k long, w array<float>").collect()
    weights = {r["k"]: np.array(r["w"], dtype=np.float32) for r in done}
    first = n - len(duels)
    if first:
        m.family_weights = np.stack([weights[k] for k in range(first)], axis=1)
    m.duels = {duel: weights[first + k] for k, duel in enumerate(duels)}
    return m


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """struct(lang, score); 'und' and 0 for a null text or one without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            lang: list[str] = []
            score = [np.zeros(0)]
            for _, _, x in vectors(*wordscan.string_buffers(col)):
                got = sent.value.predict(x)
                lang += got[0]
                score.append(got[1])
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score).astype(float))], ["lang", "score"])

    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    return F.when(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)), run(F.col(text_col))).otherwise(nothing)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, for every row of docs; 'und' and 0 for a null text and one without a letter."""
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), predict(docs, fit(docs)).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
