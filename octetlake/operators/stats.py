"""Byte statistics: entropy, edges, islands, chi-square, histograms.

A block's 256 counts come from one Arrow function that looks at each blob once; nothing explodes to a
row per byte. What follows (edges, islands, verdicts) are window functions over the blocks of a file.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIGH, LOW, OPEN = 0.95, 0.85, 0.90


def auto_block(size):
    """Block size for a file: a 2048th of it, rounded up to a multiple of 1024, at least 1024."""
    return F.greatest(F.ceil(size / 2048 / 1024).cast("long") * 1024, F.lit(1024).cast("long"))


_BLOCK = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("entropy", T.DoubleType()), T.StructField("chi_square", T.DoubleType()), T.StructField("zlib_ratio", T.DoubleType())])
)


def _counts(b: np.ndarray, size: int) -> np.ndarray:
    k = -(-len(b) // size)
    out = np.zeros((k, 256), dtype=np.int64)
    step = max(1, 65536 // size)  # blocks at once: what is counted stays in the cache, however long the blob
    for at in range(0, k, step):
        part = b[at * size : (at + step) * size]
        rows = -(-len(part) // size)
        place = np.arange(len(part), dtype=np.int64)
        place //= size
        place <<= 8
        place += part
        out[at : at + rows] = np.bincount(place, minlength=rows * 256).reshape(rows, 256)
    return out


@functools.lru_cache(maxsize=8)
def _logs(s: int) -> np.ndarray:
    """c * log2(c) of every count of a block of s bytes."""
    c = np.arange(s + 1)
    return c * np.log2(np.maximum(c, 1))


_SLICE = 1 << 14  # blocks whose counts are held at once


def _measured(v: bytes, s: int, ratio: bool) -> tuple[np.ndarray, ...]:
    """start, n, entropy, chi-square and (with ratio) deflated share of each block of s bytes."""
    whole, parts = np.frombuffer(v, dtype=np.uint8), []
    for at in range(0, len(whole), s * _SLICE):
        b = whole[at : at + s * _SLICE]
        c = _counts(b, s)
        n = c.sum(axis=1)
        logs = (_logs(s)[c] if s <= 1 << 16 else c * np.log2(np.maximum(c, 1))).sum(axis=1)
        entropy = np.where(n > 0, (np.log2(np.maximum(n, 1)) - logs / np.maximum(n, 1)) / 8, 0.0)
        chi = 256.0 * (c * c).sum(axis=1) / np.maximum(n, 1) - n
        z = [min(1.0, len(zlib.compress(b[i * s : (i + 1) * s].tobytes(), 9)) / max(1, int(n[i]))) for i in range(len(n))] if ratio else []
        parts.append((at + np.arange(len(n), dtype=np.int64) * s, n, entropy, chi, np.array(z, dtype=np.float64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * 3)


def _lists(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))


def _stats(ratio: bool):
    @F.arrow_udf(_BLOCK)
    def run(content: pa.Array, size: pa.Array) -> pa.Array:
        rows = [_measured(v.as_py() or b"", s.as_py(), ratio) for v, s in zip(content, size, strict=True)]
        start, n, entropy, chi, z = (pa.array(np.concatenate(x)) for x in zip(*rows, strict=True))
        share = z if ratio else pa.nulls(len(n), pa.float64())
        return pa.ListArray.from_arrays(_lists([len(r[0]) for r in rows]), pa.StructArray.from_arrays([start, n, entropy, chi, share], ["start", "n", "entropy", "chi_square", "zlib_ratio"]))

    return run


def _squares(b: np.ndarray, piece: int) -> np.ndarray:
    """The sum of the squared byte counts of each whole piece; only pieces in which a byte stands twice are counted by byte."""
    rows = b[: len(b) // piece * piece].reshape(-1, piece)
    near = np.sort(rows, axis=1)
    twice = np.flatnonzero((near[:, 1:] == near[:, :-1]).any(axis=1))
    total = np.full(len(rows), piece, dtype=np.int64)
    total[twice] = (_counts(rows[twice].reshape(-1), piece) ** 2).sum(axis=1)
    return total


def _odd_places(piece: int, chi: float):
    """The offsets of the pieces of each value (the last one may be shorter) whose chi-square is at least chi."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(content: pa.Array) -> pa.Array:
        out = []
        for v in content:
            whole, found = np.frombuffer(v.as_py() or b"", dtype=np.uint8), [np.zeros(0, np.int64)]
            for at in range(0, len(whole), piece * _SLICE):
                b = whole[at : at + piece * _SLICE]
                found.append(at + piece * np.flatnonzero(256.0 * _squares(b, piece) / piece - piece >= chi))
                rest = len(b) % piece
                if rest and 256.0 * float((np.bincount(b[-rest:]) ** 2).sum()) / rest - rest >= chi:
                    found.append(np.array([at + len(b) - rest]))
            out.append(np.concatenate(found))
        return pa.ListArray.from_arrays(_lists([len(x) for x in out]), pa.array(np.concatenate(out)))

    return run


def block_stats(blobs: DataFrame, block: int | None = None, ratio: bool = False) -> DataFrame:
    """(file_id, block_id, start, n, entropy, chi_square, zlib_ratio) of each block of (file_id, content).

    entropy is Shannon's, divided by 8, from 0 to 1; zlib_ratio is null unless asked for. Without a
    block size each file takes its own (auto_block). An empty blob has no block.
    """
    size = F.lit(block).cast("long") if block else auto_block(F.octet_length("content"))
    rows = blobs.select("file_id", F.posexplode(_stats(ratio)(F.col("content"), size)).alias("block_id", "b"))
    return rows.select("file_id", "block_id", "b.*")


def edges(blocks: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """(file_id, start, entropy, edge): where entropy rises to high or falls to low, with hysteresis.

    A block at or above high is H, at or below low is L; an edge is an H or L unlike the last H or L.
    """
    if low >= high:
        raise ValueError("low must be below high")
    kind = F.when(F.col("entropy") >= high, "rising").when(F.col("entropy") <= low, "falling")
    w = Window.partitionBy("file_id").orderBy("start")
    named = blocks.select("file_id", "start", "entropy", kind.alias("edge")).where("edge is not null")
    return named.withColumn("before", F.lag("edge").over(w)).where("before is null or before <> edge").drop("before")


def islands(blocks: DataFrame, threshold: float = OPEN, least: int = 4096) -> DataFrame:
    """(file_id, island_start, island_end, n_blocks, top_entropy): runs of blocks at or above threshold of at least `least` bytes."""
    w = Window.partitionBy("file_id").orderBy("start")
    above = F.col("entropy") >= threshold
    marked = blocks.withColumn("above", above).withColumn("turn", (F.col("above") != F.lag("above", 1, False).over(w)).cast("int"))
    runs = marked.withColumn("run", F.sum("turn").over(w)).where("above")
    out = runs.groupBy("file_id", "run").agg(
        F.min("start").alias("island_start"), F.max(F.col("start") + F.col("n")).alias("island_end"), F.count(F.lit(1)).alias("n_blocks"), F.max("entropy").alias("top_entropy")
    )
    return out.where(F.col("island_end") - F.col("island_start") >= least).drop("run")


def verdicts(islands_: DataFrame, blobs: DataFrame, chi: float = 512.0, piece: int = 32, block: int | None = None) -> DataFrame:
    """Each island as 'encrypted' (no 32-byte piece is far from uniform) or 'compressed'.

    Pieces are counted from the island's beginning. If the islands are made of blocks of a known size that is a multiple
    of the piece, they are the pieces of the blob too: those are judged beside the blob, and no content is shuffled.
    """
    if block and block % piece == 0:
        odd_at = blobs.select("file_id", _odd_places(piece, chi)(F.col("content")).alias("odd"))
        joined = islands_.join(odd_at, "file_id")
        odd = F.size(F.filter("odd", lambda at: (at >= F.col("island_start")) & (at < F.col("island_end"))))
    else:
        joined = islands_.join(blobs, "file_id")
        data = F.substring(F.col("content"), (F.col("island_start") + 1).cast("int"), (F.col("island_end") - F.col("island_start")).cast("int"))
        odd = F.size(_odd_places(piece, chi)(data))
    return joined.withColumn("n_odd", odd).select("file_id", "island_start", "island_end", "n_odd", F.when(F.col("n_odd") == 0, "encrypted").otherwise("compressed").alias("verdict"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _histogram(content: pa.Array) -> pa.Array:
    return pa.array([np.bincount(np.frombuffer(v or b"", dtype=np.uint8), minlength=256).tolist() for v in content.to_pylist()], pa.list_(pa.int64()))


def byte_histogram(blobs: DataFrame) -> DataFrame:
    """(byte, n) over all blobs: 256 numbers a blob are exploded and summed, not its bytes."""
    rows = blobs.select(F.posexplode(_histogram("content")).alias("byte", "n")).where("n > 0")
    return rows.groupBy("byte").agg(F.sum("n").alias("n"))


_TRIPLES = 4 << 20  # bytes of blobs whose triples are counted together


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the triples of several blobs at a time, as arrays."""

    def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], ["tuple", "n"])

    keys, held = [], 0
    for batch in batches:
        for v in batch.column(0):
            b = np.frombuffer(v.as_py() or b"", dtype=np.uint8)
            for at in range(0, len(b) // 3 * 3, _TRIPLES // 3 * 3):
                t = b[at : at + _TRIPLES // 3 * 3]
                t = t[: len(t) // 3 * 3].reshape(-1, 3).astype(np.int32)
                keys.append((t[:, 0] << 16) | (t[:, 1] << 8) | t[:, 2])
                held += 3 * len(t)
                if held >= _TRIPLES:
                    yield counted(keys)
                    keys, held = [], 0
    if keys:
        yield counted(keys)


def tuple_counts(blobs: DataFrame, top: int = 25_000) -> DataFrame:
    """(tuple, n): the most frequent byte triples at offsets 0, 3, 6, ...; ties go to the smaller triple."""
    rows = blobs.select("content").mapInArrow(_triples, "tuple long, n long")
    return rows.groupBy("tuple").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tuple").limit(top)
