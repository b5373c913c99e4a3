"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A bounded sample gives principal axes and, from several random starts, rotations that iterative
quantisation turns until the signs of the rotated vectors lose least (balanced binary codes). The
code is cut into substrings of about log2(distinct vectors) bits, one hash table each: two vectors meet
if their codes agree on a substring. Longer substrings agree more rarely, so the number of tables
follows from the recall: pairs at exactly the threshold are planted in the sample, and tables are added
(TABLES at least) until RECALL of them meet; if MAX_TABLES are not enough, substrings get shorter and
buckets larger. Every meeting is reranked with the original vectors in double precision.

Equal vectors are one row (with their number) from the start. A bucket is compared block by block,
and only per-vector counts and a spanning star of its links leave it, never its pairs; a pair that
meets in several tables is counted in the first. Buckets over `cap` vectors are salted into
blocks, and each pair of blocks is a group of its own, so a task's memory is bounded by the cap. No
candidate is dropped. Buckets of one vector are dropped before any vector is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.llm.common import checkpoint, positive
from octetlake.llm.common import threshold as threshold_of
from octetlake.llm.components import connected_components

TABLES = 36
MAX_TABLES = 256
RECALL = 0.95  # of pairs at the threshold itself; closer pairs meet more often
PLANTED = 2_000
FIT_ROWS = 5_000
MAX_AXES = 256


@dataclass(frozen=True)
class Quantiser:
    """Column j of matrix gives bit j of the code: the sign of (x / |x| - mean) . column."""

    mean: np.ndarray
    matrix: np.ndarray
    bits: int  # of a table

    @property
    def tables(self) -> int:
        return self.matrix.shape[1] // self.bits

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The key of each vector (rows) in each table (columns)."""
        out = np.empty((len(unit), self.tables), dtype=np.int64)
        for at in range(0, len(unit), 1024):
            code = ((unit[at : at + 1024] - self.mean) @ self.matrix > 0).reshape(-1, self.tables, self.bits)
            out[at : at + 1024] = code @ (1 << np.arange(self.bits, dtype=np.int64))
        return out


def _planted(sample: np.ndarray, dim: int, threshold: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two sets of pairs at cosine threshold: sample vectors turned in any direction, and towards other sample vectors."""
    rng, out = np.random.default_rng(seed), []
    if not len(sample):
        sample = rng.standard_normal((PLANTED, dim))
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    for other in (rng.standard_normal((PLANTED, dim)), sample[rng.integers(len(sample), size=PLANTED)]):
        x = sample[rng.integers(len(sample), size=PLANTED)]
        side = other - (other * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(side, axis=1)
        ok = length > 1e-6  # else the other is x itself, or there is no other direction
        if ok.any():
            x, side = x[ok], side[ok] / length[ok, None]
            out.append((x, threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * side))
    return out


def fit_itq(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 3, threshold: float = 0.9) -> Quantiser:
    """Principal axes of unit vectors and as many quantising rotations of them as the recall needs; bits may become fewer."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, :MAX_AXES]
    flat, parts = centred @ axes, []
    pairs = [((x - mean) @ axes, (y - mean) @ axes) for x, y in _planted(sample, dim, threshold, seed)]
    same = []  # of each rotation: in which bits the vectors of each pair agree
    while True:
        met, tables = [np.zeros(len(x), dtype=bool) for x, _ in pairs], 0
        while tables < TABLES or (tables < MAX_TABLES and min((m.mean() for m in met), default=1.0) < RECALL):
            while sum(p.shape[1] for p in parts) < bits * (tables + 1):
                turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
                for _ in range(rounds if len(sample) else 0):
                    u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
                    turn = (u @ v).T
                parts.append(axes @ turn)
                same.append([(x @ turn > 0) == (y @ turn > 0) for x, y in pairs])
            width = axes.shape[1]
            place = range(bits * tables, bits * (tables + 1))
            for k, m in enumerate(met):
                m |= np.all([same[j // width][k][:, j % width] for j in place], axis=0)
            tables += 1
        if bits == 1 or min((m.mean() for m in met), default=1.0) >= RECALL:
            return Quantiser(mean, np.concatenate(parts, axis=1)[:, : bits * tables], bits)
        bits -= 1


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of an Arrow column of equally long lists."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bucket_links(threshold: float):
    """For one group (a bucket, or two blocks of a large one): (id, links, root) of each vector that links."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, n, salt = ids[order], t.column("n").to_numpy()[order], t.column("salt").to_numpy()[order]
        unit = _matrix(t.column("vector"))[order]
        keys = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(len(ids), -1)[order]
        table, cross = t.column("table")[0].as_py(), t.column("a")[0].as_py() != t.column("b")[0].as_py()
        links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for at in range(0, len(ids), 512):
            near = unit[at : at + 512] @ unit.T >= threshold
            i, j = np.nonzero(near)
            i = i + at
            ok = (i < j) & (not cross or salt[i] != salt[j])
            i, j = i[ok], j[ok]
            for a in range(0, len(i), 1 << 16):
                p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                first = ~(keys[p, :table] == keys[q, :table]).any(axis=1)
                np.add.at(links, p[first], n[q[first]])
                np.add.at(links, q[first], n[p[first]])
            if len(i):  # a star from the least member is enough for the components
                label = _join(label, i, j)
        live = (links > 0) | (label != np.arange(len(ids)))
        live[label[live]] = True
        return pa.table({"id": ids[live], "links": links[live], "root": ids[label[live]]})

    return run


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each element's least member so far) after joining i with j."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        new = label.copy()
        low = np.minimum(a, b)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        label = new[label]


def _valid(v) -> F.Column:
    x = F.transform(v, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(x, lambda e: F.coalesce(e != 0, F.lit(False))), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", cap: int = 2048, bits: int | None = None) -> DataFrame:
    """One row per row of vectors: (vec_id, n_links, component_id).

    n_links counts the other rows at cosine >= threshold; component_id is the smallest id links
    reach. Vectors that are null, empty or zero, or hold nulls, NaN or infinities link with nothing;
    the others link with vectors of their own length. A null id keeps its row and is no component's id while
    another member has one. Repeated ids and rows count as rows of their own. bits of a table follow
    from the number of vectors unless given.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("dim", F.when(_valid(F.col("vector")), F.size("vector")).otherwise(0))
    out = rows.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for r in rows.where("dim > 0").select("dim").distinct().orderBy("dim").collect():
        out = out.unionByName(_linked(rows.where(F.col("dim") == r["dim"]), r["dim"], threshold, cap, bits))
    return out


def _linked(rows: DataFrame, dim: int, threshold: float, cap: int, bits: int | None) -> DataFrame:
    """near_duplicates of rows (vec_id, vector), all of one length."""
    spark = rows.sparkSession
    distinct = rows.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = checkpoint(distinct.withColumn("id", F.monotonically_increasing_id()))
    count = distinct.count()
    if bits is None and count <= cap:  # one block: all are compared
        quantiser = Quantiser(np.zeros(dim), np.zeros((dim, 1)), 1)
    else:
        bits = bits or min(30, max(8, round(math.log2(count)) + 1))
        sample = distinct.where(positive(F.xxhash64("vector")) < threshold_of(min(1.0, FIT_ROWS / count))).select("vector").limit(2 * FIT_ROWS).toArrow()
        quantiser = fit_itq(_matrix(sample.column("vector")) if len(sample) else np.zeros((0, dim)), bits, threshold=threshold)
    sent = spark.sparkContext.broadcast(quantiser)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys_of(col: pa.Array) -> pa.Array:
        if len(col) == 0:
            return pa.array([], pa.list_(pa.int64()))
        k = sent.value.keys(_matrix(col))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.ravel()))

    coded = checkpoint(distinct.select("id", "n", "vector", keys_of("vector").alias("keys")))
    slots = coded.select("id", F.posexplode("keys").alias("table", "key"))
    sizes = slots.groupBy("table", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / cap).cast("int"))
    # an expression instead of the bare key: both sides get an exchange, so a hot bucket's rows can be split
    sizes = sizes.select(F.col("table").alias("t2"), F.col("key").bitwiseXOR(F.lit(0).cast("long")).alias("k2"), "blocks")
    live = slots.join(sizes, (slots["table"] == sizes["t2"]) & (slots["key"] == sizes["k2"])).select("id", "table", "key", "blocks")
    salted = live.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(
        "id", "table", "key", "salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    groups = salted.select("id", "table", "key", "salt", F.least("salt", "other").alias("a"), F.greatest("salt", "other").alias("b")).join(coded, "id")
    found = checkpoint(groups.groupBy("table", "key", "a", "b").applyInArrow(_bucket_links(threshold), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("id"), F.col("root").alias("top"))
    named = distinct.join(links, "id", "left").join(roots, "id", "left").withColumn("top", F.coalesce("top", "id"))
    least = named.groupBy("top").agg(F.min("least").alias("component_id"))
    named = checkpoint(named.join(least, "top").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    return rows.join(named, "vector").select("vec_id", "n_links", "component_id")


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return near_duplicates(vectors).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
