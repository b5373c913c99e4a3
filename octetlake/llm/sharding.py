"""Sharding by a k-d tree: weighted medians along the widest metadata dimension.

A document is a point of metadata that follow from its text (bytes, bytes per character, lines
per byte), so equal texts are one point, and its weight is its size. All nodes of a level are cut at
once: one aggregate finds each node's widest dimension, and weighted medians come from histograms
of 2**BITS bins that are refined around the median until its bin is one point. Only the histograms
of the nodes being cut reach the driver (shards * 2**BITS rows at most, whatever the input); no
level moves the documents. A node of n shards is cut at the share that the shards on either side
should hold, so up to MAX_SHARDS shards will do and sizes stay near equal. Equal texts stay together
unless they weigh more than `whole` of a shard and lie on a cut, which then could not be met to within
that share: their rows part by a hash.

The tree is a nested CASE over the row's own metadata, so placing rows needs no join and no shuffle.
Slots are numbered in many buckets of a shard, with the buckets' offsets from their counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octetlake.llm.common import checkpoint

BITS = 11
WHOLE = 0.01
MAX_SHARDS = 1024  # the placing expression has a branch for each
SLOT_BUCKET = 20_000
DIMS = 3
TOP = 1 << 62


@dataclass
class Node:
    first: int  # the node holds shards first .. first + shards - 1
    shards: int
    dim: int = 0
    cut: int = 0  # points below go left
    part: int = 0  # of the points at cut, rows whose hash is below part go left
    left: "Node | None" = None
    right: "Node | None" = None


def _metadata(text: Column) -> list[Column]:
    size = F.octet_length(text)
    return [
        F.log2(size + 1.0),
        F.when(size > 0, size / F.length(text)).otherwise(F.lit(0.0)),
        F.when(size > 0, (F.regexp_count(text, F.lit("\n")) + 1) / size).otherwise(F.lit(0.0)),
    ]


def _points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __size, __crc, __hash (of the text), __part (of the row) and the raw dimensions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = {f"__d{i}": c for i, c in enumerate(_metadata(text))}
    return docs.withColumns(
        {
            "__size": (F.octet_length(text) + 8).cast("long"),
            "__crc": F.crc32(text.cast("binary")),
            "__hash": F.shiftrightunsigned(F.xxhash64(text), 32),
            "__part": F.shiftrightunsigned(F.xxhash64(F.lit(10), F.col(id_col)), 2),
            **dims,
        }
    )


def _keys(ranges: list[tuple[float, float]]) -> dict[str, Column]:
    """Each dimension as 30 bits of its place in the range of all documents, then the text's hash."""
    out = {}
    for i, (lo, hi) in enumerate(ranges):
        at = (F.col(f"__d{i}") - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(float((1 << 30) - 1))
        out[f"__k{i}"] = F.shiftleft(F.least(F.greatest(at, F.lit(0.0)), F.lit(float((1 << 30) - 1))).cast("long"), 32).bitwiseOR(F.col("__hash"))
    return out


def _place(n: Node, leaf, at=F.col) -> Column:
    """leaf(n) of the leaf that a point falls into; at gives the point's columns."""
    if n.left is None:
        return F.lit(leaf(n))
    k = at(f"__k{n.dim}")
    left = (k < n.cut) | ((k == n.cut) & (at("__part") < n.part)) if n.part else k < n.cut
    return F.when(left, _place(n.left, leaf, at)).otherwise(_place(n.right, leaf, at))


def _of_node(values: list[int]) -> Column:
    """The value for the row's __node."""
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("__node"))


def _cuts(points: DataFrame, key: Column, wanted: dict[int, float], near: float) -> dict[int, tuple[int, int, int, float, float]]:
    """For each node: (cut, least key, greatest key, weight before them, their weight) at the wanted weight.

    points has __node and __weight; key is a bigint from 0 to TOP. Bins are refined until the bin
    that holds the wanted weight is one key or weighs at most near.
    """
    state = {n: (0, TOP, 0.0) for n in wanted}
    done: dict[int, tuple[int, int, int, float, float]] = {}
    p = points.withColumn("__key", key)
    while state:
        some = max(state) + 1
        lo, hi, width = (
            _of_node([int(state[n][i] if i < 2 else max(1, -(-(state[n][1] - state[n][0]) // (1 << BITS)))) if n in state else 0 for n in range(some)]) for i in range(3)
        )
        rows = p.where((F.col("__node") < some) & (F.col("__key") >= lo) & (F.col("__key") < hi))
        bins = rows.groupBy("__node", F.floor((F.col("__key") - lo) / width).cast("long").alias("bin")).agg(
            F.sum("__weight").alias("w"), F.min("__key").alias("least"), F.max("__key").alias("most")
        )
        per: dict[int, list] = {}
        for r in bins.collect():
            per.setdefault(r["__node"], []).append((r["least"], r["most"], float(r["w"])))
        for n, (_, b, before) in list(state.items()):
            for k, (least, most, w) in enumerate(got := sorted(per.get(n, []))):
                if before + w >= wanted[n] or k == len(got) - 1:
                    break
                before += w
            else:
                done[n] = (0, 0, 0, 0.0, 0.0)
                del state[n]
                continue
            if least == most or w <= near:
                done[n] = (least, least, most, before, w)
                del state[n]
            else:
                state[n] = (least, most + 1, before)
    return done


def build_tree(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", whole: float = WHOLE) -> tuple[Node, list[tuple[float, float]]]:
    """The tree for docs and the ranges its keys refer to."""
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"from 1 to {MAX_SHARDS} shards")
    cols = [f"__d{i}" for i in range(DIMS)]
    rows = _points(docs.select(id_col, text_col), id_col, text_col).select(id_col, "__size", "__hash", "__part", *cols)
    rows = checkpoint(rows)
    points = rows.groupBy("__hash", *cols).agg(F.sum("__size").alias("__weight")).withColumn("__part", F.lit(0).cast("long"))
    stats = points.agg(*[f(c) for c in cols for f in (F.min, F.max)], F.sum("__weight")).first()
    ranges = [(stats[2 * i] or 0.0, stats[2 * i + 1] or 0.0) for i in range(DIMS)]
    shard = float(stats[-1] or 0) / shards
    root = Node(0, shards)
    if not shard:
        return root, ranges
    keys = _keys(ranges)
    points = checkpoint(points.withColumns(keys))
    rows = rows.withColumns(keys)
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        number = {id(n): i for i, n in enumerate(level)}
        placed = checkpoint(points.withColumn("__node", _place(root, lambda n: number.get(id(n), -1))).where("__node >= 0"))
        spread = placed.groupBy("__node").agg(F.sum("__weight").alias("w"), *[(F.max(f"__k{i}") - F.min(f"__k{i}")).alias(f"r{i}") for i in range(DIMS)]).collect()
        wanted = {}
        for r in spread:
            n = level[r["__node"]]
            n.dim = max(range(DIMS), key=lambda i: (r[f"r{i}"], -i))
            wanted[r["__node"]] = float(r["w"]) * (n.shards // 2) / n.shards
        key = F.get(F.array(*[F.col(f"__k{i}") for i in range(DIMS)]), _of_node([n.dim for n in level]).cast("int"))
        heavy: dict[int, float] = {}
        for i, (cut, least, most, before, w) in _cuts(placed, key, wanted, shard * 1e-5).items():
            n, over = level[i], wanted[i] - before
            if least == most and w > whole * shard:  # a heavy group of equal texts on the cut
                heavy[i], n.cut = over, cut
            else:
                n.cut = cut if over < w / 2 else most + 1
        if heavy:
            on_cut = F.lit(False)
            for i in heavy:
                on_cut = on_cut | ((F.col("__node") == i) & (F.col(f"__k{level[i].dim}") == level[i].cut))
            node = _place(root, lambda n: number.get(id(n), -1))
            each = checkpoint(checkpoint(rows.withColumn("__node", node)).where(on_cut).withColumn("__weight", F.col("__size")))
            points = checkpoint(points.withColumn("__node", node)).where(~on_cut)  # from now on these texts are points by row
            points = checkpoint(points.drop("__node").unionByName(each.select(*points.drop("__node").columns)))
            for i, (cut, _, most, before, w) in _cuts(each, F.col("__part"), heavy, 0).items():
                level[i].part = cut if heavy[i] - before < w / 2 else most + 1
        for n in level:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
        level = [c for n in level for c in (n.left, n.right)]
    return root, ranges


def with_slots(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """rows with slot: 0, 1, ... within each shard, in many buckets so that no shard is one task. Rows equal in order are interchangeable."""
    total = rows.count()
    buckets = max(8, -(-total // (shards * SLOT_BUCKET)))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy("shard", "__bucket").count()
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__off"))
    if shards * buckets <= 100_000:
        counts = F.broadcast(counts)
    rank = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(*order))
    rows = rows.withColumn("__rank", rank).join(counts, (F.col("shard") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return rows.withColumn("slot", (F.col("__off") + F.col("__rank") - 1).cast("long")).drop("__bucket", "__rank", "__s", "__b", "__off")


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", whole: float = WHOLE) -> DataFrame:
    """docs with shard_col, an int from 0 to shards - 1 (a column of that name is replaced), __size and __crc.

    Null and empty texts weigh 8 bytes and are one point. Rows of equal texts go to one shard unless
    they outweigh `whole` of a shard and lie on a cut: with 0 every cut is met as closely as rows allow,
    with infinity equal texts are never parted and sizes may differ by as much. An empty table stays empty.
    """
    root, ranges = build_tree(docs, shards, id_col, text_col, whole)
    keys = _keys(ranges)
    point = F.struct("__part", *[c.alias(k) for k, c in keys.items()])
    # a lambda over one element binds the point, which the nested CASE would else repeat at every node
    placed = F.transform(F.array(point), lambda p: _place(root, lambda n: n.first, lambda c: p[c]))[0]
    rows = _points(docs, id_col, text_col).withColumn(shard_col, placed.cast("int"))
    return rows.select(*[c for c in docs.columns if c != shard_col], shard_col, "__size", "__crc")


def report(docs: DataFrame, shards: int = 24, whole: float = WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), for every row of docs; a null text has size 8 and CRC 0."""
    rows = assign_shards(docs.select("doc_id", "text"), shards, whole=whole)
    rows = checkpoint(rows.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "shard"))
    rows = with_slots(rows, ["doc_id", "text_crc32", "size"], shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The documents with shard and slot (columns of these names are replaced). Null ids and texts are rows like any other."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])  # so that no name clashes with those used here
    at = {c: f"c{i}" for i, c in enumerate(keep)}
    rows = assign_shards(plain, shards, at["doc_id"], at["text"]).withColumnRenamed("__crc", "__c")
    out = with_slots(rows, [at["doc_id"], "__c", "__size"], shards)
    return out.select(*[F.col(at[c]).alias(c) for c in keep], "shard", "slot")
