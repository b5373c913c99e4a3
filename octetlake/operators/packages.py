"""Package operations on file trees (path, content): overlay, removal, exclusion, listing differences, priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetlake.plans.shared import written


def overlay(base: DataFrame, package: DataFrame, key: str = "path") -> DataFrame:
    """The tree after a package is laid over it: a file of the package replaces the base's, new files are added."""
    b, p = base.alias("b"), package.withColumn("__new", F.lit(True)).alias("p")
    j = b.join(p, F.col(f"b.{key}") == F.col(f"p.{key}"), "full")
    cols = [c for c in base.columns if c != key]
    return j.select(F.coalesce(f"p.{key}", f"b.{key}").alias(key), *[F.when(F.col("p.__new"), F.col(f"p.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in cols])


def remove(base: DataFrame, package: DataFrame, key: str = "path") -> DataFrame:
    """The tree without the files that the package names."""
    return base.join(package.select(key).distinct(), key, "left_anti")


def exclude(tree: DataFrame, patterns: list[str], anchored: bool = False, key: str = "path") -> DataFrame:
    """The tree without paths that match a pattern; one that begins with '!' takes paths back in; anchored patterns match from the root."""
    out = F.lit(False)
    for p in patterns:
        back, p = p.startswith("!"), p.removeprefix("!")
        hit = F.col(key).rlike(("^" if anchored else "") + p)
        out = (out & ~hit) if back else (out | hit)
    return tree.where(~out)


def new_entries(after: DataFrame, before: DataFrame) -> DataFrame:
    """Entries of one listing that the other lacks."""
    return after.exceptAll(before)


def by_priority(tree: DataFrame, priorities: DataFrame, default: int = 0, key: str = "path") -> DataFrame:
    """tree with priority (from -32768 to 32767, the default where none is given), sorted from the highest, ties by key."""
    j = tree.join(priorities.select(key, F.col("priority").alias("__p")), key, "left").withColumn("priority", F.coalesce("__p", F.lit(default))).drop("__p")
    return j.orderBy(F.desc("priority"), key)


def tree_paths(nodes: DataFrame, key: str, parent: str, name: str, max_depth: int = 64) -> DataFrame:
    """(key, path, depth) of each node that hangs under a root (a node without parent), level by level. Names are joined by '/';
    nodes of a circle or with a parent that is not there have no path. Each level is one join, written out."""
    nodes = written(nodes.select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(name).cast("string").alias("n")))
    level = written(nodes.where("p is null").select("k", F.col("n").alias("path"), F.lit(0).alias("depth")))
    out = level
    for depth in range(1, max_depth + 1):
        above = level.select(F.col("k").alias("up"), F.col("path").alias("before"))
        level = written(nodes.join(above, F.col("p") == F.col("up")).select("k", F.concat_ws("/", "before", "n").alias("path"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select(F.col("k").alias(key), "path", "depth")


def same_sets(sets: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first_key): the smallest key with the same set (a string); sets meet by a checksum of 16 bits and the whole set."""
    rows = sets.select(key, F.pmod(F.crc32(F.col(value)), F.lit(1 << 16)).alias("bucket"), value)
    first = rows.groupBy("bucket", value).agg(F.min(key).alias("first_key")).select(F.col("bucket").alias("b"), F.col(value).alias("v"), "first_key")
    return rows.join(first, (F.col("bucket") == F.col("b")) & (F.col(value) == F.col("v"))).select(key, "first_key")
