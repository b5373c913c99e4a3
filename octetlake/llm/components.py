"""Connected components of a table of links, by alternating star contractions.

Each round replaces the links by stars around the smallest neighbour (large star, then small star)
until nothing changes; the number of rounds grows with the logarithm of a component's size. Links
and labels stay distributed; each round is checkpointed, and only a count and a checksum reach the
driver. The neighbours of a hub are joined, never gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetlake.llm.common import checkpoint


def _with_least(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the smallest of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    # An expression instead of the bare key: the aggregate's partitioning is then not reused, both sides
    # of the join get an exchange, and adaptive execution can split the rows of a hub.
    least = least.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("k"), "m")
    return links.join(least, links["u"] == least["k"]).select("u", "v", F.least("u", "m").alias("m"))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(row)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link, for links (u, v) of type bigint.

    root is the smallest node that can be reached. Repeated links, links in either direction and
    links of a node with itself (which are ignored) are allowed; nulls are left out; no links give an
    empty table.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v")
    links = checkpoint(links.distinct())
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = checkpoint(small)
        before, state = state, _state(links)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    # every link is now (member, root)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
