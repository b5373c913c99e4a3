"""Carving and recursive extraction.

A generation of blobs is scanned, its hits are matched to extraction rules, each hit's chain of rules is
tried until one decodes, and what comes out is the next generation. Each generation is written to the
shared checkpoint folder; a depth bounds the loop, and it ends when nothing new comes out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.functions import codecs
from octetlake.functions.batches import stepwise
from octetlake.functions.lens import byte_range
from octetlake.operators.scan import rule_matches, scan
from octetlake.plans.shared import checkpoint

#: (expression over the lower-cased description, extension, codec or null to carve only, recurse)
RULES = [
    ("^gzip stream", "gz", "gzip", True),
    ("^zlib stream", "zlib", "zlib", True),
    ("^xz stream", "xz", "xz", True),
    ("^lzma stream", "lzma", "lzma", True),
    ("^lzma stream", "lzma", "lzma_modem", True),
    ("^bzip2 stream", "bz2", "bzip2", True),
    ("^zip member", "zip", None, False),
    ("^tar archive", "tar", None, False),
    ("^squashfs image", "squashfs", None, False),
    ("^cramfs image", "cramfs", None, False),
    ("^jffs2 filesystem", "jffs2", None, False),
    ("^elf object", "elf", None, False),
    ("private key$", "key", None, False),
    ("certificate$", "crt", None, False),
    ("^html document header", "html", None, False),
    ("^xml document", "xml", None, False),
]


def parse_rule(text: str) -> tuple[str, str, str | None, bool]:
    """`regex:extension[:codec[:recurse]]`; a missing extension is empty. The codec is a registered name, never a command."""
    parts = text.split(":")
    codec = parts[2] if len(parts) > 2 and parts[2] else None
    if codec and codec not in codecs.CODECS and codec not in codecs.UNSUPPORTED:
        raise ValueError(f"unknown codec {codec!r}")
    return parts[0].lower(), parts[1] if len(parts) > 1 else "", codec, len(parts) < 4 or parts[3].lower() != "false"


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    rows = [(k, *r) for k, r in enumerate(rules if rules is not None else RULES)]
    return spark.createDataFrame(rows, "priority int, regex string, ext string, codec string, recurse boolean")


def eligible(hits: DataFrame, max_count: int | None = None) -> DataFrame:
    """Displayed hits, the first max_count of each file; a hit without size reaches to the end of its file."""
    hits = hits.where("display") if "display" in hits.columns else hits
    if max_count is not None:
        w = Window.partitionBy("file_id").orderBy("offset")
        hits = hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_count).drop("k")
    return hits


def carve(hits: DataFrame, blobs: DataFrame, max_size: int | None = None) -> DataFrame:
    """(parent_id, offset, size, name, ext, content): the bytes of each hit; names are HEX.ext, unique by offset within a file."""
    j = hits.join(blobs.select("file_id", "content"), "file_id")
    size = F.coalesce("size", F.octet_length("content") - F.col("offset"))
    if max_size is not None:
        size = F.least(size, F.lit(max_size))
    rows = j.withColumn("size", size.cast("long"))
    name = F.concat(F.hex("offset"), F.when(F.col("ext") != "", F.concat(F.lit("."), F.col("ext"))).otherwise(""))
    data = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    return rows.select(F.col("file_id").alias("parent_id"), "offset", "size", name.alias("name"), "ext", data.alias("content"))


def chains(matched: DataFrame) -> DataFrame:
    """(file_id, offset, size, chain): the rules of each hit in order; a chain is bounded by the number of rules."""
    chain = F.array_sort(F.collect_list(F.struct("priority", "ext", "codec", "recurse")))
    return matched.groupBy("file_id", "offset").agg(F.min("size").alias("size"), chain.alias("chain"))


_OUTCOME = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("data", T.BinaryType())])


def _attempts(limit: int):
    def outcome(names: list[str | None], v: bytes) -> dict:
        spare = {"k": 0, "status": "failed", "data": None}
        for k, name in enumerate(names):
            if name is None:
                return {"k": k, "status": "carved", "data": None}
            if name in codecs.UNSUPPORTED:
                return {"k": k, "status": "unsupported", "data": None}
            r = codecs.CODECS[name](v, limit)
            if r["ok"] or r["over"]:
                return {"k": k, "status": "extracted" if r["ok"] else "over", "data": r["data"]}
            if r["truncated"] and r["data"] and spare["status"] == "failed":
                spare = {"k": k, "status": "truncated", "data": r["data"]}
        return spare

    @stepwise(_OUTCOME)
    def run(names: pa.Array, content: pa.Array) -> pa.Array:
        rows = [outcome(n.as_py() or [], v.as_py() or b"") for n, v in zip(names, content, strict=True)]
        return pa.array(rows, pa.struct([("k", pa.int32()), ("status", pa.string()), ("data", pa.binary())]))

    return run


def first_success(chained: DataFrame, blobs: DataFrame, max_size: int | None = None, limit: int = codecs.LIMIT) -> DataFrame:
    """Of each hit's rules, in order, the first that decodes; a rule without codec ends the chain by carving.

    status: extracted, over (what it inflates to passes limit; content is the first limit bytes, codecs.parts
    gives all), carved, unsupported, truncated (nothing decodes but a stream that breaks off) or failed. A hit
    is carved once, and rules behind the one that ends its chain are not tried.
    """
    j = chained.join(blobs.select("file_id", "content"), "file_id")
    size = F.coalesce("size", F.octet_length("content") - F.col("offset"))
    size = F.least(size, F.lit(max_size)) if max_size is not None else size
    data = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), size.cast("int"))
    j = j.select("file_id", "offset", size.cast("long").alias("size"), "chain", data.alias("carved"))
    j = j.withColumn("o", _attempts(limit)(F.transform("chain", lambda c: c["codec"]), F.col("carved")))
    rule = F.get(F.col("chain"), F.col("o.k"))
    name = F.concat(F.hex("offset"), F.when(rule["ext"] != "", F.concat(F.lit("."), rule["ext"])).otherwise(""))
    return j.select(
        F.col("file_id").alias("parent_id"), "offset", "size", name.alias("name"), rule["ext"].alias("ext"), F.col("o.status").alias("status"), rule["recurse"].alias("recurse"), F.coalesce("o.data", "carved").alias("content")
    )


def extract(blobs: DataFrame, rules=None, depth: int = 8, max_size: int | None = None, max_count: int | None = None, limit: int = codecs.LIMIT, scan_rules=None) -> DataFrame:
    """All generations: (root_id, parent_id, file_id, generation, path, offset, size, ext, status, content).

    Ids of new blobs are hashes of their parent's id, offset and name. Only what was decoded and may
    recurse is scanned again.
    """
    spark = blobs.sparkSession
    table = rule_table(spark, rules)
    level = blobs.select("file_id", F.col("file_id").alias("root_id"), F.lit("").alias("path"), "content")
    out = None
    for generation in range(1, depth + 1):
        hits = eligible(scan(level.select("file_id", "content"), scan_rules), max_count)
        new = first_success(chains(rule_matches(hits, table)), level, max_size, limit)
        origin = level.select(F.col("file_id").alias("parent_id"), "root_id", F.col("path").alias("up"))
        new = new.join(origin, "parent_id").select(
            "root_id", "parent_id", F.xxhash64("parent_id", "offset", "name").alias("file_id"), F.lit(generation).alias("generation"), F.concat("up", F.lit("/"), "name").alias("path"),
            "offset", "size", "ext", "status", "recurse", "content",
        )
        new = checkpoint(new)
        out = new if out is None else out.unionByName(new)
        level = new.where("status = 'extracted' and recurse").select("file_id", "root_id", "path", "content")
        if level.isEmpty():
            break
    return out.drop("recurse")


def range_of(blobs: DataFrame, offset: int, length: int | None) -> DataFrame:
    return blobs.withColumn("content", byte_range(F.col("content"), offset, length))
