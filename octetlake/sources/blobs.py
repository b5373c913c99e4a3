"""Blob sources: files or table columns as rows of (file_id, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octetlake.functions.lens import as_bytes, byte_range, swap


def name_filter(path: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Regular expressions searched in the file name; what is excluded stays out even if included."""
    ok = F.lit(True)
    if include:
        ok = ok & path.rlike(include)
    if exclude:
        ok = ok & ~path.rlike(exclude)
    return ok


def read_files(spark: SparkSession, path: str, include: str | None = None, exclude: str | None = None, glob: str | None = None) -> DataFrame:
    """Files as rows; the name filters act on the listing, before any content is read. Unreadable files are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).where(name_filter(F.col("path"), include, exclude))
    return files.select(F.xxhash64("path").alias("file_id"), "path", F.col("length").alias("size"), "content")


def text_blobs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A string column as blobs: (file_id, content); a null text is an empty blob."""
    return df.select(F.col(id_col).alias("file_id"), as_bytes(F.coalesce(F.col(text_col), F.lit(""))).alias("content"))


def limited(blobs: DataFrame, offset: int = 0, length: int | None = None, swap_size: int = 0) -> DataFrame:
    """Blobs cut to a range (a negative offset counts from the end), then byte-swapped."""
    content = byte_range(F.col("content"), offset, length)
    return blobs.withColumn("content", swap(content, swap_size) if swap_size else content)


def blocks(blobs: DataFrame, size: int = 1 << 20, peek: int = 8192) -> DataFrame:
    """(file_id, block_id, start, dlen, data): tumbling blocks of `size` bytes, each with `peek` bytes of look-ahead.

    dlen is the part that belongs to the block; data may be longer by what it peeks at. An empty blob
    has no block.
    """
    n = F.octet_length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    # slices are cut beside the blob and then made rows, so that no row carries the whole blob
    part = lambda at: F.struct(at.cast("long").alias("start"), F.least(F.lit(size), n - at).cast("long").alias("dlen"), F.substring(F.col("content"), at + 1, F.lit(size + peek)).alias("data"))
    out = blobs.select("file_id", F.transform(starts, part).alias("parts"))
    return out.select("file_id", F.posexplode("parts").alias("block_id", "p")).select("file_id", "block_id", "p.*")
