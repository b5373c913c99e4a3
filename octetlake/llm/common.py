"""Shared pieces of the training-data operators: table access, checkpoints, bounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the 'word' contracts after A-Z were lower-cased (digits, a-z, every non-ASCII character).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A token of the 'size' and SimHash contracts: a run of characters that are no ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, through Spark's own reader, so that any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column | str) -> Column:
    """The shared hold-out rule: crc32 of the id as text, modulo 5, is 0. A null id is never held out, nor learnt from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever the case: name itself, or name with underscores behind."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row; nulls count with their place. Maps, which cannot be hashed, are left out."""
    return F.xxhash64(*[x for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def threshold(share: float) -> int:
    """Of hashes from 0 to 2**63 - 1, about this share is below it; a tiny share is no 0."""
    return min(max(int(share * (1 << 63)), 1), (1 << 63) - 1)


def positive(hash_: Column) -> Column:
    """A 64-bit hash as a number from 0 to 2**63 - 1, to be held against threshold()."""
    return F.shiftrightunsigned(hash_, 1)


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of this machine only where spark.checkpoint.dir is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="octetlake-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: for wide rows, which checkpoint() would store uncompressed."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared checkpoint folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_labels(labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """At most about max_rows labelled ids for fitting: (doc_id, y), without held-out ids.

    Ids are chosen by a hash of the id, so reruns agree; the kept share comes from a count, so the
    result is within a few standard deviations of max_rows whatever the input, and may be broadcast.
    An id with several labels takes the largest; null ids and labels are left out.
    """
    rows = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    count = rows.count()
    return rows if count <= max_rows else rows.where(positive(F.xxhash64(F.lit(seed), F.col("doc_id"))) < threshold(max_rows / count))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """(doc_id, y, text) of a bounded labelled sample: one text for each id, that of the least hash if the id repeats.

    The ids are broadcast (bounded by max_rows), so only sampled texts are shuffled, after the rows of
    one id were folded on the map side: a hot id cannot break the bound.
    """
    ids = bounded_labels(labels, label, max_rows, seed)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
