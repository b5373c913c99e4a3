"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="octetlake-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage. The cluster's spark.checkpoint.dir is used; where it is unset, a local folder if the master is local, else an error."""
    _folder(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df written to that folder as Parquet and read again, in a folder for each value of the columns `by`, if given, so that a
    reader of some values leaves the others out. Unlike a checkpoint, the rows come back with their real size and
    without what the planner knows of the expressions they came from, which in a loop of joins doubles with every step."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}.parquet"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows of a table that may be one small file, dealt over all tasks before each is made a costly blob."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
