"""Tables that several steps of a plan use: made once, and sent to executors only after a count."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word table up to this many rows is sent to all executors; a larger one is joined by a shuffle.
SEND_ROWS = 1_000_000


def _shared_dir(df: DataFrame) -> str:
    """The session's `spark.checkpoint.dir`; without one, a local session takes a temporary folder and a cluster, where
    executors could not see it, fails.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = sc.getConf().get("spark.checkpoint.dir")
        if root is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def made_once(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder as it is and read from there by all that use it."""
    _shared_dir(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As `made_once`, by columns and compressed: for tables as large as the input or larger."""
    path = f"{_shared_dir(df).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(words: DataFrame) -> DataFrame:
    """The rows dealt by word over all shuffle partitions: a few megabytes of words are much work for one task, which adaptive plans would make of them."""
    return words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def sendable(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it has at most SEND_ROWS rows; it is counted, so it should be stored or made once."""
    return F.broadcast(table) if table.count() <= SEND_ROWS else table
