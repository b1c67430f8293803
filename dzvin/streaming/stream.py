"""An extension: token classes and marks over a stream of documents.

What needs no neighbour is a projection per document, so it keeps no state and works in append mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dzvin.functions import alphabet as A
from dzvin.functions import text as T


def word_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, key, vowels) of each word of a stream."""
    words = F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(A.WORD), F.lit(0)))
    return docs.select(F.col(id_col).alias("doc_id"), words.alias("word")).select("doc_id", "word", T.lookup_key("word").alias("key"), T.vowel_count("word").alias("vowels"))


def stress_stream(docs: DataFrame, engine, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
    """Write marked texts of each micro-batch as Parquet; a batch that is repeated replaces its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        engine.stress(df, id_col, text_col).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def each_batch(docs: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    def batch(df: DataFrame, number: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
