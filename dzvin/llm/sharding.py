"""Contiguous shards of equal bytes, from a global prefix sum of sizes.

Only (id, size, checksum) are shuffled, never texts. The rows are range-partitioned on the id (with
checksum, size and a row number behind it, so that an id that many rows repeat is spread too), the
totals of the partitions, one row each, give every partition its place in the global prefix sum, and
each row goes to the shard in whose equal slice of all bytes its middle lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dzvin.llm.common import cut_lineage, ship

ROW_OVERHEAD = 8


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard (0 to n_shards - 1) and slot, gapless from 0.

    Null text: size is the overhead alone and the checksum that of the empty text. Null ids come first.
    Repeated ids and equal texts may be cut apart: equal bytes go before keeping copies together.
    A row larger than a slice leaves the shards that it covers empty. An empty table gives no rows.
    Other columns of the input are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    order = ["doc_id", "text_crc32", "size", "row_no"]
    placed = cut_lineage(narrow.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    # One row for each partition: bounded by their number.
    totals = {r["part"]: (r["bytes"], r["rows"]) for r in placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    whole = sum(b for b, _ in totals.values())
    before, seen_bytes, seen_rows = {}, 0, 0
    for part in sorted(totals):
        before[part] = (seen_bytes, seen_rows)
        seen_bytes, seen_rows = seen_bytes + totals[part][0], seen_rows + totals[part][1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: tuple[int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(1).to_numpy()
            at, row = done or before[b.column(4)[0].as_py()]
            ends = at + np.cumsum(size)
            # Doubled, so that the middle of a row is an integer.
            middle = (2 * ends - size).tolist()
            shard = np.array([min(m * n_shards // (2 * whole), n_shards - 1) for m in middle], np.int32)
            rows = np.arange(row, row + len(size))
            done = (int(ends[-1]), row + len(size))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(shard), pa.array(rows)], ["doc_id", "size", "text_crc32", "shard", "row"])

    kind = placed.schema["doc_id"].dataType.simpleString()
    out = placed.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, shard int, row long")
    firsts = F.broadcast(out.groupBy("shard").agg(F.min("row").alias("first")))  # n_shards rows
    return out.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows into one folder per shard. Ids must be unique here: rows find their shard by id."""
    shards = assign_shards(docs, n_shards, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"))
    joined = docs.join(shards, docs[id_col].eqNullSafe(shards["__id"])).drop("__id")
    joined.repartitionByRange(joined["__shard"], joined[id_col]).write.partitionBy("__shard").parquet(path)
