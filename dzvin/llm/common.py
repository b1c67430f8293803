"""Session helpers and vectorised text views shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that one vectorised step works on; bounds the memory of a Python worker.
STEP_BYTES = 4 << 20
#: An estimate of so many bytes, or Spark's own for a table of unknown size.
HUGE = 1 << 62
#: Words longer than this are hashed one by one.
LONG_WORD = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII signs, which can also part words.
_SIGN = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one if it is local, else an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if root is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoint-"))
    return root or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs no recomputation.

    A checkpoint keeps the plan's estimate of its size, and joins multiply estimates: over rounds of joins of tables with
    themselves the number's digits triple again and again, until they fill the driver's memory. One too large to say anything is dropped.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint()
    plan = kept._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() < HUGE:
        return kept
    jvm, session = spark._jvm, spark._jsparkSession
    none = jvm.scala.Option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), spark)


def stored(df: DataFrame) -> DataFrame:
    """Written as a table in the shared folder and read again; also as compact as the columns allow."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the session did not start in its folder."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; a longer text is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(text))
    size = pyarrow.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if batch.num_rows > at:
        yield batch.slice(at)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words (runs of other bytes than ASCII white space) of a column of texts, as arrays.

    `hash` has a 64-bit hash per word, `doc` its row, `first` the first word of each row (one more
    entry than rows), `start` and `end` its bytes in `data`. Null is an empty text. With `signs` ASCII
    signs part words too.
    """

    def __init__(self, col: pa.Array, lower: bool = True, signs: bool = False):
        if not pa.types.is_string(col.type):
            col = col.cast(pa.string())
        n = len(col)
        col = pa.concat_arrays([col.fill_null("")])
        _, offsets, body = col.buffers()
        at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int32)
        raw = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and n else np.zeros(0, np.uint8)
        at = (at - at[0]).astype(np.int64)
        data = np.zeros(len(raw) + 8, np.uint8)
        data[: len(raw)] = _LOWER[raw] if lower else raw
        self.data, self.n_docs, self.at = data, n, at
        solid = ~(_SPACE | _SIGN if signs else _SPACE)[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        begins, ends = solid.copy(), solid.copy()
        if len(raw):
            begins[1:] &= ~solid[:-1] | edge[1:-1]
            ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        start, size = self.start, self.end - self.start
        lanes = np.ndarray((max(len(self.data) - 7, 0),), dtype="<u8", buffer=self.data.data, strides=(1,))
        h = size.astype(U64) * U64(0x9E3779B97F4A7C15)
        if not len(h):
            return h
        h = mix((lanes[start] & _LANE[np.minimum(size, 8)]) + h)
        left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        k = 8
        while len(left):
            s = start[left] + k
            part = lanes[s] & _LANE[np.minimum(size[left] - k, 8)]
            h[left] = mix(h[left] * U64(0xFF51AFD7ED558CCD) + part)
            k += 8
            left = left[size[left] > k]
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.data[start[i] : self.end[i]].tobytes(), 7)
        return h

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and rows of all runs of n words within a row, in order."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        h = np.zeros(m, U64)
        for k in range(n):
            h = h * U64(0xD6E8FEB86659FD93) + self.hash[k : k + m]
        keep = self.doc[:m] == self.doc[n - 1 : n - 1 + m]
        return mix(h[keep]), self.doc[:m][keep]

    def text(self, row: int) -> bytes:
        return self.data[self.at[row] : self.at[row + 1]].tobytes()
