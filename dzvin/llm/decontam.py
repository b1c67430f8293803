"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is leaked where a document holds at least 0.8 of its distinct five-word shingles. Items are
partitioned by size (powers of two of their shingle counts). An item of n shingles is sketched by its k
smallest shingle hashes, k = n - ceil(0.8 n) + 1 by its own size: whoever lacks all k lacks too many
to qualify, so the sketches lose nothing. Per size partition, documents with too few shingles are passed over;
the others' shingle hashes are looked up in the partition's sketch index, and each candidate is
verified by counting the item's shingles, as bytes, in the document's exact shingle set.

Documents are never shuffled. The benchmark is read in blocks of bounded bytes, each sent to all
executors in turn, so its size may grow.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dzvin.llm.common import U64, Words, ship, steps

WORDS, CONTAINMENT = 5, 0.8
BLOCK_BYTES = 16 << 20
_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_copies", pa.int64()), ("n_shingles", pa.int64()), ("n_found", pa.int64()), ("containment", pa.float64())])


def exact_shingles(text: bytes, width: int) -> set[bytes]:
    w = text.split()
    return {b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)}


class _Partition:
    """The sketches of the items of one width and size class."""

    def __init__(self, width: int, members: list[tuple[int, np.ndarray, int]]):
        self.width = width
        self.least = min(need for _, _, need in members)
        hashes, items = [], []
        for item, h, need in members:
            k = len(h) - need + 1
            hashes.append(h[:k])
            items.append(np.full(k, item))
        h, at = np.concatenate(hashes), np.concatenate(items)
        order = np.argsort(h, kind="stable")
        self.hash, self.item = h[order], at[order]
        self.some = np.zeros(1 << 16, bool)
        self.some[(self.hash >> U64(48)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, doc: np.ndarray, enough: np.ndarray) -> set[tuple[int, int]]:
        maybe = np.flatnonzero(self.some[(h >> U64(48)).astype(np.int64)])
        h, doc = h[maybe], doc[maybe]
        low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        hit = np.flatnonzero((high > low) & enough[doc])
        return {(int(doc[i]), int(self.item[j])) for i in hit for j in range(low[i], high[i])}


class Block:
    """A searchable block of the benchmark: distinct texts with their smallest id and number of copies."""

    def __init__(self, rows: list[tuple[int | None, int, str]], words: int, containment: float):
        self.rows = rows
        texts = Words(pa.array([t for _, _, t in rows], pa.string()))
        self.shingles: list[set[bytes]] = []
        self.need: list[int] = []
        self.width: list[int] = []
        classes: dict[tuple[int, int], list] = defaultdict(list)
        hashes = {m: texts.shingles(m) for m in range(1, words + 1)}
        for i in range(len(rows)):
            width = min(words, int(texts.first[i + 1] - texts.first[i]))
            exact = exact_shingles(texts.text(i), width) if width else set()
            need = math.ceil(containment * len(exact) - 1e-9)
            self.shingles.append(exact)
            self.width.append(width)
            self.need.append(need)
            if width:
                h, doc = hashes[width]
                classes[width, len(exact).bit_length()].append((i, np.unique(h[np.searchsorted(doc, i) : np.searchsorted(doc, i, "right")]), need))
        self.partitions = [_Partition(width, members) for (width, _), members in sorted(classes.items())]

    def search(self, col: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shingles found) of all leaks in a column of texts."""
        w, found = Words(col), []
        n_words = np.diff(w.first)
        exact: dict[tuple[int, int], set[bytes]] = {}
        hashed: dict[int, tuple] = {}
        for p in self.partitions:
            if p.width not in hashed:
                hashed[p.width] = w.shingles(p.width)
            enough = n_words - p.width + 1 >= p.least
            for row, item in sorted(p.candidates(*hashed[p.width], enough)):
                if (row, p.width) not in exact:
                    exact[row, p.width] = exact_shingles(w.text(row), p.width)
                n = len(self.shingles[item] & exact[row, p.width])
                if n >= self.need[item]:
                    found.append((row, item, n))
        return found


def benchmark_blocks(items: DataFrame, words: int, containment: float, id_col: str, text_col: str) -> Iterator[Block]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = items.select(F.col(id_col).cast("long").alias("i"), text.alias("t")).groupBy("t").agg(F.min("i").alias("i"), F.count("*").alias("n"))
    total = items.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    for k in range(blocks):
        rows = distinct.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).select("i", "n", "t").collect()  # BLOCK_BYTES or so
        if rows:
            yield Block(sorted(((r["i"], r["n"], r["t"]) for r in rows), key=lambda r: (r[0] is None, r[0], r[2])), words, containment)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, item_copies, n_shingles, n_found, containment.

    Items of equal text are one item, named by their smallest id, with the number of their rows. Items of
    fewer words than a shingle are one shingle of all their words; items without words match nothing.
    Null texts are empty, null ids stay null, repeated document rows are each reported; no items or no
    documents give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in benchmark_blocks(items, words, containment, item_col, item_text):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = sent.value
            for batch in batches:
                for part in steps(batch, "text"):
                    ids = part.column(0)
                    made = [(ids[r].as_py(), *b.rows[i][:2], len(b.shingles[i]), n, n / len(b.shingles[i])) for r, i, n in b.search(part.column(1))]
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _MATCH, strict=True)], schema=_MATCH)

        found = rows.mapInArrow(search, "doc_id long, item_id long, item_copies long, n_shingles long, n_found long, containment double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, item_copies long, n_shingles long, n_found long, containment double")


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of `docs`, all columns as they are, without those that hold an item."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    out = docs
    for block in benchmark_blocks(items, words, containment, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, batch.schema.names[at]):
                    good = np.ones(part.num_rows, bool)
                    good[[r for r, _, _ in sent.value.search(part.column(at))]] = False
                    yield part.filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
    return out
