"""SimHash near-duplicates by deletion-variant signatures.

Three differing bits over two 32-bit segments (seven over four of 16) leave one segment with at most one
differing bit. Each distinct fingerprint is indexed under its 64 one-wildcard variants (segment, bit left out, other bits);
rows meet by equality of the variant and every meeting is verified on all 64 bits.

In a bucket whose wildcard is not bit 0 only fingerprints that differ in the wildcard bit are paired:
equal segments share all their variants and meet under bit 0. Buckets up to SMALL give their verified
pairs, larger ones a spanning forest of their links (the same components, one edge a row at most), and
rows of a bucket beyond HOT are indexed again under one-wildcard variants of pieces of the other bits. At
three bits such a second bucket fixes all but 18, so it holds 2**18 fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dzvin.llm.common import U64, cut_lineage, ship
from dzvin.llm.components import connected_components

WORDS, DISTANCE = 3, 3
SMALL, HOT = 64, 1 << 16
_FOUND = pa.schema({"a": pa.int64(), "b": pa.int64(), "key": pa.int64()})


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Digests of all shingles in order. Null is an empty text, without any; fewer words than a shingle: the whole sequence."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, "<u8")
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = [join(w)] if len(w) <= words else map(join, zip(*(w[k:] for k in range(words)), strict=False))
    return np.array([digest(r, 42) for r in runs], "<u8")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The majority of each bit over the shingles; zero without words."""
    return _majority(shingles(text, words))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text_col: str, name: str, words: int = WORDS) -> DataFrame:
    """All columns of the input and the fingerprint as a signed long."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in b.column(at)], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made)], [*(f"c{k}" for k in range(b.num_columns)), "f"])

    fields = [f"`c{k}` {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)]
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).mapInArrow(add, ", ".join([*fields, "f long"])).toDF(*docs.columns, name)


def segments(distance: int) -> int:
    """The fewest equal segments of which one differs by at most one bit."""
    return distance // 2 + 1


def variants(f: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 64 one-wildcard variants of each fingerprint, and the fingerprints beside them."""
    size = 64 // segments(distance)
    out = np.empty((len(f), 64), np.int64)
    for s in range(64 // size):
        seg = (f >> U64(size * s)) & U64((1 << size) - 1)
        for i in range(size):
            out[:, size * s + i] = ((seg & ~U64(1 << i)) | U64(s << 37 | i << 32)).view(np.int64)
    return out.ravel(), np.repeat(f, 64)


def second_variants(key: np.ndarray, f: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """The same for the bits that a first key does not cover, cut into as many pieces."""
    n = segments(distance)
    size = 64 // n
    rest = (64 - size) // n
    k = key.view(U64)
    s = k >> U64(37)
    low = f & ((U64(1) << (s * U64(size))) - U64(1))
    high = np.where(s == n - 1, U64(0), f >> ((s * U64(size) + U64(size)) & U64(63)))
    other = low | high << (s * U64(size))
    # A first key in as few bits as it needs.
    short = (s * U64(size) + (k >> U64(32) & U64(31))) << U64(size) | k & U64((1 << size) - 1)
    out = np.empty((len(f), n * rest), np.int64)
    for t in range(n):
        part = (other >> U64(rest * t)) & U64((1 << rest) - 1)
        for j in range(rest):
            out[:, rest * t + j] = (short << U64(rest + 6) | U64((rest * t + j) << rest) | (part & ~U64(1 << j))).view(np.int64)
    return out.ravel(), np.repeat(f, n * rest)


def _forest(f: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of spanning trees of a bucket: each row looks only at rows that none has reached."""
    left, out = f, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                new = left[near]
                out.append((np.full(len(new), x), new))
                front.extend(new)
                left = left[~near]
    return out


def bucket_edges(key: np.ndarray, f: np.ndarray, distance: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of whole buckets; the rows are sorted by key."""
    if not len(key):
        return np.zeros(0, U64), np.zeros(0, U64)
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[begin, len(key)])
    bit = (key[begin] >> 32) & 31
    # The bit that the wildcard left out, set or not; at the second level all pairs count.
    place = (bit + 64 // segments(distance) * (key >> 37)[begin]).astype(U64) if level == 1 else bit.astype(U64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for m in np.unique(size[(size > 1) & (size <= SMALL)]):
        at = begin[size == m]
        rows = f[at[:, None] + np.arange(m)]
        i, j = np.triu_indices(m, 1)
        step = max(1, (1 << 19) // len(i))
        for k in range(0, len(at), step):
            x, y = rows[k : k + step][:, i], rows[k : k + step][:, j]
            d = x ^ y
            good = np.bitwise_count(d) <= distance
            if level == 1:
                p, b = place[size == m][k : k + step, None], bit[size == m][k : k + step, None]
                good &= (b == 0) | ((d >> p) & U64(1) == 1)
            out.append((x[good], y[good]))
    for at, m, p, b in zip(begin[size > SMALL], size[size > SMALL], place[size > SMALL], bit[size > SMALL], strict=True):
        rows = f[at : at + m]
        if level == 1 and b and len(np.unique((rows >> p) & U64(1))) == 1:
            continue
        out += _forest(rows, distance)
    if not out:
        return np.zeros(0, U64), np.zeros(0, U64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _join_buckets(index: DataFrame, distance: int, level: int, hot: int) -> DataFrame:
    """The equality join: buckets meet in key order; what exceeds `hot` comes back as (key, fingerprint)."""

    def out(a, b, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key, pa.int64())], schema=_FOUND)

    def found(key: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = bucket_edges(key, f, distance, level)
        if len(a):
            low, high = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack([low, high], 1), axis=0)
            a, b = (np.ascontiguousarray(pairs[:, k]).view(np.int64) for k in (0, 1))
            yield out(a, b, np.full(len(a), -1))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f = np.zeros(0, np.int64), np.zeros(0, U64)
        hot_key: int | None = None
        for b in batches:
            k, v = b.column(0).to_numpy(), b.column(1).to_numpy().view(U64)
            if hot_key is not None:
                same = k == hot_key
                if same.any():
                    yield out(v[same].view(np.int64), v[same].view(np.int64), k[same])
                k, v = k[~same], v[~same]
                if not len(k):
                    continue
                hot_key = None
            key, f = np.concatenate([key, k]), np.concatenate([f, v])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from found(key[:cut], f[:cut])
            key, f = key[cut:], f[cut:]
            if len(key) > hot and level == 1:
                hot_key = int(key[0])
                yield out(f.view(np.int64), f.view(np.int64), key)
                key, f = key[:0], f[:0]
        yield from found(key, f)

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "key").sortWithinPartitions("key", "f").mapInArrow(meet, "a long, b long, key long")


def _index(rows: DataFrame, level: int, distance: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                f = part.column(0).to_numpy().view(U64)
                key, f = variants(f, distance) if level == 1 else second_variants(part.column(1).to_numpy(), f, distance)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f.view(np.int64))], ["key", "f"])

    return rows.mapInArrow(make, "key long, f long")


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(f) distinct longs -> (a, b): edges with the components of the links at `distance` or fewer bits."""
    if distance not in (2, 3, 6, 7):
        raise ValueError("the distance must leave two or four equal segments: 2, 3, 6 or 7")
    ship(prints.sparkSession)
    first = cut_lineage(_join_buckets(_index(prints, 1, distance), distance, 1, hot))
    edges, over = first.where("a <> b").select("a", "b"), first.where("a = b").select("a", "key")
    if not over.isEmpty():
        edges = edges.unionByName(_join_buckets(_index(over, 2, distance), distance, 2, hot).select("a", "b"))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id, the smallest id reachable.

    Equal fingerprints are one node, so copies are never paired. Null and empty texts have fingerprint
    zero and link like any other. Null ids are reached but never name a component; it is null where all
    its ids are. Repeated rows stay. An empty table gives no rows. Other columns are not read.
    """
    prints = cut_lineage(add_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "fp", words).select("doc_id", "fp"))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = connected_components(link_fingerprints(nodes.select("fp"), distance, hot))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    classes = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    named = cut_lineage(labelled.join(classes, "label").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row of each component of fingerprints, all columns as they are: that with the smallest id.

    Where several rows have that id and fingerprint, one of them stays. Of components with null ids alone one
    row of each fingerprint stays.
    """
    n = len(docs.columns)
    key = f"c{docs.columns.index(id_col)}"
    plain = docs.toDF(*(f"c{k}" for k in range(n)))
    found = near_duplicates(docs, id_col, text_col, words, distance)
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("fp").alias("fp"))
    first = first.unionByName(found.where("component_id is null").select("doc_id", "fp").distinct())
    printed = add_fingerprint(plain, f"c{docs.columns.index(text_col)}", "f", words)
    kept = printed.join(first.toDF("i", "g"), (F.col("f") == F.col("g")) & F.col(key).eqNullSafe(F.col("i")), "left_semi")
    return kept.dropDuplicates(["f", key]).drop("f").toDF(*docs.columns)
