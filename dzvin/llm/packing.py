"""Packing into fixed windows by lexical retrieval.

Each text is encoded once; the ids are written to the shared folder and all that follows works on them.
Terms are token ids without regard to case and leading space, so document frequencies are exact counts
over all documents and bounded in number by the vocabulary.

The index is sharded by document. Documents are ordered by their terms of most BM25 weight (those that a query
by the document looks up first) with a hash of the row behind them, cut into ranges of about RANGE_BYTES,
and ranges into shards of at most SHARD_DOCS documents or SHARD_BYTES of ids. So a shard is a piece of the posting lists of
some terms, and a large group of copies fills many shards. Neither depends on how Spark is set up.

Each shard has a BM25 inverted index weighted by the frequencies of the whole corpus. A seed document
opens a window; while the window has room, the unused documents that score best against the seed come
next, then the next unused ones in order. A document that does not fit is cut: its rest opens the next
window and is that window's seed. Only the last window of a shard has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dzvin.llm.common import U64, mix, ship, steps, stored
from dzvin.llm.tokens import END_ID, encoder

WINDOW = 2048
SHARD_DOCS, SHARD_BYTES = 4096, 8 << 20
#: Bytes of ids of a range, and the most ranges; beyond these ranges are larger, shards are not.
RANGE_BYTES, MAX_RANGES = 6 << 20, 50_000
#: Documents of the sample that sets the bounds of the ranges, for each range.
SAMPLE = 100
K1, B = 1.2, 0.75
#: Terms of a document that set its place.
LEADING = 3
#: Neighbours of a seed that are ordered at once; few windows take more.
BEST = 64


class Terms:
    """Terms of documents: for each document and term in order the number of its places, without white space and the end id."""

    def __init__(self, ids: pa.Array, dtype: np.dtype, fold: np.ndarray):
        n = len(ids)
        _, offsets, body = ids.buffers()
        at = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        flat = np.frombuffer(body, np.uint8)[at[0] : at[-1]].view(dtype) if n else np.zeros(0, dtype)
        size = np.diff(at) // dtype.itemsize
        # Four bytes of document and term are sorted at twice the speed of eight.
        bits = int(fold.max()).bit_length()
        kind = np.uint32 if n.bit_length() + bits <= 32 else np.uint64
        key = fold.astype(kind)[flat] | np.repeat(np.arange(n, dtype=kind) << kind(bits), size)
        real = (key & kind((1 << bits) - 1)) > 0
        real[(np.cumsum(size) - 1)[size > 0]] = False  # the end id
        key = np.sort(key[real])
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.tf = np.diff(np.r_[begin, len(key)])
        self.doc, self.term = (key[begin] >> kind(bits)).astype(np.int64), (key[begin] & kind((1 << bits) - 1)).astype(np.int64)
        self.n_docs, self.size = n, np.bincount(self.doc, self.tf, n)


class Statistics:
    """Document frequency of each term, number of documents and their mean number of terms."""

    def __init__(self, df: np.ndarray, n_docs: int, places: int):
        self.df, self.n_docs, self.mean = df, n_docs, max(places / max(1, n_docs), 1e-9)
        # Terms that over half of the documents have weigh nothing.
        self.idf = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), 0)

    def weights(self, t: Terms) -> np.ndarray:
        return self.idf[t.term] * t.tf * (K1 + 1) / (t.tf + K1 * (1 - B + B * t.size[t.doc] / self.mean))


def corpus_statistics(encoded: DataFrame, tokenizer: str) -> Statistics:
    """Over all rows of (ids): a number for each term of the vocabulary goes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "byte")
        df, docs, places = np.zeros(enc.n_terms, np.int64), 0, 0
        for b in batches:
            for part in steps(b, "ids"):
                t = Terms(part.column(0), enc.dtype, enc.fold)
                df += np.bincount(t.term, minlength=enc.n_terms)
                docs, places = docs + t.n_docs, places + int(t.tf.sum())
        at = np.flatnonzero(df)
        # -1 and -2 carry the totals.
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[df[at], docs, places])], ["term", "n"])

    got = encoded.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(got["term"].to_pylist(), got["n"].to_pylist(), strict=True))
    df = np.zeros(encoder(tokenizer, "byte").n_terms, np.int64)
    for term, x in n.items():
        if term >= 0:
            df[term] = x
    return Statistics(df, n.get(-1, 0), n.get(-2, 0))


class Index:
    """BM25 postings of a shard."""

    def __init__(self, t: Terms, s: Statistics):
        weight = s.weights(t)
        use = np.flatnonzero(weight > 0)
        use = use[np.argsort(t.term[use].astype(np.uint32), kind="stable")]
        term, self.doc, self.weight, self.n = t.term[use], t.doc[use], weight[use], t.n_docs
        new = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(term)])
        lists = np.cumsum(new) - 1
        by_doc = np.argsort(self.doc.astype(np.uint16 if self.n <= 1 << 16 else np.int64), kind="stable")
        self.begin, self.end = begin[lists[by_doc]], (begin + size)[lists[by_doc]]
        self.of_doc = np.searchsorted(self.doc[by_doc], np.arange(self.n + 1))
        self.room = np.empty(0, np.int64), np.empty(0)

    def drop(self, unused: np.ndarray) -> None:
        """Take used documents out of the postings; they can still be seeds."""
        keep = unused[self.doc]
        before = np.r_[0, np.cumsum(keep)]
        self.doc, self.weight = self.doc[keep], self.weight[keep]
        self.begin, self.end = before[self.begin], before[self.end]

    def neighbours(self, seed: int, unused: np.ndarray, best: int | None = None) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties by place; with `best` no more than that many and the last one's ties."""
        a, z = self.of_doc[seed], self.of_doc[seed + 1]
        lists = [slice(x, y) for x, y in zip(self.begin[a:z].tolist(), self.end[a:z].tolist(), strict=True)]
        if not lists:
            return np.zeros(0, np.int64)
        total = sum(x.stop - x.start for x in lists)
        if total > len(self.room[0]):
            self.room = np.empty(2 * total, np.int64), np.empty(2 * total)
        # Whole lists are copied faster than their entries are picked, and faster still to memory that is in use.
        doc, weight = (np.concatenate([whole[x] for x in lists], out=to[:total]) for whole, to in ((self.doc, self.room[0]), (self.weight, self.room[1])))
        score = np.bincount(doc, weight, self.n)
        found = np.flatnonzero((score > 0) & unused)
        worth = -score[found]
        if best is not None and len(found) > best:
            first = worth <= np.partition(worth, best - 1)[best - 1]
            found, worth = found[first], worth[first]
        return found[np.argsort(worth, kind="stable")]


def leading(t: Terms, s: Statistics, row: np.ndarray) -> np.ndarray:
    """The place of each document in the order: its LEADING terms of most weight (ties by number), then 15 bits of its row."""
    # Weights in steps of 1/1024, largest first, make one whole number with document and term.
    weight = np.minimum(s.weights(t) * 1024, (1 << 20) - 1).astype(np.int64)
    best = np.sort(t.doc << 40 | ((1 << 20) - 1 - weight) << 20 | t.term) & ((1 << 20) - 1)
    first = np.searchsorted(t.doc, np.arange(t.n_docs + 1))
    # Numbers of terms are cut to 16 bits here; that bears on the order alone.
    out = mix(row.astype(U64)) >> U64(49)
    for k in range(LEADING):
        at = first[:-1] + k
        there = at < first[1:]
        term = np.zeros(t.n_docs, np.int64)
        term[there] = best[at[there]]
        out |= (term.astype(U64) & U64(0xFFFF)) << U64(47 - 16 * k)
    return out.astype(np.int64)


def pack_shard(index: Index, sizes: list[int], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) of all pieces of a shard."""
    unused = np.ones(len(sizes), bool)
    number = used = at = 0
    after = 0
    left = held = len(sizes)
    seed: int | None = None
    ranked: Iterator[int] = iter(())
    whole = True
    while True:
        if used == window:
            number, used, seed = number + 1, 0, None
        if at == 0:
            doc = None
            if seed is not None:
                doc = next((int(d) for d in ranked if unused[d]), None)
                if doc is None and not whole:
                    ranked, whole = iter(index.neighbours(seed, unused)), True
                    doc = next((int(d) for d in ranked), None)
            if doc is None:
                while after < len(sizes) and not unused[after]:
                    after += 1
                if after == len(sizes):
                    return
                doc = after
            unused[doc] = False
            left -= 1
            # Work for a seed goes with what the lists hold.
            if left < 0.8 * held:
                index.drop(unused)
                held = left
        take = min(sizes[doc] - at, window - used)
        yield doc, at, take, number, used
        if seed is None and used + take < window:
            seed, ranked, whole = doc, iter(index.neighbours(doc, unused, BEST)), False
        used, at = used + take, at + take
        if at == sizes[doc]:
            at = 0


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, binary).

    Each document is its ids and the end id 1; null and empty texts have the end id alone. Null and repeated
    ids stay as they are, each row is packed by itself. No documents give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("row_no"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "byte")
        end = np.array([END_ID], enc.dtype).tobytes()
        for b in batches:
            for part in steps(b, "t"):
                ids = pa.array([x + end for x in enc.encode_all(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, part.column(2)], ["doc_id", "ids", "row_no"])

    encoded = stored(rows.mapInArrow(encode, f"doc_id {kind}, ids binary, row_no long"))
    statistics = corpus_statistics(encoded, tokenizer)
    sent = spark.sparkContext.broadcast(statistics)
    size = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    n = int(min(MAX_RANGES, size // RANGE_BYTES + 1))

    def keys(ids: pa.Array, row: pa.Array) -> np.ndarray:
        enc = encoder(tokenizer, "byte")
        return leading(Terms(ids, enc.dtype, enc.fold), sent.value, row.to_numpy())

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "ids"):
                yield pa.RecordBatch.from_arrays([pa.array(keys(part.column(0), part.column(1)))], ["k"])

    # A bounded sample sets where the ranges are cut; it bears on their sizes alone.
    some = encoded.select("ids", "row_no").sample(min(1.0, SAMPLE * n / max(1, statistics.n_docs)), seed=7).mapInArrow(sampled, "k long").toArrow()["k"].to_numpy()
    bounds = np.sort(some)[(np.arange(1, n) * len(some)) // n] if len(some) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "ids"):
                k = keys(part.column(1), part.column(2))
                to = np.searchsorted(bounds, k, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(k), pa.array(to)], ["doc_id", "ids", "k", "part"])

    placed = encoded.mapInArrow(place, f"doc_id {kind}, ids binary, k long, part int")
    placed = placed.repartitionById(n, "part").sortWithinPartitions("k").select("doc_id", "ids", "part")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "byte")
        step = enc.dtype.itemsize
        first = 0
        for shard in _shards(batches):
            part = shard.column(2)[0].as_py()
            ids = shard.column(1).to_pylist()
            pieces = list(pack_shard(Index(Terms(shard.column(1), enc.dtype, enc.fold), sent.value), [len(x) // step for x in ids], window))
            cut = [np.frombuffer(ids[d], enc.dtype)[s : s + k].astype("<u4").tobytes() for d, s, k, _, _ in pieces]
            doc, start, length, number, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            columns = [shard.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
            columns += [pa.array([len(ids[d]) // step for d in doc], pa.int64()), pa.array((part << 40) + first + number), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(cut)] if with_ids else []), names)
            first += int(number[-1]) + 1

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long" + ", ids binary" * with_ids
    return placed.mapInArrow(run, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with up to SHARD_DOCS documents and about SHARD_BYTES of ids."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        for part in steps(b, "ids"):
            while part.num_rows:
                piece = part.slice(0, SHARD_DOCS - rows)
                part = part.slice(piece.num_rows)
                held.append(piece)
                rows, size = rows + piece.num_rows, size + piece.column(1).nbytes
                if rows >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield whole()
                    held.clear()
                    rows = size = 0
    if held:
        yield whole()
