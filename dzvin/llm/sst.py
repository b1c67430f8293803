"""Sorted-string-table shards of token ids.

A file holds documents in ascending key order: data blocks, a Bloom filter, a sparse index and a footer.

* Key: the identifier as 8 bytes, big-endian with the sign bit turned (byte order is number order),
  then the row's ordinal among equal identifiers as 4 bytes. A null identifier has an empty first part.
* Block: zstd of entries; entry = shared prefix length, suffix length, number of ids (varints), suffix,
  ids. The first entry of a block shares nothing, so a block can be read alone.
* Bloom filter: over identifiers, 10 bits a key, 7 probes by double hashing.
* Index: for each block its first key, offset, length and CRC-32.
* Footer: offsets of filter and index, numbers of documents and ids, id width, magic.

Rows are range-partitioned by identifier; each partition is one file, written under a name of its own
try and then renamed, so a lost task leaves no half file. Files go through pyarrow's file systems to
the shared folder.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dzvin.llm.common import shared_dir, ship
from dzvin.llm.tokens import END_ID, encoder

MAGIC = b"SSTTOK01"
FOOTER = struct.Struct("<QQQQB8s")
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_PROBES = 10, 7


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def pack_key(ident: int | None, ordinal: int) -> bytes:
    return (b"" if ident is None else struct.pack(">Q", ident + (1 << 63))) + struct.pack(">I", ordinal)


def unpack_key(key: bytes) -> tuple[int | None, int]:
    head, tail = key[:-4], key[-4:]
    return (struct.unpack(">Q", head)[0] - (1 << 63) if head else None), struct.unpack(">I", tail)[0]


def _probes(ident: int | None, bits: int) -> list[int]:
    a = xxhash.xxh64_intdigest(repr(ident), 1)
    b = xxhash.xxh64_intdigest(repr(ident), 2) | 1
    return [(a + k * b) % bits for k in range(BLOOM_PROBES)]


class SSTWriter:
    """Takes (identifier, ids as bytes) in ascending order of identifier."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.at = self.docs = self.ids = 0
        self.block, self.block_key, self.last, self.size = [], b"", b"", 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[int | None] = []
        self.previous: tuple | None = None
        self.ordinal = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, ident: int | None, ids: bytes) -> None:
        self.ordinal = self.ordinal + 1 if self.previous == (ident,) else 0
        if self.previous != (ident,):
            self.hashes.append(ident)
        self.previous = (ident,)
        key = pack_key(ident, self.ordinal)
        if not self.block:
            self.block_key, shared = key, 0
        else:
            shared = next((k for k, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        self.last = key
        self.block.append(_varint(shared) + _varint(len(key) - shared) + _varint(len(ids) // self.width) + key[shared:] + ids)
        self.size += len(self.block[-1])
        self.docs, self.ids = self.docs + 1, self.ids + len(ids) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            body = self.pack.compress(b"".join(self.block))
            self.index.append((self.block_key, self.at, len(body), zlib.crc32(body)))
            self.sink.write(body)
            self.at += len(body)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.hashes) * BLOOM_BITS)
        flags = np.zeros(bits, bool)
        for h in self.hashes:
            flags[_probes(h, bits)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(flags, bitorder="little").tobytes()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QII", at, n, crc) for k, at, n, crc in self.index)
        self.sink.write(bloom + index + FOOTER.pack(self.at, self.at + len(bloom), self.docs, self.ids, self.width, MAGIC))


class SSTReader:
    """Reads one file: `scan` in key order, `get` by Bloom filter, index and one block."""

    def __init__(self, path: str):
        fs, inner = open_fs(path)
        self.file = fs.open_input_file(inner)
        end = self.file.size()
        bloom_at, index_at, self.docs, self.ids, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token table")
        tail = self.file.read_at(end - FOOTER.size - bloom_at, bloom_at)
        self.bits = struct.unpack_from("<Q", tail)[0]
        self.bloom = tail[8 : index_at - bloom_at]
        self.index, at, index = [], 0, tail[index_at - bloom_at :]
        while at < len(index):
            n, at = _read_varint(index, at)
            self.index.append((index[at : at + n], *struct.unpack_from("<QII", index, at + n)))
            at += n + 16
        self.unpack = zstandard.ZstdDecompressor()

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n, crc = self.index[k]
        body = self.file.read_at(n, at)
        if zlib.crc32(body) != crc:
            raise ValueError("a block is damaged")
        b, at, key = self.unpack.decompress(body), 0, b""
        while at < len(b):
            shared, at = _read_varint(b, at)
            more, at = _read_varint(b, at)
            ids, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + more]
            at += more
            yield key, b[at : at + ids * self.width]
            at += ids * self.width

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield unpack_key(key)[0], ids

    def get(self, ident: int | None) -> list[np.ndarray]:
        """The ids of all documents with this identifier."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(ident, self.bits)):
            return []
        low, found = pack_key(ident, 0), []
        k = max(bisect.bisect_right([x[0] for x in self.index], low) - 1, 0)
        for block in range(k, len(self.index)):
            for key, ids in self._block(block):
                if key[:-4] == low[:-4]:
                    found.append(np.frombuffer(ids, f"<u{self.width}").astype(np.uint32))
                elif key > low:
                    return found
        return found


def write_tables(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> list[tuple]:
    """Encode and write; returns (file, documents, ids) in key order, one entry for each file.

    Null text has the end id alone; null identifiers come first; rows that repeat an identifier are all
    kept, in order of checksum and length of their texts. An empty table writes no file.
    """
    spark = docs.sparkSession
    ship(spark)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, inner = open_fs(folder)
    fs.create_dir(inner, recursive=True)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"crc": F.crc32(F.col("text").cast("binary")), "n": F.length("text"), "row_no": F.monotonically_increasing_id()})
    order = ["doc_id", "crc", "n", "row_no"]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, writer = encoder(tokenizer, "word"), None, None
        end = np.array([END_ID], enc.dtype).tobytes()
        store, place = open_fs(folder)
        name = f"try-{uuid.uuid4().hex}"
        first = None
        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if writer is None:
                    out = store.open_output_stream(f"{place}/{name}")
                    writer, first = SSTWriter(out, enc.dtype.itemsize), ident
                writer.add(ident, enc.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            out.close()
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            store.move(f"{place}/{name}", f"{place}/part-{part:06d}.sst")
            yield pa.RecordBatch.from_pylist([{"part": part, "docs": writer.docs, "ids": writer.ids}], pa.schema({"part": pa.int32(), "docs": pa.int64(), "ids": pa.int64()}))

    made = placed.mapInArrow(write, "part int, docs long, ids long").collect()  # one row for each file
    return [(f"{folder}/part-{r['part']:06d}.sst", r["docs"], r["ids"]) for r in sorted(made)]


def read_tables(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    plan, before = [], 0
    for path, _, ids in files:
        plan.append((path, before))
        before += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows = SSTReader(path), []
                for ident, ids in reader.scan():
                    n = len(ids) // reader.width
                    rows.append((ident, at, n, zlib.crc32(np.frombuffer(ids, f"<u{reader.width}").astype("<u4").tobytes())))
                    at += n
                    if len(rows) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    work = spark.createDataFrame(plan, "path string, before long").repartition(len(plan), "path") if len(plan) > 1 else spark.createDataFrame(plan, "path string, before long")
    return work.mapInArrow(read, schema)


def token_tables(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the tables and read them back; without a folder, into a new one below the shared folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    return read_tables(spark, write_tables(docs, tokenizer, folder, id_col, text_col))
