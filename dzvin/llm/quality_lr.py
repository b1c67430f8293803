"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-Proximal.

Three views of a text's words give n-grams: the words themselves (one and two), their shapes (case,
signs at the end, digits, length; one and two) and whether a word repeats one of the four before it.
N-grams are hashed into 2**20 slots; a slot's value is its share of the text's n-grams, scaled. A score
is the logistic of the sparse dot product with the weights, a gather and a sum per text.

Training takes a bounded sample of labelled rows (MAX_TRAIN, the smallest by hash of their id), read by
one task. All rows are scored, whole; the weights sent to executors have 4 MB at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dzvin.llm.common import _SIGN, U64, Words, mix, ship, steps

MAX_TRAIN = 8192
BITS = 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
EPOCHS, SCALE = 4, 30.0
#: Bytes of text of one step of training, whose n-grams are sorted.
TRAIN_STEP = 1 << 20


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return (mix(x ^ U64(salt)) >> U64(64 - BITS)).astype(np.int64)


def _shapes(w: Words) -> np.ndarray:
    d, a, z = w.data, w.start, w.end
    upper = (d >= 65) & (d <= 90)
    upper[1:] |= (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E)
    count = lambda flags: np.r_[0, np.cumsum(flags)]
    n_upper, n_digit, n_sign = count(upper), count((d >= 48) & (d <= 57)), count(_SIGN[d])
    size = z - a
    inside = lambda c: c[z] - c[a]
    last, before = d[z - 1], d[np.maximum(z - 2, a)]
    shape = np.where(_SIGN[last], last, 0).astype(np.int64)
    shape |= np.where(_SIGN[before] & (size > 1), before, 0).astype(np.int64) << 8
    shape |= np.minimum(inside(n_upper), 2) << 16 | (inside(n_digit) > 0).astype(np.int64) << 18
    shape |= (inside(n_sign) == size).astype(np.int64) << 19 | (np.minimum(size, 15) // 4) << 20
    return shape.astype(U64)


def ngrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots and rows of all n-grams of a column, and its number of rows."""
    w = Words(col, lower=False)
    h, doc = w.hash, w.doc
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.n_docs
    shape = _shapes(w)
    pair = doc[1:] == doc[:-1]
    repeat = np.zeros(len(h), U64)
    for k in range(1, 5):
        repeat[k:] |= ((h[k:] == h[:-k]) & (doc[k:] == doc[:-k])).astype(U64) << U64(k)
    two = lambda x: (x[:-1] * U64(0xD6E8FEB86659FD93) + x[1:])[pair]
    slots = [_salted(h, 1), _salted(two(h), 2), _salted(shape, 3), _salted(two(shape), 4), _salted(repeat, 5)]
    docs = [doc, doc[1:][pair], doc, doc[1:][pair], doc]
    return np.concatenate(slots), np.concatenate(docs), w.n_docs


def examples(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Slots of each text, how often it has them (in as few bytes as they need) and the worth of one n-gram."""
    for part in steps(pa.RecordBatch.from_arrays([texts], ["t"]), "t", TRAIN_STEP):
        slot, doc, n = ngrams(part.column(0))
        order = np.argsort(doc, kind="stable")
        slot, at = slot[order], np.searchsorted(doc[order], np.arange(n + 1))
        for i in range(n):
            u, c = np.unique(slot[at[i] : at[i + 1]], return_counts=True)
            yield u.astype(np.int32), c.astype(np.min_scalar_type(c.max(initial=0))), SCALE / max(1, at[i + 1] - at[i])


def train(held: list[tuple[np.ndarray, np.ndarray, float]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-Proximal, one update per text; the last weight is the bias."""
    z, g2 = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(u):
        return np.where(np.abs(z[u]) <= L1, 0.0, (np.sign(z[u]) * L1 - z[u]) / ((BETA + np.sqrt(g2[u])) / ALPHA + L2))

    for _ in range(epochs):
        for (u, c, worth), y in zip(held, labels, strict=True):
            u, x = np.r_[u, 1 << BITS], np.r_[c * worth, 1.0]
            w = weights(u)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[u] += g - (np.sqrt(g2[u] + g * g) - np.sqrt(g2[u])) / ALPHA * w
            g2[u] += g * g
    return weights(np.arange(len(z)))


def scores(col: pa.Array, w: np.ndarray) -> np.ndarray:
    slot, doc, n = ngrams(col)
    total = np.bincount(doc, weights=w[slot], minlength=n)
    return 1 / (1 + np.exp(-np.clip(SCALE * total / np.maximum(1, np.bincount(doc, minlength=n)) + w[-1], -35, 35)))


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights from `labelled` (id, label 0 or 1), which should hold no row meant for testing.

    Rows with a null id or label are left out; an id with several labels has that of most of its rows, or none
    on a tie; an id that several documents carry stands for the smallest of their texts. Without any labelled row
    all weights are zero and each score is 0.5.
    """
    spark = docs.sparkSession
    ship(spark)
    key, label = labelled.columns[0], labelled.columns[1]
    one = labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("i")).agg(F.avg(F.col(label).cast("double")).alias("y")).where("y <> 0.5")
    sample = one.orderBy(F.xxhash64("i"), "i").limit(max_train)
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # The sample has max_train rows of two numbers.
    rows = texts.join(F.broadcast(sample), "i").groupBy("i").agg(F.min("t").alias("t"), F.first("y").alias("y"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the texts one batch is held at a time.
        held, labels = [], []
        for b in batches:
            held += examples(b.column(1))
            labels += [y > 0.5 for y in b.column(2).to_pylist()]
        if held:
            w = train(held, np.array(labels, float))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["slot", "w"])

    learned = rows.orderBy(F.xxhash64("i"), "i").coalesce(1).mapInArrow(learn, "slot long, w double").toArrow()
    w = np.zeros((1 << BITS) + 1, np.float32)
    w[learned["slot"].to_numpy()] = learned["w"].to_numpy()
    return w


def score(docs: DataFrame, w: np.ndarray, name: str, text_col: str = "text") -> DataFrame:
    """All columns of the input and the score; null and empty texts have the bias alone."""
    ship(docs.sparkSession)
    at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(w)
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, b.schema.names[at]):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(part.column(at), sent.value), pa.float64())], [*(f"c{k}" for k in range(n)), "s"])

    fields = [f"`c{k}` {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)]
    return docs.toDF(*(f"c{k}" for k in range(n))).mapInArrow(run, ", ".join([*fields, "s double"])).toDF(*docs.columns, name)


def fold(ident: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(ident.cast("string").cast("binary")) % n


def keep_good(docs: DataFrame, w: np.ndarray, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that score the threshold or more, all columns as they are."""
    ship(docs.sparkSession)
    at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, b.schema.names[at]):
                yield part.filter(pa.array(scores(part.column(at), sent.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
