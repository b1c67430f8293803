"""Toxicity by two class-conditional Kneser-Ney bigram models over shared backoff counts.

Over the labelled documents (ASCII lower case, signs part words) words and word pairs are counted per
class. For class c, history h and word w:

    P(w | h)   = max(n(h w) - D, 0) / n(h) + backoff(h) P(w)     shared by the classes
    P_c(w)     = max(N_c(. w) - D_c, 0) / N_c(. .) + backoff_c P(w)
    P_c(w | h) = P(w | h) a_c(w) / Z_c(h),   a_c(w) = P_c(w) / P(w)

with N the numbers of distinct histories (of one class, or of both in P(w)) and Z the sum that makes each
history's probabilities add to one. A word too rare in either class falls back on the shared counts and
weighs alike in both; Z takes out what a history's whole language or subject shares. A toxic document is
ordinary text with a share of toxic expressions, so its likelihood is that of the mixture
(1 - SHARE) P_ordinary + SHARE P_toxic. The difference of the log-likelihoods per word, toxic less
ordinary, goes through a logistic curve fitted on labelled texts kept out of the counts.

Counts run over the labelled documents (but the texts kept for the curve) and grow with them. The
vocabulary is every word seen twice; words seen once are one unknown word, scored by the shared backoff. The
model is a number for each word and one for each history. Those of the VOCABULARY most frequent words at most
(the head) are arrays, sent to executors; those of all other words (the tail, empty for small corpora) are
a table, which pairs with such a word meet by shuffle joins. Where the head ends bears on speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dzvin.llm.common import U64, Words, cut_lineage, ship, steps

#: Words of the head, at most.
VOCABULARY = 1 << 20
SHARE = 0.03
#: Labels are sent to executors up to this many rows, joined by a shuffle beyond.
SEND_LABELS = 2_000_000
#: One text in CURVE_PART, or fewer where that would be more than CURVE_ROWS labelled rows, is kept for the curve.
CURVE_PART, CURVE_ROWS = 8, 20_000
_WIDTH = 21


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted word hashes of the head; then come the unknown word and the start
    word: np.ndarray  # log a_toxic / a_ordinary
    history: np.ndarray  # log Z_toxic / Z_ordinary
    curve: np.ndarray
    tail: DataFrame | None = None  # (id, word, history) of the other words, by `_tail_id`

    def sent(self) -> Model:
        """What goes to executors."""
        return Model(self.vocabulary, self.word, self.history, self.curve)


def _tail_id(h: np.ndarray) -> np.ndarray:
    """Hashes as negative numbers, apart from the numbers of the head."""
    return (h | U64(1 << 63)).view(np.int64)


def _ids(w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and history numbers of all words."""
    n = len(vocabulary)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n:
        at = np.minimum(np.searchsorted(vocabulary, w.hash), n - 1)
        word = np.where(vocabulary[at] == w.hash, at, n)
    else:
        word = np.zeros(len(w.hash), np.int64)
    history = np.r_[n + 1, word[:-1]]
    history[w.first[:-1][np.diff(w.first) > 0]] = n + 1
    return word, history


def _counted(train: DataFrame, keys) -> DataFrame:
    """(k, ordinary, toxic): how often each key of `keys(words)`, keys and the places of their words, occurs in either class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, ...]:
            k, o, t = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at = np.unique(k, return_inverse=True)
            return u, np.bincount(at, o, len(u)).astype(np.int64), np.bincount(at, t, len(u)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["k", "ordinary", "toxic"])

        rows = 0
        for b in batches:
            for part in steps(b, "text"):
                w = Words(part.column(0), signs=True)
                if not len(w.hash):
                    continue
                found, places = keys(w)
                if not len(found):
                    continue
                toxic = part.column(1).to_numpy(zero_copy_only=False)[w.doc[places]].astype(np.int64)
                u, at = np.unique(found, return_inverse=True)
                t = np.bincount(at, toxic, len(u)).astype(np.int64)
                held.append((u, np.bincount(at, minlength=len(u)) - t, t))
                rows += len(u)
                if rows > 1 << 20:
                    held[:] = [merged()]
                    rows = len(held[0][0])
                    if rows > 1 << 19:
                        yield out()
                        held.clear()
                        rows = 0
        if held:
            held[:] = [merged()]
            yield out()

    made = train.select("text", "toxic").mapInArrow(count, "k long, ordinary long, toxic long")
    return made.groupBy("k").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _least(counts: DataFrame, most: int) -> int:
    """The smallest count, 2 or more, that at most `most` keys reach."""
    by_count = counts.where("ordinary + toxic > 1").groupBy(F.least(F.expr("ordinary + toxic"), F.lit(1 << 16)).alias("c")).count().orderBy(F.desc("c")).collect()
    least, total = None, 0
    for r in by_count:
        total += r["count"]
        if total > most:
            break
        least = r["c"]
    return least or (1 << 16) + 1


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    t = df.select(*names).toArrow()
    return [t[n].to_numpy() for n in names]


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from `labelled` (id, 0 or 1), which should hold no row meant for testing.

    Null ids and labels are left out; an id with several labels has that of most of its rows, none on a tie;
    every document row of a labelled id counts. With one class alone or no rows all scores are the prior's.
    """
    spark = docs.sparkSession
    ship(spark)
    key, label = labelled.columns[0], labelled.columns[1]
    one = labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("i")).agg(F.avg(F.col(label).cast("double")).alias("y")).where("y <> 0.5").select("i", (F.col("y") > 0.5).alias("toxic"))
    n_labels = labelled.count()
    if n_labels <= SEND_LABELS:
        one = F.broadcast(one)
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(one, "i")
    kept_out = F.pmod(F.xxhash64("text"), F.lit(max(CURVE_PART, n_labels // CURVE_ROWS))) == 0
    train, curve = rows.where(~kept_out), rows.where(kept_out)

    words = cut_lineage(_counted(train, lambda w: (w.hash.view(np.int64), np.arange(len(w.hash)))))
    least = _least(words, VOCABULARY)
    vocabulary = np.sort(_arrays(words.where(F.expr("ordinary + toxic") >= least), "k")[0].astype(np.int64).view(U64))
    sent = spark.sparkContext.broadcast(vocabulary)
    n = len(vocabulary) + 2
    lowest = F.lit(-(1 << 63))
    rest = words.where((F.expr("ordinary + toxic") >= 2) & (F.expr("ordinary + toxic") < least)).select(F.col("k").bitwiseOR(lowest).alias("id"))
    rest = None if least <= 2 or rest.isEmpty() else rest

    whole_head = rest is None

    def pairs_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pairs, and their places; with a tail only those within the head."""
        word, history = _ids(w, sent.value)
        at = np.arange(len(word)) if whole_head else np.flatnonzero((word != n - 2) & (history != n - 2))
        return (history << _WIDTH | word)[at], at

    pairs = cut_lineage(_counted(train, pairs_of))
    both = pairs.select("ordinary", "toxic", F.shiftright("k", _WIDTH).alias("h"), F.col("k").bitwiseAND(F.lit((1 << _WIDTH) - 1)).alias("w"))
    if rest is not None:
        both = cut_lineage(both.unionByName(_tail_pairs(train, rest, sent, n)).groupBy("h", "w").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))
    seen = lambda c: F.count_if(F.col(c) > 0).alias(f"n_{c}")
    by_word = both.groupBy("w").agg(F.count("*").alias("n"), seen("ordinary"), seen("toxic"))
    by_word = cut_lineage(by_word) if rest is not None else by_word
    # A row for each word of the head: bounded.
    w, w_all, *by_class = _arrays(by_word.where("w >= 0"), "w", "n", "n_ordinary", "n_toxic")
    counts = np.zeros((3, n))
    counts[:, w] = w_all, *by_class
    # What sums over the tail add to those over the head: words, histories, and for each class histories and words with one and two.
    more = [0] * 8
    if rest is not None:
        ones = [F.count_if(F.col(f"n_{c}") == k) for c in ("ordinary", "toxic") for k in (1, 2)]
        more = [x or 0 for x in by_word.where("w < 0").agg(F.count("*"), F.sum("n"), F.sum("n_ordinary"), F.sum("n_toxic"), *ones).first()]
    total = 0.5 * (n + more[0]) + counts[0].sum() + more[1]
    shared = (0.5 + counts[0]) / total
    laws = []
    for c in (0, 1):
        seen_c = counts[c + 1]
        d_c = _discount((seen_c == 1).sum() + more[4 + 2 * c], (seen_c == 2).sum() + more[5 + 2 * c])
        whole = seen_c.sum() + more[2 + c]
        # Discounted mass of all words: each with a pair gives d_c, or all it has if that is less.
        kept = np.maximum(seen_c - d_c, 0).sum()
        if rest is not None:
            kept += by_word.where("w < 0").agg(F.sum(F.greatest(F.col(("n_ordinary", "n_toxic")[c]) - F.lit(d_c), F.lit(0.0)))).first()[0] or 0.0
        laws.append((d_c, whole, 1 - kept / whole if whole else 1.0))
    alpha = np.stack([(np.maximum(counts[c + 1] - d, 0) / max(whole, 1) + back * shared) / shared for c, (d, whole, back) in enumerate(laws)])
    once = both.agg(*(F.count_if(F.expr("ordinary + toxic") == k).alias(f"n{k}") for k in (1, 2))).first()
    d = _discount(once["n1"], once["n2"])
    sent_alpha = spark.sparkContext.broadcast(alpha)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent_alpha.value
        for b in batches:
            h, w, n = (b.column(k).to_numpy() for k in range(3))
            m = np.maximum(n - d, 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, n, m, m * a[0, w], m * a[1, w])], ["h", "n", "m", "o", "t"])

    sums = lambda rows: rows.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "m", "o", "t")))
    weighed = both.where("w >= 0").select("h", "w", F.expr("ordinary + toxic").alias("n")).mapInArrow(weigh, "h long, n long, m double, o double, t double")
    tail = None
    if rest is not None:
        p = (F.lit(0.5) + F.col("n")) / F.lit(float(total))
        a = [(F.greatest(F.col(f"n_{c}") - F.lit(float(x)), F.lit(0.0)) / F.lit(float(max(whole, 1))) + F.lit(float(back)) * p) / p for c, (x, whole, back) in zip(("ordinary", "toxic"), laws, strict=True)]
        tail = cut_lineage(by_word.where("w < 0").select("w", a[0].alias("ao"), a[1].alias("at")))
        m = F.greatest(F.expr("ordinary + toxic") - F.lit(float(d)), F.lit(0.0))
        own = both.where("w < 0").join(tail, "w").select("h", F.expr("ordinary + toxic").alias("n"), m.alias("m"), (m * F.col("ao")).alias("o"), (m * F.col("at")).alias("t"))
        weighed = cut_lineage(sums(weighed.unionByName(own)))
    else:
        weighed = sums(weighed)
    h, size, kept, *by_class = _arrays(weighed.where("h >= 0"), "h", "n", "m", "o", "t")
    z = np.ones((2, n))
    for c in (0, 1):
        z[c, h] = by_class[c] / size + 1 - kept / size
    if rest is not None:
        left = 1 - F.col("m") / F.col("n")
        after = weighed.where("h < 0").select(F.col("h").alias("id"), F.log((F.col("t") / F.col("n") + left) / (F.col("o") / F.col("n") + left)).alias("history"))
        tail = cut_lineage(tail.select(F.col("w").alias("id"), F.log(F.col("at") / F.col("ao")).alias("word")).join(after, "id", "left"))
    model = Model(vocabulary, np.log(alpha[1] / alpha[0]).astype(np.float32), np.log(z[1] / z[0]).astype(np.float32), np.zeros(4), tail)
    # Equal texts are one point with a weight.
    points = _differences(curve.select("text", "toxic"), model).groupBy("d", "n", "toxic").count().toArrow()
    model.curve = _curve(points["d"].to_numpy(), points["n"].to_numpy(), points["toxic"].to_numpy(zero_copy_only=False).astype(float), points["count"].to_numpy())
    return model


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def _tail_pairs(train: DataFrame, rest: DataFrame, vocabulary, n: int) -> DataFrame:
    """(h, w, ordinary, toxic) of pairs with a word beyond the head; those not in `rest` are the unknown word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "text"):
                w = Words(part.column(0), signs=True)
                h, word = _with_tail(w, *_ids(w, vocabulary.value)[::-1], n)
                at = np.flatnonzero((h < 0) | (word < 0))
                toxic = part.column(1).to_numpy(zero_copy_only=False)[w.doc[at]]
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(word[at]), pa.array(toxic.astype(bool))], ["h", "w", "toxic"])

    rows = train.select("text", "toxic").mapInArrow(cut, "h long, w long, toxic boolean")
    rows = rows.groupBy("h", "w").agg(F.count_if(~F.col("toxic")).alias("ordinary"), F.count_if("toxic").alias("toxic"))
    known = rest.withColumn("known", F.lit(True))
    for c in ("h", "w"):
        rows = rows.join(known.withColumnRenamed("id", c), c, "left").withColumn(c, F.when((F.col(c) >= 0) | F.col("known"), F.col(c)).otherwise(n - 2)).drop("known")
    return rows.select("ordinary", "toxic", "h", "w")


def _with_tail(w: Words, history: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of histories and words with the tail's ids in place of the unknown word's."""
    ids = _tail_id(w.hash)
    before = np.r_[ids[:1], ids[:-1]]
    return np.where(history == n - 2, before, history), np.where(word == n - 2, ids, word)


def _mixed(ratio: np.ndarray) -> np.ndarray:
    return np.log1p(SHARE * (np.exp(ratio) - 1))


def difference(col: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of toxic less that of ordinary text per word, and the numbers of words, by the head alone."""
    w = Words(col, signs=True)
    n = np.diff(w.first)
    word, history = _ids(w, m.vocabulary)
    said = _mixed(m.word[word].astype(float) - m.history[history])
    return np.bincount(w.doc, said, len(n)) / np.maximum(n, 1), n


def _differences(rows: DataFrame, model: Model) -> DataFrame:
    """The columns of (text, ...) but the text, with d and n."""
    sent = rows.sparkSession.sparkContext.broadcast(model.sent())
    others = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "text"):
                d, n = difference(part.column(0), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(d), pa.array(n)], [*others, "d", "n"])

    if model.tail is None:
        return rows.select("text", *others).mapInArrow(run, f"{kinds}, d double, n long")

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the head says of each text, and its pairs with a word beyond the head: their known parts and their ids."""
        m = sent.value
        n_ids = len(m.vocabulary) + 2
        for b in batches:
            for part in steps(b, "text"):
                w = Words(part.column(0), signs=True)
                n = np.diff(w.first)
                word, history = _ids(w, m.vocabulary)
                h, x = _with_tail(w, history, word, n_ids)
                at = np.flatnonzero((h < 0) | (x < 0))
                said = _mixed(m.word[word].astype(float) - m.history[history])
                said[at] = 0
                first = np.searchsorted(w.doc[at], np.arange(len(n) + 1)).astype(np.int32)
                # For the unknown word the head's own numbers stand where the tail has none.
                fields = [pa.array(h[at]), pa.array(x[at]), pa.array(m.history[history[at]].astype(float)), pa.array(m.word[word[at]].astype(float))]
                pairs = pa.ListArray.from_arrays(first, pa.StructArray.from_arrays(fields, ["h", "w", "z", "a"]))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.bincount(w.doc, said, len(n))), pa.array(n), pairs], [*others, "d", "n", "pairs"])

    cut = rows.select("text", *others).mapInArrow(open_pairs, f"{kinds}, d double, n long, pairs array<struct<h:long,w:long,z:double,a:double>>")
    cut = cut_lineage(cut.withColumn("row_", F.monotonically_increasing_id()))
    p = cut.select("row_", F.explode("pairs").alias("p")).select("row_", "p.*")
    for c, own, name in (("w", "a", "word"), ("h", "z", "history")):
        known = model.tail.select(F.col("id").alias(c), F.coalesce(name, F.lit(0.0)).alias("told"))
        p = p.join(known, c, "left").withColumn(own, F.coalesce("told", own)).drop("told")
    more = p.groupBy("row_").agg(F.sum(F.log1p(F.lit(SHARE) * (F.exp(F.col("a") - F.col("z")) - 1))).alias("more"))
    out = cut.drop("pairs").join(more, "row_", "left")
    return out.select(*others, ((F.col("d") + F.coalesce("more", F.lit(0.0))) / F.greatest("n", F.lit(1))).alias("d"), "n")


def _features(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    size = np.log1p(n)
    return np.stack([d * 10, d * size * 5, size / 5, np.ones(len(d))], 1)


def _curve(d: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge."""
    x, b = _features(d, n), np.zeros(4)
    if not len(y):
        return b
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (weight * (y - p)) - 0.05 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, one row per input row; null and empty texts have no words and a difference of 0."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    size = F.log1p(F.col("n").cast("double"))
    x = [F.col("d") * 10, F.col("d") * size * 5, size / 5, F.lit(1.0)]
    total = sum((v * F.lit(float(b)) for v, b in zip(x, model.curve, strict=True)), F.lit(0.0))
    return _differences(rows, model).select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), total))))).alias("score"))
