"""Tokens of documents as rows.

A text is cut once into words and the gaps before them; what a rule needs of the word before, and offsets, are put
beside each word while they are still an array, so making a token table shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dzvin.functions import alphabet as A
from dzvin.functions.text import let

#: Code points of a text whose answers stand together: an answer is looked up among blocks, then among those of its block.
BLOCK = 1024


def running_sums(numbers: Column) -> Column:
    """The sums of each number (array<long>) and all before it: each pass adds what stands 1, 2, 4, ... places before."""
    passes = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int")
    strides = F.when(F.size(numbers) > 1, F.transform(F.sequence(F.lit(0), passes - 1), lambda k: F.pow(F.lit(2), k).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(strides, numbers, lambda sums, s: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - s), F.lit(0).cast("long"))))


def _cut(text: Column, offsets: bool) -> Column:
    """Structs (gap, word, previous), with offsets also end: a gap more than words."""
    words, none = F.regexp_extract_all(text, F.lit(A.WORD), F.lit(0)), F.array(F.lit(None).cast("string"))
    if not offsets:
        return let(words, lambda w: F.arrays_zip(F.split(text, A.WORD, -1).alias("gap"), w.alias("word"), F.concat(none, w).alias("previous")))
    length = lambda g, w: (F.length(g) + F.coalesce(F.length(w), F.lit(0))).cast("long")
    cut = let(words, lambda w: F.struct(F.split(text, A.WORD, -1).alias("g"), w.alias("w")))
    cut = let(cut, lambda x: F.struct(x["g"].alias("g"), x["w"].alias("w"), F.zip_with(x["g"], x["w"], length).alias("n")))
    return let(cut, lambda x: F.arrays_zip(x["g"].alias("gap"), x["w"].alias("word"), F.concat(none, x["w"]).alias("previous"), running_sums(x["n"]).alias("end")))


def with_answers(docs: DataFrame, answers: dict[str, DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and for each name the answers (doc_id, start, answer) of the document, as blocks of places.

    Answers meet whole documents, so tokens, which are far more rows, are not shuffled. Null ids meet null ids, repeated
    ids have the same answers; of several answers to a place one counts.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    entries = lambda *names: F.map_from_entries(F.collect_list(F.struct(*names)))
    for name, table in answers.items():
        # Dealt by document once, all three aggregates are of one partition.
        placed = table.where("start is not null").select("doc_id", F.col("start").cast("long").alias("start"), "answer").repartition("doc_id")
        one = placed.groupBy("doc_id", F.expr(f"start div {BLOCK}").alias("block"), "start").agg(F.any_value("answer").alias("answer"))
        blocks = one.groupBy("doc_id", "block").agg(entries("start", "answer").alias("places"))
        whole = blocks.groupBy(F.col("doc_id").alias("doc_id_")).agg(entries("block", "places").alias(name))
        out = out.join(whole, F.col("doc_id").eqNullSafe(F.col("doc_id_")), "left").drop("doc_id_")
    return out


def _answered(cut: Column, names: tuple[str, ...]) -> Column:
    """The words of `_cut` with offsets, each with what `with_answers` has for its place."""
    fields = ("gap", "word", "previous", "end")

    def beside(t: Column) -> Column:
        start = t["end"] - F.coalesce(F.length(t["word"]), F.lit(0))
        said = (F.col(n)[F.floor(start / BLOCK)][start].alias(n) for n in names)
        return F.struct(*(t[f].alias(f) for f in fields), *said)

    return F.transform(cut, beside)


def explode_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, answers: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, k, gap, word, previous): each word with the text since the one before. A last row with a null word
    has the rest of the text, so gaps and words in order of k are the text. Null texts are empty. `row` is a
    number for each document row, so null and repeated ids are documents of their own. With `offsets` also start and end, in code points,
    and with them columns of `with_answers`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (_answered(_cut(text, offsets), answers) if answers else _cut(text, offsets)).alias("z"))
    # Outer: otherwise Spark puts a filter on the array below, which would cut each text twice.
    t = cut.select("row", "doc_id", F.posexplode_outer("z").alias("k", "z")).select("row", "doc_id", "k", "z.gap", "z.word", "z.previous", *["z.end"] * offsets, *(f"z.{n}" for n in answers))
    return t.withColumn("start", F.col("end") - F.coalesce(F.length("word"), F.lit(0))) if offsets else t


def by_place() -> Window:
    return Window.partitionBy("row").orderBy("k")


def word_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, text) of all words."""
    t = explode_words(docs, id_col, text_col, offsets=True).where("word is not null")
    return t.select("doc_id", "start", "end", F.col("word").alias("text"))
