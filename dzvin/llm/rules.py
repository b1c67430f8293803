"""Quality rules with adaptive thresholds, in DataFrame operations alone.

Six whole numbers describe a text's make-up. For each language and source a quantile sketch of each is
kept: counts of log-linear buckets (exact below 64, then 32 to a power of two, so within 1/32 of the
value). Such sketches merge by adding counts, in any order and with the same result, over partitions,
over days, and over groups. A group's quartiles are drawn towards those of its language, and these
towards those of all rows, each by the weight of SMOOTHING rows, so that groups of any size follow one rule.

A metric's upper fence is its third quartile plus SPREADS times the spread between the quartiles. Most
plain texts have no sign and no repeat at all; where the spread is under half a unit of a text of the
group's median size (one word of signs or capitals, one repeated line, one repeated window) UNITS such
units take its place. Average word length has a lower fence too. All numbers of a fence come from the
sketches of the group; the fences, a row for each group, are joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dzvin.llm.common import cut_lineage

SPACES = "\\x20\\x09-\\x0D"
SIGNS = "#*$%&|<>"
WINDOW = 8
#: Rows that the sketch above a group weighs against the group's own.
SMOOTHING = 50
#: Spreads between the quartiles, or units of a median text, from the third quartile to a fence.
SPREADS, UNITS = 6, 3
METRICS = ["sign_share", "line_share", "repeat_share", "caps_share", "word_length"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and `q`, a struct of counts; null is an empty text. Other columns are not read.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_caps (letters A to Z).

    Windows of eight words are 64-bit hashes in an array of the row. Most texts have none twice, which
    the distinct count settles; only the others are sorted, and each repeated window adds the words that
    the one before it did not cover.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = out.withColumn("w", F.transform(F.regexp_extract_all("t", F.lit(f"[^{SPACES}]+"), F.lit(0)), lambda w: F.xxhash64(w)))
    slots = F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))
    windows = F.transform(slots, lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    out = out.withColumn("h", F.when(F.size("w") >= WINDOW, windows).otherwise(F.array().cast("array<long>")))
    placed = F.sort_array(F.transform("h", lambda h, k: F.struct(h.alias("h"), k.alias("i"))))
    out = out.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed))
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    out = out.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    added = F.transform("p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - p, F.lit(WINDOW))))
    out = out.withColumn("l", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")))
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.translate("t", "\x20\x09\x0a\x0b\x0c\x0d", "")),
        "n_symbols": F.length("t") - F.length(F.translate("t", SIGNS, "")),
        "n_lines": F.size("l"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": F.coalesce(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(0)),
        "n_caps": F.length(F.regexp_replace("t", "[^A-Z]", "")),
    }
    return out.select("doc_id", "lang", "source", F.struct(*(v.cast("long").alias(k) for k, v in counts.items())).alias("q"))


def metrics(q: Column) -> dict[str, Column]:
    share = lambda part, whole: F.expr("10000L") * part / F.greatest(whole, F.lit(1))
    return {
        "sign_share": F.floor(share(q["n_symbols"], q["word_chars"])),
        "line_share": F.floor(share(q["n_dup_lines"], q["n_lines"])),
        "repeat_share": F.floor(share(q["n_repeat_words"], q["n_words"])),
        "caps_share": F.floor(share(q["n_caps"], q["word_chars"])),
        "word_length": F.floor(F.expr("100L") * q["word_chars"] / F.greatest(q["n_words"], F.lit(1))),
        # Sizes, for the units.
        "words": q["n_words"],
        "lines": q["n_lines"],
    }


def bucket(v: Column) -> Column:
    """The lower end of a value's bucket: 32 buckets to each power of two, exact below 64."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the metrics of rows with keys and `m`, a struct of metrics: keys, metric, bucket, n."""
    names = rows.schema["m"].dataType.names
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col("m")[m]).alias("bucket")) for m in names)))
    return rows.select(*keys, one.alias("x")).groupBy(*keys, F.col("x.metric").alias("metric"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, n, q1, q2, q3 of each sketch: the buckets in which the quarters of its rows lie."""
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "n")))  # a sketch: at most 2,000 buckets
    s = sketches.groupBy(*keys, "metric").agg(F.sum("n").alias("n"), ordered.alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))

    def at(quarter: int) -> Column:
        def step(a: Column, x: Column) -> Column:
            seen = a["seen"] + x["n"]
            return F.struct(seen.alias("seen"), F.coalesce(a["at"], F.when(seen * 4 >= F.col("n") * quarter, x["bucket"])).alias("at"))

        return F.aggregate("s", zero, step)["at"]

    return s.select(*keys, "metric", "n", *(at(k).alias(f"q{k}") for k in (1, 2, 3)))


def _drawn(n: Column, own: Column, above: Column) -> Column:
    """A quartile drawn towards the one above, in whole numbers."""
    return F.floor((n.cast("decimal(38,0)") * own + F.lit(SMOOTHING) * above) / (n + SMOOTHING)).cast("long")


def fences(measured: DataFrame) -> DataFrame:
    """(lang, source) -> `f`, a struct of fences; nulls are a language or a source of their own."""
    m = F.struct(*(v.cast("long").alias(k) for k, v in metrics(F.col("q")).items()))
    own = sketch(measured.select("lang", "source", m.alias("m")), ["lang", "source"])
    a, b, c = (quartiles(s, k) for s, k in ((own, ["lang", "source"]), (merge(own, ["lang"]), ["lang"]), (merge(own, []), [])))
    quarters = ("q1", "q2", "q3")
    c = c.select(F.col("metric").alias("metric3"), *(F.col(q).alias(f"c{q}") for q in quarters))
    b = b.join(F.broadcast(c), F.col("metric") == F.col("metric3"))  # a row for each metric
    b = b.select(F.col("lang").alias("lang2"), F.col("metric").alias("metric2"), *(_drawn(F.col("n"), F.col(q), F.col(f"c{q}")).alias(f"b{q}") for q in quarters))
    j = a.join(b, a["lang"].eqNullSafe(b["lang2"]) & (a["metric"] == b["metric2"]))
    j = j.select("lang", "source", "metric", *(_drawn(F.col("n"), F.col(q), F.col(f"b{q}")).alias(q) for q in quarters))
    of = lambda k, q: F.max(F.when(F.col("metric") == k, F.col(q))).alias(f"{k}_{q}")
    g = j.groupBy("lang", "source").agg(*(of(k, q) for k in [*METRICS, "words", "lines"] for q in quarters))
    per = lambda size, times: F.floor(F.lit(times) / F.greatest(F.col(f"{size}_q2"), F.lit(1)))
    unit = {
        "sign_share": per("words", 10_000), "caps_share": per("words", 10_000), "line_share": per("lines", 10_000), "repeat_share": per("words", 10_000 * 2 * WINDOW),
        "word_length": F.floor(F.col("word_length_q2") / 10),
    }
    reach = {k: F.greatest(SPREADS * (F.col(f"{k}_q3") - F.col(f"{k}_q1")), UNITS * unit[k]) for k in METRICS}
    high = [(F.col(f"{k}_q3") + reach[k]).cast("long").alias(k) for k in METRICS]
    low = (F.col("word_length_q1") - reach["word_length"]).cast("long").alias("word_length_low")
    return g.select("lang", "source", F.struct(*high, low).alias("f"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, lang, source, q (counts), f (fences of its group), base_failed, kept.

    Base: fewer than 20 words, or over 30 in 100 words in repeated windows. Empty and null texts fail the
    base. Null languages and sources are groups of their own. Repeated rows are judged alike. An empty table
    gives no rows. Other columns are not read.
    """
    measured = cut_lineage(measure(docs, id_col, text_col, lang_col, source_col))
    # A row for each group.
    limits = cut_lineage(fences(measured)).select(F.col("lang").alias("lang2"), F.col("source").alias("source2"), "f")
    out = measured.join(limits, F.col("lang").eqNullSafe(F.col("lang2")) & F.col("source").eqNullSafe(F.col("source2"))).drop("lang2", "source2")
    q, f = F.col("q"), F.col("f")
    failed = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    m = metrics(q)
    good = m["word_length"] >= f["word_length_low"]
    for k in METRICS:
        good = good & (m[k] <= f[k])
    return out.withColumns({"base_failed": failed, "kept": ~failed & good})
