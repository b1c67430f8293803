"""Evaluation: parity, latency, agreement of scores, thresholds, and targets of a gold file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dzvin.functions.text import strip_accents


def parity(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each named pair of columns, how many rows agree (nulls alike), of how many, and the share."""
    n = F.count("*")
    hits = {k: F.count_if(F.col(a).eqNullSafe(F.col(b))) for k, (a, b) in pairs.items()}
    one = rows.agg(n.alias("n"), *(v.alias(k) for k, v in hits.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("matches")) for k in pairs)))
    return one.select("n", each.alias("x")).select("x.measure", "x.matches", "n", F.try_divide("x.matches", "n").alias("share"))


def differences(rows: DataFrame, a: str, b: str, key: list[str], most: int = 10) -> DataFrame:
    """A report of the first rows that disagree."""
    return rows.where(~F.col(a).eqNullSafe(F.col(b))).orderBy(*key).limit(most)


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p.alias("p"))
    return out.select(*by, "n", "mean", *(F.get("p", F.lit(k)).alias(f"p{q}") for k, q in enumerate((50, 95, 99))))


def fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation, straight line, mean and largest difference of two scores."""
    gap = F.abs(F.col(x) - F.col(y))
    return rows.agg(F.corr(x, y).alias("correlation"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(gap).alias("mae"), F.max(gap).alias("max_difference"))


def sweep(rows: DataFrame, spark: SparkSession, agree: Column, a: str, b: str, threshold: float, step: int = 2) -> DataFrame:
    """For thresholds 0, 0.02, ... 1 on `b`: the share of rows where both select or both abstain, and agree when they select."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step)))
    t = rows.select("*", grid.alias("t"))
    same = F.when(F.col(a) >= threshold, (F.col(b) >= F.col("t") / 100) & agree).otherwise(F.col(b) < F.col("t") / 100)
    return t.groupBy("t").agg(F.count_if(same).alias("same"), F.count("*").alias("n")).select((F.col("t") / 100).alias("threshold"), F.try_divide("same", "n").alias("share"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The first of the best."""
    return swept.agg(F.max_by("threshold", F.struct("share", -F.col("threshold"))).alias("threshold"), F.max("share").alias("share"))


def gold_targets(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, line, text) of a gold file -> (doc_id, line, form, start, end): the first whole-word match of the form that the
    last `# form:` line named.
    """
    named = F.when(F.col("text").startswith("# form:"), F.lower(F.trim(F.substring("text", 8, 1_000_000))))
    w = Window.partitionBy("doc_id").orderBy("line")
    t = lines.withColumn("form", F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.where(~F.col("text").startswith("#") & (F.trim("text") != "") & F.col("form").isNotNull()).withColumn("plain", F.lower(strip_accents("text")))
    letter = "[\\p{L}\\p{Nl}\\p{No}\\p{Nd}_]"
    piece = F.concat(F.lit(f"^((?s:.*?)(?<!{letter}))"), F.lit("\\Q"), F.col("form"), F.lit(f"\\E(?!{letter})"))
    start = F.when(F.regexp_like("plain", piece), F.length(F.call_function("regexp_extract", F.col("plain"), piece, F.lit(1))))
    out = t.select("doc_id", "line", "form", start.alias("start"), (start + F.length("form")).alias("end")).where("start is not null")
    return out if limit is None else out.orderBy("doc_id", "line").limit(limit)
