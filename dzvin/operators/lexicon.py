"""The stress lexicon: one row for each form with its candidates in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dzvin.functions import alphabet as A
from dzvin.functions.text import lookup_key


def lookup_rows(lookup: DataFrame, active: int, supplementary=A.SUPPLEMENTARY, reviewed=A.REVIEWED, exclusive=A.EXCLUSIVE) -> DataFrame:
    """The archive's `stress_lookup` rows of allowed datasets, as (form, sig, upper, reviewed, exclusive, confidence, rank)."""
    return lookup.where(F.col("dataset_id").isin(sorted({active, *supplementary}))).select(
        lookup_key("form_normalized").alias("form"),
        F.col("stress_signature").alias("sig"),
        _capital("stressed_form").alias("upper"),
        F.col("dataset_id").isin(list(reviewed)).alias("reviewed"),
        F.col("dataset_id").isin(list(exclusive)).alias("exclusive"),
        F.col("confidence").cast("double").alias("confidence"),
        F.col("source_rank").cast("long").alias("rank"),
    )


def contextual_rows(contextual: DataFrame, inventory_hash: str) -> DataFrame:
    """The contextual candidates of one inventory, in the same form: no confidence, last rank."""
    return contextual.where(F.col("inventory_hash") == inventory_hash).select(
        lookup_key("form_normalized").alias("form"), F.col("stress_signature").alias("sig"), _capital("stressed_form").alias("upper"),
        F.lit(False).alias("reviewed"), F.lit(False).alias("exclusive"), F.lit(0.0).alias("confidence"), F.lit(2147483647).cast("long").alias("rank"),
    )


def _capital(c: str) -> Column:
    head = F.substring(F.coalesce(F.col(c), F.lit("")), 1, 1)
    return (head == F.upper(head)) & (head != F.lower(head))


def signature_groups(rows: DataFrame) -> DataFrame:
    """One row for each form and signature."""
    return rows.groupBy("form", "sig").agg(
        F.bool_and("upper").alias("upper"), F.bool_or("reviewed").alias("reviewed"), F.bool_or("exclusive").alias("exclusive"),
        F.max("confidence").alias("confidence"), F.min("rank").alias("rank"),
    )


def drop_subsumed(signatures: Column) -> Column:
    """Without free variations of which one member is there by itself."""
    specific = F.filter(signatures, lambda s: ~s.contains("|"))
    return F.filter(signatures, lambda s: ~(s.contains("|") & F.arrays_overlap(F.split(s, "\\|"), specific)))


def prefer(signatures: Column, wanted: Column) -> Column:
    """The wanted signature moved to the front, if it is one of them."""
    moved = F.concat(F.array(wanted), F.array_remove(signatures, wanted))
    return F.when(wanted.isNotNull() & F.array_contains(signatures, wanted), moved).otherwise(signatures)


def build_lexicon(rows: DataFrame, defaults: DataFrame | None = None, readings: DataFrame | None = None, all_readings: bool = False) -> DataFrame:
    """(form, candidates, proper[, readings]) from rows of `lookup_rows` and `contextual_rows`.

    Candidates: not always capitalised first, then by confidence, rank and signature. The first exclusive one
    stands alone; otherwise the first reviewed one, or the default of `defaults` (form, wanted), goes first.
    `readings` (form, readings) are kept for forms with several candidates.

    Partitioned by form first, both aggregates use one exchange.
    """
    groups = signature_groups(rows.repartition("form"))
    key = F.struct(F.col("upper"), (-F.col("confidence")).alias("c"), F.col("rank"), F.col("sig"), F.col("reviewed"), F.col("exclusive"))
    forms = groups.groupBy("form").agg(F.sort_array(F.collect_list(key)).alias("s"))
    if defaults is not None:
        forms = forms.join(defaults.select("form", "wanted"), "form", "left")
    else:
        forms = forms.withColumn("wanted", F.lit(None).cast("string"))
    first = lambda flag: F.get(F.filter("s", lambda x: x[flag]), F.lit(0))["sig"]
    kept = drop_subsumed(F.transform("s", lambda x: x["sig"]))
    only, decided = first("exclusive"), first("reviewed")
    candidates = F.when(only.isNotNull(), F.array(only)).when(decided.isNotNull(), prefer(kept, decided)).otherwise(prefer(kept, F.col("wanted")))
    proper = F.map_from_entries(F.transform("s", lambda x: F.struct(x["sig"], x["upper"] & x["reviewed"])))
    out = forms.select("form", candidates.alias("candidates"), proper.alias("proper"))
    if readings is not None:
        out = out.join(readings.select("form", "readings"), "form", "left")
        if not all_readings:
            out = out.withColumn("readings", F.when(F.size("candidates") > 1, F.col("readings")))
    return out
