"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dzvin.llm import decontam, packing, quality_lr, rules, secrets, sharding, simhash, sst, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(_table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secrets.listing(base), 256).alias("base_sha256"), secrets.listing(F.col("spans")).alias("spans"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of_pages(_table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return found.withColumn("headers", headers)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _labelled(spark: SparkSession, sf_dir: str, label: str, folds: int, held_out: int) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", label)
    return labels.where(quality_lr.fold(F.col("doc_id"), folds) != held_out)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = quality_lr.fit(docs, _labelled(spark, sf_dir, "quality", 3, 1))
    scored = quality_lr.score(docs.select("doc_id", "text"), weights, "score")
    held_out = F.coalesce(quality_lr.fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _labelled(spark, sf_dir, "toxic", 4, 2))
    held_out = F.coalesce(quality_lr.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rules.judge(_table(spark, sf_dir, "documents")).select("doc_id", *(F.col(f"q.{n}") for n in names), "base_failed", "kept")


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.token_tables(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secret_scans": op2_secret_scans,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_lexical_packing": op8_lexical_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_token_tables": op10_token_tables,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "list_filter(string_split_regex({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
_SHINGLES = "SELECT DISTINCT {0}, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT {0}, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM {1})"

#: Items of five words or more, as all of the benchmark are.
_OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
b AS (SELECT min(item_id) AS item_id, count(*) AS item_copies, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS ws FROM benchmark GROUP BY text),
ds AS ({_SHINGLES.format("doc_id", "d")}), bs AS ({_SHINGLES.format("item_id", "b")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_copies, n_shingles, n_found, n_found / n_shingles AS containment
FROM f JOIN n USING (item_id) JOIN b USING (item_id) WHERE n_found * 10 >= n_shingles * 8
"""

_METRICS = {"sign_share": "10000 * n_symbols // greatest(word_chars, 1)", "line_share": "10000 * n_dup_lines // greatest(n_lines, 1)", "repeat_share": "10000 * n_repeat_words // greatest(n_words, 1)", "caps_share": "10000 * n_caps // greatest(word_chars, 1)", "word_length": "100 * word_chars // greatest(n_words, 1)", "words": "n_words", "lines": "n_lines"}


def _quartiles(name: str, source: str, keys: str) -> str:
    """The buckets that hold the quarters of each sketch."""
    by = f"PARTITION BY {keys}{', ' if keys else ''}metric"
    comma = f"{keys}, " if keys else ""
    return (
        f"{name}0 AS (SELECT {comma}metric, bucket, sum(n) AS n FROM {source} GROUP BY ALL), "
        f"{name}1 AS (SELECT *, sum(n) OVER ({by}) AS rows_, sum(n) OVER ({by} ORDER BY bucket) AS seen FROM {name}0), "
        f"{name} AS (SELECT {comma}metric, any_value(rows_) AS rows_, {", ".join(f"min(CASE WHEN seen * 4 >= rows_ * {k} THEN bucket END) AS q{k}" for k in (1, 2, 3))} FROM {name}1 GROUP BY ALL)"
    )


#: A quartile of the sketch {0}, drawn towards that of {1}.
_DRAWN = f"CAST(({{0}}.rows_ * {{0}}.q{{2}} + {rules.SMOOTHING} * {{1}}.q{{2}}) // ({{0}}.rows_ + {rules.SMOOTHING}) AS BIGINT) AS q{{2}}"
_UNITS = {
    "sign_share": "10000 // greatest(words_q2, 1)", "caps_share": "10000 // greatest(words_q2, 1)", "line_share": "10000 // greatest(lines_q2, 1)",
    "repeat_share": f"{20_000 * rules.WINDOW} // greatest(words_q2, 1)", "word_length": "word_length_q2 // 10",
}
_REACH = f"greatest({rules.SPREADS} * ({{0}}_q3 - {{0}}_q1), {rules.UNITS} * ({{1}}))"

_OP7 = f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM t),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w)),
r AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM r),
k AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
q AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_caps FROM w LEFT JOIN k ON k.doc_id = w.doc_id),
m AS (SELECT *, {", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _METRICS.items())} FROM q),
u AS (UNPIVOT (SELECT doc_id, lang, source, {", ".join(_METRICS)} FROM m) ON {", ".join(_METRICS)} INTO NAME metric VALUE v),
own0_ AS (SELECT lang, source, metric, (v >> CAST(greatest(length(bin(v)) - 6, 0) AS BIGINT)) << CAST(greatest(length(bin(v)) - 6, 0) AS BIGINT) AS bucket, count(*) AS n FROM u GROUP BY ALL),
{_quartiles("own", "own0_", "lang, source")}, {_quartiles("per", "own0_", "lang")}, {_quartiles("whole", "own0_", "")},
up AS (SELECT l.lang, l.metric, {", ".join(_DRAWN.format("l", "a", k) for k in (1, 2, 3))} FROM per l JOIN whole a ON a.metric = l.metric),
p AS (SELECT o.lang, o.source, o.metric, {", ".join(_DRAWN.format("o", "l", k) for k in (1, 2, 3))} FROM own o JOIN up l ON l.lang IS NOT DISTINCT FROM o.lang AND l.metric = o.metric),
g AS (SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{k}' THEN q{i} END) AS {k}_q{i}" for k in _METRICS for i in (1, 2, 3))} FROM p GROUP BY lang, source),
f AS (SELECT lang, source, {", ".join(f"{k}_q3 + {_REACH.format(k, v)} AS {k}_high" for k, v in _UNITS.items())}, word_length_q1 - {_REACH.format("word_length", _UNITS["word_length"])} AS low FROM g),
x AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, word_length >= low AND {" AND ".join(f"{k} <= {k}_high" for k in _UNITS)} AS good
  FROM m JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM x
"""

ORACLE_SQL: dict[str, str] = {"op4_benchmark_decontamination": _OP4, "op7_quality_rules": _OP7}
