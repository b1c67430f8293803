"""Ukrainian-looking input from the driver's tables, in Spark and in SQL alike.

The driver's documents are in four languages of Latin script; a fixed transliteration gives the stress
operators words to work on. An archive-shaped lookup table is made from the words by whole-number rules.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dzvin.functions import alphabet as A
from dzvin.functions import text as T
from dzvin.operators.lexicon import build_lexicon, lookup_rows
from dzvin.operators.tables import made_once

# The transliteration, lower and upper case.
_FROM, _TO = "abcdefghijklmnopqrstuvwxyzéèêóíñçüäöß", "абцдефгхійклмнопярстувьхизєїюоіґчюяєщ"
FROM = _FROM + "".join(c.upper() for c in _FROM if c != "ß")
TO = _TO + "".join(t.upper() for c, t in zip(_FROM, _TO, strict=True) if c != "ß")
ACTIVE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_chars), transliterated."""
    return table(spark, sf_dir, "documents").select("doc_id", F.translate("text", FROM, TO).alias("text"), "n_chars")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, word), one row for each word of each document."""
    return documents(spark, sf_dir).select("doc_id", "n_chars", F.explode(F.regexp_extract_all("text", F.lit(A.WORD), F.lit(0))).alias("word"))


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word").distinct()


def lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's `stress_lookup`, from words with two vowels or more."""
    w = words(spark, sf_dir).groupBy("doc_id", "n_chars", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    v = w.withColumn("v", T.vowel_count("word")).where("v >= 2")
    form = F.when(F.col("doc_id") % 11 == 0, F.upper("word")).otherwise(F.col("word"))
    return v.select(
        (F.col("doc_id") % 20).cast("int").alias("dataset_id"), F.col("word").alias("form_normalized"), form.alias("stressed_form"),
        ((7 * F.col("doc_id") + F.col("n")) % F.col("v")).cast("string").alias("stress_signature"),
        ((F.col("n_chars") % 100) / 100).alias("confidence"), F.col("doc_id").alias("source_rank"),
    )


def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_rows(lookup_table(spark, sf_dir), ACTIVE)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once, as an engine's is on opening."""
    return made_once(build_lexicon(lexicon_rows(spark, sf_dir)))


def suffixes(lex: DataFrame, least: int = 5) -> DataFrame:
    """(suffix, from_end): of each three last letters seen in so many forms or more, the most frequent vowel from the end."""
    one = lex.select("form", (T.vowel_count("form") - 1 - F.get("candidates", F.lit(0)).cast("int")).alias("from_end"))
    counted = one.select(F.expr("right(form, 3)").alias("suffix"), "from_end").groupBy("suffix", "from_end").agg(F.count("*").alias("n"))
    best = counted.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), "from_end")).alias("x"), F.sum("n").alias("n"))
    return made_once(best.where(F.col("n") >= least).select("suffix", F.col("x.from_end").alias("from_end")))


def q(text: str) -> str:
    return text.replace("'", "''")


_DECOMPOSED = "{0}"
for _letter in "йЙїЇёЁ":
    _DECOMPOSED = f"replace({_DECOMPOSED}, '{_letter}', '{unicodedata.normalize('NFD', _letter)}')"
_HYPHENED = f"regexp_replace({{0}}, '(\\S)[{A.HYPHENS}](\\S)', '\\1-\\2', 'g')"
CANONICAL = _HYPHENED.format(_HYPHENED.format(f"translate({_DECOMPOSED}, '{q(A.APOSTROPHES)}', '{A.APOSTROPHE * len(A.APOSTROPHES)}')"))
_KEY = f"replace(lower({CANONICAL}), '{A.ACUTE}', '')"


def key_sql(c: str) -> str:
    return _KEY.replace("{0}", c)


def vowels_sql(c: str) -> str:
    """The count of vowels of a word without other decomposing letters: й counts."""
    return f"length(regexp_replace(lower({c}),'[^аеєиіїоуюяй]','','g'))"


def units_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '{A.UNIT}')"


def plain_sql(word: str, ordinal: str) -> str:
    """A single ordinal set in a word without breaks; null where it does not fit."""
    u = units_sql(word)
    return (
        f"CASE WHEN regexp_matches({u}[{ordinal} + 1], '[{A.COUNTED}]{A.MARKS}*$') "
        f"THEN array_to_string({u}[1:{ordinal} + 1], '') || '́' || coalesce(array_to_string({u}[{ordinal} + 2:], ''), '') END"
    )


#: Common table expressions for the oracles.
DOCS = f"docs AS (SELECT doc_id, n_chars, translate(text, '{FROM}', '{TO}') AS text FROM documents)"
_CUT = f"cut AS (SELECT doc_id, n_chars, regexp_extract_all(text, '{q(A.WORD)}') AS ws, string_split_regex(text, '{q(A.WORD)}') AS gs FROM docs)"
TOKENS = (
    f"{DOCS}, {_CUT}, idx AS (SELECT *, unnest(generate_series(1, len(gs))) AS i FROM cut), "
    "tok0 AS (SELECT doc_id, n_chars, i - 1 AS k, gs[i] AS gap, ws[i] AS word FROM idx), "
    'tok AS (SELECT *, sum(length(gap) + coalesce(length(word), 0)) OVER (PARTITION BY doc_id ORDER BY k) AS "end" FROM tok0), '
    'tokens AS (SELECT doc_id, n_chars, k, gap, word, "end" - length(word) AS start, "end" FROM tok WHERE word IS NOT NULL)'
)
LOOKUP = (
    f"lw AS (SELECT doc_id, n_chars, lower(word) AS word, count(*) AS n FROM tokens GROUP BY ALL), lv AS (SELECT *, {vowels_sql('word')} AS v FROM lw), "
    "lookup AS (SELECT doc_id % 20 AS dataset_id, word, doc_id % 11 = 0 AS is_up, CAST((7 * doc_id + n) % v AS VARCHAR) AS sig, (n_chars % 100) / 100 AS confidence, doc_id AS rank FROM lv WHERE v >= 2), "
    f"lrows AS (SELECT {key_sql('word')} AS form, sig, is_up, dataset_id IN (12, 13) AS reviewed, dataset_id IN (13, 18) AS exclusive, confidence, rank FROM lookup WHERE dataset_id IN (2, 5, 7, 9, 10, 12, 13, 16, 18, 19)), "
    "lsig AS (SELECT form, sig, bool_and(is_up) AS is_up, bool_or(reviewed) AS reviewed, bool_or(exclusive) AS exclusive, max(confidence) AS confidence, min(rank) AS rank FROM lrows GROUP BY form, sig)"
)
LEXICON = (
    f"{LOOKUP}, lform AS (SELECT form, list(sig ORDER BY is_up, confidence DESC, rank, sig) AS sigs, list({{'s': sig, 'r': reviewed, 'x': exclusive, 'p': is_up AND reviewed}} ORDER BY is_up, confidence DESC, rank, sig) AS xs FROM lsig GROUP BY form), "
    "lpick AS (SELECT form, sigs, xs, list_filter(xs, lambda z: z.x)[1].s AS only_, list_filter(xs, lambda z: z.r)[1].s AS decided FROM lform), "
    "lexicon AS (SELECT form, CASE WHEN only_ IS NOT NULL THEN [only_] WHEN decided IS NOT NULL THEN list_concat([decided], list_filter(sigs, lambda z: z <> decided)) ELSE sigs END AS candidates, xs FROM lpick)"
)
SUFFIXES = (
    f"sx AS (SELECT right(form, 3) AS suffix, length(regexp_replace(form, '[^аеєиіоуюя]', '', 'g')) - 1 - CAST(candidates[1] AS INT) AS from_end, count(*) AS n FROM lexicon GROUP BY ALL), "
    "suffixes AS (SELECT suffix, min({'n': -n, 'e': from_end}).e AS from_end FROM sx GROUP BY suffix HAVING sum(n) >= 5)"
)
_SKIP = "[\\s«»\"''„“”‘’()\\[\\]—–\\-]+$"
CLASSIFIED = (
    f"ini AS (SELECT *, {key_sql('word')} AS key, regexp_replace(gap, '{_SKIP}', '') AS rest FROM tokens), "
    "initial AS (SELECT *, CASE WHEN rest = '' THEN k = 0 ELSE contains('.!?…:', right(rest, 1)) END AS initial FROM ini), "
    f"cls0 AS (SELECT t.*, {vowels_sql('t.word')} AS vowels, l.candidates AS cands, l.xs AS xs, upper(left(t.word, 1)) = left(t.word, 1) AS cap FROM initial t LEFT JOIN lexicon l ON l.form = t.key), "
    "cls1 AS (SELECT *, list_filter(cands, lambda c: list_contains(list_transform(list_filter(xs, lambda z: z.p), lambda z: z.s), c)) AS names FROM cls0), "
    "cls2 AS (SELECT *, list_filter(cands, lambda c: NOT list_contains(names, c)) AS common FROM cls1), "
    "cls3 AS (SELECT *, CASE WHEN len(cands) < 2 OR len(names) = 0 OR len(common) = 0 THEN NULL WHEN NOT cap THEN common WHEN NOT initial THEN names END AS pref FROM cls2), "
    "classified AS (SELECT doc_id, k, gap, word, start, \"end\", key, initial, vowels, CASE WHEN pref IS NULL THEN cands WHEN len(pref) = 1 THEN pref ELSE list_concat(pref, list_filter(cands, lambda c: NOT list_contains(pref, c))) END AS candidates FROM cls3), "
    f"status1 AS (SELECT *, CASE WHEN vowels = 0 THEN 'not_required' WHEN candidates IS NULL OR len(candidates) = 0 THEN 'not_found' WHEN len(candidates) > 1 THEN 'model_ineligible' ELSE 'stressed' END AS st FROM classified)"
)
