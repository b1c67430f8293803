"""The registered queries of the stress operators over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dzvin.functions import alphabet as A
from dzvin.functions import text as T
from dzvin.operators import combiner, lexicon, metrics, morphology, scoring, segment, spans, tiers, tokens
from dzvin.operators.tables import sendable
from dzvin.plans import corpus as C
from dzvin.plans.engine import SpeechFrontend, StressEngine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _joined(c) -> F.Column:
    return F.array_join(c, ",")


_WORDS = f"WITH {C.TOKENS}, w AS (SELECT DISTINCT word FROM tokens)"
_LEX = f"WITH {C.TOKENS}, {C.LEXICON}"
_CLS = f"{_LEX}, {C.CLASSIFIED}"


# Scalars


@query(f"{_WORDS} SELECT word, {C.key_sql('word')} AS key FROM w")
def lookup_key(spark, sf_dir):
    return C.distinct_words(spark, sf_dir).select("word", T.lookup_key("word").alias("key"))


@query(f"{_WORDS} SELECT word, {C.vowels_sql('word')} AS vowels FROM w")
def vowel_count(spark, sf_dir):
    return C.distinct_words(spark, sf_dir).select("word", T.vowel_count("word").alias("vowels"))


_RENDERED = "SELECT l.form AS word, l.candidates[1] AS sig FROM lexicon l"


def _form_words(spark, sf_dir):
    """(word, sig): each form of the lexicon, decomposed as it is, with its first candidate."""
    return C.lexicon(spark, sf_dir).select(F.col("form").alias("word"), F.get("candidates", F.lit(0)).alias("sig"))


@query(f"{_LEX}, r AS ({_RENDERED}) SELECT word, sig, {C.plain_sql('word', 'CAST(sig AS INT)')} AS stressed FROM r WHERE NOT regexp_matches(word, '[{A.BREAK_CLASS}]')")
def apply_signature(spark, sf_dir):
    rows = _form_words(spark, sf_dir).where(~F.col("word").rlike(f"[{A.BREAK_CLASS}]"))
    return rows.select("word", "sig", T.apply_signature("word", "sig").alias("stressed"))


_ACUTED = f"r AS ({_RENDERED}), a AS (SELECT word, sig, {C.plain_sql('word', 'CAST(sig AS INT)')} AS stressed FROM r WHERE NOT regexp_matches(word, '[{A.BREAK_CLASS}]'))"


def _acuted(spark, sf_dir):
    rows = _form_words(spark, sf_dir).where(~F.col("word").rlike(f"[{A.BREAK_CLASS}]"))
    return rows.select("sig", T.render("word", "sig").alias("stressed"))


@query(f"{_LEX}, {_ACUTED} SELECT stressed, CAST(length(regexp_replace(split_part(stressed, '́', 1), '[^аеєиіоуюя]', '', 'g')) - 1 AS VARCHAR) AS sig FROM a")
def signature_of_output(spark, sf_dir):
    return _acuted(spark, sf_dir).select("stressed", T.signature_of_output("stressed").alias("sig"))


@query(f"{_LEX}, {_ACUTED} SELECT stressed, CASE WHEN regexp_matches(stressed, '[^аеєиіоуюя̈]́') OR regexp_matches(stressed, '[ыэъ]') THEN NULL ELSE sig END AS sig FROM a")
def stress_signature(spark, sf_dir):
    return _acuted(spark, sf_dir).select("stressed", T.stress_signature("stressed").alias("sig"))


_RAW = "raw AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]+')) AS word FROM docs)"
_LOW = A.LETTERS.replace("й", "").replace("ї", "")
_GOOD = f"^(?:[Ии]{A.BREVE}|[Іі]{A.DIAERESIS}|[{_LOW}{_LOW.upper()}{A.APOSTROPHE}{A.ACUTE} \\t-])*"
_NFD = C.CANONICAL.replace("{0}", "word")


@query(
    f"WITH {C.DOCS}, {_RAW}, n AS (SELECT word, {_NFD} AS t FROM raw), b AS (SELECT word, t, left(regexp_replace(t, '{C.q(_GOOD)}', ''), 1) AS bad FROM n) "
    "SELECT word, CASE WHEN t = '' THEN 'empty form' WHEN bad = '' THEN NULL WHEN regexp_matches(bad, '^\\p{C}') THEN 'control character' WHEN regexp_matches(bad, '^\\p{M}') THEN 'unsupported combining mark' ELSE 'unsupported character' END AS problem FROM b"
)
def validate_characters(spark, sf_dir):
    raw = C.documents(spark, sf_dir).select(F.explode(F.split("text", "[ \\n]+", -1)).alias("word")).distinct()
    return raw.select("word", T.char_problem("word").alias("problem"))



@query(
    f"WITH {C.TOKENS}, m AS (SELECT DISTINCT word, left(word, length(word) // 2) || '́' || substring(word, length(word) // 2 + 1) AS marked FROM tokens) "
    "SELECT marked, CASE WHEN regexp_matches(marked, '[ыэъЫЭЪ]') THEN 'unsupported character' WHEN regexp_matches(marked, '(^|[^аеєиіїоуюяАЕЄИІЇОУЮЯ])́') THEN 'acute must immediately follow a Ukrainian vowel' END AS problem FROM m"
)
def validate_stress(spark, sf_dir):
    half = F.floor(F.length("word") / 2).cast("int")
    marked = F.concat(F.substring("word", F.lit(1), half), F.lit(A.ACUTE), F.substring("word", half + 1, F.length("word")))
    return C.distinct_words(spark, sf_dir).select(marked.alias("marked")).select("marked", T.stress_problem("marked").alias("problem"))


# Tokens


@query(f'WITH {C.TOKENS} SELECT doc_id, start, "end", word AS text FROM tokens')
def word_tokens(spark, sf_dir):
    return tokens.word_tokens(C.documents(spark, sf_dir))


@query(f"WITH {C.TOKENS} SELECT lower(word) AS form, count(*) AS n FROM tokens GROUP BY 1")
def distinct_forms(spark, sf_dir):
    return C.words(spark, sf_dir).groupBy(F.lower("word").alias("form")).agg(F.count("*").alias("n"))


# Lexicon


@query(f"WITH {C.TOKENS}, {C.LOOKUP} SELECT form, sig, is_up AS upper, reviewed, exclusive, confidence, rank FROM lsig")
def lexicon_sig_agg(spark, sf_dir):
    return lexicon.signature_groups(C.lexicon_rows(spark, sf_dir))


@query(f"{_LEX} SELECT form, array_to_string(candidates, ',') AS candidates FROM lexicon")
def lexicon_candidates(spark, sf_dir):
    return C.lexicon(spark, sf_dir).select("form", _joined("candidates").alias("candidates"))


@query(f"{_LEX} SELECT form, z.s AS sig, z.p AS proper FROM (SELECT form, unnest(xs) AS z FROM lexicon)")
def lexicon_proper_map(spark, sf_dir):
    return C.lexicon(spark, sf_dir).select("form", F.explode("proper").alias("sig", "proper"))


@query(
    f"WITH {C.TOKENS}, {C.LOOKUP}, f AS (SELECT form, list(sig ORDER BY is_up, confidence DESC, rank, sig) AS sigs, CAST(length(form) % 3 AS VARCHAR) AS wanted FROM lsig GROUP BY form) "
    "SELECT form, wanted, array_to_string(CASE WHEN list_contains(sigs, wanted) THEN list_concat([wanted], list_filter(sigs, lambda z: z <> wanted)) ELSE sigs END, ',') AS candidates FROM f"
)
def lexicon_trie_default(spark, sf_dir):
    """The order of candidates with a default that depends on the form's length, and no dataset that is reviewed or exclusive."""
    rows = C.lexicon_rows(spark, sf_dir).withColumns({"reviewed": F.lit(False), "exclusive": F.lit(False)})
    defaults = rows.select("form").distinct().withColumn("wanted", (F.length("form") % 3).cast("string"))
    return lexicon.build_lexicon(rows, defaults).select("form", (F.length("form") % 3).cast("string").alias("wanted"), _joined("candidates").alias("candidates"))


@query(
    f"WITH {C.TOKENS}, {C.LOOKUP}, f AS (SELECT form, list(sig ORDER BY sig) AS sigs FROM lsig GROUP BY form), g AS (SELECT form, list_concat(sigs, [sigs[1] || '|9', '7|8']) AS sigs FROM f) "
    "SELECT form, array_to_string(list_filter(sigs, lambda z: NOT (contains(z, '|') AND list_has_any(string_split(z, '|'), list_filter(sigs, lambda y: NOT contains(y, '|'))))), ',') AS kept FROM g"
)
def drop_subsumed(spark, sf_dir):
    f = lexicon.signature_groups(C.lexicon_rows(spark, sf_dir)).groupBy("form").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))
    free = F.array(F.concat(F.get("sigs", F.lit(0)), F.lit("|9")), F.lit("7|8"))
    return f.select("form", _joined(lexicon.drop_subsumed(F.concat("sigs", free))).alias("kept"))


@query(f"{_LEX} SELECT t.doc_id, t.start, t.word, array_to_string(l.candidates, ',') AS candidates FROM tokens t LEFT JOIN lexicon l ON l.form = {C.key_sql('t.word')}")
def lexicon_lookup_join(spark, sf_dir):
    t = tokens.word_tokens(C.documents(spark, sf_dir)).withColumn("form", T.lookup_key("text"))
    j = t.join(sendable(C.lexicon(spark, sf_dir).select("form", "candidates")), "form", "left")
    return j.select("doc_id", "start", F.col("text").alias("word"), _joined("candidates").alias("candidates"))


# Tiers


def _base(spark, sf_dir) -> DataFrame:
    return tokens.explode_words(C.documents(spark, sf_dir), offsets=True)


def _classified(spark, sf_dir, offsets: bool = True) -> DataFrame:
    t = tokens.explode_words(C.documents(spark, sf_dir), offsets=offsets)
    return tiers.classify(t, C.lexicon(spark, sf_dir)).where("word is not null")


@query(f"{_CLS} SELECT st AS status, count(*) AS n FROM status1 GROUP BY 1")
def token_class_counts(spark, sf_dir):
    return _classified(spark, sf_dir, offsets=False).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_CLS} SELECT doc_id, start, word, initial FROM initial")
def sentence_initial(spark, sf_dir):
    t = _base(spark, sf_dir).where("word is not null")
    return t.select("doc_id", "start", "word", T.opens_sentence(F.col("gap"), F.col("k") == 0).alias("initial"))


@query(f"{_CLS} SELECT doc_id, start, word, array_to_string(candidates, ',') AS candidates FROM status1 WHERE vowels > 0 AND len(candidates) > 0")
def by_capitalisation(spark, sf_dir):
    return _classified(spark, sf_dir).where(F.size("candidates") > 0).select("doc_id", "start", "word", _joined("candidates").alias("candidates"))


_PRONOUNS = "'" + "','".join(A.SHIFTED_PRONOUNS) + "'"
_PREPOSITIONS = "'" + "','".join(A.PREPOSITIONS) + "'"
#: Each document with a line in which pronouns follow prepositions, and some do not.
_PAIRED = "text || ' до мене, без нього; до, неї на\nсебе і мене'"


@query(
    f"WITH {C.TOKENS.replace(C.DOCS, C.DOCS.replace('AS text FROM', 'AS text0 FROM').replace('docs AS', 'docs0 AS') + ', docs AS (SELECT doc_id, n_chars, ' + _PAIRED.replace('text ||', 'text0 ||') + ' AS text FROM docs0)')}, "
    "l AS (SELECT *, lag(lower(word)) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM tokens) "
    f"SELECT doc_id, start, word FROM l WHERE lower(word) IN ({_PRONOUNS}) AND before IN ({_PREPOSITIONS}) AND regexp_matches(gap, '^\\s+$')"
)
def prepositional_shift(spark, sf_dir):
    docs = C.documents(spark, sf_dir).withColumn("text", F.expr(_PAIRED.replace("\n", "\\n")))
    t = tokens.explode_words(docs, offsets=True).withColumns({"status": F.lit("not_found"), "output": F.col("word")})
    return tiers.prepositional_shift(t).where("status = 'prepositional'").select("doc_id", "start", "word")


#: Words joined in pairs: a known form, a hyphen and the form that follows it in the same document.
_PAIRS_SQL = f"p AS (SELECT DISTINCT word || '-' || lead(word) OVER (PARTITION BY doc_id ORDER BY k) AS word FROM tokens), q AS (SELECT word, string_split(word, '-') AS ps FROM p WHERE word IS NOT NULL AND length(word) - length(replace(word, '-', '')) = 1)"


@query(
    f"{_LEX}, {_PAIRS_SQL}, "
    f"x AS (SELECT q.word, q.ps, a.candidates[1] AS s1, b.candidates[1] AS s2 FROM q LEFT JOIN lexicon a ON a.form = {C.key_sql('q.ps[1]')} LEFT JOIN lexicon b ON b.form = {C.key_sql('q.ps[2]')}), "
    f"y AS (SELECT word, ps, {C.plain_sql('ps[1]', 'CAST(s1 AS INT)')} AS m1, {C.plain_sql('ps[2]', 'CAST(s2 AS INT)')} AS m2 FROM x) "
    "SELECT word, coalesce(m1, ps[1]) || '-' || coalesce(m2, ps[2]) AS output FROM y WHERE m1 IS NOT NULL OR m2 IS NOT NULL"
)
def compound_fallback(spark, sf_dir):
    nxt = F.lead("word").over(tokens.by_place())
    w = _base(spark, sf_dir).where("word is not null").select(F.concat_ws("-", "word", nxt).alias("word"), nxt.alias("n")).where("n is not null").select("word").distinct()
    w = w.where(F.length("word") - F.length(F.replace("word", F.lit("-"), F.lit(""))) == 1)
    return tiers.compound_words(w, C.lexicon(spark, sf_dir)).select("word", F.col("compound").alias("output"))


_UNKNOWN = f"u AS (SELECT DISTINCT word FROM status1 WHERE st = 'not_found')"
_LONGEST = (
    f"v AS (SELECT word, {C.key_sql('word')} AS t, {C.vowels_sql('word')} AS vowels FROM u), e AS (SELECT *, unnest(generate_series(1, least(13, length(t)))) AS n FROM v WHERE vowels >= 2), "
    "h AS (SELECT e.word, e.n, e.vowels - 1 - s.from_end AS ord FROM e JOIN suffixes s ON s.suffix = right(e.t, e.n) WHERE s.from_end < e.vowels), "
    "longest AS (SELECT word, CAST(max_by(ord, n) AS VARCHAR) AS sig FROM h GROUP BY word)"
)


@query(f"{_CLS}, {C.SUFFIXES}, {_UNKNOWN}, {_LONGEST} SELECT word, sig FROM longest")
def suffix_longest(spark, sf_dir):
    lex = C.lexicon(spark, sf_dir)
    t = tiers.with_initial(tokens.explode_words(C.documents(spark, sf_dir))).where("word is not null").select("word", "initial").distinct()
    unknown = tiers.classify_words(t, lex).where("status = 'not_found'").select("word").distinct()
    return tiers.longest_suffix(unknown, C.suffixes(lex))


_COUNTS = f"list_transform(string_split_regex(word, '[{A.BREAK_CLASS}]'), lambda s: length(regexp_replace(s, '[^{A.COUNTED}]', '', 'g')))"


@query(
    f"{_WORDS}, c AS (SELECT word, {_COUNTS} AS n FROM w WHERE {C.vowels_sql('word')} >= 2), "
    "d AS (SELECT word, n, coalesce(list_max(list_filter(list_transform(n, lambda x, i: CASE WHEN x > 0 THEN i END), lambda x: x IS NOT NULL)), 1) AS last FROM c) "
    "SELECT word, CAST(last - 1 AS VARCHAR) || ':' || CAST(greatest(0, n[last] - 2) AS VARCHAR) AS sig FROM d"
)
def positional_default(spark, sf_dir):
    w = C.distinct_words(spark, sf_dir).where(T.vowel_count("word") >= 2)
    return w.select("word", tiers.positional_signature("word").alias("sig"))



@query(f"{_CLS} SELECT doc_id, start, {C.plain_sql('word', 'CAST(candidates[1] AS INT)')} AS output FROM status1 WHERE st = 'model_ineligible' AND NOT regexp_matches(word, '[{A.BREAK_CLASS}]')")
def dictionary_default(spark, sf_dir):
    t = tiers.dictionary_default(_classified(spark, sf_dir)).where("status = 'dictionary_default'")
    return t.where(~F.col("word").rlike(f"[{A.BREAK_CLASS}]")).select("doc_id", "start", "output")


#: The status of each token after all tiers that need no model. Words with breaks are left out of the output's check.
_FINAL = (
    f"{_CLS}, {C.SUFFIXES}, {_UNKNOWN}, {_LONGEST}, "
    "lagged AS (SELECT s.*, lag(lower(word)) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM status1 s), "
    f"cp AS (SELECT word, unnest(string_split(word, '-')) AS part FROM u WHERE contains(word, '-')), "
    f"cq AS (SELECT DISTINCT cp.word FROM cp JOIN lexicon l ON l.form = {C.key_sql('cp.part')}), "
    f"fin AS (SELECT g.doc_id, g.start, g.word, g.candidates, g.vowels, g.st, lg.sig, CASE "
    f"WHEN lower(g.word) IN ({_PRONOUNS}) AND g.before IN ({_PREPOSITIONS}) AND regexp_matches(g.gap, '^\\s+$') THEN 'prepositional' "
    "WHEN g.st <> 'not_found' THEN g.st WHEN cq.word IS NOT NULL THEN 'compound' "
    f"WHEN lg.sig IS NOT NULL AND {C.plain_sql('g.word', 'CAST(lg.sig AS INT)')} IS NOT NULL AND NOT regexp_matches(g.word, '[{A.BREAK_CLASS}]') THEN 'suffix' "
    "WHEN g.vowels >= 2 AND lg.sig IS NOT NULL AND regexp_matches(g.word, '-') THEN 'hyphened' "
    "WHEN g.vowels >= 2 THEN 'default_position' ELSE 'not_found' END AS status "
    "FROM lagged g LEFT JOIN longest lg ON lg.word = g.word LEFT JOIN cq ON cq.word = g.word)"
)


def _engine(spark, sf_dir) -> StressEngine:
    lex = C.lexicon(spark, sf_dir)
    return StressEngine(lex, C.suffixes(lex))


def _no_breaks(df: DataFrame, c: str) -> DataFrame:
    return df.where(~F.col(c).rlike(f"[{A.BREAK_CLASS}]"))


_PLAIN_ONLY = f"NOT regexp_matches(word, '[{A.BREAK_CLASS}]')"


@query(
    f"{_FINAL} SELECT doc_id, start, word AS text, CASE WHEN status = 'model_ineligible' THEN 'dictionary_default' ELSE status END AS status, "
    f"CASE status WHEN 'stressed' THEN {C.plain_sql('word', 'CAST(candidates[1] AS INT)')} WHEN 'model_ineligible' THEN {C.plain_sql('word', 'CAST(candidates[1] AS INT)')} WHEN 'prepositional' THEN {C.plain_sql('word', '0')} "
    f"WHEN 'suffix' THEN {C.plain_sql('word', 'CAST(sig AS INT)')} WHEN 'default_position' THEN {C.plain_sql('word', '(greatest(vowels, 2) - 2)')} ELSE word END AS output_text FROM fin WHERE {_PLAIN_ONLY}"
)
def stress_default(spark, sf_dir):
    """All tiers that need no model; words with hyphens are in `stress_text`."""
    return _no_breaks(_engine(spark, sf_dir).tokens(C.documents(spark, sf_dir)), "text").select("doc_id", "start", "text", "status", "output_text")


@query(f"{_FINAL} SELECT doc_id, start, word AS text, status FROM fin WHERE {_PLAIN_ONLY}")
def stress_preserve(spark, sf_dir):
    return _no_breaks(_engine(spark, sf_dir).tokens(C.documents(spark, sf_dir), on_ambiguity="preserve"), "text").select("doc_id", "start", "text", "status")


@query()
def stress_text(spark, sf_dir):
    return _engine(spark, sf_dir).stress(C.documents(spark, sf_dir))


@query(f"WITH {C.DOCS} SELECT doc_id, text FROM docs")
def stress_lossless(spark, sf_dir):
    """The rebuilt text without its acutes is the input."""
    out = _engine(spark, sf_dir).stress(C.documents(spark, sf_dir))
    return out.select("doc_id", F.replace("text", F.lit(A.ACUTE), F.lit("")).alias("text"))


# Routing and segmentation


_ABBR = "'" + "','".join(A.ABBREVIATIONS) + "'"
_LINES = "lines AS (SELECT DISTINCT unnest(string_split(text, '\n')) AS line FROM docs)"
_NEEDS = (
    f"regexp_matches(line, '[\\p{{Nd}}]') OR regexp_matches(line, '[A-Za-z]') OR regexp_matches(line, '{segment.SYMBOLS}') OR regexp_matches(line, '{segment.SCRIPT_DIGITS}') "
    "OR (regexp_matches(line, '\\p{L}') AND regexp_matches(line, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]') AND regexp_matches(line, '(^|[^\\p{L}\\p{Nl}\\p{No}])[A-ZА-ЯІЇЄҐ]{2,5}($|[^\\p{L}\\p{Nl}\\p{No}])')) "
    f"OR len(list_filter(regexp_extract_all(line, '([\\p{{L}}\\p{{Nl}}\\p{{No}}]+(?:[''’ʼ-][\\p{{L}}\\p{{Nl}}\\p{{No}}]+)*)\\.', 1), lambda w: length(w) >= 2 AND lower(w) IN ({_ABBR}))) > 0"
)


def _lines(spark, sf_dir) -> DataFrame:
    return C.documents(spark, sf_dir).select(F.explode(F.split("text", "\n", -1)).alias("line")).distinct()


@query(f"WITH {C.DOCS}, {_LINES} SELECT line, {_NEEDS} AS needs FROM lines")
def needs_verbalization(spark, sf_dir):
    return _lines(spark, sf_dir).select("line", segment.needs_verbalization(F.col("line")).alias("needs"))


@query(
    f"WITH {C.DOCS}, {_LINES}, w AS (SELECT line, regexp_extract_all(line, '[А-Яа-яІіЇїЄєҐґ''’ʼ]+') AS ws FROM lines), "
    "c AS (SELECT line, ws, len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n FROM w) SELECT line, n >= 3 AND n * 2 > len(ws) AS run FROM c"
)
def caps_run(spark, sf_dir):
    return _lines(spark, sf_dir).select("line", segment.caps_run(F.col("line")).alias("run"))


_CLOSING, _SPACES = "[.!?…]+[\"''»”’)\\]]*$", "[ \\t\\n\\x0B\\f\\r]+"
_CHUNKED = (
    f"wg AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w, string_split_regex(text, '{_SPACES}') AS w0, regexp_extract_all(text, '{_SPACES}') AS g0, regexp_matches(text, '^{_SPACES}') AS lead_ FROM docs), "
    "tk AS (SELECT doc_id, i, w[i] AS word, w[i + 1] AS nxt, len(w) AS n, coalesce(CASE WHEN lead_ THEN g0[i + 1] ELSE g0[i] END, '') AS gap FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM wg)), "
    f"bare AS (SELECT *, trim(regexp_replace(word, '{_CLOSING}', ''), '\"''«»“”‘’()[]') AS b FROM tk), "
    f"ends AS (SELECT *, nxt IS NULL OR contains(gap, chr(10)) OR (regexp_matches(word, '{_CLOSING}') AND NOT (lower(b) IN ({_ABBR}) OR regexp_matches(b, '^\\p{{Lu}}$')) AND NOT regexp_matches(nxt, '^\\p{{Ll}}')) AS stop FROM bare), "
    "grp AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ends), "
    "sent AS (SELECT doc_id, s, string_agg(word || CASE WHEN stop THEN '' ELSE gap END, '' ORDER BY i) AS text, max(CASE WHEN stop THEN gap END) AS gap FROM grp GROUP BY doc_id, s), "
    "pieces AS (SELECT doc_id, s, 0 AS j, text, true AS speakable FROM sent UNION ALL SELECT doc_id, s, j, p[j], false FROM (SELECT doc_id, s, regexp_extract_all(gap, '\\n+|[^\\n]+') AS p, unnest(generate_series(1, len(p))) AS j FROM sent) "
    "UNION ALL SELECT doc_id, -1, j, p[j], false FROM (SELECT doc_id, regexp_extract_all(CASE WHEN lead_ THEN g0[1] ELSE '' END, '\\n+|[^\\n]+') AS p, unnest(generate_series(1, len(p))) AS j FROM wg))"
)


@query(f"WITH {C.DOCS.replace('translate(text, ' + chr(39) + C.FROM + chr(39) + ', ' + chr(39) + C.TO + chr(39) + ')', 'text')}, {_CHUNKED} SELECT doc_id, count(*) AS chunks, count_if(speakable) AS sentences, string_agg(CASE WHEN speakable THEN text END, '|' ORDER BY s, j) AS spoken FROM pieces GROUP BY doc_id")
def split_sentences(spark, sf_dir):
    """The sentences of the texts as they are."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", segment.split_sentences("text").alias("c"))
    spoken = F.filter("c", lambda x: x["speakable"])
    return docs.where(F.size("c") > 0).select("doc_id", F.size("c").cast("long").alias("chunks"), F.size(spoken).cast("long").alias("sentences"), F.array_join(F.transform(spoken, lambda x: x["text"]), "|").alias("spoken"))


@query(f"WITH {C.DOCS}, {_CHUNKED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, j) - 1 AS pos, text, speakable FROM pieces")
def sentence_chunks(spark, sf_dir):
    return segment.chunk_rows(C.documents(spark, sf_dir))


@query()
def fit_to_window(spark, sf_dir):
    return segment.chunk_rows(C.documents(spark, sf_dir), budget=12)


@query("SELECT conv_id, turn, text FROM conversations")
def fit_lossless(spark, sf_dir):
    docs = C.table(spark, sf_dir, "conversations")
    return segment.with_chunks(docs, "text", 8).select("conv_id", "turn", segment.join_chunks(F.col("chunks")).alias("text"))


@query()
def detect_spans(spark, sf_dir):
    lines = C.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.select("doc_id", "line", F.explode(spans.detect_spans("text")).alias("s")).select("doc_id", "line", "s.start", "s.end", "s.text")


@query()
def assemble(spark, sf_dir):
    """Each span written in angle marks."""
    lines = C.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    found = lines.withColumn("spans", spans.detect_spans("text"))
    said = F.transform("spans", lambda s: F.concat(F.lit("‹"), s["text"], F.lit("›")))
    return found.select("doc_id", "line", "text", "spans", said.alias("said")).select("doc_id", "line", spans.assemble("text", "spans", "said").alias("text"))


@query()
def model_input(spark, sf_dir):
    """Every span of every line, marked in its line."""
    lines = C.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    found = lines.select("doc_id", "line", "text", F.explode(spans.detect_spans("text")).alias("span"))
    return found.select("doc_id", "line", F.col("span.start").alias("start"), spans.model_input(F.col("text"), F.col("span")).alias("input"))


@query(
    f"{_CLS}, x AS (SELECT t.doc_id, t.start, t.\"end\", greatest(0, t.start - 300) AS lo, d.text FROM status1 t JOIN docs d USING (doc_id) WHERE st = 'model_ineligible' AND len(list_filter(candidates, lambda c: CAST(c AS INT) < 8)) >= 2) "
    "SELECT doc_id, start, substring(text, CAST(lo AS BIGINT) + 1, CAST(least(length(text), \"end\" + 300) - lo AS BIGINT)) AS around FROM x"
)
def context_window(spark, sf_dir):
    """The text around every word that a classifier is asked about."""
    docs = C.documents(spark, sf_dir)
    t = _classified(spark, sf_dir).where("status = 'model_ineligible'").select("doc_id", "start", "end", F.col("key").alias("form"), "candidates")
    asked = scoring.classifier_targets(docs.select("doc_id", F.col("text").alias("sentence")).join(t, "doc_id"), t, any_form=True)
    return asked.select("doc_id", "start", F.col("window").alias("around"))


# Morphology, over parses made from the words by rule


_TAGGED = (
    "tagged AS (SELECT doc_id, k, start, \"end\", word AS text, CASE length(word) % 4 WHEN 0 THEN 'NUM' WHEN 1 THEN 'NOUN' WHEN 2 THEN 'VERB' ELSE 'ADJ' END AS upos, "
    "CASE k % 3 WHEN 0 THEN 'Animacy=Inan|Case=Nom|Number=Plur' WHEN 1 THEN 'Case=Gen|Number=Sing' ELSE 'Case=Acc|Gender=Fem|Number=Plur' END AS feats FROM tokens)"
)


def _tagged(spark, sf_dir) -> DataFrame:
    t = tokens.explode_words(C.documents(spark, sf_dir), offsets=True).where("word is not null")
    upos = F.element_at(F.array(*map(F.lit, ("NUM", "NOUN", "VERB", "ADJ"))), F.length("word") % 4 + 1)
    feats = F.element_at(F.array(*map(F.lit, ("Animacy=Inan|Case=Nom|Number=Plur", "Case=Gen|Number=Sing", "Case=Acc|Gender=Fem|Number=Plur"))), F.col("k") % 3 + 1)
    return t.select("doc_id", "k", "start", "end", F.col("word").alias("text"), upos.alias("upos"), feats.alias("feats"))


@query(
    f"WITH {C.TOKENS}, {_TAGGED}, r AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'три' ELSE text END AS t FROM tagged), "
    "l AS (SELECT *, lag(upos) OVER w AS u1, lag(feats) OVER w AS f1, lower(lag(t) OVER w) AS t1 FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY start)) "
    "SELECT doc_id, start, CASE WHEN contains(feats, 'Inan') THEN 'Animacy=Inan|Case=Gen|Number=Sing' ELSE 'Case=Gen|Gender=Fem|Number=Sing' END AS counted FROM l "
    "WHERE u1 = 'NUM' AND t1 = 'три' AND NOT contains(f1, 'Case=Gen') AND upos = 'NOUN' AND contains(feats, 'Plur')"
)
def counted_form(spark, sf_dir):
    p = _tagged(spark, sf_dir).withColumn("text", F.when(F.col("k") % 5 == 0, "три").otherwise(F.col("text")))
    return morphology.counted_form(p).where("counted is not null").select("doc_id", "start", "counted")


_PARTICLES = "'" + "','".join(A.PARTICLES) + "'"


@query(
    f"WITH {C.TOKENS}, r AS (SELECT doc_id, start, k, CASE k % 7 WHEN 2 THEN 'почала' WHEN 3 THEN 'не' ELSE lower(word) END AS t FROM tokens), "
    f"g AS (SELECT *, last_value(CASE WHEN t NOT IN ({_PARTICLES}) THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gov FROM r) "
    "SELECT doc_id, start, 6 AS accent FROM g WHERE gov = 'почала'"
)
def aspect_rule(spark, sf_dir):
    """A pair of infinitives at every word; a phase verb and a particle are put among the words."""
    text = F.when(F.col("k") % 7 == 2, "почала").when(F.col("k") % 7 == 3, "не").otherwise(F.col("text"))
    p = morphology.governing_word(_tagged(spark, sf_dir).withColumn("text", text))
    tags = F.array(F.lit("VerbForm=Inf"), F.lit("upos=VERB"))
    pair = F.array(*(F.struct(tags.alias("tags"), F.array(F.lit(a)).alias("accents")) for a in (2, 6)))
    return p.withColumn("a", morphology.imperfective(pair, F.col("governor"))).where("a is not null").select("doc_id", "start", F.get("a", F.lit(0)).alias("accent"))


#: Two readings of each form, by rule: nouns that differ in case and number, or a noun and a verb.
_READINGS = "readings AS (SELECT DISTINCT text AS form, length(text) % 5 AS kind FROM tagged)"


def _readings(text):
    def reading(tags: list[str], accent: int):
        return F.struct(F.array(*map(F.lit, tags)).alias("tags"), F.array(F.lit(accent)).alias("accents"))

    plural, single = reading(["Case=Nom", "Number=Plur", "upos=NOUN"], 2), reading(["Case=Gen", "Number=Sing", "upos=NOUN"], 4)
    verb, same = reading(["VerbForm=Inf", "upos=VERB"], 6), reading(["Case=Gen", "Number=Sing", "upos=NOUN"], 2)
    kind = F.length(text) % 5
    return F.when(kind == 0, F.array(plural, verb)).when(kind == 1, F.array(plural, same)).otherwise(F.array(plural, single))


def _with_readings(spark, sf_dir) -> DataFrame:
    return _tagged(spark, sf_dir).withColumn("readings", _readings(F.col("text")))


@query(f"WITH {C.TOKENS}, {_TAGGED}, {_READINGS} SELECT form, CASE kind WHEN 0 THEN 'Case,Number,VerbForm,upos' WHEN 1 THEN '' ELSE 'Case,Number' END AS keys FROM readings")
def separating_features(spark, sf_dir):
    r = _with_readings(spark, sf_dir).select(F.col("text").alias("form"), "readings").distinct()
    return r.select("form", _joined(F.sort_array(morphology.separating_features(F.col("readings")))).alias("keys"))


@query(f"WITH {C.TOKENS}, {_TAGGED}, {_READINGS} SELECT form, kind = 0 AS split FROM readings")
def pos_split(spark, sf_dir):
    r = _with_readings(spark, sf_dir).select(F.col("text").alias("form"), "readings").distinct()
    return r.select("form", morphology.unreliable_split(F.col("readings")).alias("split"))


@query(
    f"WITH {C.TOKENS}, {_TAGGED} SELECT doc_id, start, CASE WHEN contains(feats, 'Nom') THEN 2 ELSE 4 END AS accent FROM tagged "
    "WHERE length(text) % 5 > 1 AND upos = 'NOUN' AND NOT contains(feats, 'Acc')"
)
def morph_resolve(spark, sf_dir):
    r = _with_readings(spark, sf_dir)
    got = r.withColumn("a", morphology.resolve(F.col("readings"), F.col("upos"), F.col("feats"))).where("a is not null")
    return got.select("doc_id", "start", F.get("a", F.lit(0)).alias("accent"))


@query(
    f"WITH {C.TOKENS}, {_TAGGED}, l AS (SELECT *, lag(upos) OVER w AS u1, lag(feats) OVER w AS f1 FROM tagged WINDOW w AS (PARTITION BY doc_id ORDER BY start)) "
    "SELECT doc_id, start, 4 AS accent FROM l WHERE length(text) % 5 > 1 AND u1 = 'ADJ' AND NOT contains(f1, 'Case=Gen')"
)
def agreement_repair(spark, sf_dir):
    """Modifiers that their dictionary has as genitive singular, read otherwise by the tagger."""
    w = morphology.in_order()
    r = _with_readings(spark, sf_dir).withColumns({"u1": F.lag("upos").over(w), "f1": F.lag("feats").over(w)})
    got = r.withColumn("a", morphology.agreement(F.col("readings"), F.col("u1"), F.col("f1"), F.array(F.lit("Gen|Sing"))))
    return got.where("a is not null and length(text) % 5 > 1").select("doc_id", "start", F.get("a", F.lit(0)).alias("accent"))


# Scoring, with scores by rule


def _targets(spark, sf_dir) -> DataFrame:
    """(doc_id, start, end, form, candidates) of words with several candidates."""
    t = _classified(spark, sf_dir).where("status = 'model_ineligible'")
    return t.select("doc_id", "start", "end", "word", F.col("key").alias("form"), "candidates", "k")


_TARGETS = "targets AS (SELECT doc_id, start, \"end\", word, key AS form, candidates, k FROM status1 WHERE st = 'model_ineligible')"


@query(
    f"{_CLS}, {_TARGETS} SELECT doc_id, start, CASE k % 5 WHEN 0 THEN 'target offsets are outside the sentence' WHEN 1 THEN 'target offsets do not identify the requested form' WHEN 2 THEN 'form is outside frozen training coverage' WHEN 3 THEN 'database candidates differ from model inventory' END AS problem FROM targets"
)
def target_validation(spark, sf_dir):
    """Targets spoiled in four ways, and sound ones."""
    k = F.col("k") % 5
    t = _targets(spark, sf_dir).withColumns({
        "a": F.when(k == 0, -1).otherwise(0), "b": F.when(k == 1, F.length("word") - 1).otherwise(F.length("word")),
        "signatures": F.when(k == 2, F.lit(None)).when(k == 3, F.array(F.lit("0"))).otherwise(F.reverse("candidates")),
    })
    problem = scoring.target_problem(F.col("word"), F.col("a"), F.col("b"), F.col("form"), F.col("candidates"), F.col("signatures"))
    return t.select("doc_id", "start", problem.alias("problem"))


_SENSES = "senses AS (SELECT form, CAST(i - 1 AS INT) AS pos, candidates[i] AS sig FROM (SELECT form, candidates, unnest(generate_series(1, len(candidates))) AS i FROM lexicon WHERE len(candidates) > 1))"


def _senses(spark, sf_dir) -> DataFrame:
    lex = C.lexicon(spark, sf_dir).where(F.size("candidates") > 1).select("form", F.posexplode("candidates").alias("pos", "sig"))
    return lex.withColumns({"stressed": F.concat_ws("/", "form", "sig"), "definition": F.when(F.col("pos") > 0, F.concat(F.lit("sense "), "pos")).otherwise("")})


@query(
    f"{_CLS}, {_TARGETS}, {_SENSES} SELECT t.doc_id, t.start, s.pos, s.sig, '⟦' || t.word || '⟧' AS \"left\", s.form || '/' || s.sig || CASE WHEN s.pos > 0 THEN ': sense ' || CAST(s.pos AS VARCHAR) ELSE '' END AS \"right\" "
    "FROM targets t JOIN senses s USING (form) WHERE list_contains(t.candidates, s.sig)"
)
def pair_build(spark, sf_dir):
    t = _targets(spark, sf_dir).select("doc_id", "start", F.lit(0).alias("a"), F.length("word").alias("b"), F.col("word").alias("sentence"), "form", "candidates")
    pairs = scoring.build_pairs(t.select(F.struct("doc_id", "start").alias("doc_id"), F.col("a").alias("start"), F.col("b").alias("end"), "sentence", "form", "candidates"), _senses(spark, sf_dir))
    return pairs.select("doc_id.doc_id", "doc_id.start", "pos", "sig", "left", "right")


def _scored(targets: DataFrame) -> DataFrame:
    t = targets.select("doc_id", "start", F.posexplode("candidates").alias("pos", "sig"))
    return t.withColumn("score", ((F.col("doc_id") * 7 + F.col("start") * 3 + F.col("pos") * 5) % 11).cast("double"))


_SCORED = "scored AS (SELECT doc_id, start, CAST(i - 1 AS INT) AS pos, candidates[i] AS sig, CAST((doc_id * 7 + start * 3 + (i - 1) * 5) % 11 AS DOUBLE) AS score FROM (SELECT *, unnest(generate_series(1, len(candidates))) AS i FROM targets))"


@query(
    f"{_CLS}, {_TARGETS}, {_SCORED}, o AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY doc_id, start ORDER BY score DESC, pos)) "
    "SELECT doc_id, start, sig, coalesce(score - nxt, 0) AS margin, CASE WHEN coalesce(score - nxt, 0) >= 2 THEN 'selected' ELSE 'low_margin' END AS decision FROM o WHERE rn = 1"
)
def rank_margin(spark, sf_dir):
    return scoring.rank(_scored(_targets(spark, sf_dir)), 2.0).select("doc_id", "start", "sig", "margin", "decision")


@query(f"{_CLS}, {_TARGETS}, seen AS (SELECT lower(word) AS form FROM tokens GROUP BY 1 HAVING count(*) >= 10) SELECT doc_id, start, form FROM targets WHERE form IN (SELECT form FROM seen)")
def token_gate(spark, sf_dir):
    t = _targets(spark, sf_dir).withColumn("sentence", F.col("word"))
    coverage = C.words(spark, sf_dir).groupBy(F.lower("word").alias("form")).agg(F.count("*").alias("seen"))
    return scoring.classifier_targets(t, coverage, most=100).select("doc_id", "start", "form")


@query(
    f"{_CLS}, {_TARGETS}, {_SCORED}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id, start)) AS e FROM scored) "
    "SELECT doc_id, start, sig, round(e / sum(e) OVER (PARTITION BY doc_id, start), 6) AS p FROM e"
)
def softmax(spark, sf_dir):
    m = _scored(_targets(spark, sf_dir)).groupBy("doc_id", "start").agg(F.map_from_entries(F.collect_list(F.struct("sig", "score"))).alias("m"))
    return m.select("doc_id", "start", F.explode(T.softmax(F.col("m"))).alias("sig", "p")).select("doc_id", "start", "sig", F.round("p", 6).alias("p"))


_RANKED = "o AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY doc_id, start ORDER BY score DESC, pos)), best AS (SELECT doc_id, start, sig, coalesce(score - nxt, 0) >= 2 AS sure FROM o WHERE rn = 1)"
_OUTPUTS = (
    f"CASE status WHEN 'stressed' THEN {C.plain_sql('fin.word', 'CAST(fin.candidates[1] AS INT)')} WHEN 'model_ineligible' THEN {C.plain_sql('fin.word', 'CAST(fin.candidates[1] AS INT)')} WHEN 'prepositional' THEN {C.plain_sql('fin.word', '0')} "
    f"WHEN 'suffix' THEN {C.plain_sql('fin.word', 'CAST(fin.sig AS INT)')} WHEN 'default_position' THEN {C.plain_sql('fin.word', '(greatest(fin.vowels, 2) - 2)')} ELSE fin.word END"
)


def _final_sql(more: str, join: str, said: str, status: str, output: str) -> str:
    """The rows of all tiers, where `said` holds with another status and output."""
    return (
        f"{_FINAL}, {more} SELECT fin.doc_id, fin.start, fin.word AS text, CASE WHEN status = 'model_ineligible' AND ({said}) THEN '{status}' WHEN status = 'model_ineligible' THEN 'dictionary_default' ELSE status END AS status, "
        f"CASE WHEN status = 'model_ineligible' AND ({said}) THEN {output} ELSE {_OUTPUTS} END AS output_text FROM fin {join} WHERE NOT regexp_matches(fin.word, '[{A.BREAK_CLASS}]')"
    )


def _plain_rows(t: DataFrame) -> DataFrame:
    return _no_breaks(t, "text").select("doc_id", "start", "text", "status", "output_text")


@query(_final_sql(f"{_TARGETS}, {_SCORED}, {_RANKED}", "LEFT JOIN best x ON x.doc_id = fin.doc_id AND x.start = fin.start", "x.sure", "stressed", C.plain_sql("fin.word", "CAST(x.sig AS INT)")))
def stress_decisions(spark, sf_dir):
    """All tiers with a cross-encoder's decisions, from scores by rule."""
    engine, docs = _engine(spark, sf_dir), C.documents(spark, sf_dir)
    decided = engine.words(docs)
    decisions = scoring.rank(_scored(tiers.open_words(docs, decided)), 2.0)
    return _plain_rows(engine.tokens(docs, decisions=decisions, decided=decided))


@query(_final_sql(_TARGETS, "LEFT JOIN (SELECT doc_id, start, candidates[2] AS sig FROM targets WHERE k % 3 = 0) x ON x.doc_id = fin.doc_id AND x.start = fin.start", "x.sig IS NOT NULL", "token_model", C.plain_sql("fin.word", "CAST(x.sig AS INT)")))
def stress_choices(spark, sf_dir):
    """All tiers with a token classifier's choices: by rule, the second candidate of one word in three."""
    engine, docs = _engine(spark, sf_dir), C.documents(spark, sf_dir)
    decided = engine.words(docs)
    choices = tiers.open_words(docs, decided).where("k % 3 = 0").select("doc_id", "start", F.get("candidates", F.lit(1)).alias("sig"))
    return _plain_rows(engine.tokens(docs, choices=choices, decided=decided))


@query(
    _final_sql(
        f"{_TAGGED}, {_TARGETS}, m AS (SELECT a.doc_id, a.start, CASE WHEN contains(feats, 'Nom') THEN 2 ELSE 4 END AS accent FROM tagged a JOIN targets b ON a.doc_id = b.doc_id AND a.start = b.start WHERE length(b.form) % 5 > 1 AND upos = 'NOUN' AND NOT contains(feats, 'Acc'))",
        "LEFT JOIN m ON m.doc_id = fin.doc_id AND m.start = fin.start", "m.accent IS NOT NULL", "morphology", "left(fin.word, m.accent) || '́' || substring(fin.word, m.accent + 1)",
    )
)
def stress_morphology(spark, sf_dir):
    """All tiers with the morphology tier: parses and readings by rule."""
    lex = C.lexicon(spark, sf_dir)
    readings = lex.select("form", F.col("form").alias("text")).transform(lambda d: d.select("form", _readings(F.col("text")).alias("readings")))
    engine = StressEngine(lex, C.suffixes(lex), morphology=morphology.morphology_tier(_tagged(spark, sf_dir), readings))
    return _plain_rows(engine.tokens(C.documents(spark, sf_dir)))


#: Features by rule for each candidate: a tag, readings, counts of who was heard and seen.
_FEATURED = (
    "feat AS (SELECT doc_id, start, CAST(i - 1 AS INT) AS pos, candidates[i] AS sig, word, k, CASE k % 2 WHEN 0 THEN 'Case=Gen|Number=Sing' ELSE 'Case=Nom|Number=Plur' END AS tf, CASE (i - 1) % 2 WHEN 0 THEN 'Gen' ELSE 'Nom' END AS rc, "
    "upper(left(word, 1)) = left(word, 1) AS cap FROM (SELECT doc_id, start, word, k, candidates, unnest(generate_series(1, len(candidates))) AS i FROM targets))"
)


def _featured(spark, sf_dir) -> DataFrame:
    t = _targets(spark, sf_dir).select("doc_id", "start", "word", "k", F.col("candidates"))
    c = t.select("doc_id", "start", "word", "k", F.posexplode("candidates").alias("rank", "sig"))
    even, first = F.col("k") % 2 == 0, F.col("rank") % 2 == 0
    none = F.lit(None).cast("map<string,double>")
    rows = c.select(
        "doc_id", "start", "k", F.col("word").alias("text"), F.when(F.col("k") % 3 == 0, "три").otherwise("і").alias("previous"), (F.col("k") == 0).alias("first"), "rank", "sig",
        F.lit("NOUN").alias("tag_upos"), F.when(even, "Case=Gen|Number=Sing").otherwise("Case=Nom|Number=Plur").alias("tag_feats"), F.when(even, "0").alias("morph_pick"),
        F.create_map(F.lit("0"), F.lit(0.75), F.lit("1"), F.lit(0.25)).alias("xenc"), F.when(even, F.create_map(F.lit("1"), F.lit(0.5))).otherwise(none).alias("tok"),
        F.when(even, F.array(F.lit("Gen|Sing"))).alias("allowed"), F.when(first, F.array(F.lit("Case=Gen"), F.lit("Number=Sing"))).otherwise(F.array(F.lit("Case=Nom"), F.lit("Number=Sing"))).alias("r_feats"),
        F.when(first, F.array(F.lit("NOUN"))).alias("r_upos"), (~first).alias("r_proper"), first.alias("r_senses"), F.col("rank").alias("heard"), F.lit(4).alias("heard_total"), F.lit(9).alias("seen_total"), F.lit(0.25).alias("minority"),
        F.array(F.lit("feats")).alias("told"), F.lit("0").alias("pipeline"), F.when(even, "stressed").otherwise("agreement").alias("status"),
    )
    return combiner.add_pipeline(combiner.features(rows))


_B = lambda x: f"CAST(coalesce({x}, false) AS DOUBLE)"
_FEATURES_SQL = {
    "mod_agree": _B("k % 2 = 0 AND rc = 'Gen'"), "mod_disagree": _B("k % 2 = 0 AND rc = 'Nom'"), "lex_rank": "CAST(pos AS DOUBLE)", "lex_first": _B("pos = 0"),
    "proper": _B("rc = 'Nom'"), "proper_x_capmid": _B("rc = 'Nom' AND cap AND k <> 0"), "proper_x_lower": _B("rc = 'Nom' AND NOT cap"), "counted_x_gensg": _B("k % 3 = 0 AND rc = 'Gen'"),
    "morph_says": _B("k % 2 = 0 AND sig = '0'"), "morph_other": _B("k % 2 = 0 AND sig <> '0'"),
    "tag_match": "CAST(contains(tf, rc) AS DOUBLE) + CAST(contains(tf, 'Sing') AS DOUBLE)", "tag_conflict": "CAST(NOT contains(tf, rc) AS DOUBLE) + CAST(NOT contains(tf, 'Sing') AS DOUBLE)",
    "upos_match": _B("rc = 'Gen'"), "xenc_p": "CASE sig WHEN '0' THEN 0.75 WHEN '1' THEN 0.25 ELSE 0.0 END::DOUBLE", "tok_p": "CASE WHEN k % 2 = 0 AND sig = '1' THEN 0.5 ELSE 0.0 END::DOUBLE", "tok_avail": _B("k % 2 = 0"),
    "xenc_avail": "1.0::DOUBLE", "tok_seen_log": "CASE WHEN k % 2 = 0 THEN ln(10) ELSE 0.0 END::DOUBLE", "audio_log_n": "ln(5)::DOUBLE", "told_sense": "0.0::DOUBLE", "told_feats": "1.0::DOUBLE",
    "tok_minority": "CASE WHEN k % 2 = 0 THEN 0.25 ELSE 0.0 END::DOUBLE", "audio_share": "pos / 4", "has_sense": _B("rc = 'Gen'"), "pipe_says": _B("sig = '0'"),
} | {f"pipe_says_x_{s}": _B({"stressed": "sig = '0' AND k % 2 = 0", "agreement": "sig = '0' AND k % 2 = 1"}.get(s, "false")) for s in combiner.STATUSES}
_FEATURE_NAMES = [*combiner.NAMES, *combiner.PIPELINE_NAMES]
_ROUNDED = ["tok_seen_log", "audio_log_n"]


@query(f"{_CLS}, {_TARGETS}, {_FEATURED} SELECT doc_id, start, sig, {', '.join((f'round({_FEATURES_SQL[n]}, 9)' if n in _ROUNDED else _FEATURES_SQL[n]) + f' AS {n}' for n in _FEATURE_NAMES)} FROM feat")
def combiner_features(spark, sf_dir):
    """All features of every candidate of every open word."""
    return _featured(spark, sf_dir).select("doc_id", "start", "sig", *(F.round(n, 9).alias(n) if n in _ROUNDED else n for n in _FEATURE_NAMES))


@query(
    f"{_CLS}, {_TARGETS}, {_FEATURED}, n AS (SELECT doc_id, start, pos, sig, 1.5 * CAST(rc = 'Nom' AS DOUBLE) - 0.5 * pos + 0.25 * CAST(sig = '0' AS DOUBLE) AS z FROM feat), "
    "p AS (SELECT *, exp(z - max(z) OVER w) AS e, row_number() OVER (PARTITION BY doc_id, start ORDER BY z DESC, pos) AS rn FROM n WINDOW w AS (PARTITION BY doc_id, start)), "
    "q AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id, start) AS p, max(CASE WHEN sig = '0' THEN e END) OVER (PARTITION BY doc_id, start) / sum(e) OVER (PARTITION BY doc_id, start) AS keep FROM p) "
    "SELECT doc_id, start, CASE WHEN keep IS NOT NULL AND p - keep < 0.2 THEN '0' ELSE sig END AS sig, round(CASE WHEN keep IS NOT NULL AND p - keep < 0.2 THEN keep ELSE p END, 6) AS probability, CASE WHEN keep IS NOT NULL AND p - keep < 0.2 THEN false ELSE sig <> '0' END AS departed FROM q WHERE rn = 1"
)
def combiner_decide(spark, sf_dir):
    net = combiner.linear({"proper": 1.5, "lex_rank": -0.5, "pipe_says": 0.25}, 0.0, {}, {})
    got = combiner.decide(_featured(spark, sf_dir), net, 0.2)
    return got.select("doc_id", "start", "sig", F.round("probability", 6).alias("probability"), "departed")


# Evaluation


@query(
    f"{_FINAL}, a AS (SELECT status AS a, CASE WHEN status = 'model_ineligible' THEN 'dictionary_default' ELSE status END AS b, st FROM fin WHERE {_PLAIN_ONLY}) "
    "SELECT 'final' AS measure, count_if(a = b) AS matches, count(*) AS n, count_if(a = b) / count(*) AS share FROM a UNION ALL SELECT 'first', count_if(st = b), count(*), count_if(st = b) / count(*) FROM a"
)
def parity_counts(spark, sf_dir):
    """How often the default and the preserving run, and the first tier, agree in status."""
    return metrics.parity(_no_breaks(_engine(spark, sf_dir).statuses(C.documents(spark, sf_dir)), "text"), {"final": ("preserved", "default"), "first": ("first", "default")})


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    got = metrics.latency(C.table(spark, sf_dir, "events"), "value", ["event_type"])
    return got.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")))


@query(
    "SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, "
    "round(avg(abs(l_quantity - l_extendedprice)), 4) AS mae, round(max(abs(l_quantity - l_extendedprice)), 4) AS max_difference FROM lineitem"
)
def margin_fit(spark, sf_dir):
    got = metrics.fit(C.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    places = {"correlation": 6, "slope": 4, "intercept": 2, "mae": 4, "max_difference": 4}
    return got.select(*(F.round(c, n).alias(c) for c, n in places.items()))


_SWEPT = (
    "r AS (SELECT l_discount * 10 AS a, l_tax * 10 AS b, l_linenumber % 2 = 0 AS agree FROM lineitem), g AS (SELECT unnest(generate_series(0, 100, 2)) AS t), "
    "s AS (SELECT t / 100 AS threshold, count_if(CASE WHEN a >= 0.5 THEN b >= t / 100 AND agree ELSE b < t / 100 END) / count(*) AS share FROM r, g GROUP BY t)"
)


def _swept(spark, sf_dir) -> DataFrame:
    rows = C.table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), (F.col("l_linenumber") % 2 == 0).alias("agree"))
    return metrics.sweep(rows, spark, F.col("agree"), "a", "b", 0.5)


@query(f"WITH {_SWEPT} SELECT threshold, round(share, 6) AS share FROM s")
def threshold_sweep(spark, sf_dir):
    return _swept(spark, sf_dir).select("threshold", F.round("share", 6).alias("share"))


@query(f"WITH {_SWEPT} SELECT threshold, round(share, 6) AS share FROM s ORDER BY share DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    """A single row: the first of the best thresholds."""
    return metrics.best_threshold(_swept(spark, sf_dir)).select("threshold", F.round("share", 6).alias("share"))


@query(
    "WITH l AS (SELECT doc_id, i - 1 AS line, x[i] AS text FROM (SELECT doc_id, string_split(text, '\n') AS x, unnest(generate_series(1, len(x))) AS i FROM documents)), "
    "h AS (SELECT doc_id, line, CASE WHEN line % 4 = 0 THEN '# form: ' || lower(split_part(text, ' ', 1)) ELSE text END AS text FROM l), "
    "c AS (SELECT *, last_value(CASE WHEN starts_with(text, '# form:') THEN trim(substring(text, 8)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS form FROM h) "
    "SELECT doc_id, count(*) AS lines, count(DISTINCT form) AS forms FROM c WHERE NOT starts_with(text, '#') AND trim(text) <> '' AND form IS NOT NULL GROUP BY doc_id"
)
def gold_headers(spark, sf_dir):
    """Every fourth line of a document made a header of a gold file: sentences and forms under headers."""
    lines = C.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    made = lines.withColumn("text", F.when(F.col("line") % 4 == 0, F.concat(F.lit("# form: "), F.lower(F.substring_index("text", " ", 1)))).otherwise(F.col("text")))
    named = F.when(F.col("text").startswith("# form:"), F.trim(F.substring("text", 8, 1_000_000)))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = made.withColumn("form", F.last(named, ignorenulls=True).over(w)).where(~F.col("text").startswith("#") & (F.trim("text") != "") & F.col("form").isNotNull())
    return t.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_distinct("form").alias("forms"))


@query()
def gold_targets(spark, sf_dir):
    lines = C.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    made = lines.withColumn("text", F.when(F.col("line") % 4 == 0, F.concat(F.lit("# form: "), F.lower(F.substring_index("text", " ", 1)))).otherwise(F.col("text")))
    return metrics.gold_targets(made)


@query("SELECT doc_id, text AS verbalized, text FROM (SELECT doc_id, nfc_normalize(text) AS text FROM documents)")
def prepare_passthrough(spark, sf_dir):
    """Speech preparation without a model; documents without Cyrillic come back as they are."""
    front = SpeechFrontend(_engine(spark, sf_dir))
    return front.prepare(C.table(spark, sf_dir, "documents")).select("doc_id", "verbalized", "text")


@query()
def prepare_tokens(spark, sf_dir):
    return SpeechFrontend(_engine(spark, sf_dir)).tokens(C.documents(spark, sf_dir))
