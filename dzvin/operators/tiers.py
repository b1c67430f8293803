"""The decision tiers: from words to marked text.

Most tiers depend on a word and on whether it opens a sentence, not on its place: the lexicon and case, compounds,
suffixes, the default position and the first candidate. They are decided once for each distinct word, in
a table that is joined to the tokens once. What is left for tokens is to choose among its columns, and the
tiers that look at neighbours or at a model's answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dzvin.functions import alphabet as A
from dzvin.functions import text as T
from dzvin.operators.tables import made_once, sendable, spread, stored
from dzvin.operators.tokens import explode_words, with_answers

MAX_SUFFIX = 13


def with_initial(tokens: DataFrame) -> DataFrame:
    """Adds whether a word opens a sentence."""
    return tokens.withColumn("initial", T.opens_sentence(F.col("gap"), F.col("k") == 0))


def classify_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tier 1 for distinct (word, initial): adds key, candidates in order, status and output."""
    keyed = words.withColumn("key", T.lookup_key("word"))
    found = keyed.join(sendable(lexicon.select(F.col("form").alias("key"), F.col("candidates").alias("all"), "proper")), "key", "left")
    word = F.col("word")
    found = found.withColumn("vowels", F.length(F.regexp_replace("key", "[^аеєиіоуюя]", "")))
    needs = ~word.contains(A.ACUTE) & (F.col("vowels") > 0)
    own = F.when(needs & (F.size("all") > 0), T.by_capitalisation(F.col("all"), F.col("proper"), word, F.col("initial")))
    found = found.withColumn("candidates", own)
    one = F.when(F.size("candidates") == 1, T.render("word", F.get("candidates", F.lit(0))))
    found = found.withColumn("one", one)
    status = (
        F.when(word.contains(A.ACUTE), "already_stressed")
        .when(F.col("vowels") == 0, "not_required")
        .when(F.col("candidates").isNull() | (F.size("candidates") == 0), "not_found")
        .when(F.size("candidates") > 1, "model_ineligible")
        .when(F.col("one").isNull(), "invalid_candidate")
        .otherwise("stressed")
    )
    return found.select("word", "initial", "key", "candidates", status.alias("status"), F.coalesce("one", "word").alias("output"))


def classify(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tier 1 for a token table: adds initial, key, candidates, status and output."""
    t = with_initial(tokens)
    words = spread(t.where("word is not null").select("word", "initial").distinct())
    return t.join(sendable(made_once(classify_words(words, lexicon))), ["word", "initial"], "left")


def _decide(tokens: DataFrame, where: Column, output: Column, status: str) -> DataFrame:
    """Set output and status where the condition holds and the output could be made."""
    made = tokens.withColumn("made", F.when(where, output))
    return made.withColumn("status", F.when(F.col("made").isNotNull(), status).otherwise(F.col("status"))).withColumn("output", F.coalesce("made", "output")).drop("made")


def shifted() -> Column:
    """Whether a token is a pronoun right after a preposition."""
    return F.lower("word").isin(A.SHIFTED_PRONOUNS) & F.lower("previous").isin(A.PREPOSITIONS) & F.col("gap").rlike("(?U)^\\s+\\z")


def prepositional_shift(tokens: DataFrame) -> DataFrame:
    """Tier 4: a pronoun right after a preposition is stressed on its first vowel, whatever it was before (`shifted`, where the table has it)."""
    near = F.col("shifted") if "shifted" in tokens.columns else shifted()
    return _decide(tokens, near, T.render("word", F.lit("0")), "prepositional")


def compound_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word) -> (word, compound): words with `-`, with the first candidate of each part that is known. Words
    without a known part are left out.
    """
    parts = words.where(F.col("word").contains("-")).select("word", F.posexplode(F.split("word", "-", -1)).alias("at", "part")).withColumn("key", T.lookup_key("part"))
    known = parts.join(sendable(lexicon.select(F.col("form").alias("key"), F.get("candidates", F.lit(0)).alias("sig"))), "key", "left")
    made = known.withColumn("made", T.apply_signature("part", "sig"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("made", "part").alias("x")))), lambda s: s["x"]), "-")
    return made.groupBy("word").agg(whole.alias("compound"), F.count("made").alias("n")).where("n > 0").drop("n")


def longest_suffix(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word) -> (word, sig): by the longest suffix of `table` (suffix, from_end) whose vowel the word has."""
    text = T.nfd(F.lower("word"))
    vowels = F.length(F.regexp_replace(text, "[^аеєиіоуюя]", ""))
    cut = words.select("word", text.alias("t"), vowels.alias("vowels")).where("vowels >= 2")
    cut = cut.select("word", "vowels", "t", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_SUFFIX), F.length("t")))).alias("n"))
    hits = cut.withColumn("suffix", F.expr("right(t, n)")).join(sendable(table), "suffix").where("from_end < vowels")
    return hits.groupBy("word").agg(F.max_by(F.col("vowels") - 1 - F.col("from_end"), "n").cast("string").alias("sig"))


def unknown_words(words: DataFrame, lexicon: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """(word) -> (word, compound, by_suffix, by_place): tiers 5 to 7 for distinct words that the lexicon lacks."""
    # The place is a column of its own: inside `render` an expression would be computed at each use. Before the joins, which may leave one task.
    out = words.withColumn("place", positional_signature("word"))
    # Without breaks it is a plain ordinal, which is set by a short way.
    alone = ~F.col("word").rlike(f"[{A.BREAK_CLASS}]")
    out = out.withColumn("place", F.when(alone, F.substring_index("place", ":", -1)).otherwise(F.col("place")))
    out = out.withColumn("by_place", F.when(T.vowel_count("word") >= 2, T.render("word", "place"))).drop("place")
    out = out.join(compound_words(words, lexicon), "word", "left")
    if suffixes is None:
        return out.withColumn("by_suffix", F.lit(None).cast("string"))
    return out.join(spread(longest_suffix(words, suffixes)).select("word", T.render("word", "sig").alias("by_suffix")), "word", "left")


def word_decisions(words: DataFrame, lexicon: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """Distinct (word, initial) -> what all tiers say that depend on these alone.

    key, candidates, status and output of tier 1, by_word and by_word_status of tiers 5 to 7 where it found
    nothing, and by_default, the first of several candidates set.
    """
    known = made_once(classify_words(words, lexicon))
    lost = made_once(unknown_words(made_once(spread(known.where("status = 'not_found'").select("word").distinct())), lexicon, suffixes))
    kind = F.when(F.col("compound").isNotNull(), "compound").when(F.col("by_suffix").isNotNull(), "suffix").when(F.col("by_place").isNotNull(), "default_position")
    lost = lost.select("word", F.coalesce("compound", "by_suffix", "by_place").alias("by_word"), kind.alias("by_word_status"))
    first = F.when(F.col("status") == "model_ineligible", T.render("word", F.get("candidates", F.lit(0))))
    return made_once(known.join(sendable(lost), "word", "left").withColumn("by_default", first))


def decide_words(docs: DataFrame, lexicon: DataFrame, suffixes: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word_decisions` of the words of documents."""
    words = with_initial(explode_words(docs, id_col, text_col)).where("word is not null").select("word", "initial").distinct()
    return word_decisions(spread(words), lexicon, suffixes)


def open_words(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """(doc_id, start, end, word, key, candidates, k): the words with several candidates, of documents and their `decide_words`."""
    several = made_once(decided.where("status = 'model_ineligible'").select("word", "initial", "key", "candidates"))
    t = with_initial(explode_words(docs, offsets=True)).select("doc_id", "start", "end", "word", "initial", "k")
    return t.join(sendable(several), ["word", "initial"]).select("doc_id", "start", "end", "word", "key", "candidates", "k")


def fall_back(tokens: DataFrame) -> DataFrame:
    """Tiers 5 to 7 for tokens with the columns of `word_decisions`."""
    lost = (F.col("status") == "not_found") & F.col("by_word").isNotNull()
    out = tokens.withColumn("output", F.when(lost, F.col("by_word")).otherwise(F.col("output")))
    return out.withColumn("status", F.when(lost, F.col("by_word_status")).otherwise(F.col("status")))


def positional_signature(word: Column | str) -> Column:
    """The last vowel but one of the last segment that has vowels (its only one, if there is one)."""
    w = F.col(word) if isinstance(word, str) else word
    counts = F.transform(F.split(w, f"[{A.BREAK_CLASS}]", -1), lambda s: F.length(F.regexp_replace(s, f"[^{A.COUNTED}]", "")))
    last = F.coalesce(F.array_max(F.filter(F.transform(counts, lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())), F.lit(0))
    return F.concat_ws(":", last, F.greatest(F.lit(0), F.get(counts, last) - 2))


def dictionary_default(tokens: DataFrame) -> DataFrame:
    """Tier 9: what is still undecided takes its first candidate (`by_default` where the table has it)."""
    open_ = F.col("status").isin("ambiguous", "model_ineligible") & (F.size("candidates") > 0)
    first = F.col("by_default") if "by_default" in tokens.columns else T.render("word", F.get("candidates", F.lit(0)))
    made = tokens.withColumn("made", F.when(open_, first))
    status = F.when(F.col("made").isNotNull(), "dictionary_default").when(open_, "invalid_candidate").otherwise(F.col("status"))
    return made.withColumn("status", status).withColumn("output", F.coalesce("made", "output")).drop("made")


def _model_answers(decisions: DataFrame | None, choices: DataFrame | None) -> dict[str, DataFrame]:
    """A cross-encoder's decisions (doc_id, start, sig, decision, scores, margin) and a scorer's choices (doc_id, start, sig), by the names they have beside tokens."""
    said = F.struct(F.col("sig").alias("chosen"), "decision", "scores", "margin").alias("answer")
    out = {} if decisions is None else {"said": decisions.select("doc_id", "start", said)}
    return out if choices is None else out | {"choice": choices.select("doc_id", "start", F.col("sig").alias("answer"))}


def apply_choices(tokens: DataFrame, statuses: list[str], status: str) -> DataFrame:
    """Choices (column `choice`) for tokens of given statuses; those outside the candidates are passed over."""
    if "choice" not in tokens.columns:
        return tokens
    asked = F.col("status").isin(statuses) & (F.size("candidates") >= 2) & F.array_contains("candidates", F.col("choice"))
    return _decide(tokens, asked, T.apply_signature("word", "choice"), status).drop("choice")


def with_decisions(tokens: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Tokens with a cross-encoder's decisions (doc_id, start, sig, decision, scores, margin)."""
    if decisions is None:
        return tokens.withColumns({"scores": F.lit(None).cast("map<string,double>"), "margin": F.lit(None).cast("double")})
    return _answered(tokens, decisions.select("doc_id", "start", F.col("sig").alias("chosen"), *_DECISION[1:]))


def apply_decisions(tokens: DataFrame) -> DataFrame:
    """Tier 2: decisions (columns chosen, decision) for open targets."""
    if "decision" not in tokens.columns:
        return tokens
    j = tokens.withColumn("made", F.when(F.array_contains("candidates", F.col("chosen")), T.apply_signature("word", "chosen")))
    open_, said = F.col("status") == "model_ineligible", F.col("decision")
    status = (
        F.when(open_ & (said == "selected"), F.when(F.col("made").isNotNull(), "stressed").otherwise("invalid_candidate"))
        .when(open_ & (said == "candidate_mismatch"), "invalid_candidate")
        .when(open_ & said.isin("low_margin", "ambiguous"), "ambiguous")
        .otherwise(F.col("status"))
    )
    output = F.when(open_ & (said == "selected"), F.coalesce("made", "output")).otherwise(F.col("output"))
    return j.withColumn("output", output).withColumn("status", status).drop("made", "chosen", "decision")


def mark_tokens(
    docs: DataFrame, lexicon: DataFrame, suffixes: DataFrame | None = None, on_ambiguity: str = "default", decisions: DataFrame | None = None,
    morphology=None, choices: DataFrame | None = None, combiner=None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True, decided: DataFrame | None = None,
) -> DataFrame:
    """All tiers in order: one row for each word (and a last one a document, with a null word).

    `morphology` and `combiner` take and return the token table; `decisions` and `choices` are score tables. These are
    joined to whole documents and stand beside words while they are an array; what the tiers add to a token, words in a table too large to send
    included, comes behind. `first` is the status by the lexicon alone. `decided` is `decide_words` of the same documents, where it is made already.
    """
    if on_ambiguity not in ("default", "preserve"):
        raise ValueError("on_ambiguity must be 'default' or 'preserve'")
    if decided is None:
        decided = decide_words(docs, lexicon, suffixes, id_col, text_col)
    answers = _model_answers(decisions, choices)
    if answers:
        tokens = explode_words(with_answers(docs, answers, id_col, text_col), offsets=True, answers=tuple(answers))
    else:
        tokens = explode_words(docs, id_col, text_col, offsets or not (morphology is combiner is None))
    # Of the gap and the word before, shuffles carry what is asked of them.
    tokens = with_initial(tokens).withColumn("shifted", F.coalesce(shifted(), F.lit(False)))
    if decisions is None:
        tokens = tokens.withColumns({"scores": F.lit(None).cast("map<string,double>"), "margin": F.lit(None).cast("double")})
    else:
        tokens = tokens.select("*", "said.*").drop("said")
    tokens = tokens.join(sendable(decided), ["word", "initial"], "left").withColumn("first", F.col("status"))
    tokens = apply_decisions(tokens)
    if morphology is not None:
        # Its steps read the table twice.
        tokens = morphology(stored(tokens))
    tokens = fall_back(prepositional_shift(tokens)).drop("shifted")
    tokens = apply_choices(tokens, ["ambiguous", "model_ineligible", "stressed"], "token_model")
    if on_ambiguity == "default":
        tokens = dictionary_default(tokens)
        if combiner is not None:
            tokens = combiner(tokens)
    return tokens


def rebuild(tokens: DataFrame) -> DataFrame:
    """(row, doc_id, text): gaps and outputs in order, for each document row."""
    piece = F.struct("k", F.concat("gap", F.coalesce("output", F.lit(""))).alias("x"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["x"]), "")
    return tokens.groupBy("row").agg(F.first("doc_id").alias("doc_id"), whole.alias("text"))
