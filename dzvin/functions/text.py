"""Column expressions for stress text: keys, tokens, vowels, signatures. None leaves the JVM but `nfd_any`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dzvin.functions import alphabet as A

_NO_STRINGS = "array<string>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once; inside a lambda an expression is computed at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def nfd_any(s: pd.Series) -> pd.Series:
    """NFD of any text; `nfd` is enough for text in the alphabet."""
    return s.str.normalize("NFD")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


#: A character outside these may not be as NFC has it, or may join with the one before.
_MAYBE_NOT_NFC = "[^\\x{0}-\\x{2FF}\\x{400}-\\x{482}\\x{48A}-\\x{52F}\\x{2010}-\\x{205E}\\x{20AC}\\x{2116}]"


def nfc_any(c: Column | str) -> Column:
    """NFC of any text; only texts that may need it are sent to Python."""
    text = _col(c)
    return F.when(text.rlike(_MAYBE_NOT_NFC), _nfc(F.when(text.rlike(_MAYBE_NOT_NFC), text))).otherwise(text)


#: The Cyrillic letters that decompose, for a decomposition by replacement.
_COMPOSED = [c for c in map(chr, range(0x400, 0x530)) if len(unicodedata.normalize("NFD", c)) > 1 and c in "йЙїЇёЁўЎ"]


def nfd(c: Column | str) -> Column:
    out = _col(c)
    for letter in _COMPOSED:
        out = F.replace(out, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    return out


def canonical_form(c: Column | str) -> Column:
    """NFD, one kind of apostrophe, and `-` for a hyphen between two characters that are not spaces."""
    out = F.translate(nfd(c), A.APOSTROPHES, A.APOSTROPHE * len(A.APOSTROPHES))
    return F.regexp_replace(out, f"(?U)(?<=\\S)[{A.HYPHENS}](?=\\S)", "-")


def lookup_key(c: Column | str) -> Column:
    return F.replace(F.lower(canonical_form(c)), F.lit(A.ACUTE), F.lit(""))


def vowel_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(lookup_key(c), "[^аеєиіоуюя]", ""))


def char_problem(c: Column | str) -> Column:
    """Null when all characters are allowed, otherwise the reason that the first bad one gives."""
    text = canonical_form(c)
    low = A.LETTERS.replace("й", "").replace("ї", "")
    # What is allowed taken out everywhere, the rest begins with the first bad character; runs of single characters first.
    good = f"[{low}{low.upper()}{A.APOSTROPHE}{A.ACUTE}\\x20\\t-](?![{A.BREVE}{A.DIAERESIS}])|[Ии]{A.BREVE}|[Іі]{A.DIAERESIS}|[{low}{low.upper()}{A.APOSTROPHE}{A.ACUTE}\\x20\\t-]"
    bad = F.substring(F.regexp_replace(text, good, ""), 1, 1)
    return (
        F.when(F.length(text) == 0, "empty form")
        .when(bad == "", None)
        .when(bad.rlike("^\\p{C}"), "control character")
        .when(bad.rlike("^\\p{M}"), "unsupported combining mark")
        .otherwise("unsupported character")
    )


def stress_problem(c: Column | str) -> Column:
    """As `char_problem`, then each acute must follow a vowel; ї may carry one, й may not."""
    text = canonical_form(c)
    stray = text.rlike(f"(^|[^аеєиіоуюяАЕЄИІОУЮЯ{A.DIAERESIS}]){A.ACUTE}")
    return F.coalesce(char_problem(c), F.when(stray, "acute must immediately follow a Ukrainian vowel"))


def stress_signature(c: Column | str) -> Column:
    """The vowel ordinals of the acutes: `N`, `S:N` in words of several segments, joined by `|`. Null where
    the word is invalid or bears no acute.
    """
    segments = F.filter(F.split(canonical_form(c), "(?U)[\\s-]+"), lambda s: s != "")
    count = lambda s: F.length(F.regexp_replace(F.lower(s), "[^аеєиіоуюя]", ""))

    def of_segment(s: Column, k: Column) -> Column:
        cut = F.split(s, A.ACUTE, -1)
        # The vowels before the i-th acute are those of the first i pieces.
        ordinals = F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda _, i: count(F.array_join(F.slice(cut, F.lit(1), i + 1), "")) - 1)
        return F.transform(ordinals, lambda n: F.when(F.size(segments) == 1, n.cast("string")).otherwise(F.concat_ws(":", k, n)))

    found = F.flatten(F.transform(segments, of_segment))
    return F.when(stress_problem(c).isNull() & (F.size(found) > 0), F.array_join(found, "|"))


def units(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(A.UNIT), F.lit(0))


def wanted_places(signature: Column | str) -> Column:
    """`segment:ordinal` of each part of a signature; null where it is malformed. Free variation without
    segments counts by its first member.
    """
    s = _col(signature)
    first = F.when(s.contains("|") & ~s.contains(":"), F.substring_index(s, "|", 1)).otherwise(s)
    parts = F.split(first, "\\|", -1)
    number = lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0"))
    places = F.transform(parts, lambda p: F.when(p.contains(":"), F.concat_ws(":", number(F.substring_index(p, ":", 1)), number(F.substring_index(p, ":", -1)))).otherwise(F.concat(F.lit("0:"), number(p))))
    return F.when(F.forall(parts, lambda p: p.rlike("^(?:[0-9]+:)?[0-9]+$")), F.array_distinct(places))


def apply_signature(surface: Column | str, signature: Column | str) -> Column:
    """The word with its acutes; null where the signature is malformed or does not fit, or one is there."""
    w, s = _col(surface), _col(signature)
    vowel, parts = f"[{A.COUNTED}]{A.MARKS}*$", f"[{A.BREAK_CLASS}]$"

    # A letter for each unit: it ends in a vowel, a break, or neither.
    kinds = lambda u: F.array_join(F.transform(u, lambda x: F.when(x.rlike(vowel), "v").when(x.rlike(parts), "b").otherwise("c")), "")
    count = lambda k, letter: F.length(k) - F.length(F.replace(k, F.lit(letter), F.lit("")))

    def unit_of(k: Column, place: Column) -> Column:
        """The number of the unit at `segment:ordinal`, null where the word lacks it."""
        segment, ordinal = F.substring_index(place, ":", 1).try_cast("int"), F.substring_index(place, ":", -1).try_cast("int")
        begin = F.when(segment == 0, 0).otherwise(F.length(F.call_function("substring_index", k, F.lit("b"), segment)) + 1)
        own = F.substring_index(F.substring(k, begin + 1, F.length(k)), "b", 1)
        return F.when((count(k, "b") >= segment) & (count(own, "v") > ordinal), begin + F.length(F.call_function("substring_index", own, F.lit("v"), ordinal + 1)))

    def put(u: Column, hits: Column) -> Column:
        marked = F.transform(u, lambda x, i: F.concat(x, F.when(F.array_contains(hits, i), A.ACUTE).otherwise("")))
        return F.when(F.forall(hits, lambda h: h.isNotNull()), F.array_join(marked, ""))

    def placed(t: Column) -> Column:
        with_kinds = F.struct(kinds(t["u"]).alias("k"), t["u"].alias("u"), t["wanted"].alias("wanted"))
        return let(with_kinds, lambda x: let(F.struct(F.transform(x["wanted"], lambda p: unit_of(x["k"], p)).alias("hits"), x["u"].alias("u")), lambda y: put(y["u"], y["hits"])))

    made = let(F.struct(units(w).alias("u"), wanted_places(s).alias("wanted")), placed)
    return F.when(~w.contains(A.ACUTE) & (F.length(s) > 0), made)


def plain_signature(surface: Column | str, ordinal: Column) -> Column:
    """`apply_signature` for words of one segment and a single ordinal, by one cut instead of arrays of arrays."""
    w = _col(surface)

    def put(u: Column) -> Column:
        fits = F.coalesce(F.get(u, ordinal).rlike(f"[{A.COUNTED}]{A.MARKS}*$"), F.lit(False))
        return F.when(fits, F.concat(F.array_join(F.slice(u, F.lit(1), ordinal + 1), ""), F.lit(A.ACUTE), F.array_join(F.slice(u, ordinal + 2, F.greatest(F.size(u) - ordinal - 1, F.lit(0))), "")))

    return let(units(w), put)


def render(surface: Column | str, signature: Column | str) -> Column:
    """`apply_signature`, by the short way where word and signature allow it."""
    w, s = _col(surface), _col(signature)
    simple = s.rlike("^[0-9]{1,2}$") & ~w.rlike(f"[{A.BREAK_CLASS}{A.ACUTE}]")
    return F.when(simple, plain_signature(w, F.when(simple, s).cast("int"))).otherwise(apply_signature(w, s))


def signature_of_output(c: Column | str) -> Column:
    """The ordinal of the vowel that the first acute follows; empty without an acute or before any vowel."""
    text = nfd(c)
    n = F.length(F.regexp_replace(F.lower(F.substring_index(text, A.ACUTE, 1)), "[^аеєиіоуюя]", "")) - 1
    return F.when(text.contains(A.ACUTE) & (n >= 0), n.cast("string")).otherwise("")


def apply_accents(surface: Column | str, places: Column) -> Column:
    """Acutes inserted at character offsets, from the right."""
    put = lambda a, p: F.concat(F.substring(a, F.lit(1), p), F.lit(A.ACUTE), F.substring(a, p + 1, F.length(a)))
    return F.aggregate(F.sort_array(places, asc=False), _col(surface), put)


def opens_sentence(gap: Column, first: Column) -> Column:
    """Whether a word opens a sentence, from the text since the word before it (or the start)."""
    skipped = "[\\s\\x{1C}-\\x{1F}" + "".join(f"\\{c}" if c in "[]-\"'()" else c for c in A.OPENERS) + "]"
    left = F.regexp_replace(gap, f"(?U){skipped}+\\z", "")
    return F.when(left == "", first).otherwise(F.substring(left, -1, 1).isin(list(A.ENDERS)))


def by_capitalisation(candidates: Column, proper: Column, word: Column, initial: Column) -> Column:
    """Candidates narrowed or put in order by case: `proper` maps a signature to whether it is a name's."""
    head = F.substring(word, 1, 1)
    capital = (head == F.upper(head)) & (head != F.lower(head))

    def ordered(x: Column) -> Column:
        names, common = x["names"], x["common"]
        preferred = F.when(~capital, common).when(~initial, names)
        order = F.when(F.size(preferred) == 1, preferred).otherwise(F.concat(preferred, F.array_except(candidates, preferred)))
        return F.when((F.size(names) > 0) & (F.size(common) > 0) & preferred.isNotNull(), order).otherwise(candidates)

    named = F.map_keys(F.map_filter(proper, lambda k, v: v))
    split = lambda n: F.struct(F.array_intersect(candidates, n).alias("names"), F.array_except(candidates, n).alias("common"))
    return F.when((F.size(candidates) >= 2) & (F.length(word) > 0) & proper.isNotNull(), let(named, lambda n: let(split(n), ordered))).otherwise(candidates)


def softmax(scores: Column) -> Column:
    """Probabilities of a map of scores; an empty map stays empty."""
    top = F.array_max(F.map_values(scores))
    exp = F.transform_values(scores, lambda k, v: F.exp(v - top))
    total = F.aggregate(F.map_values(exp), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(exp, lambda k, v: v / total)


def feature(feats: Column, key: str) -> Column:
    """The value of a key in `K=V|K=V`; the last one wins. Null where there is none."""
    hits = F.filter(F.split(F.coalesce(feats, F.lit("")), "\\|"), lambda p: p.startswith(f"{key}="))
    return F.substring(F.get(hits, F.size(hits) - 1), len(key) + 2, 1000)


def observed_features(upos: Column, feats: Column) -> Column:
    """The tags a parse shows: its features and its part of speech with what stands for it."""
    own = F.filter(F.split(F.coalesce(feats, F.lit("")), "\\|"), lambda p: p != "")
    same = F.when(upos.isNull() | (upos == ""), F.array().cast(_NO_STRINGS))
    for k, v in A.EQUIVALENT_UPOS.items():
        same = same.when(upos == k, F.array(*(F.lit(f"upos={x}") for x in v)))
    return F.array_union(own, same.otherwise(F.array(F.concat(F.lit("upos="), upos))))


def later_accent(accents: Column) -> Column:
    return F.coalesce(F.array_max(accents), F.lit(-1))


def strip_accents(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[̀́͂]", "")
