"""Golden vectors of the scalar rules."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from dzvin.functions import text as T
from dzvin.operators import lexicon, metrics, morphology, scoring, segment, spans, tiers, tokens

A = "́"
SIGNED = [
    ("район", "2", "райо́н"), ("війна", "2", "війна́"), ("м'ясо", "0", "м'я́со"), ("їжа", "0", "ї́жа"), ("держава", "0|1", "де́ржава"), ("пів-яблука", "0:0|1:0", "пі́в-я́блука"),
    ("МОВА", "0", "МО́ВА"), ("пів-яблука", "1:0", "пів-я́блука"), ("п'ятьох", "1", "п'ятьо́х"), ("їхати", "0", "ї́хати"), ("здоров'я", "1", "здоро́в'я"), ("сім'я", "0", "сі́м'я"),
    ("полум'ям", "0", "по́лум'ям"), ("дівчина", "0|1", "ді́вчина"), ("років", "0|1", "ро́ків"), ("району", "2", "райо́ну"), ("їжак", "0", "ї́жак"),
    ("мо" + A + "ва", "0", None), ("мова", "", None), ("мова", "-1", None), ("мова", "0:-1", None), ("мова", "abc", None), ("мова", "5", None),
]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_signatures_are_rendered(spark):
    d = spark.createDataFrame(SIGNED, "w string, s string, want string")
    got = d.select("w", "s", "want", T.apply_signature("w", "s").alias("full"), T.render("w", "s").alias("short")).collect()
    for r in got:
        want = r.want and unicodedata.normalize("NFC", r.want)
        assert [x and unicodedata.normalize("NFC", x) for x in (r.full, r.short)] == [want, want], (r.w, r.s)
    apart = unicodedata.normalize("NFD", "їжа")
    assert one(spark, T.apply_signature("w", F.lit("0")), w=apart) == apart[:2] + A + apart[2:]


def test_words_of_a_text(spark):
    text = "🦉 'Мої сестри.' м’ясо пів—яблука мо́ва -"
    got = sorted(tokens.word_tokens(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect(), key=lambda r: r.start)
    assert [r.text for r in got] == ["Мої", "сестри", "м’ясо", "пів—яблука", "мо́ва"]
    assert all(text[r.start : r.end] == r.text for r in got)


@pytest.mark.parametrize(("candidates", "names", "word", "initial", "want"), [
    (["1", "0"], ["1"], "русі", False, ["0"]), (["1", "0"], ["1"], "Русі", False, ["1"]), (["1", "0"], ["1"], "Русі", True, ["1", "0"]), (["2", "1", "0"], ["2"], "русі", False, ["1", "0", "2"]),
    (["1"], ["1"], "русі", False, ["1"]), (["1", "0"], [], "Русі", False, ["1", "0"]),
])
def test_case_orders_candidates(spark, candidates, names, word, initial, want):
    proper = F.map_from_entries(F.transform("c", lambda x: F.struct(x, F.array_contains("n", x))))
    assert one(spark, T.by_capitalisation(F.col("c"), proper, F.col("w"), F.col("i")), c=candidates, n=names, w=word, i=initial) == want


@pytest.mark.parametrize(("gap", "first", "want"), [("", True, True), ("Кінець. ", False, True), (" ", False, False), ("— «", True, True), ("... (", False, True), (", ", False, False)])
def test_sentence_start(spark, gap, first, want):
    assert one(spark, T.opens_sentence(F.col("g"), F.col("f")), g=gap, f=first) is want


def test_signature_of_output(spark):
    for word, want in (("за́мок", "0"), ("замо́к", "1"), ("райо́н", "2"), ("Сестри́", "1"), ("замок", "")):
        assert one(spark, T.signature_of_output("w"), w=word) == want


def test_keys(spark):
    for word, want in (("мо́ва", "мова"), ("п'ять", "пʼять"), ("п’ять", "пʼять"), ("пів—яблука", "пів-яблука"), ("ҐАНОК", "ґанок"), ("райо́н", "район"), ("ї́жа", "їжа"), ("— так", "— так")):
        assert one(spark, T.lookup_key("w"), w=word) == unicodedata.normalize("NFD", want)
    for word, n in (("в", 0), ("район", 3), ("їжа", 2), ("пʼять", 1)):
        assert one(spark, T.vowel_count("w"), w=word) == n


def test_validation(spark):
    cases = {"": "empty form", "мова": None, "mова": "unsupported character", "мо\x00ва": "control character", "а̀": "unsupported combining mark", "їй": None, "ў": "unsupported combining mark"}
    for word, want in cases.items():
        assert one(spark, T.char_problem("w"), w=word) == want, repr(word)
    for word, good in (("ї́жа", True), ("й́", False), ("м́ова", False), ("мо́ва", True), ("́мова", False)):
        assert (one(spark, T.stress_problem("w"), w=word) is None) is good, word
    for word, want in (("мо́ва", "0"), ("пів-я́блука", "1:0"), ("пі́в-я́блука", "0:0|1:0"), ("де́ржа́ва", "0|1"), ("мова", None), ("райо́н", "2")):
        assert one(spark, T.stress_signature("w"), w=word) == want


def test_candidate_lists(spark):
    for have, want in ((["0|1", "1"], ["1"]), (["1", "0|1"], ["1"]), (["0|1"], ["0|1"]), (["0:0|1:0", "0"], ["0:0|1:0", "0"])):
        assert one(spark, lexicon.drop_subsumed(F.col("s")), s=have) == want
    for have, wanted, want in ((["0", "1", "2"], "1", ["1", "0", "2"]), (["0", "1"], "0", ["0", "1"]), (["0", "1"], "3", ["0", "1"]), (["0"], "1", ["0"])):
        assert one(spark, lexicon.prefer(F.col("s"), F.col("w")), s=have, w=wanted) == want


def test_fall_backs(spark):
    for word, want in (("держава", "0:1"), ("пів-яблука", "1:1"), ("дім", "0:0"), ("ма-в", "0:0")):
        assert one(spark, tiers.positional_signature("w"), w=word) == want
    table = spark.createDataFrame([("ава", 1), ("а", 0), ("держава", 9)], "suffix string, from_end int")
    words = spark.createDataFrame([("держава",), ("мова",), ("дім",)], "word string")
    assert {r.word: r.sig for r in tiers.longest_suffix(words, table).collect()} == {"держава": "1", "мова": "1"}


READING = "array<struct<tags:array<string>,accents:array<int>>>"


def test_morphology(spark):
    nouns = [(["Number=Plur", "Case=Nom", "Gender=Neut", "upos=NOUN"], [2]), (["Number=Sing", "Case=Gen", "Gender=Neut", "upos=NOUN"], [4])]
    split = [(["upos=NOUN", "Case=Nom"], [2]), (["upos=VERB", "Number=Plur"], [4])]
    rows = [(nouns, "NOUN", "Case=Nom|Number=Plur|Gender=Neut", [2]), (nouns, "NOUN", "Case=Gen|Number=Sing|Gender=Neut", [4]), (nouns, "NOUN", "Case=Dat|Number=Sing", None), (split, "NOUN", "Case=Nom", None)]
    d = spark.createDataFrame(rows, f"r {READING}, u string, f string, want array<int>")
    assert all(x.got == x.want for x in d.select("want", morphology.resolve(F.col("r"), F.col("u"), F.col("f")).alias("got")).collect())
    pair = [(["VerbForm=Inf", "upos=VERB"], [2]), (["VerbForm=Inf", "upos=VERB"], [6])]
    d = spark.createDataFrame([(pair, "почала", [6]), (pair, "він", None), (nouns, "почала", None)], f"r {READING}, g string, want array<int>")
    assert all(x.got == x.want for x in d.select("want", morphology.imperfective(F.col("r"), F.col("g")).alias("got")).collect())
    p = spark.createDataFrame([(1, 0, "NUM", "Case=Nom", "три"), (1, 4, "NOUN", "Animacy=Inan|Case=Nom|Gender=Fem|Number=Plur", "книги"), (2, 0, "NUM", "Case=Gen", "трьох"), (2, 6, "NOUN", "Case=Nom|Number=Plur", "книг")], "doc_id int, start int, upos string, feats string, text string")
    got = {(r.doc_id, r.start): r.counted for r in morphology.counted_form(p).collect()}
    assert got == {(1, 0): None, (1, 4): "Animacy=Inan|Case=Gen|Gender=Fem|Number=Sing", (2, 0): None, (2, 6): None}
    for word, at, want in (("коси", 2, "ко́си"), ("коси", 4, "коси́"), ("колеса", 2, "ко́леса")):
        assert one(spark, T.apply_accents("w", F.array(F.col("a"))), w=word, a=at) == want


def chunks_of(spark, texts, budget=None, counter=segment.count_words):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = segment.with_chunks(d, "t", budget, counter).collect()
    return [([(c.text, c.speakable) for c in r.chunks], r.warnings) for r in sorted(rows, key=lambda r: r.i)]


def test_segmentation(spark):
    texts = ["Це речення. А це друге!\n\nІ третє…  ", "2024 р. у Києві.", "", "  ", "а. Б. Шевченко прийшов. так", "«Так?» — спитав він.", "\n \n Так.\tНі", "Один. Два!", None]
    for budget in (None, 2):
        for t, (cut, _) in zip(texts, chunks_of(spark, texts, budget), strict=True):
            assert "".join(x for x, _ in cut) == (t or "") and all(x.strip() == x and x if s else not x.strip() for x, s in cut)
    whole = [c for c, _ in chunks_of(spark, texts)]
    assert whole[1] == [("2024 р. у Києві.", True)] and [x for x, s in whole[7] if s] == ["Один.", "Два!"]
    assert [x for x, s in whole[0] if s] == ["Це речення.", "А це друге!", "І третє…"] and [x for x, s in whole[5] if s] == ["«Так?»", "— спитав він."]
    assert [x for x, s in whole[4] if s] == ["а.", "Б. Шевченко прийшов. так"]


def test_windows(spark):
    long = "один два три, чотири п'ять шість сім; вісім дев'ять десять"
    [(cut, warned)] = chunks_of(spark, [long], 5)
    assert "".join(x for x, _ in cut) == long and all(segment.count_words(x) <= 5 for x, _ in cut) and len(warned) == 1
    [(by_letters, warned)] = chunks_of(spark, [long + ". Так."], 20, len)
    assert all(len(x.rstrip()) <= 20 for x, s in by_letters if s) and by_letters[-1] == ("Так.", True) and len(warned) == 1
    assert segment.refit("а" * 50, len, 9) == ["а" * 50] and segment.refit("аб вг; де", len, 7) == ["аб вг; ", "де"]


def test_windows_are_cut_in_small_steps(spark, monkeypatch):
    """A batch of many texts goes through Python in parts of bounded text, with the same rows; composed text stays out of Python."""
    import pyarrow as pa

    texts = ["Один два три чотири п'ять. " * k + "е\u0301 и\u0306." for k in range(40)] + ["", "Так."]
    cut = lambda: [(r.pos, r.text, r.speakable) for r in segment.chunk_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1), budget=3).orderBy("doc_id", "pos").collect()]
    whole = cut()
    assert "".join(x for _, x, _ in whole) == unicodedata.normalize("NFC", "".join(texts)) and all(segment.count_words(x) <= 3 for _, x, s in whole if s)
    monkeypatch.setattr(segment, "_STEP", 500)
    assert cut() == whole
    chunks = pa.array([[{"text": "а" * n, "speakable": True}] for n in (100, 100, 100, 900, 10, 10)] + [[]], pa.list_(pa.struct([("text", pa.string()), ("speakable", pa.bool_())])))
    assert list(segment._steps(chunks)) == [(0, 2), (2, 1), (3, 1), (4, 3)] and list(segment._steps(chunks[1:3])) == [(0, 2)]


def test_routing(spark):
    yes = ["2024 р.", "о 14:30", "1 500 грн", "50%", "№ 5", "USD", "кілька тис. осіб"]
    no = ["сидів спокійно", "на березі річки", "довгі коси спадали на плечі", "ІСТОРИЧНИЙ НАРИС"]
    d = spark.createDataFrame([(t, t in yes) for t in yes + no], "t string, want boolean")
    assert all(r.want == r.got for r in d.select("t", "want", segment.needs_verbalization(F.col("t")).alias("got")).collect())


def test_spans(spark):
    text = lambda s: [x for _, _, x in spans.find_spans(s)]
    assert text("На 2 поверсі є 3 кімнати та 12 дверей.") == ["2 поверсі є", "3 кімнати та", "12 дверей"]
    assert text("Як Вічний Жид[93], і в мене також.") == ["[93]"] and text("Він відчинив замок ключем.") == [] and text("") == []
    assert text("У графі постав Так/Ні для пунктів.") == ["/Ні"]
    cases = [("Як Вічний Жид[93], і в мене також.", [""], "Як Вічний Жид, і в мене також."), ("У графі постав Так/Ні для пунктів.", ["слеш Ні"], "У графі постав Так слеш Ні для пунктів."), (None, [], ""), (" 5 ", ["п'ять"], "п'ять")]
    rows = [(t, [tuple(x) for x in spans.find_spans(t or "")], o, want) for t, o, want in cases]
    d = spark.createDataFrame(rows, "t string, s array<struct<start:int,end:int,text:string>>, o array<string>, want string")
    assert all(r.got == r.want for r in d.select("want", spans.assemble("t", "s", "o").alias("got")).collect())
    with pytest.raises(Exception, match="one output for each span"):
        d.limit(1).select(spans.assemble("t", "s", F.array().cast("array<string>"))).collect()


def test_marked_spans(spark):
    """The sentence around each span, by a plain cut into words on single spaces."""
    sentence = " ".join(f"слово{k}" for k in range(60)) + " 5 " + "  ".join(f"кінець{k}" for k in range(60))
    rows = [(sentence, x) for x in spans.find_spans(sentence)] + [("5", (0, 1, "5"))]
    d = spark.createDataFrame(rows, "t string, s struct<start:int,end:int,text:string>")
    for r in d.select("t", "s", spans.model_input(F.col("t"), F.col("s")).alias("got")).collect():
        left, right = r.t[: r.s.start].split(" "), r.t[r.s.end :].split(" ")
        assert r.got == " ".join(left[-41:]) + "[[" + r.s.text + "]]" + " ".join(right[:41])


def test_islands():
    import numpy as np

    a, z = spans.islands(np.array([5, 0, 9, 3, 20]), np.array([6, 4, 12, 5, 22]), lambda end, start: end == 6)
    assert (a.tolist(), z.tolist()) == ([0, 20], [12, 22])


@pytest.mark.parametrize("word", ["а" * 200_000, "а-" * 50_000 + "а", "б'" * 50_000 + "а" + "-" * 3000, "й" * 3000])
def test_long_words(spark, word):
    """Patterns must not recurse once a letter; a stack overflow would end the JVM."""
    d = spark.createDataFrame([(word,)], "w string")
    got = d.select(T.lookup_key("w").alias("key"), T.char_problem("w").alias("problem"), T.stress_signature("w").alias("sig"), segment.needs_verbalization(F.concat("w", F.lit("."))).alias("needs")).first()
    assert got.problem is None and got.sig is None and not got.needs
    [t] = tokens.word_tokens(d.select(F.lit(1).alias("doc_id"), F.col("w").alias("text"))).collect()
    assert t.text == word.rstrip("-")


def test_targets(spark):
    rows = [(-1, 5, ["0", "1"], "outside"), (3, 20, ["0", "1"], "outside"), (0, 2, ["0", "1"], "identify"), (3, 8, ["0"], "differ"), (3, 8, ["1", "0"], None)]
    d = spark.createDataFrame([("Це замок.", a, b, c, w) for a, b, c, w in rows], "s string, a int, b int, c array<string>, want string")
    problem = scoring.target_problem(F.col("s"), F.col("a"), F.col("b"), F.lit("замок"), F.col("c"), F.array(F.lit("0"), F.lit("1")))
    for r in d.select("want", problem.alias("got")).collect():
        assert (r.got is None) if r.want is None else r.want in r.got


def test_gold_file(spark):
    lines = ["# form: замок", "", "Це за́мок, а то замок.", "Замки", "# form: мова", "рідна мо́ва"]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line int, text string")
    got = sorted((r.line, r.form, r.start, r.end) for r in metrics.gold_targets(d).collect())
    assert got == [(2, "замок", 3, 8), (5, "мова", 6, 10)]
