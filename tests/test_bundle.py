"""The lexicon build from an archive to marked text."""

import gzip
import hashlib
import itertools
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from dzvin import AssetError, Lexicon, SpeechFrontend, StressEngine
from dzvin.operators import scoring, tiers
from dzvin.operators.morphology import morphology_tier
from dzvin.operators.tokens import running_sums, word_tokens
from dzvin.plans import queries
from dzvin.sources import archive

HEAD = "dataset_id,form_normalized,stressed_form,stress_signature,lemma_normalized,stressed_lemma,part_of_speech,grammatical_tags,lexeme_id,word_form_id,is_lemma,is_variant,is_obsolete,confidence,source_rank"
ROWS = [
    (99, "слово", "сло́во", "0", 1.0, 1), (2, "держави", "де́ржа́ви", "0|1", 0.9, 1), (12, "держави", "держа́ви", "1", 0.95, 2), (12, "русі", "Русі́", "1", 1.0, 1), (2, "русі", "ру́сі", "0", 0.8, 2),
    (2, "маю", "маю́", "1", 0.9, 1), (13, "маю", "ма́ю", "0", 1.0, 1), (2, "замок", "замо́к", "1", 0.8, 2), (2, "замок", "за́мок", "0", 0.8, 2),
    (2, "мене", "мене́", "1", 0.9, 1), (2, "мова", "мо́ва", "0", 0.9, 1),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archive")

    def write(name: str, text: str) -> str:
        data = gzip.compress(text.encode())
        (at / f"{name}.csv.gz").write_bytes(data)
        return f"{name}\t1\t1\t{hashlib.sha256(data).hexdigest()}"

    listed = [
        write("active_dataset", "singleton,dataset_id,activated_at\nt,2,2026-08-23 20:47:16+00\n"),
        write("stress_lookup", HEAD + "\n" + "".join(f"{d},{w},{s},{g},,,,,1,1,t,f,f,{c},{r}\n" for d, w, s, g, c, r in ROWS)),
        write("contextual_stress_candidate", "inventory_hash,model_version,form_normalized,stress_signature,stressed_form,group_id,sense_id\nabc123hash,v3,чужий,1,чужи́й,1,1\nwrong_hash,v3,чужий,0,чу́жий,1,2\n"),
    ]
    (at / "MANIFEST.tsv").write_text("\n".join(listed) + "\nshort\tline\n")
    (at / "trie_defaults_map.json").write_text('{"замок": "0"}')
    (at / "suffix_table.json").write_text(json.dumps({"ура": 0}))
    return at


@pytest.fixture(scope="module")
def bundle(spark, folder, tmp_path_factory):
    readings = spark.createDataFrame([("замок", [(["Case=Nom"], [2])])], "form string, readings array<struct<tags:array<string>,accents:array<int>>>")
    out = tmp_path_factory.mktemp("bundle")
    return archive.build_bundle(spark, str(folder), {"inventory_hash": "abc123hash", "model_version": "v3-test"}, str(out), readings)


def test_candidates_of_a_bundle(spark, bundle):
    manifest = archive.open_bundle(bundle)
    assert manifest["dataset_id"] == 2 and manifest["model_version"] == "v3-test"
    rows = {unicodedata.normalize("NFC", r.form): r for r in spark.read.parquet(str(bundle / "lexicon.parquet")).collect()}
    got = {k: r.candidates for k, r in rows.items()}
    assert got == {"держави": ["1"], "русі": ["1", "0"], "маю": ["0"], "замок": ["0", "1"], "чужий": ["1"], "мене": ["1"], "мова": ["0"]}
    assert rows["русі"].proper == {"1": True, "0": False} and rows["замок"].readings and rows["мова"].readings is None
    with Lexicon.open(spark, str(bundle)) as lexicon:
        assert len(lexicon) == 7
        assert lexicon.lookup(spark.createDataFrame([("Мо́ва",)], "word string")).first().candidates == ["0"]


TEXT = {1: "мова", 2: "мо́ва", 3: "в", 4: "до мене", 5: "до, мене", 6: "Замок у Русі.", 7: "мова-мова фігура абвгд", 8: "", 9: None, 10: "чужий мур держави"}


def test_statuses_and_marks(spark, bundle):
    engine = StressEngine.open(spark, str(bundle))
    docs = spark.createDataFrame(list(TEXT.items()), "doc_id int, text string")
    tokens = {(r.doc_id, r.text): (r.status, r.output_text) for r in engine.tokens(docs).collect()}
    assert tokens[1, "мова"] == ("stressed", "мо́ва") and tokens[2, "мо́ва"][0] == "already_stressed" and tokens[3, "в"][0] == "not_required"
    assert tokens[4, "мене"] == ("prepositional", "ме́не") and tokens[5, "мене"] == ("stressed", "мене́")
    assert tokens[6, "Замок"] == ("dictionary_default", "За́мок") and tokens[6, "Русі"] == ("stressed", "Русі́")
    assert tokens[7, "мова-мова"] == ("compound", "мо́ва-мо́ва") and tokens[7, "фігура"] == ("suffix", "фігура́") and tokens[7, "абвгд"][0] == "not_found"
    assert tokens[10, "мур"][0] == "not_found"
    text = {r.doc_id: r.text for r in engine.stress(docs).collect()}
    assert set(text) == set(TEXT) and text[8] == text[9] == "" and text[6] == "За́мок у Русі́."
    assert {r.status for r in engine.tokens(docs, on_ambiguity="preserve").where("text = 'Замок'").collect()} == {"model_ineligible"}
    with pytest.raises(ValueError):
        engine.tokens(docs, on_ambiguity="maybe")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_offsets_take_no_shuffle(spark):
    for n in (0, 1, 2, 3, 7, 8, 9, 1000):
        d = spark.createDataFrame([([k * k % 7 for k in range(n)],)], "x array<long>")
        assert d.select(running_sums(F.col("x")).alias("y")).first().y == list(itertools.accumulate(d.first().x))
    assert "Exchange" not in plan(word_tokens(spark.createDataFrame([(1, "мова")], "doc_id int, text string")))


def test_statuses_of_both_runs_in_one_pass(spark, bundle):
    engine = StressEngine.open(spark, str(bundle))
    docs = spark.createDataFrame([*TEXT.items(), (10, "мова")], "doc_id int, text string")
    got = sorted(engine.statuses(docs).collect())
    runs = [sorted((r.doc_id, r.text, r.status) for r in engine.tokens(docs, on_ambiguity=m).collect()) for m in ("preserve", "default")]
    assert [sorted((r.doc_id, r.text, r[k]) for r in got) for k in ("preserved", "default")] == runs
    assert {(r.text, r.first) for r in got if r.doc_id == 4} == {("до", "not_found"), ("мене", "stressed")} and "Window" not in plan(engine.statuses(docs))


def test_answers_of_models(spark, bundle):
    """Answers meet their words without a sort by place; of several to a place one counts, null ids meet null ids, closed words stay."""
    engine = StressEngine.open(spark, str(bundle))
    docs = spark.createDataFrame([(1, "Замок замок"), (None, "замок мова"), (2, "до мене замок")], "doc_id int, text string")
    said = [(1, 0, "1", "selected"), (1, 0, "1", "selected"), (1, 6, "0", "low_margin"), (None, 0, "1", "selected"), (None, 6, "0", "selected")]
    decisions = spark.createDataFrame(said, "doc_id int, start long, sig string, decision string").withColumns({"scores": F.create_map(F.col("sig"), F.lit(1.0)), "margin": F.lit(3.0)})
    choices = spark.createDataFrame([(2, 8, "1"), (1, 0, "7")], "doc_id int, start long, sig string")
    t = engine.tokens(docs, decisions=decisions, choices=choices)
    got = {(r.doc_id, r.start): (r.status, r.output_text, r.margin) for r in t.collect()}
    assert got == {
        (1, 0): ("stressed", "Замо́к", 3.0), (1, 6): ("dictionary_default", "за́мок", 3.0), (None, 0): ("stressed", "замо́к", 3.0), (None, 6): ("stressed", "мо́ва", 3.0),
        (2, 0): ("not_found", "до", None), (2, 3): ("prepositional", "ме́не", None), (2, 8): ("token_model", "замо́к", None),
    }
    assert t.count() == 7 and "Window" not in plan(t)


def test_tokens_are_not_shuffled_to_meet_answers(spark, bundle):
    """Far and equal places, null and repeated ids and null starts meet as a join by place would have it; words come from texts after the shuffle."""
    engine = StressEngine.open(spark, str(bundle))
    long = "мова " * 900 + "замок"
    docs = spark.createDataFrame([(1, long), (1, "замок"), (None, "мова замок"), (3, ""), (4, None)], "doc_id int, text string")
    choices = spark.createDataFrame([(1, 4500, "1"), (1, 0, "1"), (None, 5, "1"), (None, None, "1"), (9, 0, "1"), (1, 4500, "1")], "doc_id int, start long, sig string")
    t = engine.tokens(docs, choices=choices)
    got = sorted((r.doc_id or 0, r.start, r.output_text) for r in t.where("text = 'замок'").collect())
    assert got == [(0, 5, "замо́к"), (1, 0, "замо́к"), (1, 4500, "замо́к")] and t.count() == 904
    physical = t._jdf.queryExecution().executedPlan().toString()
    assert 0 < physical.index("Generate") < physical.index("Exchange hashpartitioning")
    again = engine.tokens(docs, choices=choices, decided=engine.words(docs))
    assert sorted((r.doc_id or 0, r.start, r.output_text) for r in again.collect()) == sorted((r.doc_id or 0, r.start, r.output_text) for r in t.collect())


def test_queries_with_answers_decide_words_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(queries.C, "build_lexicon", lambda rows, f=queries.C.build_lexicon: made.append("lexicon") or f(rows))
    monkeypatch.setattr(tiers, "classify_words", lambda *a, f=tiers.classify_words: made.append("words") or f(*a))
    t = queries.QUERIES["stress_decisions"](spark, "/root/testdata/sf0.001")
    assert sorted(made) == ["lexicon", "words"]
    scored = spark.createDataFrame([(1, 0, 0, "0", 1.0), (1, 0, 1, "1", 4.0)], "doc_id int, start long, pos int, sig string, score double")
    ranked = scoring.rank(scored, 2.0)
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.sig, r.margin, r.decision) for r in ranked.collect()] == [("1", 3.0, "selected")] and "decision" not in t.columns


def test_morphology_meets_open_words_only(spark, bundle):
    parses = spark.createDataFrame([(1, 0, 5, "NOUN", "Case=Nom", "Замок"), (1, 6, 10, "NOUN", "Case=Nom", "мова")], "doc_id int, start long, end long, upos string, feats string, text string")
    two = [(["Case=Nom", "upos=NOUN"], [3]), (["Case=Gen", "upos=NOUN"], [1])]
    readings = spark.createDataFrame([("замок", two), ("мова", two)], "form string, readings array<struct<tags:array<string>,accents:array<int>>>")
    engine = StressEngine.open(spark, str(bundle), morphology=morphology_tier(parses, readings))
    t = engine.tokens(spark.createDataFrame([(1, "Замок мова"), (2, "")], "doc_id int, text string"))
    assert sorted((r.start, r.status, r.output_text) for r in t.collect()) == [(0, "morphology", "Зам\u0301ок"), (6, "stressed", "мо́ва")]
    assert "Union" in plan(t)


def test_chunks_know_their_places_without_a_shuffle(spark, bundle):
    front = SpeechFrontend(StressEngine.open(spark, str(bundle)))
    docs = spark.createDataFrame([(1, "Мова. До мене!\n\n Так 5. "), (2, ""), (None, " ")], "doc_id int, text string")
    at = 0
    for r in sorted(front.chunks(docs).where("doc_id = 1").collect(), key=lambda r: r.pos):
        assert r.start == at
        at += len(r.text)
    assert at == 24 and "Window" not in plan(front.tokens(docs)) and "LogicalRDD" not in plan(front.chunks(docs))


def test_speech(spark, bundle):
    engine = StressEngine.open(spark, str(bundle))
    docs = spark.createDataFrame([(1, "Мова. До мене!\nТак 5."), (2, "")], "doc_id int, text string")
    got = {r.doc_id: r for r in SpeechFrontend(engine).prepare(docs).collect()}
    assert got[1].verbalized == got[1].source and got[1].text == "Мо́ва. До ме́не!\nТак 5." and got[2].text == ""
    said = SpeechFrontend(engine, lambda d: d.withColumn("spoken", F.regexp_replace("text", "5", "п'ять")))
    assert {r.doc_id: r.verbalized for r in said.prepare(docs).collect()}[1] == "Мова. До мене!\nТак п'ять."
    at = {r.text: r.start for r in SpeechFrontend(engine).tokens(docs).collect()}
    assert at == {"Мова": 0, "До": 6, "мене": 9, "Так": 15}


def test_broken_bundles(spark, bundle, folder, tmp_path):
    with pytest.raises(AssetError):
        archive.open_bundle(tmp_path)
    (tmp_path / "manifest.json").write_text("{")
    with pytest.raises(AssetError):
        archive.open_bundle(tmp_path)
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": 2}))
    with pytest.raises(AssetError):
        archive.open_bundle(tmp_path)
    good = json.loads((bundle / "manifest.json").read_text())
    (tmp_path / "manifest.json").write_text(json.dumps(good | {"files": {"suffix_table.json": "0" * 64}}))
    with pytest.raises(AssetError):
        archive.open_bundle(tmp_path)
    archive.verify_archive(folder)
    with pytest.raises(RuntimeError):
        archive.build_bundle(spark, str(folder), {}, str(tmp_path / "x"))
