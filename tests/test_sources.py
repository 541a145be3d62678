"""Readers on self-written files."""
import json
import os

from pyspark.sql import functions as F

from aspectra.sources import csv as SCSV
from aspectra.sources import results as SR
from aspectra.sources import xml as SX

OPINION_XML = """<?xml version="1.0" encoding="UTF-8"?>
<Reviews><Review rid="1"><sentences>
<sentence id="1"><text>  Le service était lent.  </text><Opinions>
  <Opinion target="NULL" category="SERVICE#GENERAL" polarity="negative"/>
  <Opinion category="FOOD#QUALITY" polarity="positive"/>
  <Opinion target=" plats " polarity="conflict"/>
  <Opinion target="prix" polarity="Neutral"/>
</Opinions></sentence>
<sentence id="2"><Opinions><Opinion target="x" polarity="positive"/></Opinions></sentence>
<sentence id="3"><text>   </text><Opinions><Opinion target="carte" polarity="pos"/></Opinions></sentence>
</sentences></Review></Reviews>"""

NO_OPINION_XML = """<?xml version="1.0" encoding="UTF-8"?>
<Reviews><Review rid="9"><sentences>
<sentence id="1"><text>Texte sans avis.</text><Opinions><Opinion target="a" polarity="conflict"/></Opinions></sentence>
<sentence id="2"><text>Deuxième phrase.</text></sentence>
<sentence id="3"><text></text></sentence>
</sentences></Review></Reviews>"""

TERM_XML = """<?xml version="1.0" encoding="UTF-8"?>
<sentences>
<sentence id="1"><text>The battery life is great but the screen is dim.</text><aspectTerms>
  <aspectTerm term="battery life" polarity="positive" from="4" to="16"/>
  <aspectTerm term="screen" polarity="negative"/>
  <aspectTerm term="" polarity="positive"/>
  <aspectTerm term="keyboard" polarity="conflict"/>
</aspectTerms></sentence>
<sentence id="2"><text>Nothing here.</text></sentence>
</sentences>"""

REVIEW_TAG_XML = """<?xml version="1.0" encoding="UTF-8"?>
<reviews><review id="1"><text>Old layout text.</text><aspectTerms>
<aspectTerm term="price" polarity="neutral"/></aspectTerms></review></reviews>"""


def write(path, name, content, encoding="utf-8"):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding=encoding) as f:
        f.write(content)


def test_opinion_xml_rules_and_fallback(spark, tmpdir_path):
    write(tmpdir_path, "a.xml", OPINION_XML)
    write(tmpdir_path, "b.xml", NO_OPINION_XML)
    rows = sorted((r.text, r.aspect, r.polarity, r.lang) for r in SX.read_opinion_xml(spark, tmpdir_path).collect())
    assert rows == sorted([
        ("Le service était lent.", "general", "neg", "fr"),
        ("Le service était lent.", "general", "pos", "fr"),
        ("Le service était lent.", "prix", "neutral", "fr"),
        ("", "carte", "pos", "fr"),
        ("Texte sans avis.", "general", "neutral", "fr"),
        ("Deuxième phrase.", "general", "neutral", "fr"),
    ])


def test_term_xml_and_review_tag_fallback(spark, tmpdir_path):
    write(tmpdir_path, "laptops.xml", TERM_XML)
    write(tmpdir_path, "old.xml", REVIEW_TAG_XML)
    rows = sorted((r.aspect, r.polarity) for r in SX.read_aspect_term_xml(spark, tmpdir_path).collect())
    assert rows == sorted([("battery life", "pos"), ("screen", "neg"), ("price", "neutral")])


def test_route_xml_layout_per_file(spark, tmpdir_path):
    write(tmpdir_path, "restaurants_FR.xml", TERM_XML)
    write(tmpdir_path, "opinions.xml", OPINION_XML)
    r = SX.route_xml(spark, tmpdir_path)
    langs = {(r.aspect, r.lang) for r in r.collect()}
    assert ("battery life", "fr") in langs and ("prix", "fr") in langs


CSV = 'Review,ID,text,Sentiment,label\n"ignored",1,"  multi\nline, ""quoted""  ",x, Positive \n' \
      '"ignored",2,,x,neg\n"ignored",3,"unknown label",x,spam\n"ignored",4,"ok",x,NEU\n'


def test_labelled_csv_last_candidate_wins(spark, tmpdir_path):
    write(tmpdir_path, "ru.csv", CSV)
    assert SCSV.detect_columns(["Review", "ID", "text", "Sentiment", "label"]) == ("text", "label")
    rows = sorted(tuple(r) for r in SCSV.read_labelled_csv(spark, tmpdir_path).collect())
    assert rows == sorted([('multi\nline, "quoted"', "general", "pos", "ru"), ("ok", "general", "neutral", "ru")])


def test_csv_without_candidates_is_empty(spark, tmpdir_path):
    write(tmpdir_path, "x.csv", "a,b\n1,2\n")
    assert SCSV.read_labelled_csv(spark, tmpdir_path).count() == 0


def test_result_json_both_layouts_and_malformed(spark, tmpdir_path):
    svm_dir = os.path.join(tmpdir_path, "svm")
    write(svm_dir, "svm_results_fr_prix.json", json.dumps(
        {"global_f1_macro": 0.654321, "lang": "fr", "aspect": "prix", "n_samples": 10}))
    write(svm_dir, "svm_results_bad.json", "{not json")
    write(svm_dir, "svm_results_min.json", json.dumps({"aspect": "service"}))
    m = {(r.lang, r.aspect): r for r in SR.scan_svm_metrics(spark, svm_dir, multi_line=True).collect()}
    assert m[("fr", "prix")].f1_macro == 0.6543 and m[("?", "service")].f1_macro == 0.0
    assert len(m) == 2
    bad = SR.corrupt_count(SR._read(spark, svm_dir, SR.SVM_RESULT, True)).first().n_corrupt
    assert bad == 1
    tr = os.path.join(tmpdir_path, "tr")
    write(tr, "transformer_a.json", json.dumps({"model_name": "xlm-roberta-base", "lang": "all",
                                                 "global": {"f1_macro": 0.72, "n_test": 5},
                                                 "per_aspect": {"qualité": 0.7}}))
    write(tr, "transformer_b.json", json.dumps({"global_f1_macro": 0.65}))
    rows = {(r.model, r.lang, r.aspect): r.f1_macro for r in SR.scan_model_metrics(spark, tr, True).collect()}
    assert rows == {("xlm-roberta-base", "all", None): 0.72, ("xlm-roberta-base", "all", "qualité"): 0.7,
                    ("unknown", "?", None): 0.65}


def test_labelled_csv_windows_1251(spark, tmpdir_path):
    content = 'text,label\n"Жаль, ужасно\nвторая строка",negative\n"Отлично",pos\n'
    write(tmpdir_path, "ru.csv", content, encoding="cp1251")
    old = spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        rows = sorted(tuple(r) for r in SCSV.read_labelled_csv(spark, tmpdir_path, encoding="windows-1251").collect())
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", old)
    assert rows == sorted([("Жаль, ужасно\nвторая строка", "general", "neg", "ru"),
                           ("Отлично", "general", "pos", "ru")])


DEEP_XML = """<?xml version="1.0" encoding="UTF-8"?>
<Reviews><!-- <sentence id="0"><text>hidden</text><Opinion target="no" polarity="positive"/></sentence> -->
<Review rid="1"><sentences>
<sentence id="1"><text>a &amp; &lt;b&gt;</text><Opinions><Opinion target="x &gt; &quot;y&quot;" polarity="pos"/>
  <Group><Part><Opinion category='q"q' polarity="negative">inner</Opinion></Part></Group></Opinions>
  <!-- <Opinion target="no" polarity="positive"/> --><Opinion polarity="neutral" target="bare"></Opinion></sentence>
<sentence id="2"/><sentence id="3"><text>c</text><Opinion target="last" polarity="positive"/></sentence>
</sentences></Review></Reviews>"""

DEEP_TERMS = """<sentences><sentence><text>t</text><meta><aspectTerms><aspectTerm term="first" polarity="positive"/>
<x><aspectTerm term="deeper" polarity="positive"/></x></aspectTerms></meta>
<aspectTerms><aspectTerm term="second block" polarity="negative"/></aspectTerms></sentence>
<sentence><text>u</text><aspectTerms/><aspectTerms><aspectTerm term="after an empty block" polarity="positive"/></aspectTerms></sentence></sentences>"""


def test_opinions_at_any_depth(spark, tmpdir_path):
    write(tmpdir_path, "deep.xml", DEEP_XML)
    rows = sorted((r.text, r.aspect, r.polarity) for r in SX.read_opinion_xml(spark, tmpdir_path).collect())
    assert rows == [("a & <b>", "bare", "neutral"), ("a & <b>", "general", "neg"), ("a & <b>", 'x > "y"', "pos"), ("c", "last", "pos")]


def test_terms_of_the_first_block(spark, tmpdir_path):
    write(tmpdir_path, "deep.xml", DEEP_TERMS)
    assert [(r.text, r.aspect) for r in SX.read_aspect_term_xml(spark, tmpdir_path).collect()] == [("t", "first")]


def test_large_xml_is_split(spark, tmpdir_path):
    """One file is read by many tasks; elements across the borders are neither lost nor doubled."""
    body = "".join(f'<sentence id="{i}"><text>é {i}\n</text><aspectTerms><aspectTerm term="t{i}" polarity="pos"/></aspectTerms></sentence>\n' for i in range(3000))
    write(tmpdir_path, "big.xml", f"<sentences>{body}</sentences>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        e = SX.read_elements(spark, tmpdir_path, "sentence")
        assert e.rdd.getNumPartitions() > 8 and e.count() == 3000
        assert {r.aspect for r in SX.read_aspect_term_xml(spark, tmpdir_path).collect()} == {f"t{i}" for i in range(3000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_review_fallback_runs_no_job(spark, tmpdir_path):
    write(tmpdir_path, "new.xml", TERM_XML)
    write(tmpdir_path, "old.xml", REVIEW_TAG_XML)
    write(tmpdir_path, "none.xml", "<reviews><review><text>no terms</text></review></reviews>")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    df = SX.read_aspect_term_xml(spark, tmpdir_path)
    assert jobs() == before
    assert {(r.text, r.aspect) for r in df.collect()} >= {("Old layout text.", "price"), ("no terms", "general")}


def test_routes_by_head_and_file_name(spark, tmpdir_path):
    from aspectra.sources.files import file_heads, routes
    folder = os.path.join(tmpdir_path, "fr_francais")
    write(folder, "laptops.xml", TERM_XML)                        # a misleading folder
    write(folder, "phones fr é.xml", TERM_XML)
    write(folder, "late.xml", "<sentences>" + " " * 500 + OPINION_XML.split("?>")[1] + "</sentences>")
    write(folder, "opinions.xml", OPINION_XML)
    write(folder, "part-00000.xml", TERM_XML)                     # a part that Spark wrote goes by its folder
    write(folder, "RuSentiment.csv", CSV)
    write(folder, "notes.txt", "x")
    got = {os.path.basename(r.file): (r.format, r.layout, r.lang) for r in routes(file_heads(spark, tmpdir_path)).collect()}
    assert got == {"laptops.xml": ("xml", "term", "en"), "phones%20fr%20%C3%A9.xml": ("xml", "term", "fr"), "late.xml": ("xml", "term", "en"),
                   "opinions.xml": ("xml", "opinion", "fr"), "part-00000.xml": ("xml", "term", "fr"), "RuSentiment.csv": ("csv", "csv", "ru")}
    from aspectra.sources.routing import route_inputs
    rows = {(r.aspect, r.lang) for r in route_inputs(spark, tmpdir_path).collect()}
    assert ("battery life", "en") in rows and ("battery life", "fr") in rows and ("prix", "fr") in rows and ("general", "ru") in rows


def test_route_without_csv(spark, tmpdir_path):
    from aspectra.sources.routing import route_inputs
    write(tmpdir_path, "a.xml", TERM_XML)
    assert route_inputs(spark, tmpdir_path).count() == 2


def test_csv_encodings_by_file(spark, tmpdir_path):
    """Three files in three encodings in one folder, each read in the first that fits it."""
    texts = {"utf-8": "Иван \U0001f600 é", "cp1251": "жаль, ужасно", "latin-1": "déjà \u0098"}
    for name, text in texts.items():
        write(tmpdir_path, f"{name}.csv", f'text,label\n"{text}\nline 2",pos\n', encoding=name)
    write(tmpdir_path, "bom.csv", "text,label\nbom é,neg\n", encoding="utf-8-sig")
    for order in (SCSV.ENCODINGS, SCSV.ORIGINAL_ORDER):
        got = {r.text for r in SCSV.read_labelled_csv(spark, tmpdir_path, encoding=order).collect()}
        want = {f"{t}\nline 2" for t in texts.values()}
        assert got - want == ({"bom é"} if order == SCSV.ENCODINGS else {"bom é".encode().decode("cp1251")})
        assert want <= got
    names = {os.path.basename(r.file): r.encoding for r in SCSV.file_encodings(spark, tmpdir_path, ("utf-8",)).collect()}
    assert names == {"utf-8.csv": "utf-8", "bom.csv": "utf-8", "cp1251.csv": None, "latin-1.csv": None}


def test_malformed_results_are_counted_by_the_read(spark, tmpdir_path):
    from pyspark.sql import Observation
    write(tmpdir_path, "a.json", json.dumps({"global_f1_macro": 0.5, "lang": "fr"}))
    write(tmpdir_path, "b.json", "{not json")
    seen = Observation()
    assert SR.scan_svm_metrics(spark, tmpdir_path, observed=seen).select("lang", "f1_macro").collect()[0].lang == "fr"
    assert seen.get == {"records": 2, "malformed": 1}


def test_three_families_by_file_name(spark, tmpdir_path):
    """Names come from the files; the families go into one METRIC table and its matrices."""
    import pytest

    from aspectra.operators import matrices as MX
    with pytest.raises(FileNotFoundError):
        SR.scan_results(spark, tmpdir_path)
    write(f"{tmpdir_path}/svm_results", "svm_results_fr_prix_2024.json", json.dumps({"global_f1_macro": 0.5, "lang": "fr", "aspect": "prix"}))
    write(f"{tmpdir_path}/emotion_results", "emotion_results_camembert-base_fr.json",
          json.dumps({"model_name": "camembert-base", "lang": "fr", "global": {"f1_macro": 0.65, "n_test": 7}, "per_aspect": {"prix": 0.6}}))
    got = {r.name: (r.lang, r.macro_f1, r.n_samples, r.family) for r in SR.scan_results(spark, tmpdir_path).collect()}
    assert got == {"svm_fr_prix_2024": ("fr", 0.5, 0, "svm"), "emotion_camembert-base_fr": ("fr", 0.65, 7, "emotion")}
    metric = SR.scan_all_metrics(spark, f"{tmpdir_path}/svm_results", f"{tmpdir_path}/emotion_results")
    row = MX.absa_matrix(metric).collect()
    assert len(row) == 1 and row[0]["SVM(FR)"] == 0.5 and row[0]["CamemBERT(FR)"] == 0.6
    assert [r.gain for r in MX.gain_vs_baseline(metric).collect()] == [0.1]


def test_files_without_the_element_stay_small(spark, tmpdir_path, monkeypatch):
    """A large file that lacks the end tag isn't held as one piece; its elements of the
    other tag are all read."""
    body = "".join(f'<sentence id="{i}"><text>t {i}</text><aspectTerms><aspectTerm term="a{i}" polarity="pos"/></aspectTerms></sentence>' for i in range(500))
    write(tmpdir_path, "big.xml", f"<sentences>{body}</sentences>")
    write(tmpdir_path, "old.xml", REVIEW_TAG_XML)
    monkeypatch.setattr(SX, "MAX_ELEMENT", 4096)
    lengths = SX._pieces(spark, tmpdir_path, "review").agg(F.max(F.length("value"))).first()[0]
    assert lengths < 4096
    assert {r.aspect for r in SX.read_aspect_term_xml(spark, tmpdir_path).collect()} == {"price", *(f"a{i}" for i in range(500))}
