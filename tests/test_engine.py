"""The corpus engine on a hand-made dictionary and corpus; expected values worked out by hand or by brute force."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from korpusflow.functions import text as T
from korpusflow.operators import concordance, frequency, morphology, ngrams, patterns, report, search
from korpusflow.sources import corpus as C
from korpusflow.sources import resources as R

DICTIONARY = """<?xml version="1.0" encoding="utf-8" standalone="yes"?>
<dictionary><grammemes></grammemes><restrictions></restrictions><lemmata>
<lemma id="1"><l t="ёж"><g v="NOUN"/><g v="anim"/><g v="masc"/></l><f t="ёж"><g v="sing"/><g v="nomn"/></f><f t="ежа"><g v="sing"/><g v="gent"/></f></lemma>
<lemma id="2"><l t="стать"><g v="NOUN"/><g v="inan"/><g v="femn"/></l><f t="стать"><g v="sing"/><g v="nomn"/></f><f t="стати"><g v="sing"/><g v="gent"/></f></lemma>
<lemma id="3"><l t="стать"><g v="INFN"/><g v="perf"/><g v="intr"/></l><f t="стать"></f></lemma>
<lemma id="4"><l t="стал"><g v="VERB"/><g v="perf"/><g v="intr"/></l><f t="стал"><g v="masc"/><g v="sing"/><g v="past"/></f><f t="стали"><g v="plur"/><g v="past"/></f></lemma>
<lemma id="5"><l t="сталь"><g v="NOUN"/><g v="inan"/><g v="femn"/></l><f t="сталь"><g v="sing"/><g v="nomn"/></f><f t="стали"><g v="sing"/><g v="gent"/></f></lemma>
<lemma id="6"><l t="в"><g v="PREP"/></l><f t="в"></f><f t="во"><g v="Vpre"/></f></lemma>
<lemma id="7"><l t="самолёт"><g v="NOUN"/><g v="inan"/><g v="masc"/></l><f t="самолёт"><g v="sing"/><g v="nomn"/></f><f t="самолёте"><g v="sing"/><g v="loct"/></f></lemma>
<lemma id="9"><l t="весь"><g v="ADJF"/><g v="Apro"/></l><f t="весь"><g v="masc"/><g v="sing"/><g v="nomn"/></f><f t="всё"><g v="neut"/><g v="sing"/><g v="nomn"/></f><f t="все"><g v="plur"/><g v="nomn"/></f></lemma>
<lemma id="10"><l t="лайнер"><g v="NOUN"/><g v="inan"/><g v="masc"/></l><f t="лайнер"><g v="sing"/><g v="nomn"/></f><f t="лайнере"><g v="sing"/><g v="loct"/></f></lemma>
<lemma id="11"><l t="ставший"><g v="PRTF"/><g v="past"/></l><f t="ставший"><g v="masc"/><g v="sing"/><g v="nomn"/></f></lemma>
</lemmata><link_types></link_types><links><link id="1" from="3" to="4" type="3"/><link id="2" from="4" to="11" type="4"/><link id="3" from="1" to="9" type="7"/></links></dictionary>
"""
FREQUENCIES = "Lemma\tPoS\tFreq\tR\nстать\ts\t50.0\t1\nстать\tv\t700.0\t1\nсталь\ts\t30.0\t1\nсамолет\ts\t90.0\t1\nсамолет\ts.PROP\t100.0\t1\nв\tpr\t31374.0\t1\nвесь\tapro\t4000.0\t1\nлайнер\ts\t5.0\t1\n"
TEXTS = {"a.txt": "Самолёт стал в воздухе — «стали» все!", "b.txt": "Лайнер стал в ангаре. RAD-750 Е́жа", "c.txt": ""}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "texts" / "inner").mkdir(parents=True)
    for name, text in TEXTS.items():
        (d / "texts" / name).write_text(text, encoding="utf-8")
    (d / "texts" / "inner" / "no.txt").write_text("нет", encoding="utf-8")
    (d / "dict.xml").write_text(DICTIONARY, encoding="utf-8")
    (d / "freq.csv").write_text(FREQUENCIES, encoding="utf-8")
    (d / "thesaurus.xml").write_text('<?xml version="1.0"?><thesaurus><synset l="самолёт"><synonym l="лайнер"/></synset></thesaurus>', encoding="utf-8")
    (d / "models.xml").write_text('<?xml version="1.0"?><models><model name="m"><token lemma="самолёт"/><token/><token wordform="в"><g v="PREP"/></token></model></models>', encoding="utf-8")
    return d


@pytest.fixture(scope="module")
def corpus(spark, files):
    return C.text_folder(spark, str(files / "texts"))


@pytest.fixture(scope="module")
def dictionary(spark, files):
    lexemes, forms, links = R.dictionary_xml(spark, str(files / "dict.xml"))
    return morphology.Dictionary(lexemes, forms, links, R.frequency_tsv(spark, str(files / "freq.csv")))


@pytest.fixture(scope="module")
def thesaurus(spark, files):
    return R.thesaurus_xml(spark, str(files / "thesaurus.xml"))


def test_tokens(spark):
    one = lambda s: spark.createDataFrame([(s,)], "t string").select(T.tokens(F.col("t")).alias("w")).first()["w"]
    assert one("A-b, C—d\xa0e⁰f №5 − ÉÁ Ёж - x×y÷z «q»") == ["a-b", "c", "d", "e", "f", "№5", "−", "ÉÁ", "ёж", "-", "x", "y", "z", "q"]
    assert one("е́ ́ x") == ["е", "", "x"] and one(None) == [] and one("...") == []


def test_scalar_functions(spark):
    row = spark.range(1).select(
        T.number_cell(F.lit(12345678), 4).alias("a"), T.number_cell(F.lit(7), 4).alias("b"), T.number_cell(F.lit(0.5), 10, True).alias("c"), T.text_cell(F.lit("abcdef"), 4).alias("d"),
        T.text_cell(F.lit("ab"), 4).alias("e"), T.common_prefix(F.lit("ёлка"), F.lit("ёлочка")).alias("f"), T.split_by(F.lit("a,b;;"), ",;").alias("g"), T.split_by(F.lit("a,;b;"), ",;", True).alias("h"),
        T.prefix_by(F.lit("ab=c"), "=-").alias("i"), T.trimmed(F.lit("  x "), " ").alias("j"), T.file_name(F.lit('a<b>:c d?')).alias("k"),
    ).first()
    assert tuple(row) == ("…5678", "   7", "  0.500000", "abc…", "ab  ", "ёл", ["a", "b", ""], ["a", "b"], "ab", "x ", "a_b__c_d_")


def test_resolution(dictionary):
    got = {r.surface: (r.form_lexeme_id, r.lexeme_id, r.form_pos) for r in dictionary.resolution().collect()}
    want = {"стать": (3, 3, "INFN"), "стали": (4, 3, "VERB"), "ставший": (11, 3, "PRTF"), "самолет": (7, 7, "NOUN"), "все": (9, 9, "ADJF"), "весь": (9, 9, "ADJF"), "еж": (1, 1, "NOUN"), "ежа": (1, 1, "NOUN")}
    assert {k: got.get(k) for k in want} == want and "дрон" not in got
    assert {r.lexeme_id: r.freq for r in dictionary.lexeme_freq().collect()}[7] == 100.0
    assert {r.surface: r.form for r in dictionary.resolution().collect()}["все"] == "все"


def test_cycles_end(spark):
    assert morphology.link_roots(spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 2, 0)], "src long, dst long, type int")).where("root_id = 3").count() == 2


def test_totals_and_lists(corpus, dictionary):
    assert tuple(C.totals(corpus).first()) == (12, 3)
    rows = [tuple(r) for r in frequency.frequency_list(corpus, dictionary, frequency.known).collect()]
    assert rows == [("стать", "INFN", 3, 250000.0, 2), ("в", "PREP", 2, 166666.666667, 2), ("весь", "ADJF", 1, 83333.333333, 1), ("лайнер", "NOUN", 1, 83333.333333, 1), ("самолёт", "NOUN", 1, 83333.333333, 1), ("ёж", "NOUN", 1, 83333.333333, 1)]
    assert [r.lemma for r in frequency.frequency_list(corpus, dictionary, frequency.content).collect()] == ["стать", "весь", "лайнер", "самолёт", "ёж"]
    assert [r.lemma for r in frequency.frequency_list(corpus, dictionary, frequency.unknown).collect()] == ["rad-750", "ангаре", "воздухе"]


def test_concordance(corpus, dictionary):
    get = lambda side, c=1: sorted(map(tuple, concordance.concordance(corpus, "стать в", c, 1, side, dictionary).collect()))
    assert get("left") == [("лайнер", "", 1), ("самолёт", "", 1)] and get("right") == [("", "ангаре", 1), ("", "воздухе", 1)] and get("both") == []
    assert get("both", 2) == [("лайнер", "ангаре", 1), ("самолёт", "воздухе", 1)]
    with pytest.raises(ValueError):
        concordance.concordance(corpus, "...", 1)


def test_concordance_equals_brute_force(spark):
    r = random.Random(3)
    docs = {i: [r.choice("ab") for _ in range(r.randrange(15))] for i in range(20)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    want = defaultdict(int)
    for w in docs.values():
        for p in range(len(w) - 1):
            if w[p : p + 2] == ["a", "a"]:
                for a, b in itertools.product(range(4), repeat=2):
                    if 1 <= a + b <= 3 and a <= p and p + 2 + b <= len(w):
                        want[" ".join(w[p - a : p]), " ".join(w[p + 2 : p + 2 + b])] += 1
    assert {(x.left, x.right): x.freq for x in concordance.concordance(df, "a a", 3).collect()} == want


def test_ngrams_equal_brute_force(spark, corpus, dictionary):
    assert [tuple(x) for x in ngrams.stable_ngrams(corpus, 3, 2, 0.9, dictionary).collect()] == [("стать в", 2, 2, 2, round(2 / 12 * math.log(1.5), 6))]
    r = random.Random(8)
    docs = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(12)))) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    occ = defaultdict(int)
    for _, t in docs:
        w = t.split()
        for n in range(2, 6):
            for p in range(len(w) - n + 1):
                occ[" ".join(w[p : p + n])] += 1
    for f, s in ((2, 0.5), (3, 0.3)):
        want = {g: c for g, c in occ.items() if len(g.split()) <= 4 and c >= f and all(c2 <= c * s for e, c2 in occ.items() if len(e.split()) == len(g.split()) + 1 and (e.startswith(g + " ") or e.endswith(" " + g)))}
        assert {x.gram: x.occ for x in ngrams.stable_ngrams(df, 4, f, s).collect()} == want


def test_ngram_lookup(spark, tmp_path):
    g = spark.createDataFrame([("a b", 2), ("a b c", 3), ("b c", 2), ("x a", 2)], "gram string, n int")
    get = lambda p: sorted(r.gram for r in ngrams.lookup(g, p).collect())
    assert get([]) == ["a b", "a b c", "b c", "x a"] and get(["a"]) == ["a b", "a b c", "x a"] and get(["a", "b", "c"]) == ["a b", "a b c", "b c"] and get(["b", "c", "d"]) == []
    with pytest.raises(FileNotFoundError):
        C.load(spark, f"{tmp_path}/none")
    assert C.load_or_build(spark, f"{tmp_path}/some", lambda: g).count() == 4


def test_patterns(corpus, dictionary, thesaurus, spark, files):
    lemma = lambda *w: [{"lemma": x} for x in w]
    models = [("plane", lemma("самолёт", "стать")), ("tags", [{"grammemes": ["VERB"]}, {"grammemes": ["PREP"]}]), ("last", lemma("стать", "весь")), ("none", lemma("нет"))]
    stats = {r.model: (r.freq, r.tfidf) for r in patterns.pattern_stats(corpus, models, dictionary, thesaurus).collect()}
    assert stats == {"plane": (2, 0.067578), "tags": (2, 0.067578), "last": (0, None), "none": (0, None)}
    hits = patterns.pattern_hits(corpus, models, dictionary, thesaurus, include_last=True).collect()
    assert sorted((r.model, r.doc_id, r.pos) for r in hits) == [("last", "a.txt", 4), ("plane", "a.txt", 0), ("plane", "b.txt", 0), ("tags", "a.txt", 1), ("tags", "b.txt", 1)]
    read = R.models_xml(spark, str(files / "models.xml"))
    assert read == [("m", [{"lemma": "самолёт", "wordform": None, "grammemes": []}, {"lemma": None, "wordform": None, "grammemes": []}, {"lemma": None, "wordform": "в", "grammemes": ["PREP"]}])]
    assert sorted(r.forms for r in patterns.pattern_hits(corpus, read, dictionary, thesaurus).collect()) == ["лайнер стал в", "самолёт стал в"]


def test_search(corpus, dictionary, thesaurus):
    assert search.query_terms(corpus, "самолёт в", dictionary, thesaurus) == ["лайнер", "самолёт"]
    assert [tuple(r) for r in search.bm25(corpus, "самолёт", dictionary, thesaurus).collect()] == [("a.txt", 0.40866), ("b.txt", 0.40866)]
    assert search.bm25(corpus, "стать", dictionary).count() == 0  # in more than half of the documents
    assert search.bm25(corpus, "...", dictionary).count() == 0


def test_reports(spark, corpus, dictionary, tmp_path):
    lines = report.frequency_lines(frequency.frequency_list(corpus, dictionary, frequency.known))
    report.write(lines, f"{tmp_path}/freq.txt", "lemma")
    text = open(f"{tmp_path}/freq.txt", encoding="utf-8").read().split("\n")
    assert text[0] == "lemma" and text[1] == "стать".ljust(20) + "INFN".ljust(8) + "250000.000000".rjust(16) + "2".rjust(8)
    assert report.concordance_lines(spark.createDataFrame([("a", "", 2), ("b c", "d", 1)], "left string, right string, freq long"), "k").first().line == "  a | k |         2"


def test_empty_dictionary_and_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert frequency.frequency_list(none, morphology.Dictionary.empty(spark)).count() == 0 and tuple(C.totals(none).first()) == (0, 0) and search.bm25(none, "a").count() == 0


def test_stream(spark, tmp_path):
    from korpusflow.streaming.frequency import document_stream, running_frequency

    spark.createDataFrame([(1, "a b a", "en", "s", 5), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in")
    q = running_frequency(document_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("freq").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert {r.lemma: r.occ for r in spark.sql("select * from freq").collect()} == {"a": 2, "b": 1}
