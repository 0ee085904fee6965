"""The command line on the hand-made corpus: reports as they are laid out."""

import pytest

from korpusflow import __main__ as cli
from korpusflow.operators import morphology, ngrams
from korpusflow.sources import corpus as C
from korpusflow.sources import resources as R
from tests.test_engine import corpus, dictionary, files, thesaurus  # noqa: F401


def call(spark, files, tmp_path, *args):  # noqa: F811
    argv = [args[0], str(files / "texts"), str(files / "dict.xml"), str(files / "freq.csv"), *args[1:], "--out", str(tmp_path)]
    cli.run(spark, cli.parser().parse_args(argv))
    return lambda name: (tmp_path / name).read_text(encoding="utf-8").split("\n")


def test_tasks(spark, files, tmp_path):  # noqa: F811
    read = call(spark, files, tmp_path, "freq", "--snapshot", f"{tmp_path}/dict")
    lines = read("freq.txt")
    assert lines[0].startswith("Lemma ") and lines[1] == "" and lines[2] == "стать".ljust(20) + " " + "INFN".ljust(8) + " " + "250000.000000".rjust(16) + " " + "2".rjust(8)
    assert read("freq_no_function_words.txt")[3].split()[0] == "весь"
    assert [x.split() for x in read("freq_unknown.txt")[2:5]] == [["rad-750", "1"], ["ангаре", "1"], ["воздухе", "1"]]
    again = morphology.Dictionary.load(spark, f"{tmp_path}/dict")
    assert again.resolution().count() > 10
    read = call(spark, files, tmp_path, "concordance", "стать в", "2", "1", "--snapshot", f"{tmp_path}/dict")
    assert read("concordances_lr.txt")[0] == " лайнер | стать в | ангаре  " + "1".rjust(8)
    assert len(read("concordances_l.txt")) == 3
    read = call(spark, files, tmp_path, "ngrams", "", "2", "0.9", "--ngrams", f"{tmp_path}/ng")
    assert read("n-grams.txt")[0].startswith("N-gram") and read("n-grams.txt")[2].split() == ["стать", "в", "2", "0.067578"]
    read = call(spark, files, tmp_path, "ngrams", "стать", "--ngrams", f"{tmp_path}/ng")
    assert read("n-grams.txt")[2].split()[:2] == ["стать", "в"]
    assert sorted((r.gram, r.doc_id, r.pos) for r in C.load(spark, f"{tmp_path}/ng/occurrences").collect()) == [("стать в", "a.txt", 1), ("стать в", "b.txt", 1)]
    read = call(spark, files, tmp_path, "models", str(files / "thesaurus.xml"), str(files / "models.xml"))
    assert read("models.txt")[2].split() == ["m", "2", "0.067578"] and read("models.txt")[3] == "  самолёт стал в "
    read = call(spark, files, tmp_path, "search", str(files / "thesaurus.xml"), "самолёт")
    assert read("search_result.txt")[0].endswith("Score") and read("search_result.txt")[2].split() == ["a.txt", "0.408660"]


def test_nested_and_missing(spark, tmp_path):
    g = spark.createDataFrame([("a b c d", 4), ("b c", 2), ("a b", 2), ("x y z", 3)], "gram string, n long")
    assert sorted(map(tuple, ngrams.nested(g).collect())) == [("a b c d", "a b"), ("a b c d", "b c")]
    with pytest.raises(FileNotFoundError):
        morphology.Dictionary.load(spark, f"{tmp_path}/none")


def test_tags_are_checked(spark, dictionary):  # noqa: F811
    dictionary.check()
    bad = morphology.Dictionary.of(spark, [(1, "x", "NOUN", ["NOUN", "what"])], [(1, 0, "x", ["NOUN"])], [], [("x", "zz", 1.0, 0)])
    with pytest.raises(ValueError, match="grammeme what.*list tag zz"):
        bad.check()
    assert len(R.GRAMMEMES) == len(set(R.GRAMMEMES))


def test_repeated_and_null_ids(spark):
    from korpusflow.operators import concordance, patterns, search

    df = spark.createDataFrame([(5, "of x"), (5, "q the"), (None, "of x"), (None, "q the"), (7, "of q")], "doc_id long, text string").repartition(3)
    assert [tuple(r) for r in concordance.matches(df, "of q").collect()] == [(7, 0, [], [])]
    models = [("m", [{"lemma": "of"}, {"lemma": "q"}])]
    assert [r.doc_id for r in patterns.pattern_hits(df, models, None, None, include_last=True).collect()] == [7]
    assert search.bm25(df, "x").count() == 2
    assert [x.left for x in concordance.concordance(df, "x", 1).collect()] == ["of"]


def test_compat_left_context(spark):
    from korpusflow.operators import concordance

    df = spark.createDataFrame([(1, "a b c x")], "doc_id long, text string")
    left = lambda c, compat: concordance.matches(df, "c", None, c, compat).first().left
    assert left(3, False) == ["a", "b"] and left(3, True) == ["a", "b"] and left(5, False) == ["a", "b"] and left(5, True) == []
