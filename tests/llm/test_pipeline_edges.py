"""The pipeline on an empty table, a table of odd rows, and very long texts."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, lines=12):
    word = lambda: "".join(r.choice(["the", "ing", "er", "on", "at", "ion", "es", "re"]) for _ in range(r.randrange(1, 4)))
    return "\n".join(" ".join(word() for _ in range(11)).capitalize() + "." for _ in range(lines))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_are_decided_one_by_one(spark, tmp_path):
    r = random.Random(12)
    clean = [prose(r) for _ in range(60)]
    long = prose(r, 4000)
    near = long.replace(".\n", ".\nAnd.\n", 1)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(clean)]
    rows += [(None, clean[0], None, None, None), (None, clean[1].upper().lower(), "en", "s", 1), (None, prose(r), "en", "s", 2), (5, prose(r), "en", "s", 3), (5, clean[2], "en", "s", 4), (7, clean[7], "en", "s", 1)]
    rows += [(900, long, "en", "s", 1), (901, near, "en", "s", 1), (902, None, "en", "s", 1), (903, "", "en", "s", 1), (904, "### " * 300, "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
    kept = [(x.doc_id, (x.text or "").lower()) for x in docs.collect()]
    texts = [t for _, t in kept]
    assert len(texts) == len(set(texts))  # no copy stays
    want = {(t or "").lower() for i, t, *_ in rows if i not in (901, 902, 903, 904)}
    assert set(texts) == want  # every clean text stays once, whatever its id; of the near copies the smaller id
    assert (5, clean[2].lower()) in kept and (900, long.lower()) in kept
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert "ids" in pieces.columns and sum(len(x.ids) for x in pieces.select("ids").collect()) == sum(x.length for x in pieces.select("length").collect()) > 0
