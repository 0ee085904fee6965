"""The pipeline's near-copy stage: links by fingerprints and links by Jaccard similarity, joined."""

import random

import corpus_pipeline


def test_both_kinds_of_links_join_groups(spark, tmp_path):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    core = words(41)  # odd: no bit is a tie
    repeated = " ".join(core * 60)
    a, b = f"{repeated} {' '.join(words(40))}", f"{repeated} {' '.join(words(40))}"  # fingerprints alike, most different shingles are not
    text = words(300)
    near = text[:150] + ["other"] + text[151:]  # similar sets
    docs = [(3, a), (2, b), (9, " ".join(text)), (8, " ".join(near)), (7, " ".join(words(200)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.simhash_stage(spark, df, str(tmp_path)).collect()) == [2, 7, 8]
