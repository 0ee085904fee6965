"""Postings are grouped where texts are read."""

from korpusflow.operators import index


def test_a_surface_is_one_row_for_each_range(spark):
    texts = spark.createDataFrame([(k, "a b a") for k in range(256)], "row long, text string").coalesce(1)
    got = index._blocks(texts).collect()
    assert sorted((x.surface, x.chunk, len(x.m)) for x in got) == [("a", 0, 128), ("a", 1, 128), ("b", 0, 128), ("b", 1, 128)]
    assert {(x.surface, tuple(m.places), m.n) for x in got for m in x.m} == {("a", (0, 2), 3), ("b", (1,), 3)}
