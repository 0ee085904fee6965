"""Dictionary operators on hand-made rows."""

from korpusflow.operators import morphology
from korpusflow.plans import catalog


def test_roots_of_merging_links(spark):
    links = [(1, 2, 3), (2, 3, 0), (2, 4, 1), (4, 5, 27), (6, 5, 5), (1, 7, 7), (1, 7, 99)]
    got = morphology.link_roots(spark.createDataFrame(links, "src long, dst long, type int"))
    edges = [(2, 1), (3, 2), (4, 2), (5, 4), (5, 6)]
    want, new = set(edges), set(edges)
    while new:
        new = {(a, d) for a, b in want for c, d in edges if b == c} - want
        want |= new
    assert {tuple(r) for r in got.collect()} == {(a, b) for a, b in want if b not in {c for c, _ in edges}}


def test_resolution_of_the_toy_dictionary(spark):
    rows = catalog.toy(spark).resolution().collect()
    assert sorted((r.surface, r.form_lemma, r.form_pos, " ".join(sorted(r.grammemes)), r.lemma, r.pos) for r in rows) == sorted(catalog.RESOLUTION)


def test_last_row_of_the_list_counts(spark):
    assert {r.lexeme_id: r.freq for r in catalog.toy(spark).lexeme_freq().collect()} == {5: 5.0, 6: 10.0, 1: 50.0}


def test_yo_keys(spark):
    forms = [(1, 0, "самолёт", []), (2, 0, "все", []), (3, 0, "Ёж", [])]
    rows = morphology.Dictionary.of(spark, [], forms, [], []).form_keys().collect()
    assert sorted((r.key, r.form, r.yo) for r in rows) == sorted([("самолёт", "самолёт", 0), ("самолет", "самолёт", 1), ("все", "все", 0), ("Еж", "Ёж", 1), ("Ёж", "Ёж", 0)])
