"""Link chains of any length."""

from korpusflow.operators import morphology


def test_long_chain_has_its_root(spark):
    links = [(k, k + 1, 3) for k in range(1, 41)] + [(101, 102, 3), (102, 101, 3), (102, 103, 3)]
    got = {(r.lexeme_id, r.root_id) for r in morphology.link_roots(spark.createDataFrame(links, "src long, dst long, type int")).collect()}
    assert got == {(k, 1) for k in range(2, 42)}
