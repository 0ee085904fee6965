"""License notices of few words, and those that other cuts of words would miss."""

from korpusflow.llm import licenses


def scan(spark, texts):
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.family, r.confirmed) for r in rows}


def test_whole_sentences_of_templates(spark):
    got = scan(spark, ["All rights reserved.", "some prose here\nALL RIGHTS RESERVED\nmore prose", "Proprietary and confidential.", "rights of the", "All rights"])
    assert got[0] == got[1] == got[2] == ("proprietary", True)
    assert not any(c for k, (_, c) in got.items() if k in (3, 4))


def test_words_are_cut_once(spark):
    got = scan(spark, ["SPDX-License-Identifier:MIT", "[SPDX-License-Identifier: MIT]", "**SPDX-License-Identifier:** MIT"])
    assert got == {k: ("MIT", True) for k in range(3)}
