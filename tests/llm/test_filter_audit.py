"""The filter audit against a plain replay of each order."""

import random
from itertools import permutations

from korpusflow.llm.filter_audit import FIRST_FAILURE, ORDERS, filter_audit, word_counts

SPACE = " \t\n\v\f\r"


def fails(doc, docs):
    i, text = doc[0], doc[1] or ""
    words, w = [], ""
    for c in text + " ":
        if c in SPACE:
            words += [w] if w else []
            w = ""
        else:
            w += c
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
    }


def brute_force(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    marked = [(d, fails(d, docs)) for d in docs]
    out = {}
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in marked if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [i for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                shapley[x] += len(gone)
                unique = sum(f[x] and sum(f.values()) == 1 for _, f in own)
                rows.append((order, step, len(left), len(gone), sum(f[x] for _, f in own) - len(gone), unique, sum(i in good for i in gone), sum(i in toxic for i in gone)))
        out |= {(part, r[0], r[1]): (*r[2:], shapley[r[0][r[1] - 1]]) for r in rows}
    return out


def result(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_a_replay(spark):
    r = random.Random(5)
    docs = []
    for i in range(120):
        words = [r.choice(["a", "b", "C", "#", "dé", "x%"] if r.random() < 0.3 else [f"w{k}" for k in range(400)]) for _ in range(r.choice([0, 5, 99, 100, 101, 150]))]
        docs.append((i, r.choice(SPACE).join(words).upper() if r.random() < 0.2 else r.choice(SPACE).join(words), r.choice(["en", "de", None])))
    docs += [(200 + k, docs[k % 7][1], r.choice(["en", "fr"])) for k in range(40)]
    docs += [(None, docs[0][1], "en"), (None, None, ""), (7, docs[7][1], docs[7][2]), (300, None, "xx"), (301, "", "xx"), (302, " ", "xx")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 240, 2)] + [(2, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    got = result(filter_audit(df.selectExpr("*", "1 AS part", "2 AS failures", "3 AS label"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_force(docs, labels)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit(docs, labels).count() == 0
    one = result(filter_audit(spark.createDataFrame([(1, None, None)], docs.schema), labels))
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and one["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_table_of_first_failures():
    assert FIRST_FAILURE.shape == (32, 120) and not FIRST_FAILURE[0].any()
    for mask in range(1, 32):
        for k, order in enumerate(ORDERS):
            assert FIRST_FAILURE[mask, k] == next(s for s, x in enumerate(order, 1) if mask >> "ABCDE".index(x) & 1)


def test_very_long_text():
    text = b" ".join(b"w%d" % (k % 50_000) for k in range(600_000)) + b"\n"
    assert word_counts(text) == (600_000, 50_000)
    assert word_counts(b"x" * 3_000_000) == (1, 1)
