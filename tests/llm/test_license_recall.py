"""License scans against each paragraph judged alone, and what they find of planted notices."""

import random

from korpusflow.llm import licenses as L

PLAIN = ["Onea an thanenin haha edhaed on an the thesansh at. The license of the driver was good.", "Nothing is granted here without the work of the others.", "He said that this is free and open to all."]


def planted():
    """Texts with a notice of each template, bare, behind comment marks, or wrapped over commented lines."""
    r = random.Random(3)
    out = []
    for family, texts in L.with_names(L.TEMPLATES, L.NAMES).items():
        for t in texts:
            words = t.split()
            wrapped = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
            for shape in (t, f"// {t}", f"# {t}", f"<!-- {t} -->", "\n".join(f" * {x}" for x in wrapped)):
                out.append((family, "\n\n".join([r.choice(PLAIN), shape, r.choice(PLAIN)])))
    return out


def test_planted_notices_are_found(spark):
    rows = planted()
    found = {}
    for x in L.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(4)).where("confirmed").collect():
        found.setdefault(x.doc_id, set()).add(x.family)
    right = sum(family in found.get(i, ()) for i, (family, _) in enumerate(rows))
    assert right / len(rows) >= 0.95, sorted({f for i, (f, _) in enumerate(rows) if f not in found.get(i, ())})
    assert L.license_scan(spark.createDataFrame([(i, t) for i, t in enumerate(PLAIN * 20)], "doc_id long, text string")).where("confirmed").count() == 0


def test_every_paragraph_is_judged(spark):
    r = random.Random(4)
    texts = ["\n".join(r.choice([*PLAIN, "", " ", "License: MIT", "# SPDX-License-Identifier:BSD-2-Clause", "Released under the ISC License.", "MIT"]) for _ in range(r.randrange(12))) for _ in range(60)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2 + [(100, None), (101, ""), (102, "\n\n")]
    got = [tuple(x) for x in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("probability").collect()]
    distinct = sorted({(i, t) for i, t in rows}, key=str)
    assert len(distinct) < L.BACKGROUND
    order = [r.t for r in spark.createDataFrame(distinct, "id long, t string").selectExpr("t", "xxhash64(id, t) k").orderBy("k").collect() if r.t]
    model = L.train(L.with_names(L.TEMPLATES, L.NAMES), order)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        runs, own = [], []
        for k in range(len(lines)):
            for n in range(1, len(lines) - k + 1):
                part = lines[k : k + n]
                if all(x.strip() for x in part) and (n == 1 or (k == 0 or not lines[k - 1].strip()) and (k + n == len(lines) or not lines[k + n].strip())):
                    runs.append((k, n))
        sure = {}
        for k, n in sorted(runs, key=lambda x: x[1]):
            words = L.words_of("\n".join(lines[k : k + n]))
            predicted, _ = model.classify(words)
            likes = {f: model.similarity(f, words) for f in model.families}
            if f := model.notice(words):
                row = (f, predicted, 1.0, True)
            elif predicted != L.UNKNOWN:
                ok = likes[predicted] >= L.SIMILARITY
                row = (predicted if ok else L.UNKNOWN, predicted, likes[predicted], ok)
            elif max(L.likeness(words, p) for p in model.pairs.values()) >= L.SIMILARITY:
                row = (L.UNKNOWN, L.UNKNOWN, max(L.likeness(words, p) for p in model.pairs.values()), False)
            else:
                continue
            if n == 1:
                sure[k] = row
            elif any(j in sure and sure[j][3] and sure[j][0] == row[0] for j in range(k, k + n)):
                continue
            want.append((i, k, n, len("\n".join(lines[:k])) + (k > 0), len("\n".join(lines[k : k + n])), *row))
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 50
