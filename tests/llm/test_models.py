"""Language model, license scan, quality classifier and rules, chat formatting, pipeline: brute force and planted cases."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from korpusflow.llm import chat, ctw, licenses, lm, quality_model, quality_rules, weak


def plain_ctw(train, depth):
    """Context-tree weighting by its definition, node by node; returns the probability of a byte after a context."""
    counts = defaultdict(lambda: [0, 0])
    for text in train:
        data = bytes([ctw.END]) * depth + text + bytes([ctw.END])
        for i in range(depth, len(data)):
            context = data[i - depth : i][::-1]
            for b in range(8):
                decision, bit = (1 << b) | (data[i] >> (8 - b)), data[i] >> (7 - b) & 1
                for d in range(depth + 1):
                    counts[decision, context[:d]][bit] += 1

    def log_kt(z, o):
        return sum(math.log(k + 0.5) for k in range(z)) + sum(math.log(k + 0.5) for k in range(o)) - math.lgamma(z + o + 1)

    children = defaultdict(list)
    for decision, context in list(counts):
        if context:
            children[decision, context[:-1]].append((decision, context))
    memo = {}

    def weighted(node):
        if node not in memo:
            kt = log_kt(*counts.get(node, (0, 0)))
            memo[node] = kt if len(node[1]) == depth else float(np.logaddexp(kt, sum(map(weighted, children[node])))) - math.log(2)
        return memo[node]

    def probability(context, byte):
        p = 1.0
        for b in range(8):
            decision, bit = (1 << b) | (byte >> (8 - b)), byte >> (7 - b) & 1
            q = None
            for d in range(depth, -1, -1):
                node = (decision, context[:d])
                z, o = counts.get(node, (0, 0))
                kt = ((o if bit else z) + 0.5) / (z + o + 1)
                if d == depth:
                    q = kt
                else:
                    cut = math.exp(log_kt(z, o) - math.log(2) - weighted(node))
                    q = cut * kt + (1 - cut) * q
            p *= q
        return p

    return probability


def test_language_model(spark):
    r = random.Random(4)
    words = ["the", "tion", "é", "Ab", "x", "the", "in"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(12)))) for i in range(30)] + [(30, None), (31, ""), (None, "the x"), (7, "the the"), (7, "the the")]
    got = lm.score_texts(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3), depth=3, block_bytes=200).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    low = lambda t: (t or "").encode().lower()
    train = [low(t) for i, t in rows if not held(i)]
    p = plain_ctw(train, 3)
    c = Counter(w for t in train for w in [*t.split(), b"\xff"])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        data = bytes([255] * 3) + low(t) + b"\xff"
        score = sum(math.log10(p(data[k - 3 : k][::-1], data[k])) for k in range(3, len(data)))
        tokens = [*low(t).split(), b"\xff"]
        want.append((-1 if i is None else i, held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), score))
    assert len(got) == len(want)
    for a, b in zip(sorted((-1 if x[0] is None else x[0], *x[1:]) for x in map(tuple, got)), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)
        assert a[7] == pytest.approx(-b[6] / math.log10(2) / (len(low(dict(rows).get(a[0]))) + 1), rel=1e-5) or a[0] in (-1, 7)
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_sum_to_one():
    keys, n = np.unique(ctw.grams(np.frombuffer(b"abracadabra\xffbanana\xff", dtype=np.uint8), 2), return_counts=True)
    asked = np.array([(ord("a") << 16) | (ord("r") << 8) | x for x in range(256)], dtype=np.uint64)
    every = np.union1d(keys, asked)
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, keys)] = n
    mixed, nodes = ctw.subtree(every, count, 2)
    value = ctw.Top(nodes[0] >> np.uint64(8), *nodes[1:]).log10(every, mixed, 2)
    assert (10 ** value[np.searchsorted(every, asked)]).sum() == pytest.approx(1)


def test_hash_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000).astype(np.uint64))
    asked = np.random.default_rng(2).integers(0, len(keys), 20000)
    assert np.array_equal(lm.Table(keys).places(keys[asked]), asked)


def test_licenses(spark):
    plain = "Onea an thanenin haha edhaed on an the thesansh at. The license of the driver was good.\nNothing is granted here"
    rows = [(1, f"{plain}\nReleased under the MIT License.\n{plain}"), (2, plain), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY 4.0.")]
    rows += [(7, "x " * 50_000 + "\nLicensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."), (8, "the software license the of terms and version under work")]
    got = licenses.license_scan(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, family string")).where("confirmed").collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(1, 2, "MIT"), (5, 0, "CC-BY-NC"), (6, 0, "CC-BY"), (7, 1, "Apache-2.0"), (7, 2, "GPL")]
    assert all(dict(rows)[r.doc_id][r.start : r.start + r.length] == dict(rows)[r.doc_id].split("\n")[r.paragraph] for r in got)
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_wordings():
    m = licenses.train(licenses.TEMPLATES, ["some plain words of no license at all\nand a few more lines of it"] * 50)
    assert m.classify(licenses.words_of("this software is released under the MIT license"))[0] == "MIT"
    assert m.classify(licenses.words_of("Licensed under the Apache License 2.0"))[0] == "Apache-2.0"
    assert m.classify(licenses.words_of("the cat sat on the mat under the tree in version 2 of the story"))[0] == licenses.UNKNOWN


def quality_rows():
    r = random.Random(9)
    syllables = ["the", "ing", "er", "on", "at", "ion", "es", "re", "an", "th"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    clean = lambda: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(r.randrange(3, 9)))
    rows = [(i, clean(), 1) for i in range(180)]
    for i in range(180, 200):
        t = clean()
        junk = [t.upper().replace(" ", "!! "), " ".join(w + r.choice(["###", "&&&", "$$$"]) for w in t.split()), " ".join([word()] * 60), "\n".join([t.split("\n")[0]] * 9)][i % 4]
        rows.append((i, junk, 0))
    return rows


@pytest.mark.parametrize("op", ["model", "rules"])
def test_quality(spark, op):
    rows = quality_rows() + [(200, None, 2), (201, "", 2), (202, "This.", 2), (203, "word " * 40_000, 0), (204, "\n \n", 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, y int, kept string").repartition(3)
    got = {r.doc_id: r for r in (quality_model.quality_classifier(df) if op == "model" else quality_rules.quality_rules(df)).collect()}
    assert len(got) == len(rows)
    assert {i for i, _, y in rows if y == 0 and got[i].kept} == set()
    assert {i for i, _, y in rows if y == 1 and not got[i].kept} == set()
    empty = df.where("doc_id < 0")
    assert (quality_model.quality_classifier(empty) if op == "model" else quality_rules.quality_rules(empty)).count() == 0


def test_rules_base_columns(spark):
    r = random.Random(3)
    texts = [None, "", " \n", "a", "é  b\x0bc\n\na\nb\na", "# * $%&|<>", " ".join("abcdefgh" * 5)]
    texts += ["".join(r.choice(["a ", "b ", "c\n", " ", "a b c d e f g h "]) for _ in range(r.randrange(60))) for _ in range(80)]
    got = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = Counter(windows)
        cover = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == want
        assert not (x.kept and x.base_failed)


def test_em_finds_accuracies():
    r = np.random.default_rng(5)
    good = r.random(20000) < 0.85
    share = np.array([[[0.7, 0.1, 0.2], [0.01, 0.2, 0.79]], [[0.6, 0.2, 0.2], [0.005, 0.1, 0.895]], [[0.5, 0.1, 0.4], [0.02, 0.4, 0.58]], [[0.8, 0.1, 0.1], [0.01, 0.1, 0.89]]])
    votes = np.stack([np.where(good, r.choice(3, 20000, p=s[1]), r.choice(3, 20000, p=s[0])) for s in share], 1)
    codes, n = np.unique([weak.code(v) for v in votes.tolist()], return_counts=True)
    m = weak.fit(codes, n, 4)
    right = [(votes[:, j][good] == weak.GOOD).sum() + (votes[:, j][~good] == weak.BAD).sum() for j in range(4)] / (votes != weak.ABSTAIN).sum(0)
    assert np.abs(m.accuracy - right).max() < 0.15  # the bound on what a good vote can say makes it cautious
    assert ((m.posterior(votes) > 0.5) == good).mean() > 0.95


def plain_cost(roles):
    """Least cost by trying every way of up to two empty turns before each turn and at the end."""
    ways = [w for n in range(4) for w in itertools.product((1, 2, 3), repeat=n)]

    def walk(state, way):
        for x in way:
            if x not in chat.LEGAL[state]:
                return None
            state = x
        return state

    best = {chat.START: 0}
    for r in roles:
        after = {}
        for s, c in best.items():
            for target in (1, 2, 3):
                price = c + (0 if target == r else chat.RELABEL)
                if s == target:
                    after[target] = min(after.get(target, 1 << 60), price + chat.MERGE)
                for w in ways:
                    b = walk(s, w)
                    if b is not None and target in chat.LEGAL[b]:
                        after[target] = min(after.get(target, 1 << 60), price + chat.INSERT * len(w))
        best = after
    return min(c + chat.INSERT * len(w) for s, c in best.items() for w in ways if walk(s, w) == chat.FINAL)


def test_role_repair_is_of_least_cost():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            out = chat.repair(list(roles))
            state, cost = chat.START, 0
            for r, (role, merged, before) in zip(roles, out):
                for x in before:
                    assert x in chat.LEGAL[state]
                    state, cost = x, cost + chat.INSERT
                assert state == role if merged else role in chat.LEGAL[state]
                state, cost = role, cost + (chat.MERGE if merged else 0) + (chat.RELABEL if role != r else 0)
            assert cost + chat.END_COST[state] == plain_cost(roles)


def test_chat_format(spark):
    r = random.Random(1)
    roles = ["user", "assistant", "system", "Human", None, "tool"]
    rows = [(c, t if t % 7 else None, r.choice(roles), r.choice(["hi", "", None])) for c in [1, 2, 3, None] for t in range(6)]
    rows += [(9, t, r.choice(roles[:3]), f"t{t}") for t in range(3000)]  # one long conversation over many partitions
    rows += [(1, 3, "user", "again")] * 2
    df = spark.createDataFrame([(*x, 5) for x in rows], "conv_id long, turn long, role string, text string, position int").repartition(5)
    got = chat.chat_format(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for x in got:
        by[x.conv_id].append(x)
    for c, own in by.items():
        own.sort(key=lambda x: x.position)
        assert [x.position for x in own] == list(range(len(own)))
        assert [x.turn is not None for x in own] == sorted(x.turn is not None for x in own)
        numbers = [chat.role_number(x.role_in) for x in own]
        cost = sum(("merge" in x.action) * chat.MERGE + ("relabel" in x.action) * chat.RELABEL + (x.inserted_before + x.inserted_after) * chat.INSERT for x in own)
        once = chat.repair(numbers)
        least = sum(m * chat.MERGE + (role != n) * chat.RELABEL + len(b) * chat.INSERT for n, (role, m, b) in zip(numbers, once)) + chat.END_COST[once[-1][0]]
        assert cost == least
        whole = "".join(x.segment for x in own)
        spoken = [p.split("\n")[0] for p in whole.split("<|im_start|>")[1:]]
        assert whole.endswith("<|im_end|>\n") and whole.count("<|im_start|>") == whole.count("<|im_end|>")
        state = chat.START
        for s in spoken:
            n = chat.ROLES.index(s) + 1
            assert n in chat.LEGAL[state]
            state = n
        assert state == chat.FINAL
    assert chat.chat_format(df.where("turn < 0")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t)) for i, t, y in quality_rows()]
    rows += [(500 + i, t.upper() if i == 0 else t, "en", "s", 0) for i, (_, t, _, _, _) in enumerate(rows[:3])] + [(600, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    n = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            docs = corpus_pipeline.stored(out, name)
            n.append(docs.count())
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert n == [183, 182, 180, 180]  # the null text has no votes; the rules reject it
    assert {501, 502} <= kept and not {1, 2} & kept and 0 in kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept
