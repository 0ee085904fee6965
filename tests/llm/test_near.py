"""Near copies in the pipeline against brute force."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from korpusflow.llm import near


def sets_of(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    """Row numbers that stay."""
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        g = find(k)
        best[g] = min(best.get(g, (True, 0, len(rows))), (i is None, i or 0, k))
    return [k for _, _, k in best.values()]


def near_rows():
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    out = []
    for _ in range(40):
        base = [word() for _ in range(r.randrange(20, 400))]
        for _ in range(4):
            t = list(base)
            for _ in range(r.randrange(0, 11)):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t))
    hot = [word() for _ in range(80)]  # one large group, its lists longer than SHORT
    for _ in range(90):
        t = list(hot)
        for _ in range(r.randrange(1, 4)):
            t[r.randrange(len(t))] = word()
        out.append(" ".join(t))
    out += ["", " \n", None, "one two", "One  two", "three"]
    r.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("drawn,block", [(0, near.BLOCK), (near.DRAWN, near.BLOCK), (near.DRAWN, 20)])
def test_near_stage_finds_every_pair(spark, monkeypatch, drawn, block):
    monkeypatch.setattr(near, "DRAWN", drawn)
    monkeypatch.setattr(near, "BLOCK", block)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect())
    assert got == sorted(rows[k][0] for k in brute_force(rows))


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "one copy"), (7, "One copy"), (None, "a unique text"), (8, "twice"), (9, "twice"), (8, "another unique text"), (4, "same row"), (4, "same row"), (None, long), (None, long + " x")]
    schema = "doc_id long, text string"
    exact = corpus_pipeline.exact_dedup_stage(spark, spark.createDataFrame(rows, schema).repartition(3), "")
    assert sorted(((r.doc_id or 0, r.text) for r in exact.collect())) == sorted([(7, "One copy"), (0, "a unique text"), (9, "twice"), (8, "another unique text"), (4, "same row"), (0, long), (0, long + " x")])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_stage(spark, exact, "").collect()]
    assert len(kept) == 6 and sum(t.startswith(long) for _, t in kept) == 1 and {(None, "a unique text"), (8, "another unique text")} <= set(kept)


@pytest.mark.parametrize("cut", [1, 7, 1000])
def test_lists_are_parted_whole_whatever_the_batches(cut):
    import pyarrow as pa

    r = random.Random(cut)
    lists = {h: sorted(r.sample(range(200), r.choice([1, 2, near.SHORT, near.SHORT + 1, 90]))) for h in range(25)}
    rows = [(h, node, node + 5) for h, nodes in lists.items() for node in nodes for _ in range(r.choice([1, 1, 3]))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + cut]), [pa.int64(), pa.int64(), pa.int32()])], ["h", "node", "n"]) for k in range(0, len(rows), cut)]
    got, marked = {}, {}
    for long, (h, node, n) in near._parted(iter(batches)):
        assert len(set(h.tolist())) == 1 and (n == node + 5).all()
        got.setdefault(int(h[0]), []).extend(node.tolist())
        marked.setdefault(int(h[0]), set()).add(long)
        assert long or len(got[int(h[0])]) == len(node)
    assert got == {h: nodes for h, nodes in lists.items() if len(nodes) > 1}
    assert marked == {h: {len(nodes) > near.SHORT} for h, nodes in lists.items() if len(nodes) > 1}
    assert list(near._parted(iter([]))) == []
