"""Exact dedup, BPE, SimHash, token counts and packing against plain Python and the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from korpusflow.llm import bpe, packing, simhash, token_counts
from korpusflow.llm.exact_dedup import exact_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, kept string, n_tokens int, start string"


def odd_texts():
    r = random.Random(7)
    alphabet = "ab the in er\n\t '  sS..!!--  éß漢字12" + "".join(chr(r.randrange(32, 0x3000)) for _ in range(40))
    out = ["", None, " ", "\n", "a", "A", "É", "é", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|>", "  \n\n x", "don't we'LL", "日本語 😀‍👩", "a" * 3000, "ab " * 5000, "\x00 b\x1c c", "x\r\n y\t", " the same text. " * 3]
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 150))) for _ in range(200)]
    return out + out[:20] + [t.upper() for t in out[30:40]]


def rows():
    return [(i if i != 5 else None, t, "clash", 7, "clash") for i, t in enumerate(odd_texts())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def lower(t):
    return (t or "").encode().lower()


def test_exact_dedup(spark, docs):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[lower(t)].append(i)
    got = exact_dedup(docs, digest_col="sha").collect()
    assert len(got) == len(rows())
    for r in got:
        own = groups[lower(r.text)]
        keep = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept, r.sha) == (keep, len(own), r.doc_id == keep, hashlib.sha256(lower(r.text)).hexdigest())
    assert exact_dedup(docs.where("doc_id < 0")).count() == 0
    twice = exact_dedup(spark.createDataFrame([(1, "x"), (1, "x"), (0, "X")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in twice] == [(1, 3, False), (1, 3, True), (1, 3, True)]


def expected_ids(t):
    return LIBRARY.encode(t or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(docs):
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.bpe_encode(docs, PATH).collect()}
    for i, t, *_ in rows():
        ids = expected_ids(t)
        r = got[i, hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()]
        assert r.n_tokens == len(ids) and list(r.ids) == ids
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_encode(docs.where("doc_id < 0"), PATH).count() == 0


def test_pair_table_equals_merging():
    e, r = bpe.encoder(PATH), random.Random(3)
    some = [t for t in e.v.ids if 1 < len(t) < 6]
    for _ in range(3000):
        a, b = r.choice(some), r.choice(some)
        i, j = e.v.ids[a], e.v.ids[b]
        assert e.fits[i, j] == (e.v.merged(a + b) == [i, j])


def test_decoding_replaces_what_is_not_utf8():
    e = bpe.encoder(PATH)
    ids = [e.v.ids[bytes([b])] for b in (0xE6, 0x97, 0x41, 0xFF)]
    assert e.decode(np.array(ids, dtype="<u4").tobytes()).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("chunk", [1, 7, 64, token_counts.CHUNK])
def test_token_counts(docs, chunk):
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(expected_ids(t)), len(expected_ids(t)) > 1024) for i, t, *_ in rows())
    got = token_counts.token_counts(docs, PATH, chunk=chunk).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_state_maps_compose_in_any_order():
    t = token_counts.transducer(PATH)
    text = "It's we'll they've 're 'l  two   spaces\n\n\tand !!'' 12.5 naïve — über\xa0x 'd" * 3
    m = token_counts.Machine(t)
    maps = [token_counts.StateMap(text[i : i + 5], m) for i in range(0, len(text), 5)]
    for k, scanned in enumerate(token_counts.prefix_scan(maps)):
        state, n = scanned.at(token_counts.START)
        assert n + m.end(state) == len(expected_ids(text[: 5 * k + 5]))
    whole = maps[0]
    for x in maps[1:]:
        whole = whole.then(x)
    assert whole.at(token_counts.START) == token_counts.prefix_scan(maps)[-1].at(token_counts.START)


def test_states_of_random_texts():
    """The machine over whole texts, cut anywhere, against the library."""
    r = random.Random(6)
    t = token_counts.transducer(PATH)
    parts = ["'", "'s", "'re", "'ve", "'ll", "'l", " ", "  ", "\n", "\t", "\xa0", "a", "the", "Ab", "9", "12", "!", "...", "é", "日本", "ǅ", "²", "\u200b", "x'", "<|endoftext|>", "r", "v", "l", "e"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        assert token_counts.count_tokens(text, t, r.randrange(1, 9)) == len(expected_ids(text)), text


def test_text_without_seams_goes_by_states():
    r = random.Random(7)
    t = token_counts.transducer(PATH)
    text = "".join(r.choice("abcdefghij") for _ in range(200_000))
    m = token_counts.Machine(t)
    maps = [token_counts.StateMap(text[i : i + 10_000], m) for i in range(0, len(text), 10_000)]
    for before, own in zip(range(10_000, len(text), 10_000), maps[1:]):
        own.at(m.run(token_counts.START, text[before - token_counts.GUESS : before])[0])
    guessed = [set(x.table) for x in maps[1:]]
    state, n = token_counts.prefix_scan(maps)[-1].at(token_counts.START)
    assert n + m.end(state) == len(bpe.encoder(PATH).encode(text)) // 4
    assert sum(set(x.table) == g for x, g in zip(maps[1:], guessed)) >= 18  # the guesses were right: nothing was run again


def plain_fingerprint(text, n=3):
    w = lower(text).split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < n else [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                parent[find(a)] = find(b)
    return [find(a) for a in range(len(fps))]


def near_texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    out = [None, "", " ", "x", "x y", "X  y"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(300)]
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(300)] = r.choice(words)
            out.append(" ".join(copy))
    return out


def test_simhash(spark):
    texts = near_texts()
    ids = [3 * i + 1 for i in range(len(texts))]
    got = simhash.simhash_groups(spark.createDataFrame(list(zip(ids, texts, ids)), "doc_id long, text string, fp long").repartition(3)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    of = plain_components(fps)
    least = {}
    for i, c in zip(ids, of):
        least[c] = min(i, least.get(c, i))
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", least[c]) for i, f, c in zip(ids, fps, of))
    assert len({x[2] for x in map(tuple, got)}) < len(texts) - 20
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lists_are_exact():
    r = random.Random(11)
    base = r.getrandbits(64)
    fps = {base ^ (r.getrandbits(24) << 16) for _ in range(900)} | {base ^ (1 << b) for b in range(16, 40)}
    order = np.array(sorted(fps), dtype=np.uint64)
    want = plain_components([int(x) for x in order])
    got = simhash.components(order.astype(np.int64), (0, 1, 5, 6, 7))
    pairs = {(w, g) for w, g in zip(want, got.tolist())}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_long_posting_lists_in_spark(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHORT", 3)
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.getrandbits(8) << 24) for c in centres for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = {r.u: r.v for r in simhash.connected(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    pairs = {(w, roots.get(f, f)) for w, f in zip(plain_components(fps), signed)}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_connected_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 90)], "u long, v long")
    assert {r.u: r.v for r in simhash.connected(edges).collect()} == {i: 0 for i in range(1, 41)} | {100: 90}


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(docs, window):
    got = packing.pack(docs, PATH, window=window).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert 0 < r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        size = sum(r.length for r in s)
        assert size == window or size < window and size & (size - 1) == 0
    for i, t, *_ in rows():
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [*expected_ids(t), 1] and {r.doc_tokens for r in own} == {len(expected_ids(t)) + 1}
    assert packing.pack(docs.where("doc_id < 0"), PATH).count() == 0


def test_sum_of_squares_rule():
    r, p = random.Random(1), packing.Packer(16)
    for k in range(500):
        size = r.randrange(1, 16)
        n = p.count[:16].copy()

        def cost(h, n=n, size=size):
            m = n.astype(int).tolist() + [0]
            if h:
                m[h] -= 1
            if h + size < 16:
                m[h + size] += 1
            return sum(x * x for x in m[:16])

        allowed = [h for h in range(16 - size + 1) if h == 0 or n[h]]
        assert cost(p.level(size)) == min(map(cost, allowed))
        list(p.add(k, np.arange(size)))


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 5000, "\n" * 5000, "^9" * 3000, "x <|endoftext|>y<|endoftext|><|", "é日本😀 　 x\x00\x85", "a b " * (packing.LONGEST // 3)])
def test_pack_encoder_equals_library(text):
    assert packing.pack_encoder(PATH).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
