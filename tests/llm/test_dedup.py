import collections
import hashlib
import random
import re

import numpy as np
import pytest
from conftest import words

from calorant.llm import components, phrases, recurrence, simhash, suffixes

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sorted_rows(rows):
    return sorted(rows, key=repr)


def brute_phrases(rows, window=13):
    first = {}
    key = lambda i: i if i is not None else 1 << 63
    split = [GAP.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - window + 1):
            p = tuple(w[k : k + window])
            first[p] = min(first.get(p, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows, window=400):
    data = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[k : k + window] for b in data for k in range(len(b) - window + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def shared(spark, seed, n=60):
    rng = random.Random(seed)
    passages = [words(rng, rng.randint(10, 120)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [words(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a:] if rng.random() < 0.4 else p, words(rng, rng.randint(0, 8))]
        rows.append((i, rng.choice([" ", "  ", "\n", ""]).join(parts)))
    rows += [(n + k, rows[k][1]) for k in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("crowd", [5000, 2])
def test_phrases_against_brute_force(spark, seed, crowd):
    df = shared(spark, seed)
    got = [tuple(r)[:4] for r in phrases.without_repeats(df, crowd=crowd).collect()]
    assert sorted_rows(got) == sorted_rows(brute_phrases(rows_of(df)))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("crowd", [5000, 2])
def test_suffixes_against_brute_force(spark, seed, crowd):
    df = shared(spark, seed)
    got = [tuple(r)[:5] for r in suffixes.without_repeats(df, crowd=crowd).collect()]
    assert sorted_rows(got) == sorted_rows(brute_bytes(rows_of(df)))


def test_awkward_rows(awkward):
    rows = rows_of(awkward)
    assert sorted_rows(tuple(r)[:4] for r in phrases.without_repeats(awkward).collect()) == sorted_rows(brute_phrases(rows))
    got = sorted_rows(tuple(r)[:5] for r in suffixes.without_repeats(awkward).collect())
    short = [(i, t) for i, t in rows if len(t or "") < 50_000]
    want = {r[0]: r for r in brute_bytes(short) if r[0] in (3, 4, 5, 9, 10, 11)}
    for r in got:
        if r[0] in want:
            assert r == want[r[0]]
    assert {r[2] for r in got if r[0] == 12} == {len(dict(rows)[12].encode())}


def test_empty_tables(nothing):
    assert phrases.without_repeats(nothing).count() == 0
    assert suffixes.without_repeats(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(800):
        s = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 40))]
        assert suffixes.suffix_array(np.array(s, dtype=np.int64)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_recurring_windows():
    rng = random.Random(5)
    vocabulary = [b"ab", b"cab", b"b", b"dd", b"", b"abc", b"e"]
    for _ in range(400):
        window, base = rng.choice([5, 9, 14]), b" ".join(rng.choice(vocabulary) for _ in range(12))
        group = {}
        for _ in range(rng.randint(1, 5)):
            x = bytearray(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(b"ab ")
            x = bytes(x)[rng.randint(0, 6) :]
            if len(x) >= window:
                group[x] = (x, len(x) - window + 1, 0, rng.choice([1, 1, 1, 2]))
        if not group:
            continue
        count = collections.Counter()
        for b, n, _, copies in group.values():
            for i in range(n):
                count[b[i : i + window]] += copies
        want = [[count[b[i : i + window]] > 1 for i in range(n)] for b, n, _, _ in group.values()]
        assert [list(x) for x in suffixes.recurring_windows([list(group.values())], (window,))[0]] == want


def test_equal_windows_share_their_anchor():
    rng = random.Random(6)
    passage = words(rng, 120).encode()
    texts = [words(rng, 30).encode() + b" " + passage, passage + b" " + words(rng, 9).encode()]
    u = recurrence.Bytes(texts, 400, 32, np.full(2, 1 << 40))
    r = u.regions()
    anchor = {}
    for d, s, n, a in zip(r.text, r.start, r.windows, r.anchor):
        for k in range(s, s + n):
            assert anchor.setdefault(texts[d][k : k + 400], a) == a
    assert sum(r.windows) == sum(len(t) - 399 for t in texts)


def test_simhash_against_brute_force(spark, awkward):
    rng = random.Random(7)
    base = [words(rng, 300) for _ in range(12)]
    rows = []
    for i in range(150):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = dict(zip([i for i, _ in rows], simhash.fingerprint_batch([t.encode() for _, t in rows]).tolist()))
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin((fps[a] ^ fps[b]) & (1 << 64) - 1).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (fps[i], find(i)) for i in fps}
    assert len({c for _, c in got.values()}) < len(rows)
    odd = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(awkward).collect()]
    assert len(odd) == awkward.count()
    assert {c for i, f, c in odd if f == 0} == {3}


def test_crowded_blocks_keep_their_links(spark):
    """A chain of fingerprints two bits apart, all in one block, is one component on either way."""
    fps = [((1 << 40) | sum(1 << k for k in range(n))) for n in range(0, 30, 2)]
    df = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, node long")
    for block in (2, 100):
        got = components.components(simhash.links(df, block))
        assert {r.component for r in got.collect()} == {0} and got.count() == len(fps) - 1


def test_pivots_discard_no_link():
    rng = random.Random(8)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        for p in simhash.PIVOTS:
            p &= (1 << 64) - 1
            assert abs(bin(a ^ p).count("1") - bin(b ^ p).count("1")) <= 2


def test_fingerprint_by_the_letter():
    import xxhash

    text = "One two THREE one\ttwo three é"
    w = GAP.findall(text.replace("O", "o").replace("T", "t").replace("H", "h").replace("R", "r").replace("E", "e"))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    got = simhash.fingerprint_batch([text.encode(), b"", b"a b", b" "])
    assert int(got.view(np.uint64)[0]) == want
    assert int(got.view(np.uint64)[2]) == xxhash.xxh64_intdigest(b"a b", 42)
    assert got[1] == got[3] == 0


def test_simhash_links_through_rows_without_an_id(spark):
    """A chain of fingerprints two bits apart, whose middle has no id, is one group; ids that repeat merge nothing."""
    rows = [(5, 0b0), (None, 0b11), (9, 0b1111), (9, 1 << 60 | 1 << 50 | 1 << 40), (None, 1 << 61 | 1 << 51 | 1 << 41)]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert {r.fp: r.component_id for r in got} == {0b0: 5, 0b11: 5, 0b1111: 5, rows[3][1]: 9, rows[4][1]: None}


def test_one_of_each_goes_by_row(spark, awkward, nothing):
    rng = random.Random(9)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(1, a), (7, a), (7, b), (7, b), (None, a), (None, c), (None, c), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('k', 1) AS fp", "2 AS row", "3 AS check", "4 AS group")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (7, b), (0, c), (8, None)], key=repr)
    assert simhash.one_of_each(nothing).count() == 0
    assert simhash.one_of_each(awkward).where("text is null or trim(text) = ''").count() <= 2
