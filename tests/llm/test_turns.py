"""Tries against plain prefix counting, double arrays against sets, and splitting at every size."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from calorant.llm import turns
from calorant.llm.common import fold

SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members = collections.defaultdict(set)
    ends = collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        walk = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        ends[walk].append(c)
        for d in range(len(walk) + 1):
            members[walk[:d]].add(c)
    out = []
    for node in members:
        below = [v for v in members if v[: len(node)] == node]
        leaves = [v for v in below if not any(len(w) == len(v) + 1 and w[:-1] == v for w in members)]
        kids = [v for v in below if len(v) == len(node) + 1]
        saved = sum((len(members[v]) - 1) * words(v[-1][1]) for v in below if v)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), len(leaves), saved, sha))
    return sorted(out, key=str)


def got(spark, rows, **k):
    own = turns.ordered(spark.createDataFrame(rows, SCHEMA).withColumn("words", F.lit("x")).withColumn("node", F.lit(1)).repartition(3))
    return sorted((tuple(r) for r in turns.trie(turns.regrown(own, fold("conv_id", 4)), **k).collect()), key=str)


def chats(seed, n, kinds, most):
    rng = random.Random(seed)
    said = [("user", "Hi there"), ("user", "  two\twords "), ("assistant", "Hi there"), (None, "x"), ("user", None), ("user", ""), ("a", "b c d")][:kinds]
    return [(c, t, *rng.choice(said)) for c in rng.sample(range(n * 2), n) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("most", [1, 3, 20, 65_536])
def test_nodes_equal_prefix_counts_however_shards_are_split(spark, most):
    rows = chats(most, 60, 4, 5)
    assert got(spark, rows, most=most) == brute(rows)


def test_null_turns_ties_repeated_rows_and_turnless_conversations(spark):
    rows = [(7, None, "user", "a"), (7, 0, "user", "b"), (8, 1, None, None), (8, 1, None, None), (None, 0, "user", "lost"), (21, 0, "u", "only"), (40, 3, "u", "z"), (40, 2, "u", "y"), (41, 0, "u", "q")]
    rows += [(c, 0, "u", "solo") for c in range(61, 80)]
    want = brute(rows)
    assert any(r[1] == 0 and r[7] != turns.NO_ENDS for r in want)  # some conversation lost all its turns
    assert got(spark, rows) == want
    assert got(spark, rows, most=1) == want
    assert got(spark, []) == []


def test_a_long_conversation_and_many_copies(spark):
    rows = [(5, t, "u", f"t{t}") for t in range(700)] + [(c, 0, "u", "same") for c in range(10_000, 14_500)]
    many = [r for r in got(spark, rows) if r[3] > 4000]
    ends = hashlib.sha256(",".join(map(str, range(10_000, 14_500))).encode()).hexdigest()  # every copy has its own turn or its base's
    assert {r[1] for r in many} == {0, 1} and {r[7] for r in many if r[1] == 1} == {ends}


def test_double_arrays_hold_just_their_keys():
    rng = random.Random(5)
    for codes in (3, 40, 900):
        keys = sorted({tuple(rng.randint(1, codes) for _ in range(rng.randint(1, 5))) for _ in range(400)})
        trie = turns.DoubleArray([list(k) for k in keys])
        prefixes = {k[:d] for k in keys for d in range(len(k) + 1)}
        at = {(): 0}
        for p in sorted(prefixes - {()}, key=len):
            at[p] = trie.child(at[p[:-1]], p[-1])
            assert at[p] > 0
        assert len(set(at.values())) == len(prefixes) and sorted([0, *trie.order]) == sorted(at.values())
        for p in list(prefixes)[:200]:
            for c in range(1, codes + 2):
                assert (trie.child(at[p], c) >= 0) == ((*p, c) in prefixes)
