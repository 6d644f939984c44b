"""Nothing goes for its hash alone; long texts and crowded shards give what brute force gives."""

import random

import pytest
from conftest import words
from test_dedup import brute_bytes, brute_phrases, sorted_rows

from calorant.llm import dedup, phrases, suffixes


def thue_morse(n: int) -> list[int]:
    return [bin(k).count("1") % 2 for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_texts_whose_polynomial_hashes_collide_stay(spark):
    order = thue_morse(512)
    rows = [(1, "".join("(w"[k] for k in order)), (2, "".join("w("[k] for k in order))]
    got = sorted_rows(tuple(r)[:5] for r in suffixes.without_repeats(table(spark, rows)).collect())
    assert got == sorted_rows(brute_bytes(rows)) and {r[2] for r in got} == {0}
    same = " ".join(f"word{k}" for k in range(12))
    rows = [(k + 1, f"{same} " + "".join("(w"[x ^ k] for x in order)) for k in (0, 1)]
    got = sorted_rows(tuple(r)[:4] for r in phrases.without_repeats(table(spark, rows)).collect())
    assert got == sorted_rows(brute_phrases(rows)) and {r[2] for r in got} == {0}


@pytest.fixture(scope="module")
def long_rows():
    """A text of several pieces with a passage across a cut, the same passage elsewhere, and repeats in one text."""
    rng = random.Random(12)
    passage, filler = words(rng, 400), words(rng, 60_000)
    cut = dedup.SLICE - 700
    long = filler[:cut] + " " + passage + " " + filler[cut:]
    return [(3, long + " " + filler[-3000:]), (1, "new " + passage[300:] + " end"), (2, filler[cut - 900 : cut + 900]), (4, "x" * (dedup.SLICE + 5000)), (5, "")]


def test_long_texts_in_pieces(spark, long_rows):
    df = table(spark, long_rows)
    got = {r[0]: tuple(r)[:4] for r in phrases.without_repeats(df).collect()}
    assert got == {r[0]: r for r in brute_phrases(long_rows)}
    small = [r for r in long_rows if r[0] != 4]
    got = {r[0]: tuple(r)[:5] for r in suffixes.without_repeats(df).collect()}
    assert {i: r for i, r in got.items() if i != 4} == {r[0]: r for r in brute_bytes(small)}
    assert got[4][2] == got[4][1] and got[4][3] == 1


def test_crowded_at_the_production_bound(spark):
    """A passage in more texts than CROWD, between different words: counted, with the rows of brute force."""
    rng = random.Random(13)
    passage = words(rng, 80)
    rows = [(i, f"{words(rng, 6)} {passage} {words(rng, 6)}") for i in range(max(phrases.CROWD, suffixes.CROWD) + 200)]
    df = table(spark, rows).repartition(4)
    assert sorted_rows(tuple(r)[:4] for r in phrases.without_repeats(df).collect()) == sorted_rows(brute_phrases(rows))
    got = suffixes.without_repeats(df).drop("kept").collect()
    assert sorted_rows(tuple(r)[:5] for r in got) == sorted_rows(brute_bytes(rows))


def test_passages_below_the_window_are_counted(spark):
    rng = random.Random(14)
    passage = words(rng, 60)[:330]
    rows = [(1, words(rng, 30) + " " + passage + " " + words(rng, 30)), (2, passage), (3, words(rng, 90))]
    got = {r.doc_id: r for r in suffixes.without_repeats(table(spark, rows)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 0, 0]
    assert got[1].n_passage_bytes in range(len(passage), len(passage) + 4) and got[2].n_passage_bytes == len(passage) and got[3].n_passage_bytes == 0
