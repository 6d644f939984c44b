"""Texts beyond what a shard takes in one task, and more words than characters."""

import random

from test_dedup import brute_phrases, sorted_rows

from calorant.llm import dedup, phrases, recurrence


def test_more_words_than_characters(monkeypatch):
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(20)).encode()
    regions = [(b" ".join([shared, *(f"{k}-{i}".encode() for i in range(200)), shared]), 220, k, 1) for k in range(8)]
    rng.shuffle(regions)
    judge = phrases.kernel(13)
    want = judge([regions])
    monkeypatch.setattr(phrases, "WORDS", 300)
    assert isinstance(phrases.numbered([regions])[0][0], tuple) and judge([regions]) == want
    assert all(own[0][:3] == (0, 8, 0) for own in want[0])


def test_a_long_text_in_which_one_trigram_recurs(spark):
    """A text of 10 MB with over a million different words, a trigram of which recurs every eleven words."""
    body = [w for k in range(98_000) for w in ("of", "the", "sea", *(f"w{k}x{i}" for i in range(8)))]
    passage = [f"p{i}" for i in range(60)]
    long = " ".join([*body[: 11 * 40_000], *passage, *body[11 * 40_000 :]])
    rows = [(5, long), (2, "one of the sea " + " ".join(passage)), (9, " ".join(body[11_000:22_000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = phrases.without_repeats(df).drop("kept")
    assert sorted_rows(tuple(r)[:4] for r in got.collect()) == sorted_rows(brute_phrases(rows))


def test_shards_split_by_regions_give_the_same(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(400))) for i in range(30)] + [(50 + i, "the very same words again and again " * 12) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    said = [dedup.removals(df, recurrence.Words, 5, 2, phrases.kernel(5), lambda body, n: [(0, i, b" ".join(body.split(b" ")[i : i + 5])) for i in range(n)], 4096, True, most=most) for most in (3, 16_384)]
    spans = [sorted((r.doc_id, *(tuple(x.tolist()) for x in dedup.intervals(r.found0, 5))) for r in d.collect()) for d in said]
    assert spans[0] == spans[1]
