"""Near words against all pairs, and against the definition with nulls, ties and repeated rows."""

import collections
import random
import re

import pytest

from calorant.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(occurrences, least, least_n, ratio):
    n = {w: k for w, k in collections.Counter(occurrences).items() if len(w) >= least and k >= least_n}
    form, out = {}, []
    neighbours = {w: [v for v in n if near(w, v)] for w in n}
    for w, own in neighbours.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(neighbours[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def got(spark, occurrences, **k):
    rows = spark.createDataFrame([(w, 1) for w in occurrences], "word string, n int").repartition(3)
    return sorted(tuple(r) for r in variants.group(rows, **k).select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "aàÿ×z"])
def test_near_words_equal_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 6))) for _ in range(150)]
    occurrences = [w for w in words for _ in range(rng.choice([1, 2, 3, 25, 400]))]
    assert got(spark, occurrences, least=3, least_n=2, ratio=10) == brute(occurrences, 3, 2, 10)


def test_chains_lead_to_their_last_form_and_ties_to_the_smallest(spark):
    n = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "zzzzzzzz": 3, "zzzzzzza": 30, "zzzzzzzb": 30}
    rows = {r[0]: r for r in got(spark, [w for w, k in n.items() for _ in range(k)])}
    assert rows["aaaaaaaa"][3:] == ("aaaaaaab", 20, "aaaaabbb") and rows["zzzzzzzz"][3:] == ("zzzzzzza", 30, "zzzzzzza")
    assert rows["aaaaabbb"][3:] == (None, None, "aaaaabbb")


def test_a_run_of_keys_goes_on_in_the_next_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        occurrences = [f"wordwor{c}" for c in "abcdefghijklmnop" for _ in range(2)] + ["wordwor"] * 40
        assert got(spark, occurrences) == brute(occurrences, 7, 2, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_are_maximal_and_awkward_rows_have_a_result(spark, awkward, nothing):
    rows = collections.Counter((r.doc_id, r.word) for r in variants.runs(awkward, 2).collect())
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = collections.Counter((r.doc_id, w.translate(lower)) for r in awkward.collect() for w in re.findall(r"[A-Za-zÀ-ÿ]+", r.text or "") if len(w) > 1)
    assert rows == want
    assert variants.group(variants.runs(nothing)).collect() == []
    text = [(1, "ÀÉabcdeé AbCdEfGh7abcdefgh"), (2, None), (3, "")]
    assert sorted(r.word for r in variants.runs(spark.createDataFrame(text, "doc_id long, text string")).collect()) == ["abcdefgh", "abcdefgh", "ÀÉabcdeé"]
