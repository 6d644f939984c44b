"""The registered queries on the smallest tables: columns, rows, and what SQL can't say."""

import collections
import zlib

import pytest
from test_dedup import brute_bytes, brute_phrases, sorted_rows

from calorant.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def test_repeats_equal_brute_force(spark, docs):
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    assert sorted_rows(tuple(r)[:4] for r in queries.op8_phrases(spark, SF).collect()) == sorted_rows(brute_phrases(rows))
    assert sorted_rows(tuple(r)[:5] for r in queries.op10_suffixes(spark, SF).collect()) == sorted_rows(brute_bytes(rows))


@pytest.mark.parametrize(("name", "n", "held"), [("op1_quality", 4, 2), ("op2_languages", 5, 0), ("op6_toxicity", 3, 1)])
def test_scores_hold_out_their_fold(spark, docs, name, n, held):
    got = queries.queries()[name](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs.doc_id)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held) and 0 <= r.score <= 1 for r in got)
    if name == "op2_languages":
        lang = dict(zip(docs.doc_id, docs.lang))
        judged = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
        assert sum(r.lang_pred == lang[r.doc_id] for r in judged) >= 0.97 * len(judged)
        assert all(bool(r.spans) == (r.lang_pred != "und") for r in got)


def test_sequences_are_gapless(spark, docs):
    got = queries.op3_packing(spark, SF).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == set(docs.doc_id)
    for own in pieces.values():
        own.sort()
        assert [s for s, *_ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]


def test_groups_take_their_smallest_id(spark, docs):
    got = queries.op7_simhash(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs.doc_id)
    least = collections.defaultdict(list)
    for r in got:
        least[r.component_id].append(r.doc_id)
        assert len(r.fingerprint) == 16
    assert all(min(ids) == k for k, ids in least.items())


def test_media_and_secrets_give_a_row_each(spark, docs):
    for name in ("op4_secrets", "op9_ogg"):
        assert sorted(r.doc_id for r in queries.queries()[name](spark, SF).collect()) == sorted(docs.doc_id)
