import random

from conftest import words

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    item = words(rng, 40)
    texts = [words(rng, 120) for _ in range(30)]
    key = f"{rng.getrandbits(160):040x}"
    rows = [(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "aa", "s", 1), (100, texts[3], "aa", "s", 1), (101, texts[4] + " " + item, "aa", None, 1), (102, None, "aa", "s", 1), (103, "12 34 !!", None, "s", 1), (104, texts[5] + f' token = "{key}"', None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = docs
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").collect()) for name, df in kept.items() if name != "packing"}
    assert set(ids["language"]) == {*range(30), 100, 101, 104}
    assert ids["near_duplicates"] == sorted({*range(30), 101, 104})
    assert ids["decontamination"] == sorted({*range(30), 104})
    assert ids["secrets"] == ids["decontamination"]
    masked = kept["secrets"].where("doc_id = 104").first()
    assert key not in masked.text and masked.n_chars == len(masked.text) and masked.lang == "aa"
    assert {r.doc_id for r in kept["packing"].collect()} == set(ids["secrets"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["packing"].count()


def test_rows_without_or_with_shared_ids(spark, tmp_path, nothing):
    """Null and shared ids, ties, repeated rows, clashing names and empty tables in every stage."""
    rng = random.Random(2)
    item, a, b, c, d = (words(rng, 60) for _ in range(5))
    rows = [(1, a), (7, a), (7, b), (None, a), (None, c), (None, c), (8, d + " " + item), (8, d), (None, item), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "aa" if i else None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'mine' AS _language", "1 AS row", "2 AS check", "3 AS fp", "4 AS hash", "array(5) AS spans")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    said = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    found = stages["language"](spark, docs, str(tmp_path))
    assert found.columns == docs.columns and said(found) == sorted(rows[:9], key=repr) and {r._language for r in found.collect()} == {"mine"}
    one = stages["near_duplicates"](spark, found, str(tmp_path))
    assert one.columns == docs.columns and said(one) == sorted([rows[0], rows[2], rows[4], rows[6], rows[7], rows[8]], key=repr)
    clean = stages["decontamination"](spark, one, str(tmp_path))
    assert clean.columns == docs.columns and said(clean) == sorted([rows[0], rows[2], rows[4], rows[7]], key=repr)
    masked = stages["secrets"](spark, clean, str(tmp_path))
    assert masked.columns == docs.columns and said(masked) == said(clean)
    assert stages["packing"](spark, masked, str(tmp_path)).count() >= 4
    for stage in stages.values():
        assert stage(spark, nothing, str(tmp_path)).count() == 0
