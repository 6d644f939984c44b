"""the network and its threshold come from the findings of all texts, in shards."""

import numpy as np

from calorant.llm import secrets
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_findings_of_every_text_are_learned_from(spark, monkeypatch):
    docs = spark.range(4500).select(F.col("id").alias("doc_id"), F.concat(F.lit("key "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 32), F.lit(" end")).alias("text"))
    seen = []
    monkeypatch.setattr(secrets, "written", lambda df, own=secrets.written: seen.append(own(df)) or seen[-1])
    secrets.fit(docs)
    by = {(r.label, r.made): r["count"] for r in seen[0].groupBy("label", "made").count().collect()}
    assert by[1, False] == 4500 and by[1, True] >= 4400 and by[0, True] >= 4000


def test_shards_make_a_network_that_finds_keys(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SHARD", 1000)
    monkeypatch.setattr(secrets, "SEEN", 40_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secrets.fit(docs)
    x, y = secrets.generated([r.text for r in docs.where("length(text) > 200").select("text").limit(40).collect()], 300, seed=77)
    said = model.probability(np.asarray(x)) >= model.threshold
    assert said[y == 1].mean() >= 0.85 and said[y == 0].mean() <= 0.1
