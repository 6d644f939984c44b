"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorant.llm import decontamination, languages, ogg, packing, phrases, quality, secrets, simhash, suffixes, toxicity, turns, urls, variants
from calorant.llm.common import fold, table, written


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = languages.fit(docs.where(~held_out))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"), s.lang)), ",")
    return languages.label(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", spans.alias("spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs)).drop("redacted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(table(spark, sf_dir, "documents"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(turns.ordered(table(spark, sf_dir, "conversations")))
    return turns.trie(turns.regrown(own, fold("conv_id", 4)))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = variants.runs(table(spark, sf_dir, "documents"))
    h, size = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary")), F.length("word")
    at = (h % size).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, size))
    return variants.group(run.select(F.when(h % 31 == 0, cut).otherwise(F.col("word")).alias("word")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_languages, op3_packing, op4_secrets, op5_decontamination, op6_toxicity, op7_simhash, op8_phrases, op9_ogg, op10_suffixes, op11_url_filters, op12_turns, op13_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontamination.oracle(), "op11_url_filters": urls.oracle(), "op12_turns": turns.oracle(), "op13_variants": variants.oracle()}
