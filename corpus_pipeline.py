"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Every stage works on all rows that its predecessor kept. All but the last return the columns of
`documents`; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorant.llm import decontamination, languages, packing, secrets, simhash
from calorant.llm.common import shared_folder, table

#: Least share of a text's letters in its main language; a text without letters is rejected too.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a main language, and gives it to rows without one. Null and empty texts go; repeated rows and other columns stay as they are."""
    said = "_".join(docs.columns)  # longer than any column's name
    kept = docs.withColumn(said, languages.predictor(languages.fit(docs))(F.col("text"))).where((F.col(f"{said}.lang_pred") != languages.UNDETERMINED) & (F.col(f"{said}.score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", f"{said}.lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each SimHash group the row of the smallest id, once; a row without an id where its whole group has none."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item by their own text, whatever their id. Null and empty texts stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the text; every row stays, and n_chars follows."""
    masked = docs.withColumn("text", secrets.redactor(secrets.fit(docs))(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a null or empty text is its end id alone, and every row is a document of its own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", mask_secrets), ("packing", pack)]

#: Models and packing aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _reread(df: DataFrame) -> DataFrame:
    """df written as Parquet in the session's shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/pipeline-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, _reread(docs) if k else docs, sf_dir)
    return docs
