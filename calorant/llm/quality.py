"""Quality scores by compression with dictionaries of good and of bad text.

Texts are compressed in short blocks under a zstandard dictionary built from good labelled text and
under one from bad. The difference of the two sizes over their sum, with their mean size over the
text's, is turned into a probability by logistic calibration on labelled texts that gave no
dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorant.llm.common import checkpoint, encoded

BLOCK = 256
LEVEL = 3
DICTIONARY = 112_640
#: Bounds of the labelled sample: texts, and blocks of each class for its dictionary.
SAMPLE = 8000
BLOCKS = 6000
CUTOFF = 0.7


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


@lru_cache(8)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    frame = {"level": LEVEL, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
    if not content:
        return zstandard.ZstdCompressor(**frame)
    held = zstandard.ZstdCompressionDict(content)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, **frame)


def sizes(bad: bytes, good: bytes):
    """A column function from text to (difference, size); both 0 for an empty text."""

    @F.pandas_udf("struct<difference:double,size:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        under_bad, under_good = compressor(bad).compress, compressor(good).compress
        out = []
        for text in encoded(texts):
            parts = blocks(text)
            a, b = sum(len(under_bad(p)) for p in parts), sum(len(under_good(p)) for p in parts)
            out.append(((a - b) / (a + b), (a + b) / 2 / len(text)) if text else (0.0, 0.0))
        return pd.DataFrame(out, columns=["difference", "size"])

    return of


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights of a lightly penalised logistic regression by Newton's method; the first is the constant. times: how often each row counts."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (times * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (times * (y - p)) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    #: Constant, weight of the difference, weight of the size.
    weights: tuple[float, float, float]
    #: Share of label 1, which an empty text gets.
    prior: float

    def score(self, text: Column) -> Column:
        s = sizes(self.bad, self.good)(text)
        c, d, z = self.weights
        z_score = F.lit(c) + F.lit(d) * s["difference"] + F.lit(z) * s["size"]
        return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(self.prior)).otherwise(1 / (1 + F.exp(-z_score)))


def labelled_sample(labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """Up to `most` rows (doc_id, label) in the order of the id's hash. Ids with contrary labels are left out."""
    own = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("high"))
    return checkpoint(own.where("label = high and doc_id is not null").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, label and text of the sample's ids, checkpointed: of an id with several texts the one of the smallest hash, so rows are as many as ids."""
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null")
    return checkpoint(texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows of labels (doc_id, quality). Every other row of the sample gives blocks, the rest calibrate.

    Bounded by SAMPLE texts and BLOCKS blocks a class, taken in the order of hashes over whole texts.
    Without labels of both classes the score is their share of ones, or a half if there are none.
    """
    sample = labelled_sample(labels, "quality")
    texts = sampled_texts(docs, sample)
    for_blocks = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)) == 0

    @F.pandas_udf("array<binary>")
    def cut(column: pd.Series) -> pd.Series:
        return pd.Series([blocks(t) for t in encoded(column)])

    cuts = texts.where(for_blocks).select("label", F.explode(cut("text")).alias("block"))
    content = []
    for c in (0, 1):
        taken = cuts.where(F.col("label") == c).orderBy(F.xxhash64("block"), "block").limit(BLOCKS)
        content.append(dictionary([bytes(r.block) for r in taken.select("block").collect()]))
    rows = texts.where(~for_blocks).select("label", sizes(*content)("text").alias("s")).select("label", "s.*").orderBy("label", "difference", "size").toPandas()
    y = rows["label"].to_numpy(dtype=float)
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = ones / n if n else 0.5
    if len(set(y)) < 2:
        return Model(*content, (float(np.log((ones + 0.5) / (n - ones + 0.5))), 0.0, 0.0), prior)
    return Model(*content, tuple(map(float, logistic(rows[["difference", "size"]].to_numpy(), y))), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from CUTOFF on) of every row, from its whole text alone.

    A null or empty text gets the share of label 1. A text of any length is scored whole, block by
    block. Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    return docs.select("doc_id", model.score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
