"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a fixed and a learned lexicon, hits near words of second-person address,
capitals, punctuation, and signs of obfuscation. The learned lexicon holds words and word beginnings
much more frequent in toxic labelled texts than in others, counted by Spark over the sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorant.llm.quality import CUTOFF, labelled_sample, sampled_texts
from calorant.llm.trees import Boosted, boost, isotonic

#: Insults, and words of second-person address, in English, French, German and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons scum loser losers trash clown worthless pathetic stupid disgusting dumb fool jerk freak vermin filth garbage "
    "imbécile crétin connard ordure débile dummkopf trottel abschaum versager dreck widerlich imbécil estúpido basura inútil patético".split()
)
ADDRESS = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie ihnen tú ti contigo usted ustedes vosotros".split())

SAMPLE = 10_000
BEGINNINGS = (4, 5, 6)
LEXICON = 300
NEAR = 6
WORD = re.compile(r"\w+")
MASKED = re.compile(r"[A-Za-z][@$*#0-9!]+[A-Za-z]|([A-Za-z])\1{3,}")
_UPPER = {c: None for c in range(65, 91)}
FEATURES = ["fixed", "learned", "hits", "distinct", "near", "nearest", "capitals", "shouted", "exclaimed", "asked", "symbols", "masked", "words", "length"]


@dataclass(frozen=True)
class Lexicon:
    words: frozenset
    beginnings: frozenset

    def holds(self, w: str) -> bool:
        return w in self.words or w[:4] in self.beginnings or w[:5] in self.beginnings or w[:6] in self.beginnings


def describe(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """The features of one text; zeros for an empty one."""
    low = text.lower()
    words = WORD.findall(low)
    n, size = len(words) or 1, len(text) or 1
    fixed = sum(w in INSULTS for w in words)
    known, begins = lexicon.words, lexicon.beginnings
    hits = [i for i, w in enumerate(words) if w in known or w[:4] in begins or w[:5] in begins or w[:6] in begins or w in INSULTS]
    address = [i for i, w in enumerate(words) if w in ADDRESS] if hits else []
    near, nearest = 0, 50
    if address:
        at, where = np.array(address), np.array(hits)
        k = np.searchsorted(at, where)
        gap = np.minimum(np.abs(where - at[np.minimum(k, len(at) - 1)]), np.abs(where - at[np.maximum(k - 1, 0)]))
        near, nearest = int((gap <= NEAR).sum()), min(50, int(gap.min()))
    capitals = size - len(text.translate(_UPPER)) if text else 0
    shouted = text.count("!!")
    marks = sum(map(text.count, "$%&*#@"))
    masked = sum(1 for _ in MASKED.finditer(text))
    return (
        fixed / n, len(hits) / n, np.log1p(len(hits)), float(len({words[i] for i in hits})), near / n, float(nearest), capitals / size,
        shouted / n, text.count("!") / size, text.count("?") / size, marks / size, masked / n, np.log1p(len(words)), len(low) / n,
    )


def features(texts: pd.Series, lexicon: Lexicon) -> np.ndarray:
    return np.array([describe(t if isinstance(t, str) else "", lexicon) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


def learn_lexicon(texts: DataFrame, most: int = LEXICON) -> Lexicon:
    """Words (marked by a final space) and beginnings at least eight times as frequent in toxic texts.

    texts: doc_id, text, label. Each term counts once a text. At most `most` terms, the surest first.
    """
    words = texts.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"), "doc_id")
    terms = words.select("doc_id", "label", F.explode(F.array(F.concat("word", F.lit(" ")), *(F.substring("word", 1, k) for k in BEGINNINGS))).alias("term"))
    counts = terms.where(F.length("term") >= 4).distinct().groupBy("term").agg(F.sum("label").alias("toxic"), F.count("*").alias("total"))
    n, ones = texts.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    ratio = ((F.col("toxic") + 0.5) / (ones + 1)) / ((F.col("total") - F.col("toxic") + 0.5) / (n - ones + 1))
    kept = counts.where(F.col("toxic") >= 4).where(ratio >= 8).orderBy(F.desc(F.col("toxic") * F.log(ratio)), "term").limit(most)
    got = [r.term for r in kept.collect()]
    return Lexicon(frozenset(t[:-1] for t in got if t.endswith(" ")), frozenset(t for t in got if not t.endswith(" ")))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, texts: pd.Series) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return np.clip(np.interp(self.trees.margin(features(texts, self.lexicon)), *self.knots), 0, 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows of labels (doc_id, toxic), SAMPLE at most, in the order of the id's hash.

    Three of four give the lexicon and trees, the rest the calibration. Without both classes the
    score is the labels' share of ones, or 0 if there are none.
    """
    sample = labelled_sample(labels, "toxic", SAMPLE)
    texts = sampled_texts(docs, sample)
    trains = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) != 0
    lexicon = learn_lexicon(texts.where(trains))

    @F.pandas_udf("array<double>")
    def dense(column: pd.Series) -> pd.Series:
        return pd.Series(list(features(column, lexicon)))

    rows = texts.select("doc_id", "label", trains.alias("trains"), dense("text").alias("x")).orderBy("doc_id", "label", "x").toPandas()
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    x, y, t = np.array(rows["x"].tolist(), dtype=float), rows["label"].to_numpy(dtype=float), rows["trains"].to_numpy(dtype=bool)
    if len(set(y[t])) < 2 or len(set(y[~t])) < 2:
        return Model(lexicon, None, (np.zeros(1), np.zeros(1)), ones / n if n else 0.0)
    trees = boost(x[t], y[t])
    return Model(lexicon, trees, isotonic(trees.margin(x[~t]), y[~t]), ones / n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from CUTOFF on) of every row, from its whole text alone.

    A null text counts as empty and is scored by its zero features. A text of any length is one row's
    list of words. Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(column))

    return docs.select("doc_id", scored("text").alias("score")).withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
