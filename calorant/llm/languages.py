"""Language spans of mixed text: script ranges, then Viterbi over words with a penalty for switching.

A word's script narrows its candidates to the languages that training texts write in it. Each
candidate scores the word by the log probabilities of its letters in context (hashed trigrams within
the word). The best path over a text's words, where a change of language costs a fixed penalty,
labels spans; the language with the most letters is the text's.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorant.llm.common import checkpoint, give_back, giving_back

#: The starts of script ranges by code point, in order, and the script from there on.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0x20000, "han"),
]
NAMES = sorted({s for _, s in SCRIPTS})
UNDETERMINED = "und"
BUCKETS = 1 << 16
SMOOTHING = 0.1
SWITCH = 8.0
#: Bound of the training sample, in texts, and about how many of a language; least share of a language's letters for a script to be its own.
SAMPLE = 6000
EACH = 1500
LEAST_SHARE = 0.01
SLICE = 3_000_000


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its lower case, its script's number."""
    is_letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in np.flatnonzero(is_letter).tolist():
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    starts = [a for a, _ in SCRIPTS]
    scripts = np.repeat([NAMES.index(s) for _, s in SCRIPTS], np.diff([*starts, sys.maxunicode + 1]))
    return is_letter, lower, scripts.astype(np.int8)


class Words:
    """Words (runs of letters) of a batch of texts: their places, scripts, letters and trigrams."""

    def __init__(self, texts: list[str]):
        is_letter, lower, scripts = letters()
        points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = is_letter[points]
        low = np.where(inside, lower[points], 0).astype(np.uint32)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.start, self.stop = edge[::2], edge[1::2]
        before = np.concatenate(([np.uint32(0)], low[:-1]))
        after = np.concatenate((low[1:], [np.uint32(0)]))
        hashed = before * np.uint32(0x9E3779B1) ^ low * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)
        hashed ^= hashed >> np.uint32(15)
        self.gram = ((hashed * np.uint32(0x27D4EB2F)) >> np.uint32(16))[inside]
        self.size = self.stop - self.start
        self.head = np.cumsum(self.size) - self.size
        self.script = scripts[points[self.start]] if len(self.start) else np.zeros(0, np.int8)
        self.begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, self.begin)


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    #: Log probability of each trigram bucket, by language; whether a script is a language's own.
    table: np.ndarray
    scripts: np.ndarray
    prior: np.ndarray

    def foreign(self, w: Words) -> np.ndarray:
        """Which words are of a script that no language is written in."""
        return ~self.scripts[:, w.script].any(axis=0)

    def scores(self, w: Words) -> np.ndarray:
        """Words by languages; candidates that the script rules out score far less. Zero for all where it rules out every one."""
        out = np.zeros((len(w.start), len(self.names)), dtype=np.float32)
        if len(out):
            for k, column in enumerate(self.table):
                out[:, k] = np.add.reduceat(column[w.gram], w.head)
            ruled = ~self.scripts[:, w.script].T
            out[ruled] = -1e4
            out[self.foreign(w)] = 0
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. Texts run side by side, longest first, a word of each at a step."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], first[:-1][order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), side="left")
    back = np.zeros(scores.shape, dtype=np.uint8)
    best = np.zeros((len(n), scores.shape[1]), dtype=np.float32)
    own = np.arange(scores.shape[1], dtype=np.uint8)
    for t in range(steps):
        m, at = active[t], begin[: active[t]] + t
        now = best[:m]
        if t:
            top = now.argmax(axis=1)
            moved = now[np.arange(m), top] - penalty
            stay = now >= moved[:, None]
            back[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, moved[:, None])
            now -= now.max(axis=1, keepdims=True)
        best[:m] = now + scores[at]
    label = np.zeros(len(scores), dtype=np.int64)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m, at = active[t], begin[: active[t]] + t
        label[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return label


def fit(docs: DataFrame) -> Model:
    """Trigram counts of texts with a lang: about EACH of each, SAMPLE in all at most, by the id's hash.

    Counts are summed per task of a fixed number, so what the driver gets doesn't grow.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang").distinct()
    # of each language as many, about, by the hash of the id; the bound holds whatever the languages
    share = known.groupBy("lang").agg((F.lit(EACH) / F.count("*")).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = checkpoint(known.join(share, "lang").where(drawn).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(SAMPLE))
    texts = docs.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(sample), ["doc_id", "lang"])
    # of an id with several texts one, so rows are as many as the sample's
    texts = texts.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text").repartition(8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                w = Words([t for t in own["text"] if isinstance(t, str)])
                grams[lang] = grams.get(lang, 0) + np.bincount(w.gram, minlength=BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(w.script, w.size, len(NAMES))
        if grams:
            yield pd.DataFrame({"lang": list(grams), "grams": [x.astype("<i8").tobytes() for x in grams.values()], "scripts": [x.astype("<i8").tobytes() for x in scripts.values()]}, dtype=object)

    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for r in texts.mapInPandas(giving_back(run), "lang string, grams binary, scripts binary").collect():
        grams[r.lang] = grams.get(r.lang, 0) + np.frombuffer(r.grams, dtype="<i8")
        scripts[r.lang] = scripts.get(r.lang, 0) + np.frombuffer(r.scripts, dtype="<i8")
    names = sorted(grams)
    total = np.array([grams[n].sum() for n in names], dtype=float).reshape(-1, 1)
    counts = np.array([grams[n] for n in names]).reshape(len(names), BUCKETS)
    table = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32)
    share = np.array([scripts[n] / max(1, scripts[n].sum()) for n in names]).reshape(len(names), len(NAMES))
    return Model(tuple(names), table, share >= LEAST_SHARE, total.ravel() / max(1.0, total.sum()))


def predictor(model: Model):
    """A column function from text to a struct of lang_pred and score; run once where a filter uses it too."""

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def of(column: pd.Series) -> pd.DataFrame:
        texts, out = [t if isinstance(t, str) else "" for t in column], []
        for i, j in slices(texts):
            out.append(predict(texts[i:j], model, False))
        give_back()
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": []})

    return of.asNondeterministic()


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of about SLICE characters, one text at least."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def predict(texts: list[str], model: Model, spans: bool) -> pd.DataFrame:
    """lang_pred, score and, if asked for, spans of texts."""
    names = np.array([*model.names, UNDETERMINED], dtype=object)
    k = len(model.names)
    w = Words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    best = viterbi(model.scores(w), w.first, SWITCH) if k else np.zeros(len(text), dtype=np.int64)
    if k:
        best[model.foreign(w)] = k  # no language is a candidate, so it is none's
    size = np.bincount(text * (k + 1) + best, w.size, len(texts) * (k + 1)).reshape(len(texts), k + 1)
    known, every = size[:, :k].sum(axis=1), size.sum(axis=1)
    top = np.where(known > 0, size[:, :k].argmax(axis=1), np.where(every > 0, model.prior.argmax(), k)) if k else np.zeros(len(texts), dtype=np.int64)
    share = np.where(top < k, size[np.arange(len(texts)), top] / np.maximum(1, every), 0.0)
    out = pd.DataFrame({"lang_pred": names[top], "score": share})
    if spans:
        cut = np.flatnonzero((np.diff(best, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0)) if k else np.zeros(0, dtype=np.int64)
        last = np.append(cut[1:], len(best)) - 1
        rows: list[list[dict]] = [[] for _ in texts]
        for a, b, d in zip(cut, last, text[cut]):
            rows[d].append({"start": int(w.start[a] - w.begin[d]), "end": int(w.stop[b] - w.begin[d]), "lang": names[best[a]]})
        out["spans"] = rows
    return out


def label(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and (unless left out) spans of every row, from its whole text alone.

    spans: start and end in characters and lang, from the first word of a run to the end of its last.
    lang_pred is the language with the most letters, score its share of them. Words of a script that no
    learned language is written in are no language's: their spans are `und`, and they lower the score. A
    text of such words alone has the commonest language, with score 0. A text that is null, empty or
    without a letter has `und`, score 0 and no spans, and so has every text if nothing was learned. A text of any length is labelled whole, with memory in proportion to it. Repeated rows stay;
    an empty table gives no rows; other columns are ignored.
    """
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = [t if isinstance(t, str) else "" for t in batch["text"]], batch["doc_id"].astype("Int64")
            for i, j in slices(texts):
                out = predict(texts[i:j], model, spans)
                out.insert(0, "doc_id", ids.iloc[i:j].to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(giving_back(run), schema)
