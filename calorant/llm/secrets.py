"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

The patterns find assignments, access key ids and long hexadecimal runs; their findings always stand.
Every other token that could be a key is a candidate, and the network, which sees it with the text
around it, or by overlapping windows if it is long, adds those whose calibrated score reaches a threshold set for recall.

The network learns from labelled findings in every text: the patterns' own findings and generated keys of
common forms set into the texts are positive; the remaining candidates and generated look-alikes (long
words, numbers, paths, repeated characters) are negative. Tasks train on shards of these and their weights
are averaged; the calibration and the threshold go by counts of all findings held out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorant.llm import convnet
from calorant.llm.common import give_back, giving_back, written
from calorant.llm.quality import logistic

#: The base patterns, in the order of their kinds, with the least length of the group named.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "network")
LEAST = {"assign": 12, "access": 18, "hex": 16}
SHORTEST = 12
#: Runs of key characters, and of marks that passwords hold; a shorter one than PLAIN is a candidate if it isn't letters alone.
PLAIN = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=!@#$%%^&*~-]{%d,}" % SHORTEST)
LETTERS = re.compile(r"[A-Za-z]+")
MASK = "<secret>"

#: Generated findings of each label: one a different text, and this many at least.
GENERATED = 2500
#: Findings that a task trains on, about; how often each is seen at least, and how many a task sees at least.
SHARD = 25_000
PASSES = 2
SEEN = 40_000
#: Margins of held-out findings are counted by steps of 1 / STEPS.
STEPS = 100
#: Least share of generated keys, held out, that are found, and of generated keys among what is found of these and of all look-alikes.
RECALL, PRECISION = 0.95, 0.95

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Findings of the patterns, leftmost and without overlap in a kind, by start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _could_be(text: str, a: int, b: int) -> bool:
    return b - a >= PLAIN or b - a >= SHORTEST and not LETTERS.fullmatch(text, a, b)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Tokens that could be keys, and of tokens that findings of the patterns touch, the parts beside these."""
    out, k, upto = [], 0, 0
    for m in CANDIDATE.finditer(text):
        at, end = m.start(), m.end()
        while text[end - 1] == "!" and end - at > 1:  # a sentence's mark
            end -= 1
        while k < len(base) and base[k][1] < end:
            if _could_be(text, max(at, upto), base[k][1]):
                out.append((max(at, upto), base[k][1]))
            upto = max(upto, base[k][2])
            k += 1
        if _could_be(text, max(at, upto), end):
            out.append((max(at, upto), end))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def generated(texts: list[str], n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """n keys and n look-alikes set into texts, encoded, with labels 1 and 0."""
    r = np.random.default_rng(seed)
    word = lambda chars, size: "".join(r.choice(list(chars), size))
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    texts = [t for t in texts if t.strip()] or ["the text"]

    def key() -> str:
        form, size = r.integers(8), int(r.integers(18, 44))
        if form == 0:
            return word(low + up + digit, size)
        if form == 1:
            return word(low + up + digit + "+/", size) + "=" * int(r.integers(3))
        if form == 2:
            return word("abcdefghijklmnop"[:2], 2) + "_" + word(low + up + digit, size)
        if form == 3:
            return word(up + digit, size)
        if form == 4:
            return word(low + digit, size)
        if form == 5:
            token = word(low + up + digit, int(r.integers(8, 14))) + word("!@#$%^&*~", int(r.integers(2, 5))) + word(digit, 2)
            return "".join(r.permutation(list(token)))
        if form == 6:
            return word(low + up + digit, int(r.integers(12, 18)))
        if r.random() < 0.5:
            return "-".join(word(digit + "abcdef", int(r.integers(4, 11))) for _ in range(int(r.integers(3, 6))))
        return "-".join(word(low + up + digit, 8) for _ in range(3))

    def like() -> str:
        form, size = r.integers(12), int(r.integers(16, 36))
        words = lambda: [w for w in re.findall(r"[A-Za-z]+", texts[r.integers(len(texts))]) if len(w) > 2] or ["word"]
        pick = lambda k: [(w := words())[r.integers(len(w))] for _ in range(k)]
        if form == 0:
            return word(digit, size)
        if form == 1:
            return ("".join(pick(6)) + "x" * 16)[:size] if r.random() < 0.1 else "".join(pick(6))
        if form == 2:
            return "_".join(pick(4))
        if form == 3:
            return "/".join(pick(4))
        if form == 4:
            return word(low + "-=_", 1) * size
        if form == 5:
            return "-".join([word(digit, 4), word(digit, 2), word(digit, 2), word(digit, 8)])
        if form == 6:
            return "".join(pick(4)).lower().capitalize()
        if form == 7:
            return "-".join(pick(4)).lower() + "-" + word(digit, 2)
        if form == 8:
            return "/".join(pick(3)).lower() + "/" + word(digit, 5) + "#top"
        if form == 9:
            return word("=-*#_~", 1) * (size // 2) + "".join(pick(1)) + word("=-*#_~", 1) * (size // 2)
        if form == 10:
            return "".join(pick(2)).lower() + word("!@#$%^&*~=-+", 1) * int(r.integers(2, 6))
        return "".join(w.upper() for w in pick(5))

    rows, labels = [], []
    for k in range(2 * n):
        text, token = texts[r.integers(len(texts))], like() if k % 2 else key()
        token = (token * 16)[: max(SHORTEST, len(token))]
        at = int(r.integers(len(text) + 1))
        at = (text.rfind(" ", 0, at) + 1) or 0
        lead = ["", "", "key ", "id: ", "Bearer "][r.integers(5)]
        before = text[max(0, at - 80) : at] + lead
        whole, places = before + token + " " + text[at : at + 80], convnet.windows(len(before), len(before) + len(token))
        rows += [convnet.encode(whole, a, b) for a, b in places]
        labels += [1 - k % 2] * len(places)
    return np.array(rows), np.array(labels, dtype=np.float32)


@dataclass(frozen=True)
class Model:
    network: convnet.Network
    #: Constant and slope of the calibration, and the least probability that counts.
    calibration: tuple[float, float]
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a + b * self.network.margin(x), -30, 30)))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The patterns' findings, and all findings."""
        base = base_spans(text)
        found = candidates(text, base)
        if not found:
            return base, base
        parts = [convnet.windows(a, b) for a, b in found]
        each = self.probability(np.array([convnet.encode(text, a, b) for own in parts for a, b in own]))
        p = np.maximum.reduceat(each, np.cumsum([0, *map(len, parts[:-1])]))
        more = [("network", a, b) for (a, b), q in zip(found, p) if q >= self.threshold]
        return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def _calibrated(network: convnet.Network, bins: np.ndarray, truth: np.ndarray, own: np.ndarray, times: np.ndarray) -> Model:
    """The model by counts (times) of held-out findings: the step of the margin, the label, whether generated."""
    a, b = map(float, logistic(((bins + 0.5) / STEPS)[:, None], truth, times))
    p = 1 / (1 + np.exp(-np.clip(a + b * bins / STEPS, -30, 30)))  # of the least margin of a step
    # what patterns find stands anyway, so the threshold is set by generated keys against everything else
    at = np.unique(np.concatenate((p, [1.0])))
    above = lambda which: np.array([times[which & (p >= t)].sum() for t in at])
    keys, others = (truth == 1) & own, truth == 0
    found, wrong = above(keys), above(others)
    precise = at[found >= PRECISION * np.maximum(1, found + wrong)]
    recalled = at[found >= RECALL * times[keys].sum()].max(initial=0.5)
    return Model(network, (a, b), float(max(min(precise.min(initial=1.0), 1.0), min(0.5, recalled))))


def _labelled(texts: DataFrame, each: int) -> DataFrame:
    """Different findings of all texts: label, x (encoded), made (generated: `each` of each label a text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text)
                for label, places in ((1, [(a, b) for _, a, b in base]), (0, candidates(text, base))):
                    rows += [(label, convnet.encode(text, c, d).tobytes(), False) for a, b in places for c, d in convnet.windows(a, b)]
                context = text[max(0, len(text) // 2 - 200) : len(text) // 2 + 200]
                x, y = generated([context], each, zlib.crc32(text.encode("utf-8", "surrogatepass")))
                rows += [(int(label), row.tobytes(), True) for row, label in zip(x, y)]
            yield pd.DataFrame(rows, columns=["label", "x", "made"])

    return texts.mapInPandas(giving_back(run), "label int, x binary, made boolean").distinct()


def _trained(rows: DataFrame, shards: int, passes: int, network: convnet.Network) -> convnet.Network:
    """The mean of what each shard's task makes of the network, by the shard's rows."""
    names, start = list(network.w), network.w

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["x", "label"])
        own = convnet.Network()
        own.w = dict(start)
        own.train(np.frombuffer(b"".join(shard["x"]), dtype=np.uint8).reshape(-1, convnet.WIDTH), shard["label"].to_numpy(np.float32), passes)
        return pd.DataFrame({"n": [len(shard)], "w": [np.concatenate([own.w[k].ravel() for k in names]).astype(float)]})

    each = rows.where(F.col("shard") < shards).groupBy("shard").applyInPandas(run, "n long, w array<double>")
    # decimals add up to the same in any order
    sums = each.select("n", F.posexplode("w")).groupBy("pos").agg((F.sum((F.col("col") * F.col("n")).cast("decimal(38,9)")).cast("double") / F.sum("n")).alias("w")).orderBy("pos")
    flat, out, at = np.array([r.w for r in sums.select("w").collect()], dtype=np.float32), convnet.Network(), 0
    for k in names:
        out.w[k] = flat[at : at + start[k].size].reshape(start[k].shape)
        at += start[k].size
    return out


def fit(docs: DataFrame) -> Model:
    """Train on labelled findings in all whole texts. A quarter of the different findings, by their hash, is held out.

    The threshold is the least that keeps PRECISION on held-out generated keys and all held-out
    look-alikes, and no less than what keeps RECALL of these keys, up to a half.
    """
    texts = docs.where("text is not null and text <> ''").select("text")
    n = texts.select(F.xxhash64("text")).distinct().count()
    if not n:
        texts, n = docs.sparkSession.createDataFrame([("the text",)], "text string"), 1
    rows = written(_labelled(texts, -(-GENERATED // n)).withColumn("hash", F.xxhash64("x", "label")))
    held = F.pmod("hash", F.lit(4)) == 0
    most = rows.where(~held).count()
    shards = max(1, round(most / SHARD))
    own = rows.where(~held).withColumn("shard", F.pmod(F.shiftright("hash", 2), F.lit(shards)))
    # shards begin with what the first one makes, as means of networks that have nothing in common are none
    network = _trained(own, 1, max(PASSES, -(-SEEN * shards // most)), convnet.Network())
    for _ in range(PASSES if shards > 1 else 0):
        network = _trained(own, shards, 1, network)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["x"]), dtype=np.uint8).reshape(-1, convnet.WIDTH)
            yield pd.DataFrame({"bin": np.floor(np.clip(network.margin(x).astype(float), -30, 30) * STEPS).astype(int), "label": batch["label"], "made": batch["made"]})

    counts = rows.where(held).select("x", "label", "made").mapInPandas(giving_back(margins), "bin long, label int, made boolean").groupBy("bin", "label", "made").count().orderBy("bin", "label", "made").collect()
    column = lambda name, kind: np.array([r[name] for r in counts], dtype=kind)
    return _calibrated(network, column("bin", float), column("label", float), column("made", bool), column("count", float))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and redacted (the text with MASK for spans).

    spans lists kind:start:end in characters, end exclusive, by start and then kind; base_sha256 is
    of the patterns' part of it. Overlapping spans are masked as one. A null or empty text has none
    and redacts to the empty text. A text of any length is scanned whole. Repeated rows stay; an empty table gives no rows; other columns
    are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text if isinstance(text, str) else ""
                base, every = model.spans(text)
                n = [sum(s[0] == kind for s in base) for kind in KINDS[:3]]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), redact(text, every)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(giving_back(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def redactor(model: Model):
    """A column function that masks the secrets of a text; null stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out = pd.Series([redact(t, model.spans(t)[1]) if isinstance(t, str) else None for t in texts], dtype=object)
        give_back()
        return out

    return of


def redact(text: str, spans: list[Span]) -> str:
    """The text with MASK in place of each run of overlapping spans."""
    out, at = [], 0
    end = None
    for _, a, b in spans:
        if end is None or a >= end:
            if end is not None:
                out.append(MASK)
                at = end
            out.append(text[at:a])
            end = b
        else:
            end = max(end, b)
    if end is not None:
        out.append(MASK)
        at = end
    return "".join(out) + text[at:]
