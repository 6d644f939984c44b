"""Substring deduplication of words by repeated-phrase automata.

The regions that may hold recurring passages are brought together in shards of whole anchors. There
recurring passages are confirmed word for word and compiled to an Aho-Corasick automaton, and every
region of the shard, in which every occurrence must lie, is streamed through it to locate them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from calorant.llm import dedup, recurrence
from calorant.llm.common import encoded, text_slices

WINDOW = 13
GRAM = 3
#: Most texts whose regions of one anchor are judged in one task.
CROWD = 4096
#: Word numbers become characters from here on, past the surrogates; so many words have one.
FIRST = 0xE000
WORDS = 0x110000 - FIRST
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(groups: list[list[dedup.Region]]) -> list[list]:
    """The regions' words as numbers: equal numbers are equal words. A region is a text of one character a word; a tuple where there are more words than characters."""
    numbers: dict[bytes, int] = {}
    if sum(len(body) + 1 for g in groups for body, *_ in g) <= 2 * WORDS:  # a word takes two bytes with its gap
        chars: dict[bytes, str] = {}
        return [["".join([chars.get(w) or chars.setdefault(w, chr(FIRST + len(chars))) for w in body.split(b" ")]) for body, *_ in g] for g in groups]
    every = [[tuple([numbers.setdefault(w, len(numbers)) for w in body.split(b" ")]) for body, *_ in g] for g in groups]
    if len(numbers) <= WORDS:
        return [["".join([chr(FIRST + n) for n in own]) for own in g] for g in every]
    return every


def kernel(window: int) -> dedup.Kernel:
    """Verdicts of one automaton per shard: for each window the smallest id of a region that holds it.

    The phrases are the windows that several regions, or copies of one, hold. The automaton has a node a
    word: its letters are words' numbers, as characters while those do.
    """

    def judge(groups: list[list[dedup.Region]]) -> list[list[list[dedup.Verdict]]]:
        import ahocorasick

        lows: dict = {}
        recurring = set()
        texts = numbered(groups)
        for group, own in zip(groups, texts):
            for (_, n, low, copies), text in zip(group, own):
                for i in range(n):
                    phrase = text[i : i + window]
                    before = lows.get(phrase)
                    if before is None:
                        lows[phrase] = low
                    else:
                        recurring.add(phrase)
                        if low < before:
                            lows[phrase] = low
                    if copies > 1:
                        recurring.add(phrase)
        if not recurring:
            return [[[] for _ in own] for own in texts]
        letters = isinstance(next(iter(recurring)), str)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING if letters else ahocorasick.KEY_SEQUENCE)
        for phrase in recurring:
            automaton.add_word(phrase, lows[phrase])
        automaton.make_automaton()
        out = []
        for own in texts:
            said = []
            for text in own:
                runs: list[list[int]] = []
                for end, low in automaton.iter(text):
                    at = end - window + 1
                    if runs and runs[-1][0] + runs[-1][1] == at and runs[-1][2] == low:
                        runs[-1][1] += 1
                    else:
                        runs.append([at, 1, low])
                said.append([(at, n, low, 0) for at, n, low in runs])
            out.append(said)
        return out

    return judge


def kept_words(text: bytes, found, window: int) -> tuple[int, int, str, str]:
    """Words of a text, how many go, and the digest and text of those that stay. Long texts are taken in blocks of whole words."""
    begin, end = dedup.intervals(found, window)
    blocks = [text] if len(text) <= dedup.SLICE else [piece for *_, piece in recurrence.Words.cut(text, dedup.SLICE, 1)]
    out, total = [], 0
    for block in blocks:
        words = block.split()
        if len(begin):
            a, b = np.clip(begin - total, 0, len(words)), np.clip(end - total, 0, len(words))
            kept = [w for i, j in zip([0, *b.tolist()], [*a.tolist(), len(words)]) for w in words[i:j]]
        else:
            kept = words
        total += len(words)
        if kept:
            out.append(b" ".join(kept))
    content = b" ".join(out)
    return total, int((end - begin).sum()), hashlib.sha256(content).hexdigest(), content.decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words of every row.

    Words are runs of characters other than space and tab to carriage return. Removes each word
    covered by a window of `window` consecutive words that also starts in a row of a smaller doc_id,
    so the row of the smallest id keeps a passage. Rows of the same id don't remove each other's
    words; a null id counts as the largest. A null or empty text has no words and keeps none. A text
    of any length is judged whole, in overlapping pieces. An empty table gives no rows; other columns
    are ignored. Anchors in more than `crowd` different texts are decided by counting window hashes.
    """

    def windows_of(body: bytes, n: int) -> list[tuple[int, int, bytes]]:
        words = body.split(b" ")
        return [(0, i, b" ".join(words[i : i + window])) for i in range(n)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = encoded(batch["text"]), batch["doc_id"].astype("Int64")
            below, found = (batch["low"] < batch["id"]).tolist(), batch["found0"].tolist()
            for i, j in text_slices(texts):
                out = []
                for d in range(i, j):
                    row = kept_words(texts[d], None if below[d] else found[d], window)
                    # a copy of a text with a smaller id goes whole, if it has a window at all
                    out.append((row[0], row[0], NOTHING, "") if below[d] and row[0] >= window else row)
                frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])
                frame.insert(0, "doc_id", ids.iloc[i:j].to_numpy())
                yield frame

    found = dedup.removals(docs, recurrence.Words, window, gram, kernel(window), windows_of, crowd, across=True)
    return found.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
