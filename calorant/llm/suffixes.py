"""Suffix-array deduplication of bytes: suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix. Groups are handled from the largest down: every suffix
of a group points to its previous smaller one, and the suffixes pointed to move to new groups right
behind their own, those pointed to more often further behind. When the last group is handled, groups
stand in the order of their Lyndon prefixes, and a pass from the smallest suffix up puts each suffix
at the front of its group along the chain of previous smaller ones. No names are given again and
nothing recurses. A group's members and the numbers of times are put in order by sorting, so the
whole is linear but for that.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from calorant.llm import dedup, recurrence
from calorant.llm.common import encoded, text_slices
from calorant.llm.recurrence import prefix_hash, span_hash, window_hashes

WINDOW = 400
GRAM = 32
#: Most texts whose regions of one anchor are judged in one task.
CROWD = 4096
#: Repeated passages from this length on are found too, though only those of WINDOW bytes go: about 40 words.
PASSAGE = 256
#: Mask of a hash's low bits.
LOW = (1 << 20) - 1


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Suffixes of a sequence of non-negative integers in ascending order; a shorter prefix comes first."""
    text = np.append(np.asarray(symbols, dtype=np.int64) + 1, 0)
    n = len(text)
    order = np.argsort(text, kind="stable")
    heads = np.flatnonzero(np.diff(text[order], prepend=-1))
    sizes = np.diff(np.append(heads, n))
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(heads, sizes)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    last = np.zeros(n, dtype=np.int64)
    last[heads] = heads + sizes - 1
    order, group, place, last = order.tolist(), group.tolist(), place.tolist(), last.tolist()
    smaller = [-1] * n
    end = n - 1
    while end >= 0:
        head = group[order[end]]
        if head == end:
            i = order[end]
            p = i - 1
            while p >= 0 and group[p] >= head:
                p = smaller[p]
            smaller[i] = p
            end -= 1
            if p >= 0 and last[own := group[p]] > own:
                to, at = last[own], place[p]
                other = order[to]
                order[to], order[at], place[p], place[other] = p, other, to, at
                group[p] = last[to] = to
                last[own] = to - 1
            continue
        members = order[head : end + 1]
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= head:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        times: dict[int, list[int]] = {}
        for p, k in pointed.items():
            times.setdefault(k, []).append(p)
        for k in sorted(times, reverse=True):
            moved: dict[int, int] = {}
            for p in times[k]:
                own = group[p]
                m = moved.get(own, 0)
                to, at = last[own] - m, place[p]
                other = order[to]
                order[to], order[at] = p, other
                place[p], place[other] = to, at
                moved[own] = m + 1
            for own, m in moved.items():
                stop = last[own]
                start = stop - m + 1
                if start > own:
                    for p in order[start : stop + 1]:
                        group[p] = start
                    last[own], last[start] = start - 1, stop
        end = head - 1
    front, placed, out = list(range(n)), bytearray(n), [0] * n
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            placed[p] = 1
            p = smaller[p]
    return out[1:]


def common_length(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the bytes at a and at b, `most` at most, by binary search on hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        same = span_hash(prefix, x, x + mid) == span_hash(prefix, y, y + mid)
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1


class Ends(dict):
    """Whether a phrase ends with a word: a third of all words do, by their bytes alone."""

    def __missing__(self, word: bytes) -> bool:
        self[word] = out = zlib.crc32(word) % 3 == 0
        return out


def symbols_of(group: list[dedup.Region], ends: Ends, longest: int) -> list[list[bytes]]:
    """Each region as phrases of words, each with the blank after it; as words where a phrase is longer than `longest`, as bytes where a word is.

    No phrase, except a region's last, is the beginning of another, so their order is that of their
    bytes. A region's first word may be part of one and ends no phrase.
    """
    split = [body.split(b" ") for body, *_ in group]
    out = []
    for words in split:
        cut = [k + 1 for k, w in enumerate(words) if ends[w] and k]
        own = [b" ".join(words[i:j]) + b" " for i, j in zip([0, *cut], [*cut, len(words)]) if i < j]
        own[-1] = own[-1][:-1]
        out.append(own)
    if max(max(map(len, own)) for own in out) <= longest:
        return out
    if max(max(map(len, words)) for words in split) < longest:
        return [[*(w + b" " for w in words[:-1]), words[-1]] for words in split]
    return [[body[i : i + 1] for i in range(len(body))] for body, *_ in group]


def among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which hashes are among others. Most are told apart by their low bits, the rest by a search."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    low = np.uint64(LOW)
    marked = np.zeros(LOW + 1, dtype=bool)
    marked[of & low] = True
    out, of = marked[values & low], np.sort(of)
    left = values[out]
    out[out] = of[np.minimum(np.searchsorted(of, left), len(of) - 1)] == left
    return out


def confirmed(joined: bytes, a: np.ndarray, b: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    """The lengths, with those of `least` bytes or more confirmed byte by byte."""
    at = np.flatnonzero(length >= least)
    for k, x, y, n in zip(at.tolist(), a[at].tolist(), b[at].tolist(), length[at].tolist()):
        if joined[x : x + n] != joined[y : y + n]:
            length[k] = next(i for i in range(n) if joined[x + i] != joined[y + i])
    return length


def recurring_windows(groups: list[list[dedup.Region]], windows: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each size of window, and each region of the groups in turn, which of its windows also start elsewhere in its group or in copies.

    The suffix array is of the regions' phrases, ranked as bytes and with a separator below all of them
    between regions. Among suffixes that start at a phrase, the longest common prefix in bytes is with a
    neighbour, so the array decides every window that starts at a phrase, and those inside the phrase
    that the same match covers. Equal windows have their phrases' ends in common, but for the first word,
    so of two that start inside a phrase one at least is followed by a suffix that matches far enough;
    these are decided by an exact check. Matches are found by hashes and confirmed by their bytes.
    """
    group = [region for g in groups for region in g]
    bodies = [body for body, *_ in group]
    ends = Ends()
    words = [own for g in groups for own in symbols_of(g, ends, min(windows) // 2)]
    rank = {w: k + 1 for k, w in enumerate(sorted({w for own in words for w in own}))}
    symbols = np.array([x for own in words for x in (*map(rank.__getitem__, own), 0)], dtype=np.int64)
    size = np.array([x for own in words for x in (*map(len, own), 1)], dtype=np.int64)
    place = np.cumsum(size) - size
    joined = b"\0".join(bodies) + b"\0"
    starts = np.cumsum([0, *(len(body) + 1 for body in bodies)])
    stop = np.repeat(starts[1:] - 1, [len(own) + 1 for own in words])
    order = np.array(suffix_array(symbols))
    order = order[symbols[order] > 0]
    prefix = prefix_hash(np.frombuffer(joined, dtype=np.uint8))
    a, b = order[:-1], order[1:]
    most = np.minimum(np.minimum(stop[a] - place[a], stop[b] - place[b]), max(windows) + np.maximum(size[a], size[b]))
    length = confirmed(joined, place[a], place[b], common_length(prefix, place[a], place[b], most), min(windows) - int(size.max()))
    match = np.zeros(len(symbols), dtype=np.int64)
    np.maximum.at(match, a, length)
    np.maximum.at(match, b, length)
    n = len(joined)

    def between(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        step = np.zeros(n + 1, dtype=np.int64)
        np.add.at(step, begin, 1)
        np.add.at(step, end, -1)
        return np.cumsum(step[:-1]) > 0

    out = []
    for window in windows:
        own = [max(0, min(k, len(body) - window + 1)) for body, k, *_ in group]
        mine, copied = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        for (*_, copies), k, at in zip(group, own, starts):
            mine[at : at + k], copied[at : at + k] = True, copies > 1
        far = np.flatnonzero(match >= window)
        again = between(place[far], place[far] + np.minimum(match[far] - window + 1, size[far])) & mine | copied
        # inside the phrase before: as many bytes before the suffix as its match lacks, at least
        near = np.flatnonzero((match[1:] >= window - size[:-1]) & (symbols[:-1] > 0) & (symbols[1:] > 0)) + 1
        inside = between(place[near - 1], place[near] - np.maximum(window - match[near], 1) + 1) & mine
        every, open_, near = np.flatnonzero(mine), mine & ~again, np.flatnonzero(inside)
        hashes, beside = window_hashes(prefix, window), np.flatnonzero(open_ & ~inside)
        wanted = np.concatenate((hashes[np.flatnonzero(open_ & inside)], (x := hashes[beside])[among(x, hashes[near])]))
        seen: dict[bytes, int] = {}
        for at in every[among(hashes[every], wanted)].tolist():
            body = joined[at : at + window]
            if (other := seen.setdefault(body, at)) != at:
                again[at] = again[other] = True
        out.append([again[at : at + k] for k, at in zip(own, starts)])
    return out


def kernel(windows: tuple[int, ...]) -> dedup.Kernel:
    """Suffix-array verdicts, with the number of the window size as level."""

    def judge(groups: list[list[dedup.Region]]) -> list[list[list[dedup.Verdict]]]:
        out: list[list[list[dedup.Verdict]]] = [[[] for _ in g] for g in groups]
        if groups:
            flat = [(k, r) for k, g in enumerate(groups) for r in range(len(g))]
            for level, each in enumerate(recurring_windows(groups, windows)):
                for (k, r), again in zip(flat, each):
                    if not again.any():
                        continue
                    if again.all():
                        out[k][r].append((0, len(again), groups[k][r][2], level))
                        continue
                    cut, values = recurrence.runs(again)
                    out[k][r] += [(int(a), int(b - a), groups[k][r][2], level) for a, b, v in zip(cut[:-1], cut[1:], values) if v]
        return out

    return judge


def without_repeats(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes and the kept bytes of every row.

    Removes each UTF-8 byte covered by a `window`-byte string that also starts at another place, of
    the same row or another; a repeated row repeats its text. n_passage_bytes counts the bytes that
    strings of `passage` bytes (no more than `window`) cover in the same way; these stay. A null or
    empty text, and one shorter than the window, keeps all. A text of any length is judged whole, in
    overlapping pieces. An empty table gives no rows; other columns are ignored. The kept bytes are
    binary, as a cut may fall inside a character. Anchors in more than `crowd` different texts are
    decided by counting window hashes.
    """
    sizes = (window, passage)

    def windows_of(body: bytes, n: int) -> list[tuple[int, int, bytes]]:
        return [(level, i, body[i : i + size]) for level, size in enumerate(sizes) for i in range(max(0, min(n, len(body) - size + 1)))]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = encoded(batch["text"]), batch["doc_id"].astype("Int64")
            copies, found, passages = batch["copies"].tolist(), batch["found0"].tolist(), batch["found1"].tolist()
            for i, j in text_slices(texts):
                out = []
                for d in range(i, j):
                    text = texts[d]
                    # of a text with copies every window recurs
                    begin, end = dedup.intervals(found[d], window) if copies[d] == 1 else (np.array([0]), np.array([len(text)])) if len(text) >= window else dedup.intervals(None, window)
                    low, high = dedup.intervals(passages[d], passage)
                    kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
                    held = len(text) * (len(text) >= passage) if copies[d] > 1 else int((high - low).sum())
                    out.append((len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), held, kept))
                frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "kept"])
                frame.insert(0, "doc_id", ids.iloc[i:j].to_numpy())
                yield frame

    found = dedup.removals(docs, recurrence.Bytes, passage, gram, kernel(sizes), windows_of, crowd, across=False, reach=window, levels=2)
    return found.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, kept binary")
