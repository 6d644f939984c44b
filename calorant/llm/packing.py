"""Packing of tokenised documents into fixed windows by minimum bin slack.

Documents are cut at window size; whole windows stand alone, and what remains of each document is
packed with other remainders. For each window the largest remainder left is taken and a bounded
subset-sum over the multiset of remaining lengths (a bitset, with the counts used recovered by
walking the bitsets backwards) finds the fill closest to capacity.

Packing is local to an input partition, so nothing is shuffled and memory is bounded by one pool of
remainders. What the pool holds at the end of a partition that doesn't fill a window is cut at
powers of two, which need no padding.

Ids are those that tokenizers gives for its JSON file. Where a text holds only characters below
U+0250 that all libraries class alike, they are computed by tiktoken from the same file's vocabulary,
which is several times as fast; any other text goes through tokenizers itself.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from calorant.llm.common import giving_back

WINDOW = 2048
POOL = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")


def encoder(path: str):
    """A function from a text to its ids, for a byte-level BPE file whose ids follow the merges' order."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    full.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
    special = {t.content for t in full.get_added_tokens_decoder().values()}
    ranks = {token: i for token, i in ranks.items() if token.decode("utf-8", "replace") not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        return fast.encode_ordinary(text) if PLAIN.fullmatch(text) else full.encode(text, add_special_tokens=False).ids

    return ids


def closest_fill(lengths: list[int], counts: list[int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to capacity that the multiset gives, and how often each length is used.

    Bit s of a bitset says that sum s can be reached. A length's multiplicity is split into powers of
    two, so a step is one shift. Stops as soon as the capacity itself is reached.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length, count in zip(lengths, counts):
        if length > capacity:
            continue
        part = 1
        while count > 0:
            take = min(part, count)
            if length * take <= capacity:
                steps.append((length, take, reach))
                reach |= (reach << (length * take)) & mask
            count -= take
            part *= 2
        if reach >> capacity & 1:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return best, used


class Remainders:
    """The multiset of remainders waiting for a window: lengths in order, and the pieces of each."""

    def __init__(self, window: int):
        self.window, self.order, self.pieces, self.n = window, [], {}, 0

    def add(self, piece: tuple) -> None:
        length = piece[2]
        if length not in self.pieces:
            insort(self.order, length)
            self.pieces[length] = []
        self.pieces[length].append(piece)
        self.n += 1

    def take(self, length: int) -> tuple:
        own = self.pieces[length]
        piece = own.pop()
        self.n -= 1
        if not own:
            del self.pieces[length]
            self.order.remove(length)
        return piece

    def fill(self) -> list[tuple]:
        """The pieces of the next window."""
        first = self.take(self.order[-1])
        if (room := self.window - first[2]) == 0:
            return [first]
        lengths = [x for x in reversed(self.order) if x <= room]
        _, used = closest_fill(lengths, [len(self.pieces[x]) for x in lengths], room)
        return [first, *(self.take(length) for length, n in used.items() for _ in range(n))]


def powers(total: int) -> list[int]:
    """The powers of two that sum to total, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


class Packer:
    """Places the pieces of one partition; rows wait in `out` until taken."""

    def __init__(self, window: int, pool: int, first_id: int):
        self.window, self.limit, self.next_id = window, pool, first_id
        self.pool, self.out = Remainders(window), []

    def put(self, doc_id, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int) -> None:
        self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset))

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, length, ids, tokens in pieces:
            self.put(doc_id, start, ids, tokens, self.next_id, offset)
            offset += length
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self.close([(doc_id, start, self.window, ids[start : start + self.window], len(ids))])
        if whole < len(ids):
            self.pool.add((doc_id, whole, len(ids) - whole, ids[whole:].copy(), len(ids)))
        while self.pool.n > self.limit:
            self.close(self.pool.fill())

    def finish(self) -> None:
        """Windows for all that waits; those that don't come out full are cut at powers of two together."""
        loose = []
        while self.pool.n:
            pieces = self.pool.fill()
            if sum(p[2] for p in pieces) == self.window:
                self.close(pieces)
            else:
                loose += pieces
        total = sum(p[2] for p in loose)
        sizes = [self.window] * (total // self.window) + powers(total % self.window)
        for size in sizes:
            pieces, room = [], size
            while room:
                doc_id, start, length, ids, tokens = loose.pop(0)
                n = min(room, length)
                pieces.append((doc_id, start, n, ids[:n], tokens))
                if n < length:
                    loose.insert(0, (doc_id, start + n, length - n, ids[n:], tokens))
                room -= n
            self.close(pieces)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, pool: int = POOL, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a tokenizers JSON file that every executor can read. A null or empty
    text is the end id alone. Rows with the same doc_id are separate documents; of remainders of one
    length the last that came goes first. A text of any length is encoded whole and cut at the window. No row comes of an
    empty table; other columns are ignored. sequence_id is the input partition's number and a count
    in it, so a task that runs again gives the same ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        packer = Packer(window, pool, TaskContext.get().partitionId() << 33)

        def rows() -> pd.DataFrame:
            got, packer.out = packer.out, []
            return pd.DataFrame(got, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) if isinstance(text, str) else []
                packer.add(None if pd.isna(doc_id) else int(doc_id), np.array([*ids, end_id], dtype=np.uint32))
                if len(packer.out) > 5000:
                    yield rows()
        packer.finish()
        yield rows()

    return docs.select("doc_id", "text").mapInPandas(giving_back(run), PIECES)
