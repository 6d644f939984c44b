"""The plan shared by the operators that remove recurring passages, of words or of bytes.

1. Rows of equal text are one class, by a 128-bit cut of SHA-256, counted before anything is shuffled.
   One member, with the smallest id, is judged; the others follow from it.
2. Every text gives its regions' anchors, once, to a written table; anchors of one class alone are dropped by a
   pre-aggregated count.
3. The regions of the remaining anchors are brought together by shard with all their units, and a
   kernel (repeated-phrase automata for words, suffix arrays for bytes) says of each window whether,
   and where first, it recurs. It compares units, not hashes. Anchors that the same few texts share
   are one shard, so that neighbouring regions move as one; any other anchor is a shard of its own.
4. What the windows cover is removed from the documents.

A shard with more than `crowd` texts, or REGIONS regions, isn't gathered in one task: its distinct regions are
pre-aggregated and each of their windows becomes a row, by a 128-bit hash, counted without gathering.

A text longer than SLICE is worked on in pieces that overlap by a window less a unit, so memory
doesn't grow with it beyond the text itself. A null id counts as the largest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorant.llm.common import checkpoint, encoded, text_slices, written

NO_ID = (1 << 63) - 1
SHARD = 400_000
SLICE = 400_000
#: Anchors of up to this many rows, none of a text above LONG bytes, share a shard with those of the same rows.
FEW = 64
LONG = 100_000
#: Most regions of a shard, of all its texts, that are judged in one task.
REGIONS = 16_384
#: Crowded shards are broadcast up to this many (of 8 bytes); beyond, both sides are shuffled.
BROADCAST = 500_000

#: One distinct region: its units as bytes, the number of its windows, the smallest id that has it, its copies.
Region = tuple[bytes, int, int, int]
#: A run of windows: the first, how many, the smallest id with an equal window, and the level.
Verdict = tuple[int, int, int, int]
#: Judges shards' distinct regions, several shards at a time. Gives the verdicts on the windows that
#: recur, for every region of every shard.
Kernel = Callable[[list[list[Region]]], list[list[list[Verdict]]]]


def pieces(texts: list[bytes], units, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Slices of a batch, long texts cut: of each piece the text's number, its first unit, how many units windows may start at, and its bytes."""
    cut = [(d, *piece) for d, text in enumerate(texts) for piece in (units.cut(text, SLICE, reach) if len(text) > SLICE else [(0, NO_ID, text)])]
    for i, j in text_slices([c[3] for c in cut], SLICE):
        text, first, most, own = zip(*cut[i:j])
        yield np.array(text), np.array(first, dtype=np.int64), np.array(most, dtype=np.int64), list(own)


def anchors(docs: DataFrame, units, window: int, gram: int, reach: int) -> DataFrame:
    """A row for each region of each row: anchor, row, whether the text is a long one, and for units of which equal windows of one text matter, whether it may hold some."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts = batch["row"].to_numpy(), encoded(batch["text"])
            size = np.array([len(t) for t in texts])
            for text, _, most, own in pieces(texts, units, reach):
                r = units(own, window, gram, most).regions()
                out = {"anchor": r.anchor, "row": rows[text[r.text]], "long": size[text[r.text]] > LONG}
                if units.inner:
                    order = np.lexsort((r.anchor, r.text))
                    again = np.zeros(len(order), dtype=bool)
                    again[order[1:]] = (np.diff(r.text[order]) == 0) & (np.diff(r.anchor[order]) == 0)
                    out["own"] = r.inner | again | (most[r.text] < NO_ID)
                yield pd.DataFrame(out)

    return docs.select("row", "text").mapInPandas(run, "anchor long, row long, long boolean" + ", own boolean" * units.inner)


def bodies(docs: DataFrame, units, window: int, gram: int, reach: int) -> DataFrame:
    """Regions, with their units, of the anchors that each row lists with their shards. Windows of a region may reach `reach` units.

    Regions of one shard that adjoin are one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, ids, copies, lists, shards = (batch[c].to_numpy() for c in ("row", "id", "copies", "anchors", "shards"))
            for text, first, most, own in pieces(encoded(batch["text"]), units, reach):
                u = units(own, window, gram, most)
                r = u.regions()
                edge = np.searchsorted(r.text, np.arange(len(own) + 1)).tolist()
                at, shard = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for k, d in enumerate(text.tolist()):
                    held, mine = np.asarray(lists[d], dtype=np.int64), r.anchor[edge[k] : edge[k + 1]]
                    place = np.minimum(np.searchsorted(held, mine), len(held) - 1)
                    there = np.flatnonzero(held[place] == mine)
                    at.append(edge[k] + there)
                    shard.append(np.asarray(shards[d], dtype=np.int64)[place[there]])
                at, shard = np.concatenate(at), np.concatenate(shard)
                piece, start, windows = r.text[at], r.start[at], r.windows[at]
                joins = np.zeros(len(at), dtype=bool)
                joins[1:] = (shard[1:] == shard[:-1]) & (piece[1:] == piece[:-1]) & (start[1:] == start[:-1] + windows[:-1])
                head = np.flatnonzero(~joins)
                piece, start, shard = piece[head], start[head], shard[head]
                windows = np.add.reduceat(windows, head) if len(head) else windows
                d = text[piece]
                body = [u.piece(k, a, a + n + reach - 1) for k, a, n in zip(piece.tolist(), start.tolist(), windows.tolist())]
                yield pd.DataFrame({"shard": shard, "row": rows[d], "id": ids[d], "copies": copies[d], "start": first[piece] + start, "windows": windows, "body": body})

    # with all columns of the documents, so that their exchange is the one that the result reads too
    return docs.select("doc_id", "text", "id", "row", "key", "copies", "anchors", "shards").mapInPandas(run, "shard long, row long, id long, copies long, start long, windows int, body binary")


def spans_schema(levels: int) -> str:
    """One row for a region: of each level the runs of windows that go, as first << 24 | count."""
    return "row long, id long, " + ", ".join(f"found{k} array<long>" for k in range(levels))


def judged(found: DataFrame, kernel: Kernel, across: bool, levels: int) -> DataFrame:
    """Runs of windows to remove (spans_schema), by a kernel that gets whole shards. Regions with the same bytes are one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: list[dict[bytes, list]] = []
        last, size = None, 0

        def close() -> pd.DataFrame:
            out = []
            said = kernel([[(body, n, low, copies) for body, (n, low, copies, _) in g.items()] for g in groups])
            for g, verdicts in zip(groups, said):
                for (*_, places), own in zip(g.values(), verdicts):
                    for row, i, start in places:
                        runs: list[list[int]] = [[] for _ in range(levels)]
                        for at, n, low, level in own:
                            if low < i or not across:
                                mine, first = runs[level], start + at
                                if mine and (mine[-1] >> 24) + (mine[-1] & 0xFFFFFF) == first:
                                    mine[-1] += n
                                else:
                                    mine.append(first << 24 | n)
                        if any(runs):
                            out.append((row, i, *runs))
            groups.clear()
            return pd.DataFrame(out, columns=["row", "id", *(f"found{k}" for k in range(levels))])

        for batch in batches:
            for shard, row, i, copies, start, n, body in zip(*(batch[c].tolist() for c in ("shard", "row", "id", "copies", "start", "windows", "body"))):
                if shard != last:
                    if size > SHARD:
                        yield close()
                        size = 0
                    groups.append({})
                    last = shard
                known = groups[-1].get(body)
                if known is None:
                    groups[-1][body] = [n, i, copies, [(row, i, start)]]
                    size += len(body)
                else:
                    known[1], known[2] = min(known[1], i), known[2] + copies
                    known[3].append((row, i, start))
        yield close()

    return found.repartition("shard").sortWithinPartitions("shard").mapInPandas(run, spans_schema(levels))


def counted(found: DataFrame, windows_of: Callable[[bytes, int], list[tuple[int, int, bytes]]], across: bool, levels: int) -> DataFrame:
    """Windows to remove (spans_schema) of crowded shards: a row for each window (level, place, units) of each distinct region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                each = [windows_of(bytes(body), n) for body, n in zip(part["body"], part["windows"].tolist())]
                rows = [(level, at, hashlib.blake2b(w, digest_size=16).digest()) for own in each for level, at, w in own]
                out = pd.DataFrame(rows, columns=["level", "at", "digest"])
                n = [len(own) for own in each]
                for c in ("shard", "region", "low", "copies"):
                    out[c] = np.repeat(part[c].to_numpy(), n)
                yield out

    found = found.withColumn("region", F.unhex(F.substring(F.sha2("body", 256), 1, 32)))
    distinct = found.groupBy("shard", "region", "windows").agg(F.min("id").alias("low"), F.sum("copies").alias("copies"), F.first("body").alias("body"))
    each = distinct.mapInPandas(run, "level int, at int, digest binary, shard long, region binary, low long, copies long")
    known = each.groupBy("level", "digest").agg(F.min("low").alias("least"), F.sum("copies").alias("total")).where("total > 1")
    said = each.join(known, ["level", "digest"]).groupBy("shard", "region").agg(F.collect_list(F.struct("level", "at", "least")).alias("said"))
    at = found.select("shard", "region", "row", "id", "start").join(said, ["shard", "region"])
    goes = lambda k: lambda w: (w.level == k) & (w.least < F.col("id") if across else F.lit(True))
    run_of = lambda w: F.shiftleft(F.col("start") + w.at, 24).bitwiseOR(F.lit(1))
    return at.select("row", "id", *(F.transform(F.filter("said", goes(k)), run_of).alias(f"found{k}") for k in range(levels)))


def removals(docs: DataFrame, units, window: int, gram: int, kernel: Kernel, windows_of, crowd: int, across: bool, reach: int | None = None, levels: int = 1, most: int = REGIONS) -> DataFrame:
    """Every row's doc_id and text, with id, the smallest id of its text's class (low), the class's size
    (copies), and for each level the runs of windows that go in the row of the smallest id
    (found0 and so on; null if none).

    across: a window goes if an equal one starts in a row of a smaller id. Otherwise it goes if an
    equal one starts at any other place, of the same row or another.
    """
    reach = reach or window
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"))
    every = written(anchors(docs, units, window, gram, reach))
    spread = [F.min("row").alias("least"), F.max("row").alias("most"), F.count("*").alias("n")]
    seen = every.groupBy("anchor").agg(*spread, *([F.max("own").alias("own"), F.max("long").alias("long")] if units.inner else [F.max("long").alias("long")]))
    shard = F.when((F.col("n") <= FEW) & ~F.col("long"), F.xxhash64("least", "most", "n")).otherwise(F.col("anchor"))
    recurring = seen.where("least < most or own" if units.inner else "least < most").select("anchor", shard.alias("shard"))
    each = every.select("anchor", "row").join(recurring, "anchor").groupBy("row", "anchor", "shard").agg(F.count("*").alias("n"))
    held = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("anchor", "shard", "n"))).alias("held"))
    wanted = held.select("row", F.col("held.anchor").alias("anchors"), F.col("held.shard").alias("shards"), F.col("held.n").alias("regions"))
    classes = docs.groupBy("row", "key").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    known = checkpoint(classes.join(wanted, "row", "left"))
    own = known.select("row", F.explode(F.arrays_zip("shards", F.transform("regions", lambda n: n / F.col("copies")).alias("regions"))).alias("r")).groupBy("row", F.col("r.shards").alias("shard")).agg(F.sum("r.regions").alias("regions"))
    full = own.groupBy("shard").agg(F.count("*").alias("texts"), F.sum("regions").alias("regions"))
    crowded = checkpoint(full.where((F.col("texts") > crowd) | (F.col("regions") > most)).select("shard"))
    many = crowded.limit(BROADCAST + 1).count()
    # an equality would become part of the join's key, and the exchange one of its own
    judge = docs.join(known, ["row", "key"]).where("id <= low and size(anchors) > 0")
    found = bodies(judge, units, window, gram, reach)
    if many:
        marked = F.broadcast(crowded) if many <= BROADCAST else crowded
        spans = judged(found.join(marked, "shard", "left_anti"), kernel, across, levels).unionByName(counted(found.join(marked, "shard", "left_semi"), windows_of, across, levels))
    else:
        spans = judged(found, kernel, across, levels)
    packed = spans.groupBy("row", "id").agg(*(F.flatten(F.collect_list(f"found{k}")).alias(f"found{k}") for k in range(levels))).withColumnRenamed("id", "low")
    verdicts = known.select("row", "key", "low", "copies").join(packed, ["row", "low"], "left")
    return docs.join(verdicts, ["row", "key"]).select("doc_id", "text", "id", "low", "copies", *(f"found{k}" for k in range(levels)))


def intervals(found, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) of units that a row's runs of windows cover, in order."""
    packed = np.sort(np.asarray(found if found is not None else [], dtype=np.int64))
    begin, end = packed >> 24, (packed >> 24) + (packed & 0xFFFFFF) + window - 1
    if not len(begin):
        return begin, end
    last = np.maximum.accumulate(end)
    head = np.flatnonzero(np.concatenate(([True], begin[1:] > last[:-1])))
    return begin[head], last[np.append(head[1:], len(begin)) - 1]
