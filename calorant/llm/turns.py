"""A trie of conversations by their turns, in double arrays.

1. A turn is a 128-bit digest of role and text; a node is the digest of its turns, chained. Equal
   conversations are one sequence with its number, counted before anything is shuffled.
2. Nodes whose subtrees hold more than `most` turns are split off from the top (the root always); the
   subtrees under them are shards. Each task packs whole shards, several at a time, into BASE and CHECK
   arrays over dense turn ids, walks them, and gives the nodes with their subtrees' aggregates.
3. The nodes split off are few (each holds more than `most` turns at its depth); their aggregates are
   sums over the shards' tops, and then over each other by the paths they carry.
4. Conversations that end at a node are listed by blocks of ids, and blocks are hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorant.llm.common import crc32_sql, written

WORD = r"[^\x20\x09-\x0D]+"
#: The root's digest, and what every chain starts with.
ROOT = hashlib.md5(b"").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Most turns of a shard that isn't split further, and about as many for one double array.
MOST = 65_536
#: Split-off nodes are broadcast up to this many; beyond, both sides are shuffled.
BROADCAST = 100_000
#: Ids of one block of a node's list.
BLOCK = 4096


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, place, turn and words of every turn in order: by turn (null first), equal ones by digest. Rows without a conv_id belong to none."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select("conv_id", F.col("turn").alias("at"), digest.alias("turn"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "turn")) - 1
    return rows.select("conv_id", place.alias("place"), "turn", "words")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (turn, words), from rows of conv_id, part, place, turn, words. A row without a turn stands for a conversation that may have none."""
    held = F.sort_array(F.collect_list(F.struct("part", "place", "turn", "words")))
    return turns.groupBy("conv_id").agg(held.alias("held")).select("conv_id", F.expr("filter(held, x -> x.turn is not null)").alias("turns"))


def chained(conversations: DataFrame) -> DataFrame:
    """conv_id, node (the digest of all turns), keys, words, and nodes (the digest at each depth)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c, turns in zip(batch["conv_id"].tolist(), batch["turns"]):
                now, nodes = ROOT, []
                for t in turns:
                    now = hashlib.md5(now + t["turn"]).digest()
                    nodes.append(now)
                out.append((c, now, [t["turn"] for t in turns], [t["words"] for t in turns], nodes))
            yield pd.DataFrame(out, columns=["conv_id", "node", "keys", "words", "nodes"])

    return conversations.mapInPandas(run, "conv_id long, node binary, keys array<binary>, words array<int>, nodes array<binary>")


class DoubleArray:
    """A trie in BASE and CHECK: the child of s by code c is t = BASE[s] + c where CHECK[t] = s. State 0 is the root."""

    def __init__(self, keys: list[list[int]]) -> None:
        """keys: sorted, distinct, of codes from 1 on. States are packed breadth first, each at the first free place that fits."""
        self.base, self.check = [0], [-1]
        self._next = [1]  # the first free place from here on, by path halving
        self.order: list[int] = []  # states but the root, breadth first
        level = [(0, 0, len(keys), 0)]
        while level:
            below = []
            for state, i, j, depth in level:
                while i < j and len(keys[i]) == depth:
                    i += 1
                codes, edges = [], []
                for k in range(i, j):
                    if not codes or keys[k][depth] != codes[-1]:
                        codes.append(keys[k][depth])
                        edges.append(k)
                if codes:
                    self._place(state, codes)
                    below += [(self.base[state] + c, a, b, depth + 1) for c, a, b in zip(codes, edges, [*edges[1:], j])]
            self.order += [state for state, *_ in below]
            level = below

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            more += len(self.base)
            self._next += range(len(self.base), len(self.base) + more)
            self.base += [0] * more
            self.check += [-1] * more

    def _free(self, at: int) -> int:
        self._grow(at + 1)
        follow = self._next
        while follow[at] != at:
            if follow[at] == len(follow):
                self._grow(len(follow) + 1)
            follow[at] = follow[follow[at]]
            at = follow[at]
        return at

    def _place(self, state: int, codes: list[int]) -> None:
        first, last = codes[0], codes[-1]
        at = self._free(first + 1)
        while True:
            base = at - first
            self._grow(base + last + 2)
            if all(self.check[base + c] < 0 for c in codes):
                break
            at = self._free(at + 1)
        self.base[state] = base
        for c in codes:
            self.check[base + c] = state
            self._next[base + c] = base + c + 1

    def child(self, state: int, code: int) -> int:
        """The child's state, -1 if there is none."""
        t = self.base[state] + code
        return t if 0 < t < len(self.check) and self.check[t] == state else -1


NODES = "node binary, parent binary, top boolean, depth int, low long, parent_low long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def walked(pack: list[tuple]) -> list[tuple]:
    """The nodes of whole shards (shard, depth of its top, n, low, keys, words, nodes), by one double array."""
    codes: dict[bytes, int] = {}
    own = [([shard, *keys[depth:]], n, low, words[depth - 1 :], nodes[depth - 1 :], depth, ROOT if depth == 1 else nodes[depth - 2]) for shard, depth, n, low, keys, words, nodes in pack]
    for d in range(max(len(o[0]) for o in own)):  # breadth first, so that the codes of the wide upper nodes are dense
        for o in own:
            if d < len(o[0]):
                codes.setdefault((d == 0, o[0][d]), len(codes) + 1)
    own = [([codes[d == 0, k] for d, k in enumerate(o[0])], *o[1:]) for o in own]
    own.sort(key=lambda o: o[0])
    trie = DoubleArray([o[0] for o in own])
    size = len(trie.check)
    convs, low, kids, leaves, saved = ([0] * size for _ in range(5))
    said: list = [None] * size
    for path, n, least, words, nodes, depth, above in own:
        state = 0
        for k, code in enumerate(path):
            state = trie.child(state, code)
            if said[state] is None:
                said[state], low[state] = (nodes[k], nodes[k - 1] if k else above, k == 0, depth + k, words[k]), least
            elif least < low[state]:
                low[state] = least
            convs[state] += n
    out = []
    for state in reversed(trie.order):
        above = trie.check[state]
        node, parent, top, depth, words = said[state]
        leaves[state] = leaves[state] or 1
        saved[state] += (convs[state] - 1) * words
        kids[above] += 1
        leaves[above] += leaves[state]
        saved[above] += saved[state]
        out.append((node, parent, top, depth, low[state], None if top else low[above], convs[state], kids[state], leaves[state], saved[state]))
    return out


def shards_walked(shards: DataFrame, most: int) -> DataFrame:
    """walked() of all shards, in packs of about `most` turns. A shard is in one task, a conversation in one row."""
    names = [c.split()[0] for c in NODES.split(", ")]

    def frame(pack: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(walked(pack), columns=names)
        return out.astype({"parent_low": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch[c] for c in ("shard", "depth", "n", "low", "keys", "words", "nodes"))):
                if size > most and row[0] != last:
                    yield frame(pack)
                    pack, size = [], 0
                last = row[0]
                pack.append((*row[:4], *(list(x) for x in row[4:])))
                size += len(row[4])
        if pack:
            yield frame(pack)

    return shards.repartition("shard").sortWithinPartitions("shard").mapInPandas(run, NODES)


def _beside(rows: DataFrame, few: DataFrame, on: str, how: str) -> DataFrame:
    """A join with a table of which the size is counted first: broadcast if small."""
    return rows.join(F.broadcast(few) if few.limit(BROADCAST + 1).count() <= BROADCAST else few, on, how)


def ends(conversations: DataFrame) -> DataFrame:
    """node and the SHA-256 of the ascending ids, comma-joined, of the conversations that end there."""
    block = F.floor(F.col("conv_id") / BLOCK).alias("block")
    blocks = conversations.groupBy("node", block).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sha = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch["node"], batch["ids"]):
                if node == last:
                    sha.update(b",")
                else:
                    if last is not None:
                        out.append((last, sha.hexdigest()))
                    last, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(last, sha.hexdigest())], columns=["node", "ends_sha256"])

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInPandas(run, "node binary, ends_sha256 string")


def _split_off(seqs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The shards, and the nodes split off from the top: node, parent, depth, path, words, n_convs, low."""
    path, parent = F.array(F.lit(ROOT)).alias("path"), F.lit(None).cast("binary").alias("parent")
    upper = seqs.groupBy().agg(F.sum("n").alias("n_convs"), F.min("low").alias("low")).where("n_convs > 0").select(F.lit(ROOT).alias("node"), parent, F.lit(0).alias("depth"), path, F.lit(0).alias("words"), "n_convs", "low")
    alive, shards, d = seqs.where(F.size("keys") > 0), None, 0
    while True:
        d += 1
        alive = alive.withColumn("shard", F.element_at("nodes", d)).withColumn("depth", F.lit(d))
        crowded = written(alive.groupBy("shard").agg(F.sum(F.size("keys")).alias("turns"), F.count("*").alias("seqs")).where((F.col("turns") > most) & (F.col("seqs") > 1)).select("shard"))
        if crowded.isEmpty():
            return (alive if shards is None else shards.unionByName(alive)), upper
        rest = _beside(alive, crowded, "shard", "left_anti")
        shards = rest if shards is None else shards.unionByName(rest)
        inside = written(_beside(alive, crowded, "shard", "left_semi"))
        above = F.lit(ROOT) if d == 1 else F.element_at("nodes", d - 1)
        facts = [F.first(above).alias("parent"), F.first(F.concat(F.array(F.lit(ROOT)), F.slice("nodes", 1, d))).alias("path"), F.first(F.element_at("words", d)).alias("words"), F.sum("n").alias("n_convs"), F.min("low").alias("low")]
        upper = upper.unionByName(inside.groupBy(F.col("shard").alias("node")).agg(*facts).withColumn("depth", F.lit(d)))
        alive = inside.where(F.size("keys") > d)


def _summed(upper: DataFrame, tops: DataFrame) -> DataFrame:
    """The split-off nodes with the aggregates of their subtrees, from those of the shards' tops by parent."""
    under = tops.groupBy("parent").agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("parent", "node")
    kids = upper.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "node")
    own = upper.join(under, "node", "left").join(kids, "node", "left").na.fill(0, ["tops", "leaves", "saved", "kids"])
    children = F.col("tops") + F.col("kids")
    own = written(own.withColumn("n_children", children).withColumn("leaves", F.when(children == 0, 1).otherwise(F.col("leaves"))).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words")))
    subtree = own.select(F.explode("path").alias("node"), "leaves", "saved").groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    lows = own.select(F.col("node").alias("parent"), F.col("low").alias("parent_low"))
    return own.select("node", "parent", "depth", "low", "n_convs", "n_children").join(subtree, "node").join(lows, "parent", "left")


def trie(turns: DataFrame, most: int = MOST) -> DataFrame:
    """Every node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: rows as sequences() takes them. A node's members are the conversations that start with its
    turns, and conv_id is the smallest; parent_conv_id is its parent's (root: null). n_leaves and
    saved_tokens are summed over the subtree, its top included: a saved token is a word of the last
    turn, once for every member but one. ends_sha256 hashes the ids of the members that end there. A
    conversation without turns ends at the root; an empty table has no root.
    """
    every = written(chained(sequences(turns)))
    first = [F.first(c).alias(c) for c in ("keys", "words", "nodes")]
    seqs = written(every.groupBy("node").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), *first))
    shards, upper = _split_off(seqs, most)
    nodes, upper = written(shards_walked(shards, most)), written(upper)
    lows = upper.select(F.col("node").alias("parent"), F.col("low").alias("upper_low"))
    below = _beside(nodes, lows, "parent", "left").withColumn("parent_low", F.when(F.col("top"), F.col("upper_low")).otherwise(F.col("parent_low")))
    cols = ["node", "depth", "low", "parent_low", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    both = below.select(*cols).unionByName(_summed(upper, nodes.where("top")).select(*cols))
    return both.join(ends(every), "node", "left").select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def regrown(own: DataFrame, h: Column, group: int = 20) -> DataFrame:
    """Rows for sequences(): every conversation c takes the first h turns of conversation c - c % group, then its own after its first h."""
    convs = own.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h)
    donors = own.where(F.col("conv_id") % group == 0).withColumnRenamed("conv_id", "base")
    given = convs.join(donors, "base").where("place < h").select("conv_id", F.lit(0).alias("part"), "place", "turn", "words")
    kept = own.withColumn("h", h).where("place >= h").select("conv_id", F.lit(1).alias("part"), "place", "turn", "words")
    none = own.where("place = 0").select("conv_id", F.lit(2).alias("part"), "place", F.lit(None).cast("binary").alias("turn"), F.lit(0).alias("words"))
    return given.unionByName(kept).unionByName(none)


def oracle() -> str:
    """The same nodes of regrown `conversations` in DuckDB: a node is the joined digests of its turns."""
    return f"""
with own as (
  select conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as key, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as words,
    row_number() over (partition by conv_id order by turn nulls first, key) - 1 as place
  from conversations where conv_id is not null
), convs as (
  select conv_id as c, conv_id - conv_id % 20 as base, {crc32_sql("cast(conv_id as varchar)")} % 4 as h from (select distinct conv_id from own)
), turns as (
  select c, 0 as part, place, key, words from convs join own on own.conv_id = base where place < h
  union all select c, 1, place, key, words from convs join own on own.conv_id = c where place >= h
), walks as (
  select c, count(*) over w as depth, string_agg(key, '') over w as node, words from turns window w as (partition by c order by part, place)
  union all select c, 0, '', 0 from convs
), nodes as (
  select node, any_value(depth) as depth, any_value(words) as words, min(c) as low, count(*) as n_convs from walks group by node
), lasts as (
  select node, sha256(string_agg(cast(c as varchar), ',' order by c)) as ends from (select c, arg_max(node, depth) as node from walks group by c) group by node
), kids as (
  select left(node, 32 * (depth - 1)) as node, count(*) as n_children from nodes where depth > 0 group by all
), facts as (
  select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * words as saved from nodes n left join kids using (node)
), spread as (
  select left(node, 32 * unnest(range(0, depth + 1))) as node, n_children = 0 as leaf, saved from facts
), summed as (
  select node, count(*) filter (leaf) as n_leaves, sum(saved) as saved_tokens from spread group by node
)
select f.low as conv_id, f.depth, p.low as parent_conv_id, f.n_convs, f.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, coalesce(ends, '{NO_ENDS}') as ends_sha256
from facts f join summed using (node) left join lasts using (node) left join nodes p on f.depth > 0 and p.node = left(f.node, 32 * (f.depth - 1))
"""
