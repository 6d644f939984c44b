"""Spelling variants of words, grouped by permuterm rotations.

A word of L code points with a terminator has L + 1 rotations. The rotation that ends in the code point
to be edited, less that code point, is a key: words that share it differ by one replacement there, and
a word that has the key as a whole rotation lacks just that code point. So near words are runs of equal
keys in the sorted rotations. A run has at most one word for each code point of the alphabet and one
more, so no group grows with the data; each member gets its best near word and their number, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorant.llm.common import crc32_sql, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
#: Least code points and occurrences of a word.
LEAST_LENGTH = 7
LEAST_N = 2
#: A form occurs so many times as often as its variant.
RATIO = 10
#: Sorts before every letter and is none.
END = "$"


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id and word of every maximal run of letters of at least `least` code points, A to Z in lower case. Null and empty texts have none."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("word")).withColumn("word", F.translate("word", UPPER, LOWER))


def counts(words: DataFrame, least: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """word and n of the words of at least `least` code points with `least_n` occurrences; a null is no word."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """key, last and n: every whole rotation of a word (last 0), and every rotation but its last code point (last)."""
    size, twice = F.length("word"), F.concat("word", F.lit(END), F.col("word"))
    whole = F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.struct(F.substring(twice, i, size + 1).alias("key"), F.lit(0).alias("last")))
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.substring(twice, i + 1, size).alias("key"), F.ascii(F.substring(F.col("word"), i, 1)).alias("last")))
    return words.where(size > 0).select("n", F.explode(F.concat(whole, cut)).alias("r")).select("r.key", "r.last", "n")


def members(key: str, group: list[tuple[int, int]]) -> list[tuple[str, int, int, str]]:
    """word, number of near words, and the best one's n and word, of each member of a run of equal keys.

    Of equal neighbouring code points only the first counts as deleted, so no pair is met twice.
    """
    after, _, before = key.partition(END)
    skipped = ord(key[-1])
    whole = None
    replaced = []
    for last, n in group:
        if last:
            replaced.append((-n, f"{before}{chr(last)}{after}", last != skipped))
        else:
            whole = (-n, before + after)
    replaced.sort()
    out = []
    for k, (_, word, deletes) in enumerate(replaced):
        near, best = len(replaced) - 1, replaced[not k][:2] if len(replaced) > 1 else None
        if whole and deletes:
            near, best = near + 1, min(best, whole) if best else whole
        if best:
            out.append((word, near, -best[0], best[1]))
    if whole:
        cut = [r for r in replaced if r[2]]
        if cut:
            out.append((whole[1], len(cut), -cut[0][0], cut[0][1]))
    return out


SCANNED = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """members() of every run of two or more equal keys of sorted rows; a run may go on in the next batch."""
    held_key, held = None, []

    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * 4, SCANNED)], schema=SCANNED)

    for batch in batches:
        keys, found = batch.column("key"), []
        new = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(new.nonzero()[0] + 1).tolist(), len(keys)]
        last, n = batch.column("last").to_pylist(), batch.column("n").to_pylist()
        for k, (i, j) in enumerate(zip(starts[:-1], starts[1:])):
            if 0 < k < len(starts) - 2:
                if j - i > 1:
                    found += members(keys[i].as_py(), list(zip(last[i:j], n[i:j])))
                continue
            own = keys[i].as_py()
            if own != held_key:
                if len(held) > 1:
                    found += members(held_key, held)
                held_key, held = own, []
            held += zip(last[i:j], n[i:j])
        yield rows(found)
    yield rows(members(held_key, held) if len(held) > 1 else [])


def near(words: DataFrame) -> DataFrame:
    """word, n_near, best and best_n of every word that has a near one: the best has the largest n, and of these is the smallest."""
    rows = rotations(words)
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: forms (word, form) followed to their last by doubling. n grows by the ratio each step, so a few rounds do."""
    jumps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = written(jumps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.drop("moved")
        jumps = further.drop("moved")


def group(words: DataFrame, least: int = LEAST_LENGTH, least_n: int = LEAST_N, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every distinct word of the rows of `words`.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form
    is its near word of the largest n (ties: the smallest in code-point order), if that n is at least
    `ratio` times its own, else null; its root follows forms to the last. Null, short and rare words are
    left out, repeated rows are occurrences, an empty table gives no rows, and other columns are ignored.
    Words must not hold the terminator "$".
    """
    known = written(counts(words.select("word"), least, least_n))
    is_form = F.col("best_n") >= ratio * F.col("n")
    scored = written(known.join(near(known), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    return scored.join(roots(scored.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def oracle() -> str:
    """The same rows of `documents`, some misspelt, in DuckDB: all keys of all words, joined to pairs."""
    return f"""
with recursive occurrences as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{7,}}')), '{UPPER}', '{LOWER}') as w from documents
), hashed as (
  select w, {crc32_sql("concat(doc_id, ':', w)")} as h, count(*) as n from occurrences group by all
), words as (
  select word, cast(sum(n) as bigint) as n
  from (select case when h % 31 = 0 then concat(w[1 : cast(h % length(w) as int)], w[cast(h % length(w) as int) + 2 :]) else w end as word, n from hashed)
  where length(word) >= 7 group by word having sum(n) >= 2
), keys as (
  select word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: concat(word[i + 1 :], '$', word[1 : i - 1]))) as key, length(word) as size from words
), wholes as (
  select word, n, unnest(list_transform(range(1, length(word) + 2), lambda i: concat(word[i :], '$', word[1 : i - 1]))) as key from words
), pairs as (
  select a.word, b.word as other, b.n as m from keys a join keys b on a.key = b.key and a.word <> b.word
  union select a.word, b.word, b.n from keys a join wholes b on a.key = b.key
  union select b.word, a.word, a.n from keys a join wholes b on a.key = b.key
), best as (
  select word, count(*) as n_near, arg_min(other, (-m, other)) as best, max(m) as best_n from pairs group by word
), scored as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * w.n then best end as form, case when best_n >= 10 * w.n then best_n end as form_n
  from words w left join best using (word)
), chain as (
  select word, word as reached, 0 as steps from scored
  union all select c.word, s.form, steps + 1 from chain c join scored s on s.word = c.reached where s.form is not null
)
select word, n, n_near, form, form_n, root from scored join (select word, arg_max(reached, steps) as root from chain group by word) using (word)
"""
