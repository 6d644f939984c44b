import random

import pytest
from pyspark.sql import functions as F

from calorant.llm import decontamination, queries

ITEM = "Anna has 40 crates in the old yard. Tom Baker brings 1,200 more of them by noon. Anna then sells 3.5 tons to the shop near Leeds, and how much is left in the yard"


def test_whole_numbers_and_runs_are_one_placeholder(spark):
    df = spark.createDataFrame([("Anna Smith paid 1,200 and 3.5kg. Then O'Brien-Jones left\nX9y A1 iPhone 5 km",), ("",), (" ".join(["Name"] * 50_000),)], "text string")
    got = df.select(decontamination.whole_template(F.col("text")).alias("t"), decontamination.whole_words(F.col("text")).alias("w")).collect()
    assert got[0].t == ["zzname", "paid", "zznum", "and", "zznum", "zzunit", "zzname", "left", "x9", "y", "a1", "iphone", "zznum", "zzunit"]
    assert got[0].w[:3] == ["anna smith", "paid", "1,200"] and got[0].w[6] == "then o'brien-jones"
    assert all(len(r.t) == len(r.w) for r in got) and len(got[2].w) == 1


def test_finds_names_and_numbers_of_other_token_counts(spark):
    swaps = [("Tom Baker", "Eve"), ("Tom Baker", "Ann Lee Fox"), ("Anna", "Bob"), ("Anna", "Mary Ann"), ("1,200", "950"), ("3.5", "4"), ("40", "2,040.5")]
    texts = [ITEM]
    for old, new in swaps:
        texts += [ITEM.replace(old, new), texts[-1].replace(old, new)]
    uneven = ITEM.replace("Anna then", "Bob then")
    docs = spark.createDataFrame([*enumerate(texts), (99, uneven)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {*range(len(texts)), 99}
    # the uneven one is an occurrence by its plain words alone
    assert got[99].windows < got[0].windows
    other = [(100, "The yard is empty"), (101, None)]
    docs = docs.union(spark.createDataFrame(other, "doc_id long, text string"))
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [100, 101]


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = sorted(con.execute(queries.oracle_sql()["op5_decontamination"]).fetchall())
    assert sorted(tuple(r) for r in queries.op5_decontamination(spark, sf).collect()) == want and want


def test_items_of_many_placeholders(spark):
    """An item without a window of five plain words is found where all its windows are, with even slots."""
    item = "then 12 km and 15 kg for 3 days at 40 usd"
    docs = [(1, "so " + item.replace("12", "90").replace("15", "1,5") + " end"), (2, item.replace("days", "days or")), (3, "then 12 km and 15 kg for 3 days")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()] == [(1, 5)]


def test_rows_are_judged_by_their_own_text(spark):
    """Null and shared ids: a row goes for its own text alone. Columns may have any name."""
    rows = [(None, ITEM), (None, "The yard is empty"), (4, ITEM + " now"), (4, "A clean text of the same id"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS check", "3 AS hash", "4 AS item_id")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in (rows[1], rows[3], rows[4], rows[5]))


@pytest.mark.parametrize("kind", ["numbers", "names", "units"])
def test_recall_of_reparameterised_items(spark, kind):
    """Every item with all its numbers, names or units replaced is found; items with other words are not."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items, changed = [], []
    for k in range(60):
        body = [" ".join(word() for _ in range(7)) for _ in range(3)]
        fill = lambda n, who, unit: f"{who} {body[0]} {n} {unit} {body[1]} {who} {body[2]}"  # noqa: B023, E731
        items.append((k, fill(rng.randint(2, 99), "Anna", "km")))
        changed.append((k, fill("4,512" if kind == "numbers" else 7, "Mary Ann Fox" if kind == "names" else "Anna", "miles" if kind == "units" else "km")))
    clean = [(1000 + k, " ".join(word() for _ in range(60))) for k in range(60)]
    got = decontamination.contaminated(spark.createDataFrame(changed + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(60)}
