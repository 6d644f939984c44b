"""Items shorter than a window are found in texts of just their words, and nowhere else."""

import duckdb

from calorant.llm import decontamination

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_short_items_are_found_whole(spark, tmp_path):
    rows = [(1, "What is 7 times 8?"), (2, "what is 7 TIMES 8"), (3, "What is 7 times 9?"), (4, "Say: what is 7 times 8? Yes."), (5, ""), (6, None), (None, "What is 7 times 8"), (7, "Paris."), (7, "Paris."), (8, "..."), (9, "one two three four five six seven eight")]
    items = [(1, "What is 7 times 8?"), (2, "Paris"), (3, ""), (4, "!!"), (5, "one two three four five six seven eight"), (None, "Paris"), (6, None)]
    docs, benchmark = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS own", "2 AS row"), spark.createDataFrame(items, ITEMS)
    got = sorted((str(r.doc_id), r.item_id, r.windows) for r in decontamination.contaminated(docs, benchmark).collect())
    assert [g for g in got if g[2] == 0] == [("1", 1, 0), ("2", 1, 0), ("7", 2, 0), ("None", 1, 0)]
    assert {r.doc_id for r in decontamination.clean(docs, benchmark).collect()} == {3, 4, 5, 6, 8} | ({9} - {int(g[0]) for g in got if g[0] == "9"})
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents")
    benchmark.write.parquet(f"{tmp_path}/benchmark")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}/*.parquet')")
    want = con.execute(decontamination.oracle()).fetchall()
    assert sorted((str(a), b, c) for a, b, c, _ in want) == got
