import duckdb
from collections import Counter

from graphloom.llm import exact

SCHEMA = "doc_id long, text string, h string, keep_id int"


def test_null_empty_tied_and_repeated_rows(spark):
    long = "word " * 100_000
    rows = [(3, "a", "x", 1), (1, "a", "y", 2), (None, "a", "z", 3), (2, "", "x", 4), (5, "", None, None), (7, None, "x", 5), (8, None, "x", 5), (9, long, "x", 1), (4, long, "x", 1), (6, "b", "x", 1), (6, "b", "x", 1), (10, "a ", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.doc_id, r.keep_id, r.n_copies) for r in exact.exact_duplicates(df).collect())
    assert got == Counter({(3, 1, 3): 1, (1, 1, 3): 1, (2, 2, 2): 1, (5, 2, 2): 1, (9, 4, 2): 1, (4, 4, 2): 1, (6, 6, 2): 2})
    kept = exact.keep_first_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.h) for r in kept.collect()) == [(1, "y"), (2, "x"), (4, "x"), (6, "x"), (7, "x"), (8, "x"), (10, "x")]
    assert exact.exact_duplicates(df.limit(0)).count() == 0 and exact.keep_first_copies(df.limit(0)).count() == 0


def test_texts_that_only_share_a_hash_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "content_hash", lambda text: F.substring(text, 1, 1).cast("binary"))
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "ac"), (4, "ad"), (5, "ad"), (6, "x"), (7, "x")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.n_copies) for r in exact.exact_duplicates(df).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (4, 4, 2), (5, 4, 2), (6, 6, 2), (7, 6, 2)}
    assert {r.doc_id for r in exact.keep_first_copies(df).collect()} == {1, 3, 4, 6}


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(map(tuple, exact.op3_exact_dedup(spark, folder).collect())) == sorted(con.execute(exact.OP3_SQL).fetchall())


def test_maps_clashing_names_and_kinds_of_ids(spark):
    df = spark.createDataFrame([(2, "a", 5), (1, "a", 6), (1, "a", 7), (3, "b", 8)], "doc_id int, text string, x int").selectExpr("*", "map('k', x) AS m", "x AS __h", "x AS __text", "x AS __first", "x AS no_id", "x AS h", "x AS keep_id")
    kept = exact.keep_first_copies(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted((r.doc_id, r.x, r.m["k"]) for r in kept.collect()) == [(1, 6, 6), (3, 8, 8)]
    assert {(r.doc_id, r.keep_id, r.n_copies) for r in exact.exact_duplicates(df).collect()} == {(1, 1, 3), (2, 1, 3)}
