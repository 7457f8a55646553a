import corpus_pipeline
from graphloom.llm import decontaminate, exact, minhash, toxicity
from graphloom.llm.packing import END_ID


def test_stages_chain_and_take_effect(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    texts = spark.read.parquet(f"{folder}/documents.parquet")
    gone = {r.doc_id for r in toxicity.toxic_documents(texts, labels).collect()}
    assert ids[0] - ids[1] == gone
    left = texts.filter(~texts.doc_id.isin(list(gone)) if gone else "true")
    copies = {r.doc_id for r in exact.exact_duplicates(left).collect() if r.doc_id != r.keep_id}
    assert ids[1] - ids[2] == copies
    left = left.filter(~left.doc_id.isin(list(copies)))
    near = {r.doc_id for r in minhash.near_duplicate_groups(left).collect() if r.doc_id != r.group_id}
    assert ids[2] - ids[3] == near
    left = left.filter(~left.doc_id.isin(list(near)))
    assert ids[3] - ids[4] == {r.doc_id for r in decontaminate.contaminated_documents(left, benchmark).collect()}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {d for r in rows for d in r.doc_ids} == {r.doc_id for r in docs.filter("text <> ''").collect()}
    assert all(r.n_tokens > 0 and len(r.ids) == 2 * 2048 for r in rows) and END_ID == 50256


def test_no_documents(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_odd_rows(spark, tmp_path):
    """NULL ids and texts, empty, tied and repeated rows, clashing names and maps, through every stage as it is run."""
    folder = "/root/testdata/sf0.001"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "no id " + text), (None, None), (1, None), (2, ""), (3, text), (3, text), (4, text + " more"), (5, "short"), (6, "short"), (7, "x " * 30_000), (8, "other words stand here")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", *[f"1 AS {c}" for c in ("__found", "__gone", "gone", "c0", "n", "key", "place", "toxic", "item_id")], "map('a', 1) AS m")
    schema = docs.schema.simpleString()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        found.write.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.schema.simpleString() == schema, name
            docs = spark.read.parquet(str(tmp_path / str(k)))
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(i for i, _ in left if i) == [1, 2, 3, 5, 7, 8] and sum(i is None for i, _ in left) == 2
    packed = {d for r in spark.read.parquet(str(tmp_path / "4")).collect() for d in r.doc_ids}
    assert packed == {None, 3, 5, 7, 8}
