import random

import pytest

from graphloom.llm import toxicity

SCHEMA = "doc_id long, text string, score double, toxic int"
LABELS = "doc_id long, toxic int, text string"
NEUTRAL = "the report describes how people live work travel and read in the city near a river with many old bridges every summer".split()
INSULTS = ["wretchling", "scumgrub", "vilespawn", "dunderfool"]
GROUPS = ["muslim", "jewish", "gay", "christian", "immigrant", "black"]


def corpus(seed=0, n=600):
    """Insults make a text toxic; groups are mostly named in toxic texts, so a plain classifier would blame the names."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(NEUTRAL) for _ in range(rng.randrange(10, 60))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        if rng.random() < (0.9 if toxic else 0.05):
            words.insert(rng.randrange(len(words)), rng.choice(GROUPS[:4]))
        docs.append((i, " ".join(words), 0.0, 0))
        if i % 2:
            labels.append((i, int(toxic), "t"))
    return docs, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus()
    truth = {i: any(w in t for w in INSULTS) for i, t, _, _ in docs}
    neutral = [(10_000 + k, " ".join(NEUTRAL[:8] + [g] + NEUTRAL[8:]), 0.0, 0) for k, g in enumerate(GROUPS)]
    df, known = spark.createDataFrame(docs + neutral, SCHEMA), spark.createDataFrame(labels, LABELS)
    found = {r.doc_id for r in toxicity.toxic_documents(df, known).collect()}
    held = [i for i in truth if i % 2 == 0]
    right = sum((i in found) == truth[i] for i in held)
    assert right >= 0.97 * len(held)
    assert not found & {i for i, *_ in neutral}
    model = toxicity.fit(df, known)
    from graphloom.llm.common import Words
    import pyarrow as pa

    plain = toxicity.fit(df, known, penalty=0.0)
    gap = lambda m: abs(m.scores(Words(pa.array([neutral[0][1]])))[0] - m.scores(Words(pa.array([" ".join(NEUTRAL)])))[0])
    assert gap(model) <= 0.02 and gap(model) <= gap(plain)


def test_edge_cases(spark):
    docs, labels = corpus(1, 200)
    odd = [(None, "wretchling scumgrub", 0.0, 0), (900, None, 0.0, 0), (901, "", 0.0, 0), (902, "calm river " * 50_000, 0.0, 0), docs[1], docs[1]]
    df = spark.createDataFrame(docs + odd, SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1, "t"), (5, None, "t"), (7, 1, "t"), (7, 0, "t"), (10**6, 1, "t")], LABELS)
    kept = toxicity.drop_toxic(df, known)
    assert kept.columns == df.columns and {900, 901, 902} <= {r.doc_id for r in kept.collect()}
    assert toxicity.toxic_documents(df, known.limit(0)).count() == 0
    assert toxicity.toxic_documents(df, known.withColumn("toxic", known.toxic * 0)).count() == 0
    assert toxicity.toxic_documents(df.limit(0), known).count() == 0
    assert toxicity.drop_toxic(df, known.limit(0)).count() == df.count()


@pytest.mark.parametrize("n_toxic,n_clean", [(10, 10), (90, 10)])
def test_labels_that_no_feature_stands_out_in(spark, n_toxic, n_clean):
    rng = random.Random(4)
    plain = [w for w in NEUTRAL if w != "old"]  # a name of a group, so a feature by itself
    text = lambda toxic: " ".join([rng.choice(plain) for _ in range(20)] + ["wretchling"] * toxic)
    docs = [(i, text(i < n_toxic), 0.0, 0) for i in range(n_toxic + n_clean)] + [(900, None, 0.0, 0), (901, "", 0.0, 0), (902, "calm river", 0.0, 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame([(i, int(i < n_toxic), "t") for i in range(n_toxic + n_clean)], LABELS)
    assert toxicity.toxic_documents(df, known).count() == 0
    assert toxicity.drop_toxic(df, known).count() == len(docs)


def test_a_text_without_weighted_features_is_never_toxic(spark, monkeypatch):
    docs, labels = corpus(2, 200)
    monkeypatch.setattr(toxicity, "best_threshold", lambda scores, toxic: 0.0)
    df, known = spark.createDataFrame(docs + [(900, None, 0.0, 0), (901, "", 0.0, 0)], SCHEMA), spark.createDataFrame(labels, LABELS)
    assert {900, 901} <= {r.doc_id for r in toxicity.drop_toxic(df, known).collect()}


@pytest.mark.parametrize("size", ["0.1"])
def test_labels_of_the_test_tables(spark, size):
    folder = f"/root/testdata/sf{size}"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    fit = spark.createDataFrame([(i, t, "x") for i, t in truth.items() if i % 3], LABELS)
    found = {r.doc_id for r in toxicity.toxic_documents(docs, fit).collect()}
    held = {r.doc_id for r in docs.select("doc_id").collect()} & {i for i in truth if i % 3 == 0}
    hits = sum(truth[i] for i in held & found)
    print("precision", hits / max(1, len(held & found)), "recall", hits / max(1, sum(truth[i] for i in held)))
    assert hits >= 0.8 * len(held & found) and hits >= 0.8 * sum(truth[i] for i in held)


def test_more_features_than_fit_a_dense_matrix(spark):
    """Many words that stand out: each is looked at, and the fit holds only those that it selects."""
    rng = random.Random(6)
    kinds = [f"q{i}z" for i in range(6000)]
    docs = [(i, " ".join([rng.choice(NEUTRAL) for _ in range(20)] + (["wretchling"] + [w for w in kinds if rng.random() < 0.25]) * (i % 2 == 0)), 0.0, 0) for i in range(240)]
    df = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame([(i, int(i % 2 == 0), "t") for i in range(240)], LABELS)
    assert {r.doc_id for r in toxicity.toxic_documents(df, known).collect()} == set(range(0, 240, 2))


def test_sparse_gram():
    import numpy as np

    rng = np.random.default_rng(0)
    dense = (rng.random((2500, 7)) < 0.3) * rng.choice([-1.0, 1.0], (2500, 7))
    row, col = np.nonzero(dense)
    weight = rng.random(2500)
    assert np.allclose(toxicity._gram(row, col, dense[row, col], weight, 7), (dense * weight[:, None]).T @ dense)


def test_clashing_names_and_kinds_of_ids(spark):
    docs, labels = corpus(3, 200)
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("CAST(doc_id AS int) AS doc_id", "text", "score", "toxic", "map('a', 1) AS m", "1 AS c0", "2 AS feature")
    known = spark.createDataFrame(labels, LABELS)
    kept = toxicity.drop_toxic(df, known)
    assert kept.schema == df.schema and 0 < kept.count() < df.count()
