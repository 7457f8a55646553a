import random
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import minhash
from graphloom.llm.common import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_the_full_table():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randrange(40))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        d = distance(a, b)
        for limit in (0, 1, 3, 9, 60):
            assert minhash.edit_distance(np.array(a, int), np.array(b, int), limit) == min(d, limit + 1)


def make_families(n_families=40, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs, family = {}, {}
    for f in range(n_families):
        n = rng.choice([8, 20, 45, 60, 150, 400])
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(rng.choice([1, 2, 3, 6])):
            words = list(base)
            for _ in range(int(len(words) * rng.uniform(0, 0.12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            family[len(docs)] = f
            docs[len(docs)] = " ".join(words)
    return docs


def groups_of(rows):
    found = defaultdict(set)
    for r in rows:
        found[r.group_id].add(r.doc_id)
    return found


def test_groups_against_all_pairs(spark):
    docs = make_families()
    words = {i: t.split() for i, t in docs.items()}
    pairs = {(a, b) for a in docs for b in docs if a < b and distance_within(words[a], words[b])}
    rows = minhash.near_duplicate_groups(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], SCHEMA)).collect()
    group = {r.doc_id: r.group_id for r in rows}
    hit = sum(a in group and group.get(a) == group.get(b) for a, b in pairs)
    assert len(pairs) > 60 and hit >= 0.9 * len(pairs)
    for root, members in groups_of(rows).items():  # every member is linked to another one of its group
        assert root == min(members) and len(members) > 1
        assert all(any(tuple(sorted((m, o))) in pairs for o in members - {m}) for m in members)


def distance_within(a, b):
    limit = int(0.2 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= limit and distance(a, b) <= limit


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "", None, None, None), (None, "one two three four", "en", "s", 3),
        (4, "one two three four", "en", "s", 3), (5, "one two three four", "en", "s", 3), (5, "one two three four", "en", "s", 3),
        (6, long, "en", "s", 9), (7, long.replace("t77 ", "other "), "en", "s", 9), (8, "Hi", "en", "s", 2), (9, "hi", "en", "s", 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS sketches", "3 AS words", "4 AS a", "5 AS root")
    got = {(r.doc_id, r.group_id) for r in minhash.near_duplicate_groups(df).collect()}
    assert got == {(4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8)}
    kept = minhash.keep_one_of_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, i) for i in (1, 2, 3, 4, 6, 8)]
    assert kept.filter("doc_id IS NULL").count() == 1
    assert minhash.near_duplicate_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 20, 45, 60, 64, 100, 300, 1000])
@pytest.mark.parametrize("band", [(0.80, 0.82), (0.82, 0.85)])
def test_recall_of_scattered_replacements(n, band):
    counts = [k for k in range(n) if band[0] - 1e-9 <= 1 - k / n < band[1] - 1e-9]
    if not counts:
        pytest.skip("no number of replaced words lies in the band")
    rng, hits = np.random.default_rng(n), 0
    for _ in range(200):
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        at = rng.choice(n, max(counts), replace=False)
        b[at] = rng.integers(1, 1 << 62, len(at)).astype(np.uint64)
        hits += bool(np.isin(minhash.text_sketches(a), minhash.text_sketches(b)).any())
    assert hits >= 0.9 * 200


def test_recall_when_only_one_text_is_short():
    rng, hits = np.random.default_rng(2), 0
    for _ in range(200):
        a = rng.integers(1, 1 << 62, 70).astype(np.uint64)
        b = np.delete(a, rng.choice(70, 14, replace=False))
        hits += bool(np.isin(minhash.text_sketches(a), minhash.text_sketches(b)).any())
    assert hits >= 0.9 * 200


def test_sketch_order_matters():
    import pyarrow as pa

    words = [f"a{i}" for i in range(200)]
    swapped = words[100:] + words[:100]
    a, b, c = (Words(pa.array([" ".join(x)])).hashes for x in (words, swapped, words[:190] + ["z"] * 10))
    same = lambda x, y: np.isin(minhash.text_sketches(x), minhash.text_sketches(y)).mean()
    assert same(a, a) == 1 and same(a, c) > same(a, b)


@pytest.mark.parametrize("size", ["0.001"])
def test_recall_on_the_test_tables(spark, size):
    rows = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet").select("doc_id", "text").collect()
    import pyarrow as pa

    words = Words(pa.array([r.text for r in rows]))
    own = {r.doc_id: words.hashes[a:b].astype(np.int64) for r, a, b in zip(rows, words.bounds[:-1], words.bounds[1:], strict=True)}
    ids = [i for i in own if len(own[i])]
    pairs = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            most, least = max(len(own[a]), len(own[b])), min(len(own[a]), len(own[b]))
            limit = int(0.2 * most + 1e-9)
            if most - least <= limit and minhash.edit_distance(own[a], own[b], limit) <= limit:
                pairs.append((a, b))
    group = {r.doc_id: r.group_id for r in minhash.near_duplicate_groups(spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")).collect()}
    hit = sum(a in group and group.get(a) == group.get(b) for a, b in pairs)
    assert pairs and hit >= 0.9 * len(pairs), (hit, len(pairs))
    assert set(group) <= {i for p in pairs for i in p}


def test_banded_alignment_of_longer_texts():
    rng = random.Random(13)
    for _ in range(60):
        k = rng.choice([3, 40, 1000])
        a = [rng.randrange(k) for _ in range(rng.randrange(300))]
        b = list(a) if rng.random() < 0.8 else [rng.randrange(k) for _ in range(rng.randrange(300))]
        for _ in range(rng.randrange(90)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = [rng.randrange(k)] * rng.randrange(3)
        d = distance(a, b)
        for limit in (31, 32, 33, 64, 100, 400):
            assert minhash.edit_distance(np.array(a, int), np.array(b, int), limit) == min(d, limit + 1)


@pytest.mark.parametrize("frequent", [0, 50])
def test_similar_texts_share_a_rare_word(frequent):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    common = np.sort(minhash._labelled(pa.scalar(rng.integers(1, 1 << 62, 60).astype(np.uint64).tobytes(), pa.binary())))[:frequent]
    place = rng.permutation(len(common))
    for _ in range(300):
        n = int(rng.integers(3, 80))
        a = rng.integers(1, 60, n).astype(np.uint64)
        b, limit = a.copy(), int(0.2 * n + 1e-9)
        b[rng.choice(n, limit, replace=False)] = rng.integers(100, 200, limit)
        b = np.delete(b, rng.choice(n, int(rng.integers(0, 1 + limit // 3)), replace=False)) if rng.random() < 0.5 else b
        if minhash.edit_distance(a.astype(int), b.astype(int), int(0.2 * max(len(a), len(b)) + 1e-9)) > int(0.2 * max(len(a), len(b)) + 1e-9):
            continue
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["id", "words"])
        (out,) = minhash._rare_words([batch], common, place, 0.8)
        of = [set(out.column("token").filter(pa.array(out.column("id").to_numpy() == i)).to_pylist()) for i in (0, 1)]
        assert of[0] & of[1]


def test_hot_sketches_lose_no_pair(spark, monkeypatch):
    docs = make_families(25, 8)
    part = " ".join(f"licence{i}" for i in range(300))
    rng = random.Random(1)
    more = {1000 + i: f"{part} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(120)) for i in range(30)}
    more |= {2000 + i: t.replace("licence7 ", "other ") for i, t in enumerate(list(more.values())[:10])}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in (docs | more).items()], SCHEMA)
    cool = {(r.doc_id, r.group_id) for r in minhash.near_duplicate_groups(df).collect()}
    monkeypatch.setattr(minhash, "HOT", 2)
    assert {(r.doc_id, r.group_id) for r in minhash.near_duplicate_groups(df).collect()} == cool
    assert {(2000 + i, 1000 + i) for i in range(10)} <= cool


def test_clashing_names_and_kinds_of_ids(spark):
    df = spark.createDataFrame([(1, "one two three four five", 7), (2, "one two three four five", 8), (None, "x", 9)], "doc_id int, text string, x int")
    wide = df.selectExpr("*", "x AS __gone", "x AS gone", "map('a', x) AS m", "x AS n", "x AS least", "x AS bucket", "x AS token")
    kept = minhash.keep_one_of_group(wide)
    assert kept.schema == wide.schema and sorted(r.x for r in kept.collect()) == [7, 9]
    with pytest.raises(ValueError, match="doc_id"):
        minhash.near_duplicate_groups(df.selectExpr("CAST(doc_id AS string) AS doc_id", "text"))
