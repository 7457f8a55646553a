import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import decontaminate as d
from graphloom.llm.common import Words

DOCS = "doc_id long, text string, lang string"


def test_block_max_wand_finds_what_scoring_every_item_finds(monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 3)
    rng = random.Random(2)
    words = [np.array([rng.randrange(60) ** 2 % 97 for _ in range(rng.randrange(4, 30))], np.uint64) for _ in range(80)]
    df = {}
    for w in words:
        for t in set(w.tolist()):
            df[t] = df.get(t, 0) + 1
    index = d.Index(list(range(80)), words, [w[:0] for w in words], df, 80, 16.0)
    for _ in range(150):
        terms = sorted(rng.sample(range(len(index.terms)), min(len(index.terms), rng.randrange(1, 30))))
        for threshold in (0.1, 0.3, 0.6):
            scores = np.zeros(80)
            for t in terms:
                for i, x in zip(*index.postings[t], strict=True):
                    scores[i] += x
            want = {i for i in range(80) if scores[i] >= threshold - 1e-9}
            got = dict(index.search(terms, threshold))
            assert set(got) == want and all(abs(got[i] - scores[i]) < 1e-9 for i in got)


def brute(docs, items):
    """Every passage against every item, by the definition."""
    split = {}
    for i, text in items:
        sentences = text.rsplit(". ", 1)
        split[i] = (sentences[0] + ".", sentences[1])
    hashes = lambda t: Words(pa.array([t])).hashes
    parts = {i: (hashes(q), hashes(a)) for i, (q, a) in split.items()}
    n, mean = len(parts), np.mean([len(q) + len(a) for q, a in parts.values()])
    every = {i: np.concatenate(p).tolist() for i, p in parts.items()}
    df = {}
    for w in every.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    size = max(d.PASSAGE_WORDS, 2 * max(len(w) for w in every.values()))
    found = set()
    for doc, text in docs:
        w = hashes(text)
        for start in range(0, max(1, len(w) - size // 2), size // 2):
            here = w[start : start + size]
            for i, terms in every.items():
                weight = lambda t, terms=terms: (
                    np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * terms.count(t) * (d.K1 + 1) / (terms.count(t) + d.K1 * (1 - d.B + d.B * len(terms) / mean))
                )
                own = sum(weight(t) for t in set(terms))
                score = sum(weight(t) for t in set(terms) & set(here.tolist())) / own
                q, a = parts[i]
                if score >= d.THRESHOLD and d.overlap(q, here) >= d.MIN_QUESTION and d.overlap(a, here) >= d.MIN_ANSWER:
                    found.add((doc, i))
    return found


def test_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40))) + ". " + " ".join(word() for _ in range(4))) for i in range(20)]
    docs = []
    for k in range(60):
        words = [word() for _ in range(rng.choice([5, 90, 400, 900]))]
        if k % 2:
            leak = items[rng.randrange(20)][1].split()
            if k % 3 == 0:
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = leak if k % 5 else leak[: len(leak) // 3]
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id) for r in d.contaminated_documents(df, bench).collect()}
    assert got == want and len(want) > 15
    sharded = {(r.doc_id, r.item_id) for r in d.contaminated_documents(df, bench, index_items=6).collect()}
    assert sharded == want
    kept = {r.doc_id for r in d.drop_contaminated(df, bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in want}


def test_one_edit_in_a_short_answer(spark):
    question = "Which large animal did the stubborn captain hunt across every ocean until his ship was lost at last?"
    texts = {
        "a quiet whale": ["a quiet whale", "a quite whale", "some quiet whale", "a quiet shark", "a very quiet whale", "a whale"],
        "Moby Dick": ["Moby Dick", "Moby Duck", "Mobi Dick"],
        "whale": ["whale", "whalle"],
        "a large white whale": ["a large white whale", "a large wite whale", "a huge white whale"],
        "one of the very large whales": ["one of the vary large whales", "one of very large whales"],
    }
    for answer, copies in texts.items():
        docs = [(i, f"{question} {c} and so on", "en") for i, c in enumerate(copies)] + [(99, "Nothing of this kind stands here", "en")]
        bench = spark.createDataFrame([(1, f"{question} {answer}"), (2, "Other words are asked here? Yes they are")], "item_id long, text string")
        got = {r.doc_id for r in d.contaminated_documents(spark.createDataFrame(docs, DOCS), bench).collect() if r.item_id == 1}
        assert got == set(range(len(copies))), (answer, got)
    words = lambda t: Words(pa.array([t])).hashes
    assert d.overlap(words("a quiet whale"), words("some quiet shark and a dog")) == 0
    assert d.answer_overlap(words(question), words("Moby Dick"), words(question + " Captain Ahab")) < d.MIN_ANSWER


def test_edge_cases(spark):
    leak = "Who wrote the long book about the white whale and the sea. Herman Melville did it in the end"
    rows = [(1, None, None), (2, "", "en"), (None, leak, "en"), (3, leak, "en"), (3, leak, "en"), (4, "x " * 40000 + leak, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS item_id", "2 AS score")
    bench = spark.createDataFrame([(1, leak), (2, None), (None, leak), (3, ""), (4, "word"), (1, leak)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in d.contaminated_documents(df, bench).collect())
    assert set(got) == {(3, 1), (4, 1)}
    assert d.contaminated_documents(df.limit(0), bench).count() == 0
    assert d.contaminated_documents(df, bench.limit(0)).count() == 0
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]


def test_items_do_not_depend_on_each_other(spark):
    rng = random.Random(3)
    word = lambda n=4000: f"w{rng.randrange(n)}"
    text = lambda n: " ".join(word() for _ in range(n))
    question, answer = text(20), text(5)
    items = [(1, f"{question}. {answer}")] + [(k, f"{text(15)}. {text(4)}") for k in range(2, 9)]
    long = [(50, f"{text(150)}. {text(50)}")]
    docs = [(1, f"{text(30)} {question} {text(180)} {answer} {text(40)}", "en"), (2, f"{text(90)} {question} {answer} {text(90)}", "en"), (3, f"{text(300)} {long[0][1]} {text(300)}", "en")]
    df = spark.createDataFrame(docs, DOCS)
    bench = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    found = lambda rows, n=20_000: {(r.doc_id, r.item_id, r.first_word) for r in d.contaminated_documents(df, bench(rows), index_items=n).collect()}
    alone = found(items)
    assert {x[:2] for x in alone} == {(2, 1)}
    for n in (20_000, 3, 2):
        assert {x for x in found(items + long, n) if x[1] != 50} == alone
        assert {x[:2] for x in found(items + long, n)} == {(2, 1), (3, 50)}


def test_the_first_test_lets_every_result_pass(monkeypatch):
    rng = random.Random(8)
    words = [np.array([rng.randrange(60) ** 2 % 97 for _ in range(rng.randrange(4, 30))], np.uint64) for _ in range(40)]
    df = {}
    for w in words:
        for t in set(w.tolist()):
            df[t] = df.get(t, 0) + 1
    index = d.Index(list(range(40)), words, [w[:0] for w in words], df, 40, 16.0)
    for aside in (0.0, 0.7, 1.0):
        monkeypatch.setattr(d, "ASIDE", aside)
        gate = d.Gate(index, 0.5)
        for _ in range(5):
            passages = [sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 30))) for _ in range(100)]
            got = set(gate.passages(np.repeat(np.arange(100), [len(p) for p in passages]), np.concatenate(passages)).tolist())
            want = {k for k, p in enumerate(passages) if index.search(p, 0.5)}
            assert want <= got and len(want) > 10


def test_clashing_names_and_kinds_of_ids(spark):
    leak = "Who wrote the long book about the white whale and the sea. Herman Melville did it in the end"
    bench = spark.createDataFrame([(1, leak)], "item_id int, text string")
    df = spark.createDataFrame([(1, leak, 5), (2, "nothing here", 6), (None, leak, 7)], "doc_id int, text string, x int")
    wide = df.selectExpr("*", "x AS __found", "x AS gone", "map('a', x) AS m")
    kept = d.drop_contaminated(wide, bench)
    assert kept.columns == wide.columns and kept.schema == wide.schema and sorted(r.x for r in kept.collect()) == [6, 7]
    with pytest.raises(ValueError, match="doc_id"):
        d.contaminated_documents(df.selectExpr("CAST(doc_id AS string) AS doc_id", "text"), bench)
