import random
import re
from collections import Counter
from functools import partial

import pyarrow as pa
import pytest

from graphloom.llm import automata, suffixes
from graphloom.llm.common import WORD_PATTERN

DOCS = "doc_id long, text string, lang string"


def brute(docs, n):
    words = [(i, re.findall(WORD_PATTERN, (t or "").lower())) for i, t in docs]
    seen = Counter(tuple(w[k : k + n]) for _, w in words for k in range(len(w) - n + 1))
    covered = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                covered.setdefault(i, set()).add(k)
    out = set()
    for i, starts in covered.items():
        begin = last = None
        for k in sorted(starts):
            if last is not None and k <= last + n:
                last = k
            else:
                if last is not None:
                    out.add((i, begin, last + n))
                begin = last = k
        out.add((i, begin, last + n))
    return out


def corpus(seed, n=50):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "Ünder"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(k)] for k in (n - 1, n, n + 1, n + 3, 80, 200)] + [["ha"] * 120]
    docs = []
    for i in range(50):
        text = [word() for _ in range(rng.choice([0, 3, 60, 300]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = passages[rng.randrange(len(passages))]
        docs.append((i, ", ".join(text)))
    return docs + [(100, docs[3][1]), (101, docs[3][1]), (102, docs[7][1].upper())]


OPERATORS = {
    "automata": automata.repeated_passages,
    "suffixes": suffixes.repeated_suffixes,
    "suffixes, three rounds": lambda df: suffixes.repeated_suffixes(df, first_words=6, anchor_words=5),
    "suffixes from one word": lambda df: suffixes.repeated_suffixes(df, first_words=1),
    "suffixes from 13 words": lambda df: suffixes.repeated_suffixes(df, first_words=13),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_against_brute_force(spark, name):
    docs = corpus(4)
    got = {(r.doc_id, r.start_word, r.end_word) for r in OPERATORS[name](spark.createDataFrame([(i, t, "en") for i, t in docs], DOCS)).collect()}
    want = brute(docs, 50)
    assert got == want and len(want) > 20


@pytest.mark.parametrize("name", ["automata", "suffixes"])
def test_edge_cases(spark, name):
    long = " ".join(f"t{i}" for i in range(40000))
    part = " ".join(f"t{i}" for i in range(500, 551))
    rows = [(1, None, None), (2, "", "en"), (None, part, "en"), (3, part, "en"), (4, long, "en"), (5, "a b c", "en"), (6, "z " * 49, "en"), (7, "y " * 50, "en"), (8, "x " * 51, "en"), (9, part + " q", "en"), (9, part + " q", "en")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS anchor", "2 AS key", "3 AS anchors", "4 AS start", "5 AS low")
    got = {(r.doc_id, r.start_word, r.end_word) for r in OPERATORS[name](df).collect()}
    assert got == {(3, 0, 51), (4, 500, 551), (8, 0, 51), (9, 0, 52)}
    assert OPERATORS[name](df.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_one_id_for_several_texts(spark, name):
    docs = [(1, " ".join(f"a{i}" for i in range(70))), (1, "b " + " ".join(f"a{i}" for i in range(60))), (1, "short"), (2, " ".join(f"c{i}" for i in range(300)))]
    docs += [(3, docs[3][1])] * 3 + [(2, " ".join(f"d{i}" for i in range(200)))]
    got = {(r.doc_id, r.start_word, r.end_word) for r in OPERATORS[name](spark.createDataFrame([(i, t, "en") for i, t in docs], DOCS)).collect()}
    assert got == {(1, 0, 61), (2, 0, 300), (3, 0, 300)}


def test_ranks_and_pairs_across_batches():
    """Streams cut anywhere give what one batch gives."""
    rng = random.Random(6)
    pairs = sorted((rng.randrange(6), rng.randrange(6)) for _ in range(60))
    rows = [(i // 9, i % 9, *p) for i, p in enumerate(pairs)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "at", "low", "high"])
    several = [p for p in pairs if pairs.count(p) > 1]
    places = sorted((d, at, d * 9 + at) for d in range(5) for at in range(30) if rng.random() < 0.9)
    stream = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*places, strict=True)], ["doc_id", "at", "rank"])
    known = {(d, at): r for d, at, r in places}
    for size in (1, 2, 3, 7, 60):
        cut = lambda b: (b.slice(i, size) for i in range(0, b.num_rows, size))  # noqa: E731, B023
        got = [tuple(r.values()) for b in suffixes._ranked_from(cut(batch), 0) for r in b.to_pylist()]
        assert [pairs[d * 9 + at] for d, at, _ in got] == several
        assert all((x[2] == y[2]) == (p == q) for x, p in zip(got, several, strict=True) for y, q in zip(got, several, strict=True))
        got = {(r["doc_id"], r["at"]): (r["low"], r["high"]) for b in suffixes._paired(cut(stream), 3) for r in b.to_pylist()}
        assert all(got[k] == (known[k], known[k[0], k[1] + 3]) for k in got)
        assert set(got) >= {(d, at) for d, at in known if all((d, at + k) in known for k in range(4))}


def streamed(df, drop=lambda automata: automata):
    """Spans, and how many texts went through the automata, as one task works on one shard."""
    seen = []
    with pytest.MonkeyPatch.context() as m:
        compiled, occurrences = automata.compiled, automata.occurrences
        m.setattr(automata, "compiled", lambda phrases: drop(compiled(phrases)))
        m.setattr(automata, "occurrences", lambda words, *a: seen.append(len(words)) or occurrences(words, *a))
        found = [b for b in automata._located_windows(iter(df), 50, automata.ANCHOR_WORDS)]
    return sum(seen), sum(b.num_rows for b in found)


def test_the_automata_do_the_locating(spark, monkeypatch):
    docs = corpus(4)
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], DOCS)
    phrases = {r.what for r in automata.recurring_anchors(automata.pick_documents(df), what=partial(automata.packed_phrases, anchor_words=automata.ANCHOR_WORDS), kind="binary").collect()}
    assert len(phrases) > 20 and all(len(p) == 3 * automata.ANCHOR_WORDS for p in phrases)
    rows = [(0, bytes(p), None, None) for p in phrases] + [(1, None, i, t) for i, t in docs]
    kind, phrase, ids, texts = zip(*rows, strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(phrase, pa.binary()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["kind", "phrase", "doc_id", "text"])
    whole = streamed([batch.slice(0, 10), batch.slice(10)])
    assert whole[0] == len(docs)
    monkeypatch.setattr(automata, "AUTOMATON_PHRASES", 10)
    assert streamed([batch]) == whole
    for k in range(len(automata.compiled(phrases))):
        assert streamed([batch], lambda a, k=k: a[:k] + a[k + 1 :])[1] < whole[1]
    assert streamed([batch], lambda a: [])[1] == 0


def test_what_stands_nearly_everywhere(spark):
    part = " ".join(f"t{i}" for i in range(60))
    docs = [(i, f"a{i} {part} b{i}") for i in range(300)] + [(1000, " ".join(f"t{i}" for i in range(5, 56)))]
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], DOCS)
    for name in OPERATORS:
        got = {(r.doc_id, r.start_word, r.end_word) for r in OPERATORS[name](df).collect()}
        assert got == {(i, 1, 61) for i in range(300)} | {(1000, 0, 51)}, name
    keys = Counter(r.key for r in automata.located_windows(df).collect())
    assert max(keys.values()) < 20
