"""Operator 7, benchmark decontamination: BM25 inverted index of the test items, block-max WAND, overlap check.

Every test item is a document of a small index; every passage of every training document is a query.  Impacts are
divided by the item's score for its own text, so a score is the share of the item that a passage has, 0 to 1, with
rare words weighing more.  Passages overlap by half and are at least twice as long as the item, so each place where
it can stand lies within one passage.  Items of up to 64 words have passages of 128, those of up to 128 words
passages of 256, and so on: what is found of an item does not depend on the other items, nor on how they are dealt.

WAND's pivot test, that only an item whose lists' maxima reach the threshold can be a result, is first made for all
passages of a slice at once.  Of each item, the words most frequent in the corpus are set aside as long as their impacts
sum to less than ``ASIDE`` of the threshold; a passage at or above the threshold must make up the rest with the item's
other words, which are rare.  Passages in which some item passes are searched by block-max WAND one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Words, pick, pick_documents, slices, without_ids

PASSAGE_WORDS = 128
THRESHOLD = 0.5
MIN_QUESTION = 0.5
MIN_ANSWER = 0.5
#: Items whose index is sent to the tasks at once; more items make several indexes, one pass over the documents each.
INDEX_ITEMS = 20_000
#: Words up to which a part may have one edit: of longer ones half of the runs of 3 words outlast it.
SHORT = 7
K1, B = 1.2, 0.75
BLOCK = 16
#: Share of the threshold that an item's frequent words may make up without being looked at in the first test.
ASIDE = 0.7
_SENTENCE = r"(?s)^(.*[.?!])\s+(\S.*)$"


class Index:
    """Postings by term with impacts, their maxima by block and by list, and the items' words for the last check."""

    def __init__(self, item_ids: list[int], questions: list[np.ndarray], answers: list[np.ndarray], df: dict[int, int], n_items: int, mean_length: float):
        self.item_ids, self.questions, self.answers = item_ids, questions, answers
        lists: dict[int, list[tuple[int, float]]] = {}
        longest = 1
        for i, (q, a) in enumerate(zip(questions, answers, strict=True)):
            words, tf = np.unique(np.concatenate((q, a)), return_counts=True)
            length = int(tf.sum())
            longest = max(longest, length)
            n = np.array([df[w] for w in words.tolist()], float)
            idf = np.log1p((n_items - n + 0.5) / (n + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
            for w, x in zip(words.tolist(), (impact / impact.sum()).tolist(), strict=True):
                lists.setdefault(w, []).append((i, x))
        self.terms = np.array(sorted(lists), np.uint64)
        self.postings = [([i for i, _ in lists[t]], [x for _, x in lists[t]]) for t in self.terms.tolist()]
        self.most = np.array([max(x) for _, x in self.postings])
        self.block_last = [[ids[min(at + BLOCK, len(ids)) - 1] for at in range(0, len(ids), BLOCK)] for ids, _ in self.postings]
        self.block_most = [[max(x[at : at + BLOCK]) for at in range(0, len(x), BLOCK)] for _, x in self.postings]
        self.of_term = np.repeat(np.arange(len(self.postings)), [len(ids) for ids, _ in self.postings])
        self.of_item = np.array([i for ids, _ in self.postings for i in ids], np.int64)
        self.impact = np.array([x for _, xs in self.postings for x in xs])
        self.passage_words = passage_words(longest)
        self._low: np.ndarray | None = None

    def low(self) -> np.ndarray:
        """Which upper 18 bits the terms have; most words that are no terms are told by it."""
        if self._low is None:
            self._low = np.zeros(1 << 18, bool)
            self._low[(self.terms >> np.uint64(46)).astype(np.int64)] = True
        return self._low

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that the distinct ``terms`` score at least ``threshold`` for: block-max WAND."""
        floor = threshold - 1e-9
        cursors = [[self.postings[t][0][0], t, 0] for t in terms]
        found = []
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, reach = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for _, t, _ in cursors[: pivot + 1]:
                block = bisect_left(self.block_last[t], item)
                if block < len(self.block_last[t]):
                    bound += self.block_most[t][block]
                    reach = min(reach, self.block_last[t][block] + 1)
            if bound >= floor:
                if cursors[0][0] == item:
                    score = sum(self.postings[t][1][at] for _, t, at in cursors[: pivot + 1])
                    if score >= floor:
                        found.append((item, score))
                    target, moved = item + 1, cursors[: pivot + 1]
                else:
                    target, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            else:  # no item before the next block, or the next list, can reach the threshold
                target, moved = max(reach, item + 1), cursors[: pivot + 1]
            for c in moved:
                ids = self.postings[c[1]][0]
                c[2] = bisect_left(ids, target, c[2])
                c[0] = ids[c[2]] if c[2] < len(ids) else -1
            cursors = [c for c in cursors if c[0] >= 0]


class Gate:
    """The test that a passage's terms let some item reach the threshold; no passage that does is left out.

    Which words of an item are frequent is counted in the passages seen so far, and settled again whenever these have
    doubled.  It only says how many passages pass in vain.
    """

    def __init__(self, index: Index, threshold: float):
        self.index, self.floor = index, threshold - 1e-9
        self.seen, self.due = np.zeros(len(index.terms), np.int64), 0

    def passages(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The passages, of distinct (passage, term) pairs, that may score an item at least the threshold."""
        index, n_items = self.index, len(self.index.item_ids)
        self.seen += np.bincount(term, minlength=len(self.seen))
        if self.seen.sum() >= self.due:
            self._settle()
            self.due = 2 * self.seen.sum()
        n = np.diff(self.begin)[term]
        some = np.flatnonzero(n)
        n = n[some]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        posting = self.rare[np.repeat(self.begin[term[some]], n) + place]
        pair = np.repeat(passage[some], n) * n_items + index.of_item[posting]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else pair
        score = np.add.reduceat(index.impact[posting][order], first) if len(pair) else np.zeros(0)
        pair = pair[first]
        return np.unique(pair[score >= self.floor - self.aside[pair % n_items] - 1e-9] // n_items)

    def _settle(self) -> None:
        index = self.index
        order = np.lexsort((-self.seen[index.of_term], index.of_item))
        item, sums = index.of_item[order], np.cumsum(index.impact[order])
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        sums -= np.repeat(np.append(0, sums[first[1:] - 1]), np.diff(np.append(first, len(item))))
        rare = sums >= ASIDE * self.floor
        self.aside = np.bincount(item[~rare], index.impact[order[~rare]], len(index.item_ids))
        self.rare = np.sort(order[rare])
        self.begin = np.searchsorted(index.of_term[self.rare], np.arange(len(index.terms) + 1))


def passage_words(longest: int) -> int:
    """The length of the passages in which items of up to ``longest`` words are looked for."""
    return PASSAGE_WORDS << max(0, (max(longest, 1) * 2 - 1) // PASSAGE_WORDS).bit_length()


def word_grams(words: np.ndarray, n: int) -> set[tuple[int, ...]]:
    values = words.tolist()
    return {tuple(values[i : i + n]) for i in range(len(values) - n + 1)}


def overlap(part: np.ndarray, text: np.ndarray) -> float:
    """The share of the part's runs of 3 words, or fewer if it is shorter, that the text has; 1 for an empty part.

    One edit can break all runs of a part of 3 to ``SHORT`` words, so one that the text has but for a word changed,
    missing or put in has a share of all its words but one at least.
    """
    n = min(3, len(part))
    if not n:
        return 1.0
    mine = word_grams(part, n)
    share = len(mine & word_grams(text, n)) / len(mine)
    if 3 <= len(part) <= SHORT and share < (least := 1 - 1 / len(part)) and _one_edit(part, text):
        return least
    return share


def _one_edit(part: np.ndarray, text: np.ndarray) -> bool:
    """Whether the part stands in the text with at most one word changed, missing or put in."""
    n, m = len(part), len(text)
    same = np.zeros((n, m + n + 2), bool)
    same[:, :m] = part[:, None] == text[None, :]

    def run(first: int, last: int, shift: int) -> np.ndarray:
        """For each place of the text, whether the part's words ``first`` to ``last`` stand from ``shift`` words on."""
        found = np.ones(m + 1, bool)
        for k in range(first, last):
            at = shift + k - first
            found &= same[k, at : at + m + 1]
        return found

    return any(
        (run(0, k, 0) & (run(k + 1, n, k + 1) | run(k + 1, n, k) | (run(k, n, k + 1) if k else False))).any() for k in range(n)
    )


def answer_overlap(question: np.ndarray, answer: np.ndarray, text: np.ndarray) -> float:
    """The overlap of the answer, or if that is higher, of one of less than 4 words with the words before it."""
    found = overlap(answer, text)
    if 0 < len(answer) < 4 and found < 1:
        found = max(found, overlap(np.concatenate((question[len(question) - min(len(question), 4 - len(answer)) :], answer)), text))
    return found


def _search(batches: Iterator[pa.RecordBatch], indexes: list[Index], threshold: float, min_question: float, min_answer: float) -> Iterator[pa.RecordBatch]:
    gates = [Gate(index, threshold) for index in indexes]
    for batch in batches:
        rows: list[tuple] = []
        for part in slices(batch):
            words = Words(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            for gate in gates:
                found = _found(words, gate, threshold, min_question, min_answer)
                rows += [(ids[doc], gate.index.item_ids[item], *x) for (doc, item), x in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "first_word", "question_overlap", "answer_overlap"])


def _found(words: Words, gate: Gate, threshold: float, min_question: float, min_answer: float) -> dict[tuple[int, int], tuple]:
    """By text and item, the best passage: score, first word, overlap of question and answer."""
    index = gate.index
    size, n_terms = index.passage_words, len(index.terms)
    half = size // 2
    maybe = np.flatnonzero(index.low()[(words.hashes >> np.uint64(46)).astype(np.int64)])
    term = np.searchsorted(index.terms, words.hashes[maybe])
    term[term == n_terms] = 0
    hit = index.terms[term] == words.hashes[maybe]
    at, term = maybe[hit], term[hit]
    text = words.text_of_word()[at]
    # Passage p of a text has its words p * half to p * half + size; passages are numbered over all texts.
    counts = np.maximum(1, -(-(np.diff(words.bounds) - half) // half))
    first = np.cumsum(counts) - counts
    step = (at - words.bounds[text]) // half
    upper = first[text] + np.minimum(step, counts[text] - 1)
    lower = np.where((step > 0) & (step - 1 < counts[text]), first[text] + step - 1, -1)
    key = np.unique(np.concatenate((upper * n_terms + term, (lower * n_terms + term)[lower >= 0])))
    passage, term = key // n_terms, key % n_terms
    best: dict[tuple[int, int], tuple] = {}
    searched = gate.passages(passage, term)
    spans = np.searchsorted(passage, searched), np.searchsorted(passage, searched, side="right")
    for p, begin, end in zip(searched.tolist(), *(x.tolist() for x in spans), strict=True):
        doc = int(np.searchsorted(first, p, side="right")) - 1
        start = int(words.bounds[doc] + (p - first[doc]) * half)
        stop = int(min(start + size, words.bounds[doc + 1]))
        for item, score in index.search(term[begin:end].tolist(), threshold):
            here = words.hashes[start:stop]
            q, a = overlap(index.questions[item], here), answer_overlap(index.questions[item], index.answers[item], here)
            if q >= min_question and a >= min_answer:
                old = best.get((doc, item))
                if old is None or score > old[0] + 1e-12:
                    best[doc, item] = score, start - int(words.bounds[doc]), q, a
    return best


def split_items(benchmark: DataFrame) -> DataFrame:
    """``(item_id, question, answer)``: the columns of these names, or ``text`` with its last sentence as the answer.

    An item of one sentence has the last quarter of its words as the answer.  Rows without an id or a text are left
    out; several rows of one id are items of their own.
    """
    if {"question", "answer"} <= set(benchmark.columns):
        return pick(benchmark, item_id="item_id", question="question", answer="answer").filter("item_id IS NOT NULL AND question IS NOT NULL").fillna("", ["answer"])
    items = pick(benchmark, item_id="item_id", text="text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    words = F.split(F.trim("text"), r"\s+")
    tail = F.greatest(F.lit(1), F.floor(F.size(words) / 4)).cast("int")
    one = ~F.col("text").rlike(_SENTENCE)
    return items.select(
        "item_id",
        F.when(one, F.array_join(F.slice(words, F.lit(1), F.size(words) - tail), " ")).otherwise(F.regexp_extract("text", _SENTENCE, 1)).alias("question"),
        F.when(one, F.array_join(F.slice(words, F.size(words) - tail + 1, tail), " ")).otherwise(F.regexp_extract("text", _SENTENCE, 2)).alias("answer"),
    )


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for name in ("question", "answer"):
            w = Words(batch.column(name))
            parts.append(pa.array([w.hashes[a:b].view(np.int64).tolist() for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), *parts], ["item_id", "question", "answer"])


def indexes(benchmark: DataFrame, index_items: int = INDEX_ITEMS) -> Iterator[list[Index]]:
    """The items' indexes of at most about ``index_items`` in all, one for each length of passages.

    Word frequencies and the mean length are those over all items.
    """
    items = split_items(benchmark).select(F.col("item_id").cast("long").alias("item_id"), "question", "answer")
    words = items.mapInArrow(_item_words, "item_id long, question array<long>, answer array<long>").withColumn("n", F.size("question") + F.size("answer")).filter("n > 0")
    n, mean = words.agg(F.count(F.lit(1)), F.avg("n")).first()
    if not n:
        return
    shards = -(-n // index_items)
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    terms = words.select(shard.alias("shard"), F.explode(F.array_distinct(F.concat("question", "answer"))).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    unsigned = lambda x: np.array(x, np.int64).view(np.uint64)
    for k in range(shards):
        mine = words.filter(shard == k).orderBy("item_id", "question", "answer").collect()
        if not mine:
            continue
        own = terms.filter(F.col("shard") == k).select("term").distinct() if shards > 1 else None
        rows = (df.join(own, "term") if own is not None else df).collect()
        frequency = dict(zip(unsigned([r.term for r in rows]).tolist(), [r.df for r in rows], strict=True))
        by_length: dict[int, list] = {}
        for r in mine:
            by_length.setdefault(passage_words(r.n), []).append(r)
        yield [
            Index([r.item_id for r in some], [unsigned(r.question) for r in some], [unsigned(r.answer) for r in some], frequency, n, float(mean))
            for _, some in sorted(by_length.items())
        ]


def contaminated_documents(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER, index_items: int = INDEX_ITEMS
) -> DataFrame:
    """``(doc_id, item_id, score, first_word, question_overlap, answer_overlap)`` for each item found in a document.

    The best passage is given, the first of equal ones.  Every passage is a query and all items of at least
    ``threshold`` are looked at; of these, at least ``min_question`` of the runs of three words of the item's question
    and ``min_answer`` of its answer must be in the passage.  Parts of 3 to ``SHORT`` words may have one word changed,
    missing or put in; answers of less than 4 words may be checked with the words before them.

    NULL ids, NULL and empty texts give nothing, nor does an empty benchmark.  Rows that repeat an id are searched
    each for itself.  A very long text is searched whole, passage by passage.  Of passages with equal scores the first
    is given; several items in one passage are a row each.  Ids are integers of any width.
    """
    texts = pick_documents(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id long, item_id long, score double, first_word int, question_overlap double, answer_overlap double"
    result = None
    for some in indexes(benchmark, index_items):
        run = partial(_search, indexes=some, threshold=threshold, min_question=min_question, min_answer=min_answer)
        found = texts.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found; all columns are kept, and rows with NULL ids or texts.

    Rows that repeat an id go together.
    """
    return without_ids(docs, contaminated_documents(docs, benchmark).select("doc_id"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
