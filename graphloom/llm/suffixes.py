"""Operator 4, suffix-array deduplication by distributed prefix doubling.

Suffixes, one for each word, are sorted by their first k words, then by 2k, and so on: with the ranks by k words known,
the rank by 2k words of the suffix at i is that of the pair (rank at i, rank at i + k).  Spark sorts the pairs over
all machines and ranks them anew.  A suffix that has a rank for itself repeats nothing of that length and drops out;
sorting ends when ranks stand for ``min_words`` words.  Suffixes left share their first ``min_words`` words with
another one, and their union are the repeated passages.

A round has two shuffles: of pairs, by pair, and of the new ranks, by document, so that each task reads the rank k words
on from the same sorted stream.  Pairs are dealt to tasks by hash and sorted there, so ranks say which suffixes begin
alike, and in which order within a task, not between tasks.  A round's ranks are written as a table, and the tables and
shuffle files of the round before are deleted.

Two shortcuts keep the sort small.  Suffixes whose first ``min_words`` words hold an anchor that stands nowhere else
(see ``passages``) drop out before the first round, and the first ranks stand for ``first_words`` words at once, named by
hash.  Equal texts have equal names, which is all that ranks of the first round must have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Words, forget, grams, pick_documents, slices, sweep, table
from graphloom.llm.passages import ANCHOR_WORDS, MIN_WORDS, _repeated, recurring_anchors, spans_of_windows

#: Offsets grow from here: ranks by 13, 26 and then 50 words.
FIRST_WORDS = 13
#: ``at`` has the number of the row among those of its id in the upper half, and of the word in the lower.
_PAIRS = "doc_id long, at long, low long, high long"
_RANKS = "doc_id long, at long, rank long"


def _first_pairs(batches: Iterator[pa.RecordBatch], first: int, offset: int, min_words: int, anchor_words: int) -> Iterator[pa.RecordBatch]:
    """(document, place, name, name ``offset`` words on) of the suffixes that may repeat ``min_words`` words.

    Rows come sorted by document: first its recurring anchors, ``kind`` 0, then its texts.
    """
    more = min_words - first - offset  # later rounds look up ranks so much further on
    doc, copies, anchors = None, 0, np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, kind, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "kind", "key"))
        edges = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids)).tolist()
        rows: list[int] = []
        numbers: list[int] = []
        places: list[np.ndarray] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if ids[a] != doc:
                doc, copies, anchors = ids[a], 0, np.zeros(0, np.int64)
            split = a + int(np.searchsorted(kind[a:b], 1))
            if split > a:
                anchors = np.append(anchors, key[a:split])
            for i in range(split, b):
                if len(anchors):
                    rows.append(i)
                    numbers.append(copies)
                    places.append(anchors)
                copies += 1
        some = batch.select(["text"]).take(pa.array(rows, pa.int64())) if rows else batch.select(["text"]).slice(0, 0)
        done = 0
        for part in slices(some):
            words = Words(part.column("text"))
            names = grams(words.hashes, first).view(np.int64)
            change = np.zeros(len(words.hashes) + 2, np.int32)
            bounds = words.bounds.tolist()
            for text in range(part.num_rows):
                a, last = bounds[text], bounds[text + 1] - min_words
                if last < a:
                    continue
                at = a + places[done + text]
                at = at[at + anchor_words <= bounds[text + 1]]
                np.add.at(change, np.maximum(a, at + anchor_words - min_words), 1)
                np.add.at(change, np.minimum(last, at) + more + 1, -1)
            start = np.flatnonzero(np.cumsum(change) > 0)
            text = words.text_of_word()[start]
            here = slice(done, done + part.num_rows)
            number = np.array(numbers[here], np.int64)[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows[here]][text]), pa.array(number << 32 | start - words.bounds[text]), pa.array(names[start]), pa.array(names[start + offset])],
                ["doc_id", "at", "low", "high"],
            )
            done += part.num_rows


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _ranked_from(batches, TaskContext.get().partitionId() << 40)


def _ranked_from(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """Ranks for sorted pairs: the task's number and the count of different pairs before; single ones are left out."""
    last: tuple[int, int] | None = None
    held: tuple[np.ndarray, ...] | None = None

    def out(columns: tuple[np.ndarray, ...], which: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[which]) for c in columns], ["doc_id", "at", "rank"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, at, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "at", "low", "high"))
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        new[0] = last != (low[0], high[0])
        rank = number + np.cumsum(new)
        number, last = int(rank[-1]), (low[-1], high[-1])
        columns = (ids, at, rank)
        if held is not None:
            columns = tuple(np.concatenate((h, x)) for h, x in zip(held, columns, strict=True))
        rank = columns[2]
        twin = np.zeros(len(rank), bool)
        twin[1:] = rank[1:] == rank[:-1]
        twin[:-1] |= twin[1:]
        # The last row waits for the next batch; if its rank came before, it goes with a second row of the same rank.
        tail = 2 if len(rank) > 1 and rank[-1] == rank[-2] else 1
        ready = twin.copy()
        ready[len(rank) - 1 :] = False
        if held is not None and len(held[0]) == 2:
            ready[0] = False  # already given out
        held = tuple(c[-tail:] for c in columns)
        yield out(columns, ready)
    if held is not None and len(held[0]) == 2:
        yield out(held, np.array([False, True]))


def _paired(batches: Iterator[pa.RecordBatch], offset: int) -> Iterator[pa.RecordBatch]:
    """Pairs of ranks ``offset`` words apart, from ranks sorted by document and place.

    Where the longer run of words recurs, so do the shorter ones that begin within it, up to ``offset`` words on.  So all
    these have ranks, and the rank looked for is ``offset`` rows on, or the run does not recur.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if batch.num_rows else held
        n = batch.num_rows - offset
        if n > 0:
            ids, at, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "at", "rank"))
            which = np.flatnonzero((ids[offset:] == ids[:n]) & (at[offset:] == at[:n] + offset))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[which], at[which], rank[which], rank[which + offset])], ["doc_id", "at", "low", "high"])
            batch = batch.slice(n)
        held = batch


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, repeats in _repeated(batches, lambda b: [b.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high")]):
        yield batch.filter(pa.array(repeats)).select(["doc_id", "start"])


def repeated_suffixes(docs: DataFrame, min_words: int = MIN_WORDS, first_words: int = FIRST_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words)``: all words that lie in a run of ``min_words`` words that recurs.

    Runs recur in one document or in several; those that overlap or touch are one row.

    NULL ids, NULL texts and texts of fewer than ``min_words`` words give nothing.  A very long text is sorted whole, as
    any other.  Rows that repeat an id are documents of their own when runs are counted; their runs are listed under
    the one id, as one union.  Equal runs have one rank, so ties need no order.  All suffixes with one pair of ranks pass
    through one task, as a sorted stream of which it holds a batch.
    """
    if not (1 <= first_words <= min_words and anchor_words <= min_words):
        raise ValueError("need 1 <= first_words <= min_words and anchor_words <= min_words")
    spark = docs.sparkSession
    texts = pick_documents(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = recurring_anchors(texts, min_words, anchor_words)
    both = anchors.select("doc_id", F.lit(0).alias("kind"), F.col("what").cast("long").alias("key"), F.lit(None).cast("string").alias("text")).unionByName(
        texts.select("doc_id", F.lit(1).alias("kind"), F.xxhash64("text").alias("key"), "text")
    )
    by_doc = both.repartition("doc_id").sortWithinPartitions("doc_id", "kind", "key")
    offset = min(first_words, min_words - first_words)
    run = partial(_first_pairs, first=first_words, offset=offset, min_words=min_words, anchor_words=anchor_words)
    pairs, reach, before = by_doc.mapInArrow(run, _PAIRS), first_words + offset, None
    del anchors, both, by_doc
    while reach < min_words:
        ranks = table(_sorted(pairs).mapInArrow(_ranked, _RANKS))
        pairs = None
        if before is not None:
            forget(before)
        sweep(spark)
        offset = min(reach, min_words - reach)
        pairs, before = ranks.repartition("doc_id").sortWithinPartitions("doc_id", "at").mapInArrow(partial(_paired, offset=offset), _PAIRS), ranks
        reach += offset
    windows = pairs.select("doc_id", F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("start"), "low", "high")
    return spans_of_windows(_sorted(windows).mapInArrow(_recurring, "doc_id long, start int"), min_words)


def _sorted(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("low", "high").sortWithinPartitions("low", "high")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
