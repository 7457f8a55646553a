"""What operators 1 and 4 share: anchors that no recurring passage lacks, and the way from windows to spans.

A passage recurs if ``min_words`` words in a row stand at two places or more, in one document or in several.  Its
places are the same from the runs of ``ANCHOR_WORDS`` words of least hash among all such runs in each window of
``min_words`` words: that choice depends on the window alone.  So a window whose anchor stands nowhere else cannot
recur, and one shuffle of the anchors, one for some 20 words, rules out most of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Words, grams, slices

MIN_WORDS = 50
ANCHOR_WORDS = 12


def anchor_positions(words: Words, keys: np.ndarray, min_words: int, anchor_words: int) -> np.ndarray:
    """Word numbers where anchors begin; ``keys`` are the hashes of all runs of ``anchor_words`` words."""
    width = min_words - anchor_words + 1
    n = len(words.hashes) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    text_of = words.text_of_word()
    inside = np.flatnonzero(text_of[:n] == text_of[min_words - 1 :])
    if not len(inside):
        return inside
    # The least of each window, by doubling: least[i] is the place of the least key in keys[i:i + reach].
    least, reach = np.arange(len(keys)), 1
    while reach < width:
        step = min(reach, width - reach)
        m = len(least) - step
        a, b = least[:m], least[step : step + m]
        least = np.where(keys[b] < keys[a], b, a)
        reach += step
    return np.unique(least[inside])


def _anchor_rows(batches: Iterator[pa.RecordBatch], min_words: int, anchor_words: int, what: Callable[[Words, np.ndarray], pa.Array]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            keys = grams(words.hashes, anchor_words)
            at = anchor_positions(words, keys, min_words, anchor_words)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[words.text_of_word()[at]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(ids), what(words, at)], ["anchor", "doc_id", "what"])


def place_in_text(words: Words, at: np.ndarray) -> pa.Array:
    return pa.array((at - words.bounds[words.text_of_word()[at]]).astype(np.int32))


def recurring_anchors(
    texts: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, what: Callable[[Words, np.ndarray], pa.Array] = place_in_text, kind: str = "int"
) -> DataFrame:
    """``(anchor, doc_id, what)`` of each anchor of ``(doc_id, text)`` that stands at two places or more.

    ``what`` tells more of the anchors that begin at given words.  Anchors are counted before they are shuffled, and the
    join back may split what one anchor has.
    """
    run = partial(_anchor_rows, min_words=min_words, anchor_words=anchor_words, what=what)
    rows = texts.mapInArrow(run, f"anchor long, doc_id long, what {kind}")
    several = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    return rows.join(several, "anchor", "left_semi")


def _repeated(batches: Iterator[pa.RecordBatch], keys: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their keys, and which of them have keys that come more than once.

    A row is held back until the next one is known.
    """
    held: pa.RecordBatch | None = None
    last_repeats = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        same = np.ones(n - 1, bool)
        for c in keys(batch):
            same &= c[1:] == c[:-1]
        repeats = np.zeros(n, bool)
        repeats[1:] = same
        repeats[:-1] |= same
        repeats[0] |= last_repeats and held is not None
        last_repeats = bool(repeats[-1])
        held = batch.slice(n - 1)
        yield batch.slice(0, n - 1), repeats[:-1]
    if held is not None:
        yield held, np.array([last_repeats])


def _spans(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Windows sorted by document and start, joined where they touch or overlap."""
    doc, begin, end = None, 0, 0

    def out(d: np.ndarray, b: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int64()), pa.array(b, pa.int32()), pa.array(e, pa.int32()), pa.array(np.asarray(e) - np.asarray(b), pa.int32())],
            ["doc_id", "start_word", "end_word", "n_words"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        d, s = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("start").to_numpy(zero_copy_only=False).astype(np.int64)
        if doc is not None:
            d, s = np.append(np.int64(doc), d), np.append(end - min_words, s)
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + min_words)
        first = np.flatnonzero(new)
        begins, ends = s[first].copy(), s[np.append(first[1:], len(s)) - 1] + min_words
        if doc is not None:
            begins[0] = begin
        docs = d[first]
        yield out(docs[:-1], begins[:-1], ends[:-1])
        doc, begin, end = docs[-1], int(begins[-1]), int(ends[-1])
    if doc is not None:
        yield out(np.array([doc]), np.array([begin]), np.array([end]))


SPANS = "doc_id long, start_word int, end_word int, n_words int"


def spans_of_windows(windows: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words)`` of the union of the windows ``(doc_id, start)``."""
    ordered = windows.repartition("doc_id").sortWithinPartitions("doc_id", "start")
    return ordered.mapInArrow(partial(_spans, min_words=min_words), SPANS)
