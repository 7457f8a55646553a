"""Operator 1, substring deduplication with repeated-phrase automata.

First, recurring passages are confirmed: the phrases that they cannot lack, the anchors of ``passages``, are counted over
the corpus, and those of two places or more are kept.  Only the phrases are known then, not where they stand.  They are
dealt to shards, each shard's phrases are compiled into an Aho-Corasick automaton in which each word is three letters, and
every document is streamed through its shard's automaton, which locates all occurrences of all its phrases.  Around them
lie the windows of ``min_words`` words that may recur; those whose words stand at another place too are the passages.

A shard is a partition of the documents with the phrases that were counted in them.  So each automaton has a bounded
size, all together are as large as the phrases' places, and every document is streamed once, whatever the size of the
corpus.  A phrase of one shard never stands, as an anchor, in a document of another one that was not given it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Words, grams, mix, pick_documents, slices, sweep, table
from graphloom.llm.passages import ANCHOR_WORDS, MIN_WORDS, _repeated, recurring_anchors, spans_of_windows

#: Letters of a word, of 7 bits of its hash each: the automaton looks through a node's branches one by one.
_SPELT = 3
#: Phrases of one automaton; a shard with more has several, and its documents are streamed through each.
AUTOMATON_PHRASES = 500_000
#: What a window's row is: one that may recur, one known to recur, or a sign for others that it does.
_MAYBE, _SURE, _SIGN = 0, 1, 2


def spelt(hashes: np.ndarray) -> np.ndarray:
    """The letters of words, by their hashes: a row of bytes for each."""
    shifts = np.arange(64 - 7 * _SPELT, 64, 7, dtype=np.uint64)
    return (((hashes[:, None] >> shifts) & np.uint64(127)) + np.uint64(1)).astype(np.uint8)


def packed_phrases(words: Words, at: np.ndarray, anchor_words: int) -> pa.Array:
    """The letters of the phrases that begin at some words."""
    data = np.ascontiguousarray(spelt(words.hashes)[at[:, None] + np.arange(anchor_words)])
    offsets = np.arange(len(at) + 1, dtype=np.int32) * (_SPELT * anchor_words)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def compiled(phrases: set[bytes]) -> list[ahocorasick.Automaton]:
    """Automata of at most ``AUTOMATON_PHRASES`` phrases each."""
    ordered, out = sorted(phrases), []
    for first in range(0, len(ordered), AUTOMATON_PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in ordered[first : first + AUTOMATON_PHRASES]:
            automaton.add_word(phrase.decode("latin-1"))
        automaton.make_automaton()
        out.append(automaton)
    return out


def occurrences(words: Words, automata: list[ahocorasick.Automaton], anchor_words: int) -> np.ndarray:
    """Word numbers where phrases begin in the texts, as the automata locate them."""
    stream = spelt(words.hashes).tobytes().decode("latin-1")
    ends = np.array([end for automaton in automata for end, _ in automaton.iter(stream)], np.int64) + 1
    ends = ends[ends % _SPELT == 0] // _SPELT  # not from within a word
    at = ends - anchor_words
    text = words.text_of_word()
    return at[text[at] == text[ends - 1]] if len(at) else at  # not from one text into the next


def _located_windows(batches: Iterator[pa.RecordBatch], min_words: int, anchor_words: int) -> Iterator[pa.RecordBatch]:
    """Rows of the windows around all occurrences of a shard's phrases.  The phrases, of ``kind`` 0, come before the texts.

    Windows that come more than once here are known to recur.  One sign says so to the other shards, and their rows
    are spread by another key, so that no task gets all places of a passage that stands nearly everywhere.
    """
    phrases: set[bytes] = set()
    automata: list[ahocorasick.Automaton] | None = None
    signed = np.zeros(0, np.uint64)
    for batch in batches:
        split = int(np.searchsorted(batch.column("kind").to_numpy(zero_copy_only=False), 1))
        phrases.update(batch.column("phrase").slice(0, split).to_pylist())
        if split == batch.num_rows:
            continue
        if automata is None:
            automata, phrases = compiled(phrases), set()
        for part in slices(batch.slice(split)):
            words = Words(part.column("text"))
            at = occurrences(words, automata, anchor_words)
            text = words.text_of_word()[at]
            change = np.zeros(len(words.hashes) + 2, np.int32)  # +1 where windows around a phrase begin, -1 after their end
            low, high = np.maximum(words.bounds[text], at + anchor_words - min_words), np.minimum(words.bounds[text + 1] - min_words, at)
            np.add.at(change, low[low <= high], 1)
            np.add.at(change, high[low <= high] + 1, -1)
            start = np.flatnonzero(np.cumsum(change) > 0)
            key = grams(words.hashes, min_words)[start]
            check = (grams(mix(words.hashes), min_words)[start] >> np.uint64(32)).astype(np.int64)
            text = words.text_of_word()[start]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[text]
            place = start - words.bounds[text]
            different, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            known = np.isin(different, signed, assume_unique=True)
            sure = (known | (n > 1))[back]
            sign = first[~known & (n > 1)]
            signed = np.union1d(signed, key[sign])
            spread = np.where(sure, mix(key + place.astype(np.uint64) + mix(ids.astype(np.int64).view(np.uint64))), key)
            kind = np.where(sure, _SURE, _MAYBE).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(spread, key[sign]).view(np.int64)),
                    pa.array(np.append(ids, np.zeros(len(sign), np.int64))),
                    pa.array(np.append(check << 32 | kind << 30 | place, check[sign] << 32 | _SIGN << 30)),
                ],
                ["key", "doc_id", "place"],
            )


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by key and place, those that recur: equal ones have the same 64 bits of key and 32 of place."""

    def keys(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column("key").to_numpy(zero_copy_only=False), batch.column("place").to_numpy(zero_copy_only=False) >> 32]

    for batch, repeats in _repeated(batches, keys):
        place = batch.column("place").to_numpy(zero_copy_only=False)
        kind = place >> 30 & 3
        which = np.flatnonzero((kind == _SURE) | ((kind == _MAYBE) & repeats))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[which]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((place[which] & (1 << 30) - 1).astype(np.int32))], ["doc_id", "start"])


def located_windows(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``(key, doc_id, place)`` of all windows around the occurrences that the automata locate."""
    texts = pick_documents(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    phrases = recurring_anchors(texts, min_words, anchor_words, partial(packed_phrases, anchor_words=anchor_words), "binary")
    both = phrases.select("doc_id", F.lit(0).alias("kind"), F.col("what").alias("phrase"), F.lit(None).cast("string").alias("text")).unionByName(
        texts.select("doc_id", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("phrase"), "text")
    )
    shards = both.repartition("doc_id").sortWithinPartitions("kind")
    return shards.mapInArrow(partial(_located_windows, min_words=min_words, anchor_words=anchor_words), "key long, doc_id long, place long")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words)``: every place of every passage of ``min_words`` words that recurs.

    Overlapping and touching places of one document are one row, so a copied document is one row from its first word
    to its last.  Words are those of ``common``, by 64-bit hash; windows are compared by 96 bits.

    NULL ids, NULL texts and texts of fewer than ``min_words`` words give nothing.  A very long text is streamed whole.
    Rows that repeat an id are documents of their own when places are counted; their places are listed under the one
    id, as one union, so repeated rows recur in each other.  All places of a passage are given, so there are no ties.
    """
    located = table(located_windows(docs, min_words, anchor_words))
    sweep(docs.sparkSession)  # the shuffled texts are done with
    ordered = located.repartition("key").sortWithinPartitions("key", "place")
    return spans_of_windows(ordered.mapInArrow(_recurring, "doc_id long, start int"), min_words)


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
