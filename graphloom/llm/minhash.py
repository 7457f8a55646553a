"""Operator 8, near-duplicate documents by Order MinHash, verified by banded alignment.

Order MinHash is sensitive to edit similarity: a sketch holds, for one hash function, the ``ell`` occurrence-labelled
k-mers of least hash *in the order in which the text has them*.  Two texts that agree in any of ``n_sketches``
sketches are candidates.  Their edit similarity, 1 - distance / longer length in words, is then computed exactly by
a banded alignment.  Documents linked by pairs of at least ``min_similarity`` make a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import SLICE_BYTES, Words, cut, grams, mix, pick_documents, slices, table, without_ids

MIN_SIMILARITY = 0.8
#: (k, ell, sketches, least words, most words).  Short texts have few k-mers, so they need shorter and fewer of them;
#: lengths around the border get both kinds, as lengths of similar texts differ.  With a fifth of its words replaced a
#: text keeps about a third of its 3-word k-mers: 40 sketches of two find 0.99 of such pairs, of three only 0.8.
FAMILIES = ((3, 2, 40, 41, None), (2, 2, 32, 3, 63))
#: Texts of a sketch beyond which those not yet linked are only compared if they share a rare word.
HOT = 100
#: Most frequent words that come last in the order of rarity; the others are ordered by hash.
FREQUENT = 20_000
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def order_min_hashes(hashes: np.ndarray, k: int, ell: int, n_sketches: int) -> np.ndarray:
    """The sketches of one text from its word hashes; none if it has fewer than ``ell`` k-mers."""
    kmers = grams(hashes, k)
    n = len(kmers)
    if n < ell:
        return np.zeros(0, np.uint64)
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = np.arange(n) - first
    labelled = mix(kmers + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))
    out = np.empty(n_sketches, np.uint64)
    step = max(1, 2_000_000 // n)  # bounds memory for very long texts
    for at in range(0, n_sketches, step):
        seeds = _SEEDS[at : min(at + step, n_sketches)]
        table = labelled[None, :] ^ seeds[:, None]
        table *= np.uint64(0x9E3779B97F4A7C15)
        table ^= table >> np.uint64(32)
        table *= np.uint64(0xD6E8FEB86659FD93)
        least = np.argpartition(table, ell - 1, axis=1)[:, :ell]
        least.sort(axis=1)  # the order of the text
        sketch = seeds.copy()
        for j in range(ell):
            sketch = mix(sketch ^ labelled[least[:, j]]) + np.uint64(j)
        out[at : at + len(seeds)] = sketch
    return out


def text_sketches(hashes: np.ndarray) -> np.ndarray:
    found = [
        order_min_hashes(hashes, k, ell, n) + np.uint64(k)
        for k, ell, n, least, most in FAMILIES
        if len(hashes) >= least and (most is None or len(hashes) <= most)
    ]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            words = Words(part.column("text"))
            bounds = words.bounds
            n = np.diff(bounds)
            place = (np.arange(len(words.hashes)) - np.repeat(bounds[:-1], n)).astype(np.uint64)
            weight = np.zeros(len(words.hashes) + 1, np.uint64)
            np.cumsum(mix(words.hashes + np.uint64(1) + place * np.uint64(0xC2B2AE3D27D4EB4F)), out=weight[1:])
            wide = [words.hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            chain = np.array([int(grams(h, len(h))[0]) if len(h) else 0 for h in wide], np.uint64)
            sketches = [text_sketches(h) for h in wide]
            sizes = np.append(0, np.cumsum([len(s) for s in sketches])).astype(np.int32)
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array((weight[bounds[1:]] - weight[bounds[:-1]]).view(np.int64)),
                    pa.array(chain.view(np.int64)),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64))),
                ],
                ["doc_id", "h1", "h2", "n_words", "sketches"],
            )


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Words to insert, delete or replace to make ``b`` of ``a``; ``limit + 1`` if more than ``limit``.

    Common ends are cut off and the band doubles from 32 until the distance lies within it, so the work is in
    proportion to length times distance.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    differ = np.flatnonzero(a != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n, m = len(a), len(b)
    differ = np.flatnonzero(a[::-1] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: n - tail], b[: m - tail]
    n, m = len(a), len(b)
    if n == 0:
        return m if m <= limit else limit + 1
    shared = np.isin(a, b).sum()
    if m - min(int(shared), n) > limit:  # words of the longer one that no word of the other can match
        return limit + 1
    places: dict[int, int] = {}
    for at, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << at
    text = b.tolist()
    band = 32
    while True:
        band = min(band, limit)
        if m - n <= band:
            found = _banded(places, n, text, band)
            if found <= band or band == limit:
                return min(found, limit + 1)
        band *= 2


def _banded(places: dict[int, int], n: int, text: list[int], band: int) -> int:
    """The distance along paths within ``band`` of the diagonal; more than ``band`` if the true one is.

    ``places`` has a bit for each place of a word in the other text, of ``n`` words.  Column by column of the table, the
    differences between neighbouring cells of the band are held as the bits of integers, so that all rows of the band
    take a dozen operations.  Bit i of column j is of row j - band + i; what comes in from beyond the band is too high,
    never too low.
    """
    m, full = len(text), (1 << 2 * band + 1) - 1
    top = 1 << 2 * band
    up, down = full >> band << band, 0  # before the first column each row is one more than the last; row 1 is bit ``band``
    diagonal = max(0, n - band)
    score = min(band, n)
    for j in range(1, m + 1):
        shift = j - band - 1
        bits = places.get(text[j - 1], 0)
        same = (bits >> shift if shift >= 0 else bits << -shift) & full
        level = ((((same & up) + up) ^ up) | same | down) & full  # the cell is as high as that diagonally before it
        rise = down | (full ^ (level | up))
        fall = level & up
        if j <= diagonal:
            score += not level & top
            if score > band + m - n + band:
                return band + 1
        else:
            last = 1 << n - j + band
            score += bool(rise & last) - bool(fall & last)
        level >>= 1
        up = (fall | (full ^ (level | rise))) & full | top
        down = level & rise & ~top
    return score


def _similar(batches: Iterator[pa.RecordBatch], min_similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("words_a"), batch.column("words_b"), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            limit = int((1 - min_similarity) * max(len(a), len(b)) + 1e-9)
            keep[i] = edit_distance(a, b, limit) <= limit
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            blobs = [words.hashes[a:b].tobytes() for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(blobs, pa.binary())], ["id", "words"])


def _labelled(blob: pa.Scalar) -> np.ndarray:
    """The words of a text, each with its number among equal ones, as hashes: a set for a text with repeated words."""
    words = np.sort(np.frombuffer(blob.as_buffer(), np.uint64))
    new = np.append(True, words[1:] != words[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(words)), 0))
    return mix(words + (np.arange(len(words)) - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            token, n = np.unique(np.concatenate([_labelled(x) for x in batch.column("words")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])


def _rare_words(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, place: np.ndarray, min_similarity: float) -> Iterator[pa.RecordBatch]:
    """``(id, token)``: of each text, so many of its rarest words that any similar text has one of them among its own.

    Texts of at most n words with a distance of at most (1 - min_similarity) n share all words but so many; so if each is
    put in one order, that of ``frequent`` last, the first of their common words is among so many and one of either.
    """
    for batch in batches:
        ids, tokens = [], []
        for i, x in zip(batch.column("id").to_pylist(), batch.column("words"), strict=True):
            own = _labelled(x)
            rank = np.zeros(len(own), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                rank = np.where(frequent[at] == own, place[at] + 1, 0)
            longest = int(len(own) / min_similarity + 1e-9)  # that a similar text can have
            n = min(len(own), int((1 - min_similarity) * longest + 1e-9) + 1)
            chosen = own[np.lexsort((own, rank))[:n]]
            ids.append(np.full(len(chosen), i, np.int64))
            tokens.append(chosen)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(tokens).view(np.int64))], ["id", "token"])


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, root)`` for each id in the pairs ``(a, b)``: the smallest id that it is linked to, by any chain.

    Each round takes the least root among neighbours and then that of the root itself, so chains shorten to half.
    """
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "id"))
    for _ in range(rounds):
        near = edges.join(roots, edges.b == roots.id).groupBy("a").agg(F.min("root").alias("near"))
        better = roots.join(near, roots.id == near.a, "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("least"))
        jump = better.select(F.col("id").alias("least"), F.col("least").alias("next"))
        after = cut(better.join(jump, "least", "left").select("id", F.least("least", F.coalesce("next", "least")).alias("root"), (F.col("root") != F.least("least", F.coalesce("next", "least"))).alias("moved")))
        roots = after.select("id", "root")
        if not after.filter("moved").take(1):
            return roots
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicate_groups(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``(doc_id, group_id)`` for each document that has a near copy; ``group_id`` is the smallest id of its group.

    Texts with the same words are one from the start.  The candidates of a sketch are first compared with the
    smallest id that has it; pairs that no chain of similar pairs links by then are all compared as well.  So the
    groups are those that comparing every pair with a common sketch gives, without the pairs inside large groups.
    Of a sketch of more than ``HOT`` texts, such as one of a passage that unlike documents share, only those are compared
    that have one of their rarest words in common, as similar texts must.  Words are compared by 64-bit hash.

    NULL texts and texts without words have no near copies.  Rows with a NULL id are left out.  Rows that repeat an
    id are in one group.  Texts of one or two words have only those with the same words as near copies.  A very long text
    has as many sketches as any other and is aligned whole.  Of equal ids and similarities none is preferred: a group's
    members are all that links reach.
    """
    texts = pick_documents(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    sketched = cut(
        texts.mapInArrow(_sketch_rows, "doc_id long, h1 long, h2 long, n_words int, sketches array<long>").filter("n_words > 0")
    )
    same = sketched.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.min_by("sketches", "doc_id").alias("sketches"), F.first("n_words").alias("n_words"))
    rows = same.select("id", "n_words", F.explode("sketches").alias("sketch"))
    one = F.struct("id", "n_words")
    sketches = rows.groupBy("sketch").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    # Of sketches that the same texts have, one is enough.
    buckets = sketches.filter("n > 1").groupBy("n", "x", "y").agg(F.min("sketch").alias("sketch"), F.first("least").alias("least"))
    member = table(rows.join(buckets.select("sketch", "n", "least"), "sketch").select(F.col("sketch").alias("bucket"), "n", "least", "id", "n_words"))
    words = table(
        texts.withColumnRenamed("doc_id", "id").join(member.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
        .select(F.col("id").alias("doc_id"), "text").mapInArrow(_word_rows, "id long, words binary")
    )

    def near(x: str, y: str) -> str:
        return f"least({x}, {y}) >= {min_similarity} * greatest({x}, {y}) - 1e-9"

    def verified(pairs: DataFrame) -> DataFrame:
        a = words.select(F.col("id").alias("a"), F.col("words").alias("words_a"))
        b = words.select(F.col("id").alias("b"), F.col("words").alias("words_b"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(partial(_similar, min_similarity=min_similarity), "a long, b long")

    stars = member.filter("id <> least.id").filter(near("n_words", "least.n_words")).selectExpr("least.id AS a", "id AS b").distinct()
    linked = cut(verified(stars))
    roots = components(linked)
    # What stays apart under one sketch: one pair for each two members of different groups.
    placed = member.select("bucket", "n", "id", "n_words").join(roots, "id", "left").select("bucket", "n", "id", "n_words", F.coalesce("root", "id").alias("root"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    still = placed.join(several, "bucket", "left_semi")
    cool = still.filter(F.col("n") <= HOT).select("bucket", F.lit(0).cast("long").alias("token"), "id", "n_words", "root")
    hot = still.filter(F.col("n") > HOT)
    if hot.take(1):
        hot = cut(hot)
        own = words.join(hot.select("id").distinct(), "id", "left_semi")
        counts = own.mapInArrow(_word_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")
        most = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
        frequent = np.array([r.token for r in reversed(most)], np.int64).view(np.uint64)
        order = np.argsort(frequent)
        rare = own.mapInArrow(partial(_rare_words, frequent=frequent[order], place=order, min_similarity=min_similarity), "id long, token long")
        cool = cool.unionByName(hot.select("bucket", "id", "n_words", "root").join(rare, "id").select("bucket", "token", "id", "n_words", "root"))
    x, y = (cool.select("bucket", "token", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "n_words", "root")]) for k in "xy")
    rest = (
        x.join(y, ["bucket", "token"]).filter("id_x < id_y AND root_x <> root_y").filter(near("n_words_x", "n_words_y"))
        .selectExpr("id_x AS a", "id_y AS b").distinct().join(stars, ["a", "b"], "left_anti")
    )
    more = cut(verified(rest))
    groups = components(linked.unionByName(more)) if more.take(1) else roots
    copies = sketched.select("doc_id", "h1", "h2").join(same.select("h1", "h2", "id"), ["h1", "h2"])
    named = copies.join(groups, "id", "left").select("doc_id", F.coalesce("root", "id").alias("group_id")).distinct()
    large = named.groupBy("group_id").count().filter("count > 1").select("group_id")
    return named.join(large, "group_id", "left_semi").select("doc_id", "group_id")


def keep_one_of_group(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The documents without the near copies of a smaller id; all columns are kept, and rows with NULL ids or texts."""
    return without_ids(docs, near_duplicate_groups(docs, min_similarity).filter("doc_id <> group_id").select("doc_id"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
