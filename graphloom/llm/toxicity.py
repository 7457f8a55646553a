"""Operator 2, toxicity: a counterfactually regularised classifier.

Features of a text are its distinct words and their beginnings of ``PREFIXES`` bytes, by 64-bit hash.  A sparse
logistic regression is fitted on labelled texts; for each of them that names a group of people, the name is swapped
for others of the same kind, and the squared change of the score is part of the loss.  Names of groups therefore
carry next to no weight, however they are spread over the labels.  A swap for no term at all is among these, so a
neutral mention of any group scores as if the group were not named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Words, cut, mix, pick, pick_documents, slices

PREFIXES = (3, 4, 5, 6)
#: Labelled rows to fit on, at most; the sample is by hash of the id, so it is the same at every run.
MAX_LABELLED = 20_000
#: Standard deviations by which a feature must be more frequent in toxic texts than chance would have it.
MIN_Z = 4

#: Words for groups of people; words of one line replace each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("women", "men", "girls", "boys"),
    ("female", "male"),
    ("mother", "father", "parent"),
    ("wife", "husband", "spouse"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "latina", "hispanic", "african", "european", "arab", "indigenous"),
    ("immigrant", "refugee", "foreigner", "migrant", "citizen", "native"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens", "natives"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "british", "turkish", "polish"),
    ("deaf", "blind", "disabled", "autistic", "paralyzed"),
    ("old", "elderly", "young", "teenage"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("ausländer", "flüchtlinge", "einwanderer", "bürger"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("étrangers", "réfugiés", "immigrés", "citoyens"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
    ("extranjeros", "refugiados", "inmigrantes", "ciudadanos"),
)


@dataclass
class Model:
    """Sorted feature hashes, their weights, the intercept and the score from which a text is toxic.

    ``features`` is empty if nothing could be learned.
    """

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    threshold: float = 0.5

    def scores(self, words: Words) -> np.ndarray:
        """The probability that each text is toxic."""
        text, index = known_features(words, self.features)
        z = np.bincount(text, self.weights[index], len(words)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature hashes, word numbers), once for whole words and once for each length of beginning."""
    yield words.hashes, np.arange(len(words.hashes))
    lengths = words.ends - words.starts
    for k in PREFIXES:
        at = np.flatnonzero(lengths > k)
        yield mix(words.between(words.starts[at], words.starts[at] + k) + np.uint64(0x5851F42D4C957F2D + k)), at


def known_features(words: Words, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, index in the sorted ``features``) pairs of all texts."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(1 << 18, bool)
    seen[(features >> np.uint64(46)).astype(np.int64)] = True
    text_of, found = words.text_of_word(), []
    for hashes, at in word_features(words):
        maybe = np.flatnonzero(seen[(hashes >> np.uint64(46)).astype(np.int64)])
        index = np.searchsorted(features, hashes[maybe])
        index[index == len(features)] = 0
        hit = features[index] == hashes[maybe]
        found.append(text_of[at[maybe[hit]]] * len(features) + index[hit])
    pairs = np.unique(np.concatenate(found))
    return pairs // len(features), pairs % len(features)


def labelled_texts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, toxic, text)``: distinct labelled texts, of ``max_labelled`` labels at most.

    Rows with a NULL id, text or label are left out; of several labels of one document, or of equal texts, the
    highest counts.  The labels are few by construction and so are sent to the documents.
    """
    some = (
        pick(labels, doc_id="doc_id", toxic="toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    texts = pick_documents(docs).filter("text IS NOT NULL").join(F.broadcast(some), "doc_id")
    return texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text")


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, toxic, kinds = [], [], []
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            label = part.column("toxic").to_numpy(zero_copy_only=False)
            text_of = words.text_of_word()
            for kind, (found, at) in enumerate(word_features(words)):
                order = np.lexsort((text_of[at], found))
                h, t = found[order], text_of[at][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                hashes.append(h[new])
                toxic.append(label[t[new]])
                kinds.append(np.full(new.sum(), kind, np.int64))
    if hashes:
        features, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        kind = np.concatenate(kinds)[first]
        flag = np.concatenate(toxic)
        n, n_toxic = np.bincount(back), np.bincount(back, flag).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(features.view(np.int64)), pa.array(kind), pa.array(n), pa.array(n_toxic)], ["feature", "kind", "n", "n_toxic"]
        )


def _term_features() -> tuple[np.ndarray, dict[int, list[tuple[np.ndarray, list[np.ndarray]]]]]:
    """The identity terms' word hashes; by word hash, the term's features and those of the terms that replace it."""
    terms = [t for line in IDENTITY_TERMS for t in line]
    words = Words(pa.array(terms))
    own: list[list[int]] = [[] for _ in terms]
    for hashes, at in word_features(words):
        for h, i in zip(hashes.tolist(), at.tolist(), strict=True):
            own[i].append(h)
    features = [np.array(x, np.uint64) for x in own]
    swaps, at = {}, 0
    for line in IDENTITY_TERMS:
        for i in range(len(line)):
            swaps[int(words.hashes[at + i])] = [(features[at + i], [features[at + j] for j in range(len(line)) if j != i])]
        at += len(line)
    return np.unique(words.hashes), swaps


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, penalty: float = 2.0) -> Model:
    """Fit on labelled documents; ``penalty`` weighs the squared change of the logit under swaps of identity terms.

    With no toxic or no clean labelled text there is nothing to learn: the model then scores every text 0.  So it does
    if no feature gets a weight, as with few labels (with as many toxic as clean texts a feature needs 17 toxic ones, at
    90 % toxic 145).  A text without a weighted feature is never toxic, whatever the threshold.
    """
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    sample = cut(labelled_texts(docs, labels, max_labelled))
    n_by = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_all = sum(n for t, n in n_by.items() if t > 0), sum(n_by.values())
    if not n_toxic or n_toxic == n_all:
        return nothing
    flagged = sample.select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "text")
    share = n_toxic / n_all
    counts = (
        flagged.mapInArrow(_count_features, "feature long, kind long, n long, n_toxic long")
        .groupBy("feature").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).filter("n > 1")
    )
    excess = F.col("n_toxic") - F.col("n") * share
    ranked = counts.withColumn("z", excess * F.abs(excess) / (F.col("n") * share * (1 - share))).filter(F.col("z") > MIN_Z**2)
    best = ranked.select("feature", "kind").collect()  # all of them; there are as many as the labelled texts have
    terms, swaps = _term_features()
    features = np.union1d(np.array([r["feature"] for r in best], np.int64).view(np.uint64), terms)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                text, index = known_features(words, features)
                bounds = np.searchsorted(text, np.arange(len(words) + 1))
                present = [index[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                swapped = [_swapped(words.hashes[a:b], set(p), swaps, features) for a, b, p in zip(words.bounds[:-1], words.bounds[1:], present, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic").cast(pa.int32()), pa.array(present, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32())))],
                    ["doc_id", "toxic", "present", "swapped"],
                )

    rows = flagged.mapInArrow(rows_of, "doc_id long, toxic int, present array<int>, swapped array<array<int>>").toArrow().to_pylist()
    # The longer of two beginnings that the same texts have says more: whole words come first, then 6 bytes and less.
    rank = np.full(len(features), len(PREFIXES) + 1)
    kinds = np.array([r["kind"] for r in best], np.int64)
    rank[np.searchsorted(features, np.array([r["feature"] for r in best], np.int64).view(np.uint64))] = np.where(kinds == 0, 0, len(PREFIXES) + 1 - kinds)
    is_term = np.isin(features, terms)
    rows.sort(key=lambda r: r["doc_id"])
    part = mix(np.array([r["doc_id"] for r in rows], np.int64).view(np.uint64)) % np.uint64(5)
    held = [r for r, p in zip(rows, part.tolist(), strict=True) if p == 0]
    threshold = 0.5
    if {r["toxic"] for r in held} == {r["toxic"] for r, p in zip(rows, part.tolist(), strict=True) if p} == {0, 1}:
        weights, intercept = _fit_sparse([r for r, p in zip(rows, part.tolist(), strict=True) if p], rank, is_term, penalty)
        z = np.array([weights[r["present"]].sum() + intercept for r in held])
        threshold = best_threshold(1 / (1 + np.exp(-z)), np.array([r["toxic"] for r in held]))
    weights, intercept = _fit_sparse(rows, rank, is_term, penalty)
    used = weights != 0
    if not used.any():
        return nothing
    model = Model(features[used], weights[used], intercept, threshold)
    model.threshold = max(threshold, float(np.nextafter(model.scores(Words(pa.array([""])))[0], 1)))
    return model


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of highest F1 on held-out texts; of several, that nearest to 0.5."""
    grid = np.linspace(0.2, 0.95, 76)
    hits = np.array([[(toxic[scores >= t] > 0).sum(), (scores >= t).sum()] for t in grid])
    f1 = 2 * hits[:, 0] / np.maximum(hits[:, 1] + toxic.sum(), 1)
    return float(min(grid[f1 >= f1.max() - 1e-12], key=lambda t: abs(t - 0.5)))


def _swapped(hashes: np.ndarray, present: set[int], swaps: dict, features: np.ndarray) -> list[list[int]]:
    """The features of the text with each identity term in it replaced by each other one of its kind, and by none."""
    out = []
    for h in {*hashes.tolist()} & swaps.keys():
        for own, others in swaps[h]:
            gone = _indexes(own, features)
            out += [sorted((present - gone) | _indexes(o, features)) for o in others] + [sorted(present - gone)]
    return out


def _indexes(hashes: np.ndarray, features: np.ndarray) -> set[int]:
    return {*np.flatnonzero(np.isin(features, hashes)).tolist()}


def _fit_sparse(rows: list[dict], rank: np.ndarray, terms: np.ndarray, penalty: float, l1: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept for logistic loss, both classes weighing the same, with the penalty on swaps.

    Features that the same texts have count once, that of least ``rank``.  An L1 norm selects among the others by
    accelerated proximal gradient; Newton's method then fits those without it.  No feature may speak against toxicity,
    as any text could be made harmless by adding such words.
    """
    n, y = len(rank), np.array([r["toxic"] for r in rows], float)
    texts = np.repeat(np.arange(len(rows)), [len(r["present"]) for r in rows])
    col = np.array([c for r in rows for c in r["present"]], np.int64)
    mark = mix(np.arange(1, len(rows) + 1).astype(np.uint64))
    profile = np.zeros(n, np.uint64)
    np.add.at(profile, col, mark[texts])
    order = np.lexsort((rank, profile))
    single = np.ones(n, bool)
    single[order[1:]] = profile[order[1:]] != profile[order[:-1]]
    single &= profile != 0
    single |= terms
    pairs, plus = 0, []
    for r in rows:
        here = set(r["present"])
        for s in map(set, r["swapped"]):
            plus += [(pairs, c, 1.0) for c in s - here] + [(pairs, c, -1.0) for c in here - s]
            pairs += 1
    swap = np.array(plus, float).reshape(-1, 3)

    def chosen(keep: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        index = np.full(n, -1)
        index[keep] = np.arange(len(keep))
        a, b = index[col] >= 0, index[swap[:, 1].astype(int)] >= 0
        return (texts[a], index[col[a]]), (swap[b, 0].astype(int), index[swap[b, 1].astype(int)], swap[b, 2])

    keep = np.flatnonzero(single)
    keep = keep[_select(y, *chosen(keep), pairs, len(keep), penalty, l1, steps) != 0]
    while True:
        w, b = _newton(y, *chosen(keep), pairs, len(keep), penalty)
        bad = w < 0
        if not bad.any():
            break
        keep = keep[~bad]
    weights = np.zeros(n)
    weights[keep] = w
    return weights, b


def _class_weights(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))


def _select(y: np.ndarray, x: tuple, swap: tuple, pairs: int, n: int, penalty: float, l1: float, steps: int) -> np.ndarray:
    (row, col), (p_row, p_col, p_sign) = x, swap
    v = _class_weights(y)
    sizes = np.bincount(row, minlength=len(y))
    bound = 0.25 * np.bincount(col, ((sizes + 1.0) * v)[row], n).max(initial=0) + 0.25
    if pairs:
        bound += 2 * penalty / pairs * np.bincount(p_col, np.bincount(p_row, minlength=pairs)[p_row], n).max()
    step = 1 / bound
    w, b, w0, b0, t = np.zeros(n), 0.0, np.zeros(n), 0.0, 1.0
    for _ in range(steps):
        z = np.bincount(row, w[col], len(y)) + b
        g = v * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw = np.bincount(col, g[row], n)
        if pairs:
            change = np.bincount(p_row, p_sign * w[p_col], pairs)
            gw += np.bincount(p_col, (2 * penalty / pairs) * p_sign * change[p_row], n)
        w1 = w - step * gw
        w1 = np.maximum(w1 - step * l1, 0)
        b1 = b - step * g.sum()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, b = w1 + (t - 1) / t1 * (w1 - w0), b1 + (t - 1) / t1 * (b1 - b0)
        w0, b0, t = w1, float(b1), t1
    return w0


def _gram(row: np.ndarray, col: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The sum over rows of weight times the outer product of the row, from its entries that are not 0; rows come sorted."""
    out = np.zeros((n, n))
    for first in range(0, len(weight), 1000):
        a, b = np.searchsorted(row, (first, first + 1000))
        block = np.zeros((min(1000, len(weight) - first), n))
        np.add.at(block, (row[a:b] - first, col[a:b]), value[a:b])
        out += (block * weight[first : first + 1000, None]).T @ block
    return out


def _newton(y: np.ndarray, x: tuple, swap: tuple, pairs: int, n: int, penalty: float, l2: float = 1e-4, steps: int = 40) -> tuple[np.ndarray, float]:
    """Newton's method.  Beside the entries that are not 0 it holds matrices of the selected features alone."""
    (row, col), (p_row, p_col, p_sign) = x, swap
    row, col = np.append(row, np.arange(len(y))), np.append(col, np.full(len(y), n))  # the last column is the intercept
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    one = np.ones(len(row))
    fixed = np.diag(np.append(np.full(n, l2), 1e-9))
    if pairs:
        order = np.argsort(p_row, kind="stable")
        fixed += 2 * penalty / pairs * _gram(p_row[order], p_col[order], p_sign[order], np.ones(pairs), n + 1)
    w, v = np.zeros(n + 1), _class_weights(y)

    def loss(w: np.ndarray) -> float:
        z = np.bincount(row, w[col], len(y))
        return float(v @ (np.logaddexp(0, z) - y * z) + 0.5 * w @ fixed @ w)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)), -40, 40)))
        gradient = np.bincount(col, (v * (p - y))[row], n + 1) + fixed @ w
        curve = _gram(row, col, one, v * p * (1 - p), n + 1) + fixed
        move, scale = np.linalg.solve(curve, gradient), 1.0
        while scale > 1e-4 and (then := loss(w - scale * move)) > now:
            scale /= 2
        if scale <= 1e-4 or now - then < 1e-9:
            break
        w, now = w - scale * move, then
    return w[:n], float(w[n])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every document with an id; a NULL or empty text has no features and so the least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(Words(part.column("text"))))], ["doc_id", "score"])

    return pick_documents(docs).filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, score double")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score)`` of the documents that the classifier rejects.

    Repeated rows are repeated in the result.  NULL ids, NULL and empty texts are not listed.  A very long text is scored
    by all its words, each once.  Documents with the same words have the same score, and a score that equals the threshold
    is toxic.  ``MAX_LABELLED`` is the one bound: it says on how many labelled rows the classifier is fitted.
    """
    model = fit(docs, labels)
    return score(docs, model).filter(F.col("score") >= model.threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns; NULL ids and texts stay."""
    model = fit(docs, labels)
    # The score is made beside the row, in one pass, so no column of the input takes part and none can clash.
    columns = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{text}"):
                clean = model.scores(Words(part.column(f"c{text}"))) < model.threshold
                yield part.filter(pa.array(clean))

    return inner.mapInArrow(run, inner.schema).toDF(*columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
