"""Partitions of a network: agreement, matching of labels, modularity and consensus.

Partitions are ``(part, id, label)`` with whole-numbered labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.iterate import cut, in_order
from graphloom.linalg import MAX_DENSE, hungarian
from graphloom.model import beside, edges_of, ids_of, null_div, require
from graphloom.shipping import Network, collected, replicates

ASSIGN = "part long, id long, label long"
#: Labels of one partition up to which an optimal matching is sought on the driver.
MAX_LABELS = 2000


def assignments_of(df: DataFrame) -> DataFrame:
    return require(df, "part", "id", "label").select(*[F.col(c).cast("long").alias(c) for c in ("part", "id", "label")])


def contingency(x: DataFrame, y: DataFrame) -> DataFrame:
    """``(label_x, label_y, n)``: how many ids have each pair of labels in two tables ``(id, label)``."""
    return require(x, "id", "label").withColumnRenamed("label", "label_x").join(require(y, "id", "label").withColumnRenamed("label", "label_y"), "id").groupBy("label_x", "label_y").agg(F.count(F.lit(1)).alias("n"))


def get_relabels(x: DataFrame, y: DataFrame) -> DataFrame:
    """``(label_x, label_y, cost)`` of the one-to-one matching of labels that leaves the fewest ids apart."""
    t = collected(contingency(x, y), MAX_LABELS**2)
    a, b = np.unique(t["label_x"]), np.unique(t["label_y"])
    if max(len(a), len(b)) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    both = np.zeros((len(a), len(b)))
    both[np.searchsorted(a, t["label_x"]), np.searchsorted(b, t["label_y"])] = t["n"]
    cost = both.sum(axis=1)[:, None] + both.sum(axis=0)[None, :] - 2 * both
    i, j = hungarian(cost)
    rows = [(int(a[p]), int(b[q]), int(cost[p, q])) for p, q in zip(i, j, strict=True)]
    return x.sparkSession.createDataFrame(rows, "label_x long, label_y long, cost long")


def _new_labels(cells: pd.DataFrame, top: int) -> pd.DataFrame:
    """``(part, label, new)`` for one partition's cells ``(part, label, goal, n)``; cells without a goal only name a label."""
    labels, known = np.unique(cells["label"]), cells[cells["goal"].notna()]
    a, b = np.unique(known["label"]), np.unique(known["goal"].astype(np.int64))
    if max(len(a), len(b)) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    new = dict.fromkeys(labels.tolist())
    if len(a):
        both = np.zeros((len(a), len(b)))
        both[np.searchsorted(a, known["label"]), np.searchsorted(b, known["goal"].astype(np.int64))] = known["n"]
        for i, j in zip(*hungarian(both.sum(axis=1)[:, None] + both.sum(axis=0)[None, :] - 2 * both), strict=True):
            new[int(a[i])] = int(b[j])
    left = [x for x, y in new.items() if y is None]
    new.update(zip(left, range(top + 1, top + 1 + len(left)), strict=True))
    return pd.DataFrame({"part": cells["part"].iloc[0], "label": list(new), "new": list(new.values())})


def _renamed(assign: DataFrame, target: DataFrame) -> DataFrame:
    """Every partition of ``assign`` renamed after the target ``(id, label)``: one task for each, over its cells alone."""
    goal = target.select(F.col("id"), F.col("label").cast("long").alias("goal"))
    cells = assign.join(goal, "id", "left").groupBy("part", "label", "goal").agg(F.count(F.lit(1)).alias("n"))
    top = target.agg(F.max("label").cast("long").alias("top"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return _new_labels(part, int(part["top"].iloc[0]))

    names = beside(cells, top).groupBy("part").applyInPandas(run, "part long, label long, new long")
    return assign.join(names, ["part", "label"]).select("part", "id", F.col("new").alias("label"))


def match_cluster_labels(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(id, label)``: the source with its labels renamed after the target; labels without a match get new ones above the target's."""
    return _renamed(assignments_of(source.withColumn("part", F.lit(0))), target).select("id", "label")


def match_assignments(assign: DataFrame, target: int | None = None, seed: int | None = None) -> DataFrame:
    """``(part, id, label)``: every partition renamed after the partition ``target``, or after one drawn from those of the lowest largest label."""
    a = cut(assignments_of(assign))
    if target is None:
        tops = a.groupBy("part").agg(F.max("label").alias("top"))
        least = sorted(r.part for r in tops.join(tops.agg(F.min("top").alias("top")), "top").collect())
        target = int(np.random.RandomState(seed).choice(least))
    return _renamed(a, a.filter(F.col("part") == target).select("id", "label"))


def leaf_order(rows: np.ndarray) -> list[int]:
    """The leaves of an average-linkage tree over Hamming distances, the cluster with the smaller number left.

    Each row keeps its nearest one, the first of equals, so a merge costs n and not n squared.
    """
    n, m = rows.shape if rows.ndim == 2 else (len(rows), 0)
    if n < 2:
        return list(range(n))
    d = np.zeros((n, n))
    for column in rows.T:
        d += column[:, None] != column[None, :]
    d /= max(m, 1)
    np.fill_diagonal(d, np.inf)
    sizes, leaves, number = np.ones(n), [[i] for i in range(n)], list(range(n))
    near = d.argmin(axis=1)
    least = d[np.arange(n), near]
    last = 0
    for step in range(n - 1):
        at = int(np.argmin(least))
        i, j = sorted((at, int(near[at])))
        first, second = (i, j) if number[i] < number[j] else (j, i)
        joined = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
        joined[[i, j]] = np.inf
        d[i], d[:, i] = joined, joined
        d[j], d[:, j] = np.inf, np.inf
        leaves[i], sizes[i], number[i], last = leaves[first] + leaves[second], sizes[i] + sizes[j], n + step, i
        again = (near == i) | (near == j)
        again[[i, j]] = True
        closer = ~again & ((joined < least) | ((joined == least) & (i < near) & np.isfinite(joined)))
        near[closer], least[closer] = i, joined[closer]
        some = np.flatnonzero(again)
        near[some] = d[some].argmin(axis=1)
        least[some] = d[some, near[some]]
    return leaves[last]


def reorder_assignments(assign: DataFrame, consensus: DataFrame | None = None, col_sort: bool = True, row_sort: bool = True, seed: int | None = None) -> DataFrame:
    """``(part, id, label, row, col)``: matched labels with the place of each id and partition, similar ones side by side.

    Partitions are grouped by their largest label, ids by the label of ``consensus`` ``(id, label)`` if given.
    """
    t = collected(match_assignments(assign, seed=seed)).pivot(index="id", columns="part", values="label")
    if max(t.shape) > MAX_DENSE:
        raise ValueError(f"more than {MAX_DENSE} ids or partitions")
    m = t.to_numpy()
    cols, rows = list(range(m.shape[1])), list(range(m.shape[0]))
    if col_sort:
        tops = m.max(axis=0)
        cols = [c for top in np.unique(tops) for at in [np.flatnonzero(tops == top)] for c in at[leaf_order(m[:, at].T)].tolist()]
    if row_sort:
        group = np.zeros(len(m)) if consensus is None else collected(require(consensus, "id", "label")).set_index("id")["label"].reindex(t.index).to_numpy()
        rows = [r for g in np.unique(group) for at in [np.flatnonzero(group == g)] for r in at[leaf_order(m[np.ix_(at, cols)])].tolist()]
    found = [(int(t.columns[c]), int(t.index[r]), int(m[r, c]), i, j) for i, r in enumerate(rows) for j, c in enumerate(cols)]
    return assign.sparkSession.createDataFrame(found, ASSIGN + ", row int, col int")


def agreement_matrix(assign: DataFrame) -> DataFrame:
    """``(src, dst, w)``: in how many partitions two different ids have the same label; pairs without any have no row."""
    a = assignments_of(assign)
    other = a.withColumnRenamed("id", "dst")
    return a.withColumnRenamed("id", "src").join(other, ["part", "label"]).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def canonical(assign: DataFrame) -> DataFrame:
    """The same partitions with labels 0, 1, ... in the order of the least id that has them."""
    a = assignments_of(assign)
    first = a.groupBy("part", "label").agg(F.min("id").alias("first"))
    names = first.select("part", "label", (F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1).cast("long").alias("new"))
    return a.join(names, ["part", "label"]).select("part", "id", F.col("new").alias("label"))


def unique_partitions(assign: DataFrame) -> DataFrame:
    """``(part, id, label)``: canonical partitions, of equal ones that with the least number."""
    c = canonical(assign)
    sign = c.groupBy("part").agg(F.bit_xor(F.xxhash64("id", "label")).alias("a"), F.bit_xor(F.xxhash64("label", "id", F.lit(7))).alias("b"), F.count(F.lit(1)).alias("n"))
    kept = sign.groupBy("a", "b", "n").agg(F.min("part").alias("part")).select("part")
    return c.join(kept, "part", "left_semi")


def _z_of(sums: DataFrame) -> DataFrame:
    """z-Rand from n, the sums of squares and cubes of both margins (x2, x3, y2, y3) and of the cells (c2)."""
    half = sums.selectExpr("*", "n * (n - 1) / 2 AS m", "(x2 - n) / 2 AS m1", "(y2 - n) / 2 AS m2", "(c2 - n) / 2 AS wab", "n * (n * n - 3 * n - 2) AS base")
    more = half.selectExpr("*", "base - 8 * (n + 1) * m1 + 4 * x3 AS c1", "base - 8 * (n + 1) * m2 + 4 * y3 AS c2x", "pow(4 * m1 - 2 * m, 2) AS p1", "pow(4 * m2 - 2 * m, 2) AS p2")
    spread = more.withColumn(
        "v",
        F.expr("m / 16 - p1 * p2 / (256 * m * m) + c1 * c2x / (16 * n * (n - 1) * (n - 2)) + (p1 - 4 * c1 - 4 * m) * (p2 - 4 * c2x - 4 * m) / (64 * n * (n - 1) * (n - 2) * (n - 3))"),
    )
    z = F.when(F.col("v") < 0, F.lit(0.0)).otherwise(null_div(F.expr("wab - m1 * m2 / m"), F.sqrt("v")))
    return spread.withColumn("z", z)


def zrand_partitions(assign: DataFrame) -> DataFrame:
    """``(part_a, part_b, z)`` for each two partitions, part_a < part_b: the z-score of the Rand index.

    NULL where a partition has one label only, or there are fewer than four ids; 0 where the variance is negative.
    """
    a = assignments_of(assign)
    margin = a.groupBy("part", "label").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("part").agg(F.sum("k").alias("n"), F.sum(F.expr("k * k")).alias("s2"), F.sum(F.expr("k * k * k")).alias("s3"), F.count(F.lit(1)).alias("labels"))
    x, y = a.withColumnRenamed("part", "part_a").withColumnRenamed("label", "lx"), a.withColumnRenamed("part", "part_b").withColumnRenamed("label", "ly")
    cells = x.join(y, "id").filter("part_a < part_b").groupBy("part_a", "part_b", "lx", "ly").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("part_a", "part_b").agg(F.sum(F.expr("k * k")).alias("c2"))
    sides = cells.join(margin.selectExpr("part AS part_a", "n", "s2 AS x2", "s3 AS x3", "labels AS la"), "part_a").join(margin.selectExpr("part AS part_b", "s2 AS y2", "s3 AS y3", "labels AS lb"), "part_b")
    some = sides.filter("la > 1 AND lb > 1 AND n > 3")
    return sides.select("part_a", "part_b").join(_z_of(some).select("part_a", "part_b", "z"), ["part_a", "part_b"], "left")


def zrand(x: DataFrame, y: DataFrame) -> DataFrame:
    """``(z)`` of two tables ``(id, label)``."""
    both = x.select(F.lit(0).alias("part"), "id", "label").unionByName(y.select(F.lit(1).alias("part"), "id", "label"))
    return zrand_partitions(both).select("z")


def get_modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """``(label, q)``: what each community of ``labels`` ``(id, label)`` adds to the modularity."""
    e, c = edges_of(edges), require(labels, "id", "label")
    ends = e.join(c.selectExpr("id AS dst", "label AS ld"), "dst").join(c.selectExpr("id AS src", "label AS ls"), "src")
    sides = ends.select(F.col("ls").alias("label"), F.col("w").alias("o"), F.lit(0.0).alias("i"), F.when(F.expr("ls = ld"), F.col("w")).otherwise(0.0).alias("inner"))
    sides = sides.unionByName(ends.select(F.col("ld").alias("label"), F.lit(0.0).alias("o"), F.col("w").alias("i"), F.lit(0.0).alias("inner")))
    sums = sides.groupBy("label").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("inner").alias("inner"))
    every = c.select("label").distinct().join(sums, "label", "left").fillna(0.0)
    return beside(every, e.agg(F.sum("w").alias("s"))).select("label", null_div(F.col("inner") - null_div(gamma * F.col("o") * F.col("i"), F.col("s")), F.col("s")).alias("q"))


def _null_modularity(edges: DataFrame, labels: DataFrame, gamma: float, n_perm: int, seed: int) -> DataFrame:
    """``(perm, label, q)`` with the labels shuffled over the nodes."""
    table = collected(require(labels, "id", "label")).sort_values("id")
    net = Network(collected(edges_of(edges)), table["id"].to_numpy())
    names, label = np.unique(table["label"].to_numpy(), return_inverse=True)
    out, into, total = np.bincount(net.frm, net.w, len(net)), np.bincount(net.to, net.w, len(net)), net.w.sum()

    def run(perm: int) -> pd.DataFrame:
        c = np.random.default_rng((seed, perm)).permutation(label)
        same = c[net.frm] == c[net.to]
        inner = np.bincount(c[net.frm[same]], net.w[same], len(names))
        q = (inner - gamma * np.bincount(c, out, len(names)) * np.bincount(c, into, len(names)) / total) / total
        return pd.DataFrame({"perm": perm, "label": names, "q": q})

    return replicates(edges.sparkSession, n_perm, run, "perm long, label long, q double")


def get_modularity_z(edges: DataFrame, labels: DataFrame, gamma: float = 1.0, n_perm: int = 10_000, seed: int = 0) -> DataFrame:
    """``(z)``: the mean over communities of the modularity's z-score among shuffled labels; without scaling if any has no spread."""
    null = _null_modularity(edges, labels, gamma, n_perm, seed).groupBy("label").agg(F.avg("q").alias("m"), F.stddev_pop("q").alias("s"))
    rows = get_modularity(edges, labels, gamma).join(null, "label")
    return rows.agg(F.when(F.min("s") == 0, F.avg(F.expr("q - m"))).otherwise(F.avg(null_div(F.expr("q - m"), F.col("s")))).alias("z"))


def get_modularity_sig(edges: DataFrame, labels: DataFrame, gamma: float = 1.0, n_perm: int = 10_000, alpha: float = 0.01, seed: int = 0) -> DataFrame:
    """``(label, significant)``: whether a community's modularity is above the ``1 - alpha`` quantile among shuffled labels."""
    null = _null_modularity(edges, labels, gamma, n_perm, seed).groupBy("label").agg(F.percentile("q", F.lit(1 - alpha)).alias("bar"))
    return get_modularity(edges, labels, gamma).join(null, "label").select("label", (F.col("q") > F.col("bar")).alias("significant"))


def louvain_labels(w: np.ndarray, gamma: float, rng: np.random.Generator, b: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Louvain's labels and modularity of a matrix; ``b`` replaces the modularity matrix."""
    n, s = len(w), w.sum()
    if b is None:
        b = w - gamma * np.outer(w.sum(axis=1), w.sum(axis=0)) / s if s else w.copy()
    b = (b + b.T) / 2
    top, labels = b, np.arange(n)
    while True:
        k = len(b)
        own = np.arange(k)
        gain = b.copy()  # gain[i, c]: what node i is tied to community c with
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in rng.permutation(k):
                change = gain[i] - gain[i, own[i]] + b[i, i]
                change[own[i]] = 0
                to = int(np.argmax(change))
                if change[to] > 1e-10:
                    gain[:, to] += b[:, i]
                    gain[:, own[i]] -= b[:, i]
                    own[i], moved, moved_any = to, True, True
        names, own = np.unique(own, return_inverse=True)
        labels = own[labels]
        if not moved_any or len(names) == 1:
            break
        member = np.eye(len(names))[own]
        b = member.T @ b @ member
    same = labels[:, None] == labels[None, :]
    return labels, float(top[same].sum() / s) if s else 0.0


def community_louvain(edges: DataFrame, nodes: DataFrame | None = None, gamma: float = 1.0, runs: int = 1, seed: int = 0, b: DataFrame | None = None) -> DataFrame:
    """``(part, id, label, q)``: communities by Louvain's method, one partition for each run; ``q`` is its modularity.

    ``b`` ``(src, dst, w)`` takes the place of the modularity matrix.
    """
    ids = collected((ids_of(edges_of(edges)) if nodes is None else require(nodes, "id")).distinct(), MAX_DENSE)["id"].to_numpy()
    net = Network(collected(edges_of(edges)), ids)
    given = None if b is None else Network(collected(edges_of(b)), net.ids).matrix()

    def run(number: int) -> pd.DataFrame:
        labels, q = louvain_labels(net.matrix(), gamma, np.random.default_rng((seed, number)), given)
        return pd.DataFrame({"part": number, "id": net.ids, "label": labels, "q": q})

    return replicates(edges.sparkSession, runs, run, ASSIGN + ", q double")


def consensus_clustering(agreement: DataFrame, nodes: DataFrame, threshold: float, n_it: int = 10, seed: int = 0, rounds: int = 100) -> DataFrame:
    """``(id, label)``: communities of the agreement from ``threshold`` on, agreed on again until all runs are equal.

    Labels begin with 1; every node is alone if no agreement is left.
    """
    ids = require(nodes, "id").distinct()
    for number in range(rounds):
        kept = cut(edges_of(agreement).filter((F.col("w") >= threshold) & (F.col("w") != 0) & (F.col("src") != F.col("dst"))))
        if not kept.take(1):
            return in_order(ids, "id").select("id", (F.col("place") + 1).cast("long").alias("label"))
        parts = cut(community_louvain(kept, ids, runs=n_it, seed=seed + number).select("part", "id", "label"))
        alike = unique_partitions(parts)
        if alike.select("part").distinct().count() == 1:
            return alike.select("id", (F.col("label") + 1).alias("label"))
        agreement = agreement_matrix(parts).select("src", "dst", (F.col("w") / n_it).alias("w"))
    raise RuntimeError(f"no consensus in {rounds} rounds")


def shuffled(assign: DataFrame, seed: int = 0) -> DataFrame:
    """The same partitions with the labels of each shuffled over its ids, in an order by hash."""
    a = assignments_of(assign)
    place = a.select("part", "id", F.row_number().over(Window.partitionBy("part").orderBy("id")).alias("k"))
    drawn = a.select("part", "label", F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "part", "id"), "id")).alias("k"))
    return place.join(drawn, ["part", "k"]).select("part", "id", "label")


def find_consensus(assign: DataFrame, null_func: str | Callable[[Column], Column] = "mean", seed: int = 0, return_agreement: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``(id, label)`` by consensus; the threshold is the ``mean`` or ``max`` agreement of shuffled labels, zeros counted.

    ``null_func`` may be any aggregate of a column, such as ``F.median``; it then sees the agreement of each two ids, the
    n times n of them with zeros, and so a row for each.  With ``return_agreement`` also the agreement above the threshold.
    """
    a = cut(assignments_of(assign))
    parts, n = a.agg(F.count_distinct("part"), F.count_distinct("id")).first()
    share = agreement_matrix(a).select("src", "dst", (F.col("w") / parts).alias("w"))
    null = agreement_matrix(shuffled(a, seed)).select("src", "dst", (F.col("w") / parts).alias("w"))
    if callable(null_func):
        ids = a.select("id").distinct()
        every = ids.selectExpr("id AS src").crossJoin(ids.selectExpr("id AS dst")).join(null, ["src", "dst"], "left")
        threshold = float(every.agg(null_func(F.coalesce("w", F.lit(0.0))).alias("t")).first().t)
    elif null_func in ("mean", "max"):
        total, top = null.agg(F.sum("w"), F.max("w")).first()
        threshold = (total or 0.0) / (n * n) if null_func == "mean" else top or 0.0
    else:
        raise ValueError("null_func is 'mean', 'max' or an aggregate")
    found = consensus_clustering(share, a.select("id").distinct(), threshold, seed=seed)
    return (found, share.filter(F.col("w") > threshold)) if return_agreement else found


def consensus_modularity(edges: DataFrame, gamma: float = 1.0, repeats: int = 250, seed: int = 0, b: DataFrame | None = None, null_func: str | Callable[[Column], Column] = "mean") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The consensus ``(id, label)`` of Louvain's runs, their modularities ``(part, q)`` and pairwise z-Rand.

    ``b`` ``(src, dst, w)`` takes the place of the modularity matrix, ``null_func`` is that of ``find_consensus``.
    """
    runs = cut(community_louvain(edges, gamma=gamma, runs=repeats, seed=seed, b=b))
    return find_consensus(runs, null_func, seed=seed), runs.groupBy("part").agg(F.first("q").alias("q")), zrand_partitions(runs)

