"""Networks from data: upper triangles, thresholds, spanning trees and group consensus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.iterate import cut, in_order
from graphloom.model import INF, beside, edges_of, ids_of, null_div, require
from graphloom.operators.routing import components
from graphloom.shipping import MAX_SENT, collected, replicates


def get_triu(edges: DataFrame, k: int = 1) -> DataFrame:
    """Rows with dst at least k after src."""
    return edges_of(edges).filter(F.col("dst") - F.col("src") >= k)


def _upper_percentile(upper: DataFrame, pairs: int, share: float) -> float:
    """The percentile of the weights of all pairs, those without an edge counting as 0 without having rows."""
    if not pairs:
        return INF
    n, below = upper.agg(F.count(F.lit(1)), F.count(F.when(F.col("w") < 0, 1))).first()
    absent = pairs - n
    at = share * (pairs - 1)
    low = int(at)
    places = {k: (k if k < below else None if k < below + absent else k - absent) for k in (low, min(low + 1, pairs - 1))}
    asked = sorted({k for k in places.values() if k is not None})
    values = {r.place: r.w for r in in_order(upper, "w").filter(F.col("place").isin(asked)).select("place", "w").collect()} if asked else {}
    first, second = (0.0 if k is None else values[k] for k in (places[low], places[min(low + 1, pairs - 1)]))
    return first + (second - first) * (at - low)


def binarize_network(edges: DataFrame, nodes: DataFrame, retain: float = 10, keep_diag: bool = False) -> DataFrame:
    """Weight 1 for what is above the ``100 - retain`` percentile of the upper triangle, absent pairs counting as 0.

    Work is in proportion to the edges: pairs without an edge are only counted.  If the percentile is below 0, all of
    them are above it and so in the result.
    """
    if not 0 <= retain <= 100:
        raise ValueError(f"retain must lie within 0 and 100, not {retain}")
    ids = cut(require(nodes, "id").select(F.col("id").cast("long").alias("id")).distinct())
    inside = edges_of(edges).join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    e = cut(inside.select("src", "dst", F.coalesce("w", F.lit(0.0)).alias("w")))
    n = ids.count()
    bar = _upper_percentile(e.filter("src < dst"), n * (n - 1) // 2, 1 - retain / 100)
    kept = e.filter(F.col("w") > bar).select("src", "dst")
    if bar < 0:
        every = ids.select(F.col("id").alias("src")).crossJoin(ids.select(F.col("id").alias("dst")))
        kept = kept.unionByName(every.join(e, ["src", "dst"], "left_anti"))
    return (kept if keep_diag else kept.filter("src <> dst")).select("src", "dst", F.lit(1.0).alias("w"))


def _joined_up(part: pd.DataFrame) -> pd.DataFrame:
    """The edges that link what better ones, or of equal ones those before, have not linked."""
    t = part.sort_values(["w", "src", "dst"], ascending=[False, True, True])
    ids, ends = np.unique(t[["src", "dst"]].to_numpy(), return_inverse=True)
    root = list(range(len(ids)))
    keep = []
    for a, b in ends.reshape(-1, 2).tolist():
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        keep.append(a != b)
        root[b] = a
    return t[keep][["src", "dst", "w"]]


def spanning_tree(edges: DataFrame, max_sent: int = MAX_SENT) -> DataFrame:
    """``(src, dst, w)``, src < dst: the maximum spanning forest; among equal weights the least pair comes first.

    At most ``max_sent`` edges are one task.  With more, every component takes its best edge outwards in each round, so
    there are log2 n rounds of several jobs.
    """
    e = cut(edges_of(edges).filter("src < dst AND w <> 0"))
    if e.limit(max_sent + 1).count() <= max_sent:
        return e.withColumn("forest", F.lit(0)).groupBy("forest").applyInPandas(_joined_up, "src long, dst long, w double")
    ids = cut(ids_of(e))
    place = ids.select("id", F.col("id").alias("component"))
    tree = None
    while True:
        open_ = e.join(place.selectExpr("id AS src", "component AS ca"), "src").join(place.selectExpr("id AS dst", "component AS cb"), "dst").filter("ca <> cb")
        sides = open_.select(F.col("ca").alias("c"), "src", "dst", "w").unionByName(open_.select(F.col("cb").alias("c"), "src", "dst", "w"))
        best = cut(sides.groupBy("c").agg(F.max(F.struct("w", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d"))).alias("b")).select((-F.col("b.s")).alias("src"), (-F.col("b.d")).alias("dst"), "b.w").distinct())
        if not best.take(1):
            return e.limit(0) if tree is None else tree
        tree = cut(best if tree is None else tree.unionByName(best))
        place = components(tree, ids)


def threshold_network(edges: DataFrame, nodes: DataFrame, retain: float = 10) -> DataFrame:
    """Weight 1, both ways, for the maximum spanning tree and the best other edges up to ``retain`` percent of all pairs.

    Raises if the tree alone has more.  Pairs without an edge are never added.
    """
    if not 0 <= retain <= 100:
        raise ValueError(f"retain must lie within 0 and 100, not {retain}")
    tree = cut(spanning_tree(edges))
    n, size = require(nodes, "id").distinct().count(), tree.count()
    rest = int(retain / 100 * (n * (n - 1) / 2)) - size
    if rest < 0:
        raise ValueError(f"the spanning tree has {size} edges, {-rest} more than {retain}% of all pairs")
    more = edges_of(edges).filter("src < dst AND w > 0").join(tree, ["src", "dst"], "left_anti").orderBy(F.col("w").desc(), "src", "dst").limit(rest)
    half = tree.select("src", "dst").unionByName(more.select("src", "dst"))
    return half.unionByName(half.selectExpr("dst AS src", "src AS dst")).select("src", "dst", F.lit(1.0).alias("w"))


def correlation_by_subject(series: DataFrame) -> DataFrame:
    """``(subject, src, dst, w)``, src < dst: correlation over time; NaN or NULL where one does not vary."""
    s = require(series, "subject", "id", "t", "v")
    return s.withColumnRenamed("id", "src").join(s.selectExpr("subject", "t", "id AS dst", "v AS y"), ["subject", "t"]).filter("src < dst").groupBy("subject", "src", "dst").agg(F.corr("v", "y").alias("w"))


def _both_ways(half: DataFrame) -> DataFrame:
    ids = ids_of(half)
    return half.unionByName(half.selectExpr("dst AS src", "src AS dst", "w")).unionByName(ids.selectExpr("id AS src", "id AS dst", "1.0D AS w"))


def func_consensus(series: DataFrame, n_boot: int = 1000, ci: float = 95, seed: int = 0) -> DataFrame:
    """``(src, dst, w)``: the group's correlations over ``(subject, id, t, v)``.

    Without bootstraps the mean of the subjects' own.  Otherwise that of all series end to end, without pairs whose
    ``100 - ci`` and ``ci`` percentiles over samples of time points differ in sign.
    """
    if not n_boot:
        own = correlation_by_subject(series).select("src", "dst", F.when(~F.isnan("w"), F.col("w")).alias("w"))
        return _both_ways(own.groupBy("src", "dst").agg(F.avg("w").alias("w")))
    table = collected(require(series, "subject", "id", "t", "v"), MAX_SENT).pivot(index="id", columns=["subject", "t"], values="v").sort_index(axis=1)
    data, ids = table.to_numpy(float), table.index.to_numpy()
    size = data.shape[1] // table.columns.get_level_values(0).nunique()
    i, j = np.triu_indices(len(ids), 1)

    def run(boot: int) -> pd.DataFrame:
        draw = np.random.default_rng((seed, boot)).integers(data.shape[1], size=size)
        with np.errstate(invalid="ignore", divide="ignore"):
            return pd.DataFrame({"src": ids[i], "dst": ids[j], "w": np.corrcoef(data[:, draw])[i, j]})

    boots = replicates(series.sparkSession, n_boot, run, "src long, dst long, w double")
    limits = boots.groupBy("src", "dst").agg(F.percentile("w", F.array(F.lit(1 - ci / 100), F.lit(ci / 100))).alias("p"))
    gone = limits.filter("signum(p[0]) + signum(p[1]) = 0").select("src", "dst", F.lit(True).alias("gone"))
    whole = correlation_by_subject(require(series, "subject", "id", "t", "v").select(F.lit(0).alias("subject"), "id", F.struct("subject", "t").alias("t"), "v")).select("src", "dst", "w")
    return _both_ways(whole.join(gone, ["src", "dst"], "left").select("src", "dst", F.when(F.col("gone"), 0.0).otherwise(F.col("w")).alias("w")))


def ecdf(values: DataFrame, value: str = "x") -> DataFrame:
    """``(q, prob)``: each value with the share of rows up to it, and the least one once more with 0."""
    v = require(values, value).select(F.col(value).cast("double").alias("q")).filter("q IS NOT NULL")
    counts = v.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    total = v.agg(F.count(F.lit(1)).alias("all"), F.min("q").alias("least"))
    steps = beside(in_order(counts, "q", sum_of="n", name="upto"), total).select("q", (F.col("upto") / F.col("all")).alias("prob"))
    return steps.unionByName(total.filter("all > 0").select(F.col("least").alias("q"), F.lit(0.0).alias("prob")))


def struct_consensus(stack: DataFrame, distances: DataFrame, nodes: DataFrame, conn_num_inter: int | None = None, conn_num_intra: int | None = None, weighted: bool = False) -> DataFrame:
    """``(src, dst, w)``: the group's network of subjects ``(subject, src, dst, w)`` with their length distribution.

    Pairs within and between the halves ``hemi`` of ``nodes`` ``(id, hemi)`` are treated apart: the lengths of the
    subjects' edges make as many bins as a subject has edges on average, and each bin gives the pair that most
    subjects have, then that of the greatest mean weight, then the first.  ``weighted`` takes the mean weight over all
    subjects.  The bins' limits are few beside pairs; Spark sends them along where their size allows.
    """
    s = require(stack, "subject", "src", "dst", "w")
    subjects = s.select("subject").distinct().agg(F.count(F.lit(1)).alias("subjects"))
    h = require(nodes, "id", "hemi")
    pairs = edges_of(distances).filter("src < dst AND w <> 0").withColumnRenamed("w", "d")
    pairs = pairs.join(h.selectExpr("id AS src", "hemi AS ha"), "src").join(h.selectExpr("id AS dst", "hemi AS hb"), "dst").select("src", "dst", "d", F.expr("int(ha = hb)").alias("intra"))
    counts = s.filter("src < dst").groupBy("src", "dst").agg(F.sum(F.expr("int(w > 0)")).alias("c"), F.sum("w").alias("total"))
    pairs = cut(pairs.join(counts, ["src", "dst"], "left").select("src", "dst", "d", "intra", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("total", F.lit(0.0)).alias("total")))
    some = pairs.filter("c > 0")
    fixed = F.lit(None).cast("double")
    given = F.when(F.col("intra") == 1, F.lit(conn_num_intra).cast("double") if conn_num_intra is not None else fixed).otherwise(F.lit(conn_num_inter).cast("double") if conn_num_inter is not None else fixed)
    sums = beside(some.groupBy("intra").agg(F.sum("c").alias("all"), F.min("d").alias("least")), subjects).select("intra", "all", "least", F.coalesce(given, F.col("all") / F.col("subjects")).alias("m"))
    upto = F.sum("c").over(Window.partitionBy("intra").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    steps = some.groupBy("intra", "d").agg(F.sum("c").alias("c")).select("intra", "d", upto.alias("upto")).join(sums, "intra").select("intra", "d", F.bround(F.col("upto") / F.col("all") * F.col("m")).alias("bin"), "m")
    steps = steps.unionByName(sums.select("intra", F.col("least").alias("d"), F.lit(0.0).alias("bin"), "m")).filter("bin < floor(m)")
    limits = steps.groupBy("intra", "bin").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    inside = pairs.join(limits, "intra").filter("d >= lo AND d <= hi")
    best = Window.partitionBy("intra", "bin").orderBy(F.desc("c"), null_div(F.col("total"), F.col("c")).desc_nulls_last(), "src", "dst")
    chosen = beside(inside.withColumn("k", F.row_number().over(best)).filter("k = 1").select("src", "dst", "total").distinct(), subjects)
    half = chosen.select("src", "dst", (F.col("total") / F.col("subjects") if weighted else F.lit(1.0)).alias("w"))
    return half.unionByName(half.selectExpr("dst AS src", "src AS dst", "w"))
