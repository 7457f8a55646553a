"""Degrees, Laplacian, assortativity, matching index and hub classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.special import student_t_sf
from graphloom.model import beside, edges_of, ends, ids_of, nodes_of, null_div, require

#: Edges of a node beyond which several tasks make its wedges.
HUB = 2000


def _every(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    return ids_of(edges) if nodes is None else require(nodes, "id").select(F.col("id").cast("long").alias("id")).distinct()


def degrees_und(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, degree)``: edges with w > 0 into each node; nodes without any have 0."""
    e = edges_of(edges)
    counts = e.filter("w > 0").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return _every(nodes, e).join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degrees_dir(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, in_degree, out_degree, degree)``: edges with w > 0 into, out of, and at each node."""
    e = edges_of(edges)
    some = e.filter("w > 0")
    both = some.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(some.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counts = both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("long")
    return (
        _every(nodes, e).join(counts, "id", "left")
        .select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))
        .withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    )


def binarize(edges: DataFrame) -> DataFrame:
    """Weight 1 for each edge with w > 0, no row for any other."""
    return edges_of(edges).filter("w > 0").select("src", "dst", F.lit(1.0).alias("w"))


def graph_laplacian(edges: DataFrame) -> DataFrame:
    """Diagonal of column sums minus the network; self-loops cancel in part."""
    e = edges_of(edges)
    diagonal = e.groupBy("dst").agg(F.sum("w").alias("w")).select(F.col("dst").alias("src"), "dst", "w")
    return diagonal.unionByName(e.select("src", "dst", (-F.col("w")).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def assortativity_und(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(assortativity)``: correlation of a node value over the ends of edges, weighted by them.

    Means and variance weigh each node by its column sum.  Two passes, so large values lose no precision.
    """
    e = ends(edges_of(edges), nodes_of(nodes))
    mean = e.agg(null_div(F.sum(F.col("w") * F.col("xd")), F.sum("w")).alias("m"))
    z = beside(e, mean).select("w", (F.col("xs") - F.col("m")).alias("a"), (F.col("xd") - F.col("m")).alias("b"))
    return z.agg(null_div(F.sum(F.expr("w * a * b")), F.sum(F.expr("w * b * b"))).alias("assortativity"))


def assortativity_dir(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(assortativity)`` of a directed network: sources by out-strength, targets by in-strength."""
    e = ends(edges_of(edges), nodes_of(nodes))
    mean = e.agg(null_div(F.sum(F.expr("w * xs")), F.sum("w")).alias("mo"), null_div(F.sum(F.expr("w * xd")), F.sum("w")).alias("mi"))
    z = beside(e, mean).selectExpr("w", "xs - mo AS a", "xd - mi AS b")
    return z.agg(null_div(F.sum(F.expr("w * a * b")), F.sqrt(F.sum(F.expr("w * a * a")) * F.sum(F.expr("w * b * b")))).alias("assortativity"))


def wedges(edges: DataFrame) -> DataFrame:
    """``(k, i, wi, j, wj)``: each two edges i-k and j-k with one end in common, both ways round and an edge with itself.

    A node of degree d has d squared of them.  Those of a node of more than ``HUB`` edges are made by several tasks:
    its edges are dealt to as many parts, and each part meets all of them.
    """
    e = edges.select("src", F.col("dst").alias("k"), "w")
    parts = e.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("parts"))
    dealt = e.join(parts, "k")
    a = dealt.select("k", F.pmod(F.xxhash64("src"), "parts").alias("part"), F.col("src").alias("i"), F.col("w").alias("wi"))
    b = dealt.select("k", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("src").alias("j"), F.col("w").alias("wj"))
    return a.join(b, ["k", "part"]).select("k", "i", "wi", "j", "wj")


def matching_index(edges: DataFrame) -> DataFrame:
    """``(src, dst, w)`` for pairs of different nodes with common neighbours: twice their number over the strengths of
    both, without the edge between them.  Pairs without any are 0 and have no row.

    The network is undirected, without negative weights; self-loops are ignored.
    """
    e = edges_of(edges).filter("w <> 0 AND src <> dst")
    strength = e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("s"))
    common = wedges(e).filter("i <> j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))
    si, sj = strength.select(F.col("id").alias("i"), F.col("s").alias("si")), strength.select(F.col("id").alias("j"), F.col("s").alias("sj"))
    direct = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w")
    return (
        common.join(direct, ["i", "j"], "left").join(si, "i").join(sj, "j")
        .select(F.col("i").alias("src"), F.col("j").alias("dst"), null_div(2 * F.col("c"), F.expr("si + sj - 2 * coalesce(w, 0)")).alias("w"))
        .filter("w IS NOT NULL")
    )


def rich_feeder_peripheral(values: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, stat: str = "median") -> DataFrame:
    """``(threshold, kind, value, p)`` for each degree threshold from 0 to one less than the largest degree.

    Nodes of at least that degree are hubs.  ``values`` are ``(src, dst, w)`` for each pair src < dst; a pair is rich
    with two hubs, feeder with one, peripheral with none.  ``value`` is the median or mean; ``p`` is from a one-sided
    Welch test: rich against all other pairs, feeder against peripheral, peripheral against feeder.  A class without
    pairs has no value, and tests with fewer than two values on a side no p.
    """
    if stat not in ("mean", "median"):
        raise ValueError("stat is 'mean' or 'median'")
    degree = degrees_und(edges, nodes)
    pairs = edges_of(values).filter("src < dst").join(degree.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(degree.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    most = degree.agg(F.max("degree").alias("top"))
    rows = beside(pairs, most).filter("top > 0").select("w", "ds", "dd", F.explode(F.expr("sequence(0, top - 1)")).alias("threshold"))
    kinds = rows.select("threshold", "w", F.expr("CASE int(ds >= threshold) + int(dd >= threshold) WHEN 2 THEN 'rich' WHEN 1 THEN 'feeder' ELSE 'peripheral' END").alias("kind"))
    middle = F.expr("percentile(w, 0.5)") if stat == "median" else F.avg("w")
    own = kinds.groupBy("threshold", "kind").agg(middle.alias("value"), F.count("w").alias("n"), F.avg("w").alias("m"), F.var_samp("w").alias("v"))

    def side(kind: str, frame: DataFrame, prefix: str) -> DataFrame:
        picked = frame.filter(F.col("kind") == kind) if kind else frame
        return picked.select("threshold", *[F.col(c).alias(prefix + c) for c in ("n", "m", "v")])

    rest = kinds.filter("kind <> 'rich'").groupBy("threshold").agg(F.count("w").alias("n"), F.avg("w").alias("m"), F.var_samp("w").alias("v"))
    tests = None
    for kind, other in (("rich", side("", rest, "b")), ("feeder", side("peripheral", own, "b")), ("peripheral", side("feeder", own, "b"))):
        one = own.filter(F.col("kind") == kind).join(other, "threshold", "left").select("threshold", "kind", "value", "n", "m", "v", "bn", "bm", "bv")
        tests = one if tests is None else tests.unionByName(one)
    se = F.expr("v / n + bv / bn")
    t = null_div(F.expr("m - bm"), F.sqrt(se))
    df = null_div(se * se, F.expr("(v / n) * (v / n) / nullif(n - 1, 0) + (bv / bn) * (bv / bn) / nullif(bn - 1, 0)"))
    return tests.select(F.col("threshold").cast("int").alias("threshold"), "kind", "value", student_t_sf(t, df).alias("p"))


