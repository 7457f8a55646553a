"""Spatial autocorrelation: Moran, Geary and Lee, of all nodes together and of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import beside, edges_of, ends, nodes_of, null_div


def _centred(nodes: DataFrame, value: str = "x") -> DataFrame:
    """``(id, x)`` less its mean."""
    n = nodes_of(nodes, value)
    return beside(n, n.agg(F.avg("x").alias("m"))).select("id", (F.col("x") - F.col("m")).alias("x"))


def _moment(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.sum(F.expr("x * x")).alias("q"), F.count(F.lit(1)).alias("n"))


def _neighbours(edges: DataFrame, z: DataFrame) -> DataFrame:
    """``(id, lag, sw)``: sums of the neighbours' weighted values, and of weights; tasks sum up what they have before it moves."""
    to = z.select(F.col("id").alias("dst"), F.col("x").alias("xd"))
    return edges_of(edges).join(to, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.expr("w * xd")).alias("lag"), F.sum("w").alias("sw"))


def morans_i(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(morans_i)``: n sum w z_i z_j / (sum z^2 sum w); the weights may be asymmetric and have a diagonal."""
    z = _centred(nodes)
    s = z.join(_neighbours(edges, z), "id").agg(F.sum(F.expr("x * lag")).alias("a"), F.sum("sw").alias("sw"))
    return beside(s, _moment(z)).select(null_div(F.expr("n * a"), F.expr("q * sw")).alias("morans_i"))


def local_morans_i(nodes: DataFrame, edges: DataFrame, use_sampvar: bool = True) -> DataFrame:
    """``(id, morans_i)``: z_i times the weighted sum of its neighbours, over the variance."""
    z = _centred(nodes)
    rows = beside(z.join(_neighbours(edges, z), "id", "left"), _moment(z))
    return rows.select("id", null_div(F.expr("x * coalesce(lag, 0)"), F.col("q") / (F.col("n") - (1 if use_sampvar else 0))).alias("morans_i"))


def gearys_c(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(gearys_c)``: (n - 1) sum w (x_i - x_j)^2 / (2 sum w sum z^2)."""
    z = _centred(nodes)
    s = ends(edges_of(edges), z).agg(F.sum(F.expr("w * (xs - xd) * (xs - xd)")).alias("a"), F.sum("w").alias("sw"))
    return beside(s, _moment(z)).select(null_div(F.expr("(n - 1) * a"), F.expr("2 * sw * q")).alias("gearys_c"))


def local_gearys_c(nodes: DataFrame, edges: DataFrame, use_sampvar: bool = True) -> DataFrame:
    """``(id, gearys_c)``: the weighted sum of squared differences to the neighbours, over the variance."""
    z = _centred(nodes)
    sums = ends(edges_of(edges), z).groupBy(F.col("src").alias("id")).agg(F.sum(F.expr("w * (xs - xd) * (xs - xd)")).alias("a"))
    rows = beside(z.select("id").join(sums, "id", "left"), _moment(z))
    return rows.select("id", null_div(F.expr("coalesce(a, 0)"), F.col("q") / (F.col("n") - (1 if use_sampvar else 0))).alias("gearys_c"))


def _lags(nodes: DataFrame, edges: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    a, b = _centred(nodes, x), _centred(nodes, y).withColumnRenamed("x", "y")
    both = a.join(b, "id")
    to = both.select(F.col("id").alias("dst"), "x", "y")
    sums = edges_of(edges).join(to, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("row"), F.sum(F.expr("w * x")).alias("lx"), F.sum(F.expr("w * y")).alias("ly"))
    rows = both.select("id").join(sums, "id", "left").fillna(0.0, ["row", "lx", "ly"])
    return rows, both.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.expr("x * x"))).alias("qx"), F.sqrt(F.sum(F.expr("y * y"))).alias("qy"))


def lees_l(nodes: DataFrame, edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``(lees_l)``: n / sum of squared row sums, times the sum of products of both lags, over both norms."""
    rows, norms = _lags(nodes, edges, x, y)
    s = rows.agg(F.sum(F.expr("row * row")).alias("r"), F.sum(F.expr("lx * ly")).alias("a"))
    return beside(s, norms).select(null_div(F.expr("n * a"), F.expr("r * qx * qy")).alias("lees_l"))


def local_lees_l(nodes: DataFrame, edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``(id, lees_l)``: n times the product of both lags of a node, over both norms; row sums play no part."""
    rows, norms = _lags(nodes, edges, x, y)
    return beside(rows, norms).select("id", null_div(F.expr("n * lx * ly"), F.expr("qx * qy")).alias("lees_l"))
