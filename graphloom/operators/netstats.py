"""Correlation, variance, covariance and polarisation of node values on a network."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.linalg import dense_block
from graphloom.model import beside, edges_of, ends, nodes_of, null_div, require
from graphloom.operators.graph import graph_laplacian


def network_pearsonr(nodes: DataFrame, edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``(r)``: correlation of two node values in which pairs weigh by the network."""
    n = require(nodes, "id", x, y).select(F.col("id").cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    z = beside(n, n.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))).selectExpr("id", "x - mx AS x", "y - my AS y")
    e = edges_of(edges).join(z.selectExpr("id AS src", "x AS xi", "y AS yi"), "src").join(z.selectExpr("id AS dst", "x AS xj", "y AS yj"), "dst")
    s = e.agg(F.sum(F.expr("w * xi * yj")).alias("a"), F.sum(F.expr("w * xi * xj")).alias("b"), F.sum(F.expr("w * yi * yj")).alias("c"))
    return s.select(null_div(F.col("a"), F.sqrt("b") * F.sqrt("c")).alias("r"))


def network_pearsonr_pairwise(maps: DataFrame, edges: DataFrame) -> DataFrame:
    """``(map_a, map_b, r)`` for each pair of the maps ``(map_id, id, x)``.

    The lag of each map is summed once; pairs are then products over nodes, so nothing of size maps^2 nodes^2 exists.
    """
    m = require(maps, "map_id", "id", "x").select("map_id", F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"))
    mean = m.groupBy("map_id").agg(F.avg("x").alias("m"))
    z = m.join(mean, "map_id").select("map_id", "id", (F.col("x") - F.col("m")).alias("x"))
    lag = edges_of(edges).join(z.withColumnRenamed("id", "dst"), "dst").groupBy("map_id", F.col("src").alias("id")).agg(F.sum(F.expr("w * x")).alias("lag"))
    cross = z.selectExpr("map_id AS map_a", "id", "x").join(lag.selectExpr("map_id AS map_b", "id", "lag"), "id").groupBy("map_a", "map_b").agg(F.sum(F.expr("x * lag")).alias("s"))
    own = cross.filter("map_a = map_b")
    a, b = own.selectExpr("map_a", "s AS sa"), own.selectExpr("map_b", "s AS sb")
    return cross.join(a, "map_a").join(b, "map_b").select("map_a", "map_b", null_div(F.col("s"), F.sqrt("sa") * F.sqrt("sb")).alias("r"))


def effective_resistance(edges: DataFrame, directed: bool = True) -> DataFrame:
    """``(src, dst, w)``: q_ii - q_ij - q_ji + q_jj of the pseudo-inverse Laplacian, for all pairs."""

    def kernel(a: np.ndarray) -> np.ndarray:
        q = np.linalg.pinv(a, hermitian=not directed)
        d = np.diag(q)
        return d[:, None] - q - q.T + d[None, :]

    return dense_block(graph_laplacian(edges), kernel, keep=lambda m: np.ones(m.shape, bool))


def polarisation_difference(nodes: DataFrame) -> DataFrame:
    """``(id, x)``: positive values over their largest, less the size of negative ones over theirs."""
    n = nodes_of(nodes)
    most = n.agg(F.max(F.greatest("x", F.lit(0.0))).alias("p"), F.max(F.greatest(-F.col("x"), F.lit(0.0))).alias("q"))
    return beside(n, most).select("id", F.when(F.col("x") > 0, null_div(F.col("x"), F.col("p"))).when(F.col("x") < 0, null_div(F.col("x"), F.col("q"))).otherwise(0.0).alias("x"))


def network_polarisation(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """``(polarisation)``: the length of the polarisation difference in the pseudo-inverse Laplacian."""
    q = dense_block(graph_laplacian(edges), lambda a: np.linalg.pinv(a, hermitian=not directed))
    return ends(q, polarisation_difference(nodes)).agg(F.sqrt(F.sum(F.expr("xs * w * xd"))).alias("polarisation"))


def network_variance(nodes: DataFrame, distances: DataFrame) -> DataFrame:
    """``(variance)``: half the sum of p_i p_j d_ij^2, p being the values over their sum."""
    n = nodes_of(nodes)
    p = beside(n, n.agg(F.sum("x").alias("s"))).select("id", null_div(F.col("x"), F.col("s")).alias("x"))
    return ends(edges_of(distances), p).agg((0.5 * F.sum(F.expr("xs * xd * w * w"))).alias("variance"))


def network_covariance(joint: DataFrame, distances: DataFrame, calc_marginal: bool = True) -> DataFrame:
    """``(covariance, var_p, var_q)`` of a joint distribution ``(src, dst, w)``; without marginals the variances are 0."""
    j, d = edges_of(joint), edges_of(distances).withColumnRenamed("w", "d")
    p = j.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("p"))
    q = j.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("q"))
    pq = p.join(q, "id", "full").selectExpr("id", "coalesce(p, 0) AS p", "coalesce(q, 0) AS q")
    rows = d.join(pq.selectExpr("id AS src", "p AS pi", "q AS qi"), "src").join(pq.selectExpr("id AS dst", "p AS pj", "q AS qj"), "dst").join(j, ["src", "dst"], "left")
    half = lambda e: (0.5 * F.coalesce(F.sum(F.expr(e)), F.lit(0.0)))
    zero = F.lit(0.0)
    return rows.agg(
        half("(pi * qj - coalesce(w, 0)) * d * d").alias("covariance"),
        (half("pi * pj * d * d") if calc_marginal else zero).alias("var_p"),
        (half("qi * qj * d * d") if calc_marginal else zero).alias("var_q"),
    )
