"""Matrix products over edge tables, and dense blocks for what needs a whole matrix at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes up to which an operator may hold the whole matrix in one task: 8 bytes a cell, a few copies.
MAX_DENSE = 5000


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(src, dst, w)`` of the matrix product: a join on the inner index and a sum."""
    left, right = a.select("src", F.col("dst").alias("k"), F.col("w").alias("wa")), b.select(F.col("src").alias("k"), "dst", F.col("w").alias("wb"))
    return left.join(right, "k").groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def to_matrix(rows: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    out = np.zeros((len(ids), len(ids)))
    out[np.searchsorted(ids, rows["src"].to_numpy()), np.searchsorted(ids, rows["dst"].to_numpy())] = rows["w"].to_numpy()
    return out


def dense_block(edges: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], nodes: DataFrame | None = None, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(src, dst, w)`` of ``kernel(matrix)``, computed in one task with numpy.

    ``nodes`` adds nodes without edges.  A network of more than ``MAX_DENSE`` nodes is refused rather than cut.
    """
    rows = edges.select(F.lit(0).alias("block"), "src", "dst", "w")
    if nodes is not None:
        rows = rows.unionByName(nodes.select(F.lit(0).alias("block"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("w")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((part["src"].to_numpy(), part["dst"].to_numpy())))
        if len(ids) > MAX_DENSE:
            raise ValueError(f"{len(ids)} nodes; this operator holds the whole matrix and takes {MAX_DENSE} at most")
        out = np.asarray(kernel(to_matrix(part[part["w"].notna()], ids)), float)
        some = np.ones(out.shape, bool) if keep is None else keep(out)
        i, j = np.nonzero(some)
        return pd.DataFrame({"src": ids[i], "dst": ids[j], "w": out[i, j]})

    return rows.groupBy("block").applyInPandas(run, "src long, dst long, w double")


def expm(a: np.ndarray) -> np.ndarray:
    """The matrix exponential by scaling, a Taylor sum to machine precision, and squaring."""
    norm = np.abs(a).sum(axis=0).max(initial=0.0)
    if not np.isfinite(norm):
        return np.full(a.shape, np.nan)
    squarings = max(0, int(np.ceil(np.log2(norm / 0.25)))) if norm > 0.25 else 0
    x = a / 2.0**squarings
    total, term = np.eye(len(a)), np.eye(len(a))
    for k in range(1, 30):
        term = term @ x / k
        total += term
        if np.abs(term).max(initial=0) <= 1e-17 * np.abs(total).max(initial=1):
            break
    for _ in range(squarings):
        total = total @ total
    return total


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of least cost, rows in order: shortest augmenting paths."""
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        columns, rows = hungarian(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            row = match[at]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            back[1:][better] = at
            nxt = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nxt
            if match[at] == 0:
                break
        while at:
            match[at] = match[back[at]]
            at = back[at]
    columns = np.flatnonzero(match[1:])
    order = np.argsort(match[1:][columns])
    return match[1:][columns][order] - 1, columns[order]
