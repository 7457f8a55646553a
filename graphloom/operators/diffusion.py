"""Communicability, first passage, resource efficiency and flow: what spreads over all paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.linalg import dense_block, expm
from graphloom.model import edges_of, ids_of, nodes_of, require, safe_div
from graphloom.operators.routing import every_id, mean_of_pairs
from graphloom.shipping import Network, collected, for_each

_ALL = lambda m: np.ones(m.shape, bool)
_OFF = lambda m: ~np.eye(len(m), dtype=bool)


def communicability_bin(edges: DataFrame, normalize: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """``(src, dst, w)``: the exponential of a 0/1 network, over its largest eigenvalue first if ``normalize``.

    Raises for a network with weights other than 0 and 1.
    """
    e = edges_of(edges)
    if e.filter("w NOT IN (0, 1)").take(1):
        raise ValueError("weights must be 0 or 1")

    def kernel(a: np.ndarray) -> np.ndarray:
        if normalize and (top := np.linalg.eigvals(a).real.max(initial=0)) > 0:
            a = a / top
        return expm(a)

    return dense_block(e, kernel, nodes, _ALL)


def communicability_wei(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(src, dst, w)`` for different nodes: the exponential of the network scaled by both row sums' square roots.

    A node without weight has no scale, and then no value is defined (NaN).
    """

    def kernel(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = a.sum(axis=1) ** -0.5
            return expm(scale[:, None] * a * scale[None, :])

    return dense_block(edges_of(edges), kernel, nodes, _OFF)


def mean_first_passage_time(edges: DataFrame, tol: float = 1e-3) -> DataFrame:
    """``(src, dst, w)``: expected steps of a random walk from src until it first meets dst; 0 from a node to itself."""

    def kernel(a: np.ndarray) -> np.ndarray:
        p = a / a.sum(axis=1, keepdims=True)
        values, vectors = np.linalg.eig(p.T)
        at = int(np.argmin(np.abs(values - 1)))
        if abs(values[at]) > 1 + tol:
            raise ValueError(f"the eigenvalue nearest to 1 is {values[at]}")
        still = vectors[:, at].real
        still = still / still.sum()
        z = np.linalg.inv(np.eye(len(p)) - p + still[None, :])
        return (np.diag(z)[None, :] - z) / still[None, :]

    return dense_block(edges_of(edges), kernel, keep=_ALL)


def diffusion_efficiency(edges: DataFrame) -> DataFrame:
    """``(src, dst, w)`` for different nodes: one over the mean first passage time."""
    return mean_first_passage_time(edges).filter("src <> dst").select("src", "dst", safe_div(F.lit(1.0), F.col("w")).alias("w"))


def global_diffusion_efficiency(edges: DataFrame) -> DataFrame:
    """``(value)``: the mean over pairs."""
    return mean_of_pairs(diffusion_efficiency(edges), ids_of(edges_of(edges)))


def resource_efficiency_bin(edges: DataFrame, lambda_prob: float = 0.5, nodes: DataFrame | None = None) -> DataFrame:
    """``(src, dst, w, prob)`` for linked pairs of different nodes.

    ``prob`` is the chance that a walk that stops at dst gets there in as many steps as the shortest path has; ``w`` is
    one over the number of walkers of which one does so with probability ``lambda_prob``, 1 if each does.  Edges count
    if w > 0.  Targets are spread over tasks, each with the whole network.
    """
    if not 0 < lambda_prob < 1:
        raise ValueError("lambda_prob must lie between 0 and 1")
    e = edges_of(edges).filter("w > 0")
    net = Network(collected(e.select("src", "dst", F.lit(1.0).alias("w"))))
    degree = np.maximum(np.diff(net.start), 1)

    def to_target(target: int) -> pd.DataFrame:
        at = int(np.searchsorted(net.ids, target))
        chance = np.zeros(len(net))
        chance[at] = 1
        hops = np.where(np.arange(len(net)) == at, 0, -1)
        prob = np.zeros(len(net))
        for step in range(1, len(net)):
            reached = np.bincount(net.frm, hops[net.to] == step - 1, len(net)) > 0
            fresh = reached & (hops < 0)
            if not fresh.any():
                break
            hops[fresh] = step
            chance = np.bincount(net.frm, chance[net.to], len(net)) / degree
            chance[at] = 1
            prob[fresh] = chance[fresh]
        some = np.flatnonzero(hops > 0)
        p = prob[some]
        with np.errstate(divide="ignore"):
            walkers = np.where(p >= 1, 1.0, np.log(1 - lambda_prob) / np.log1p(-np.minimum(p, 1)))
        return pd.DataFrame({"src": net.ids[some], "dst": target, "w": 1 / walkers, "prob": p})

    ids = every_id(e, None) if nodes is None else require(nodes, "id").join(ids_of(e), "id", "left_semi").distinct()
    return for_each(ids, lambda t: pd.concat([to_target(int(x)) for x in t]), "src long, dst long, w double, prob double")


def flow_graph(edges: DataFrame, rates: DataFrame | None = None, t: float = 1.0) -> DataFrame:
    """``(src, dst, w)``: flow between nodes up to time ``t`` in a walk whose nodes are left at ``rates`` ``(id, x)``, 1 by default."""
    e = edges_of(edges)
    speed = None if rates is None else dict(map(tuple, collected(nodes_of(rates)).to_numpy()))
    names = None if speed is None else np.sort(collected(ids_of(e))["id"].to_numpy())

    def kernel(a: np.ndarray) -> np.ndarray:
        r = np.ones(len(a)) if speed is None else np.array([speed[i] for i in names.tolist()])
        inflow = a.sum(axis=0)
        total = (inflow[None, :] / r[:, None]).sum(axis=0)
        share = inflow[None, :] / (total[None, :] * r[:, None])
        walk = np.diag(r) - a / inflow[None, :] * r[:, None]
        flow = total[None, :] * expm(-t * walk) * share
        return (flow + flow.T) / 2

    return dense_block(e, kernel, keep=_ALL)
