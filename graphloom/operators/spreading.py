"""A model of agents that spread over a network, and the loss that they cause.

``paths`` are ``(src, dst, w, length)``; ``regions`` are ``(id, size)`` with optional ``clearance`` and ``synthesis``
scores.  Self-loops are ignored.  The state of a run is two vectors and two matrices that change some thousand times,
so a run is one task; runs of several seeds go side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.special import normal_cdf_of
from graphloom.linalg import MAX_DENSE
from graphloom.model import edges_of, require, safe_div
from graphloom.shipping import collected, replicates


class _World:
    def __init__(self, paths: DataFrame, regions: DataFrame, dt: float, p_stay: float, v: float, k: float):
        cols = [c for c in ("clearance", "synthesis") if c in regions.columns]
        r = collected(require(regions, "id", "size", *cols), MAX_DENSE).sort_values("id")
        p = collected(require(paths, "src", "dst", "w", "length", *(["fc"] if "fc" in paths.columns else [])))
        self.ids, self.size, self.dt, self.v = r["id"].to_numpy(), r["size"].to_numpy(float), dt, v
        n = len(r)
        i, j = np.searchsorted(self.ids, p["src"]), np.searchsorted(self.ids, p["dst"])
        self.length, density, fc = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))
        self.length[i, j], density[i, j] = p["length"], p["w"]
        if "fc" in p:
            fc[i, j] = p["fc"]
        for m in (self.length, density, fc):
            np.fill_diagonal(m, 0)
        pull = density * np.exp(k * fc)
        column = pull.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.leave = ((1 - p_stay) * pull + p_stay * np.diag(column)) / column[:, None]
        np.fill_diagonal(self.leave, 0)
        self.clear, self.make = (self._rate(r[c].to_numpy(float)) if c in cols else np.full(n, 0.5) for c in ("clearance", "synthesis"))

    @staticmethod
    def _rate(score: np.ndarray) -> np.ndarray:
        return normal_cdf_of((score - score.mean()) / score.std()) if score.any() else np.full(len(score), 0.5)

    def move(self, inside: np.ndarray, under_way: np.ndarray, v: float) -> tuple[np.ndarray, np.ndarray]:
        out = inside[:, None] * self.leave * self.dt
        arrive = np.divide(under_way * v, self.length, out=np.zeros_like(under_way), where=self.length != 0) * self.dt
        return inside + arrive.sum(axis=0) - out.sum(axis=1), under_way - arrive + out

    def fill(self, v: float = 1.0, tol: float = 1e-7, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        inside, under_way = np.zeros(len(self.ids)), np.zeros_like(self.length)
        kept, made = np.exp(-self.clear * self.dt), self.make * self.size * self.dt
        for _ in range(most):
            before = inside
            inside, under_way = self.move(inside, under_way, v)
            inside = inside * kept + made
            if (np.abs(inside - before) < tol * before).all():
                return inside, under_way
        raise RuntimeError(f"agents did not settle in {most} steps")


def normal_spread(paths: DataFrame, regions: DataFrame, dt: float = 0.1, p_stay: float = 0.5, v: float = 1.0, k: float = 0.0) -> DataFrame:
    """``(id, agents)`` when growth, clearance and movement of normal agents balance."""
    world = _World(paths, regions, dt, p_stay, v, k)
    return replicates(paths.sparkSession, 1, lambda _: pd.DataFrame({"id": world.ids, "agents": world.fill(v)[0]}), "id long, agents double")


def misfolded_spread(
    paths: DataFrame, regions: DataFrame, seeds: list[int], t_total: int = 1000, dt: float = 0.1, p_stay: float = 0.5, v: float = 1.0, k: float = 0.0, trans_rate: float = 1.0, init_number: float = 1.0, fill_v: float | None = None,
    return_agents_in_paths: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``(seed, id, t, normal, misfolded)`` after each step t from 0, for a run from each seed region.

    Normal agents fill the network first; as in the model's first description, their speed there is 1 whatever ``v``
    is, unless ``fill_v`` is given.  With ``return_agents_in_paths`` also ``(seed, src, dst, normal, misfolded)``, the
    agents under way after the last step; it takes a run of its own.
    """
    world = _World(paths, regions, dt, p_stay, v, k)

    def steps(seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        normal, normal_paths = world.fill(1.0 if fill_v is None else fill_v)
        bad, bad_paths = np.zeros(len(world.ids)), np.zeros_like(world.length)
        bad[int(np.searchsorted(world.ids, seed))] = init_number
        cleared, made = 1 - np.exp(-world.clear * dt), world.make * world.size * dt
        for t in range(t_total):
            normal, normal_paths = world.move(normal, normal_paths, v)
            bad, bad_paths = world.move(bad, bad_paths, v)
            infected = normal * np.exp(-world.clear) * (1 - np.exp(-bad * (trans_rate / world.size) * dt))
            normal, bad = normal - normal * cleared - infected + made, bad - bad * cleared + infected
            yield t, normal, bad, normal_paths, bad_paths

    def run(number: int) -> pd.DataFrame:
        frames = [pd.DataFrame({"seed": seeds[number], "id": world.ids, "t": t, "normal": normal, "misfolded": bad}) for t, normal, bad, *_ in steps(seeds[number])]
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=["seed", "id", "t", "normal", "misfolded"])

    def under_way(number: int) -> pd.DataFrame:
        normal = bad = np.zeros_like(world.length)
        for *_, normal, bad in steps(seeds[number]):
            pass
        i, j = np.nonzero(world.length)
        return pd.DataFrame({"seed": seeds[number], "src": world.ids[i], "dst": world.ids[j], "normal": normal[i, j], "misfolded": bad[i, j]})

    inside = replicates(paths.sparkSession, len(seeds), run, "seed long, id long, t int, normal double, misfolded double")
    if not return_agents_in_paths:
        return inside
    return inside, replicates(paths.sparkSession, len(seeds), under_way, "seed long, src long, dst long, normal double, misfolded double")


def atrophy(edges: DataFrame, agents: DataFrame, dt: float = 0.1, k1: float = 0.5, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """``(*by, id, t, atrophy)``: summed loss by misfolded agents and, one step later, by the loss of neighbours.

    ``agents`` are ``(*by, id, t, normal, misfolded)``.  Where there are no agents the ratio is 0.
    """
    keys = list(by)
    share = F.when(F.expr("normal + misfolded") != 0, F.expr("misfolded / nullif(normal + misfolded, 0)")).otherwise(0.0)
    loss = require(agents, *keys, "id", "t", "normal", "misfolded").select(*keys, "id", "t", (1 - F.exp(-share * dt)).alias("loss"))
    e = edges_of(edges)
    column = e.groupBy("dst").agg(F.sum("w").alias("s")).select(F.col("dst").alias("src"), "s")
    pull = e.join(column, "src").select("src", "dst", safe_div(F.col("w"), F.col("s")).alias("w"))
    around = pull.join(loss.withColumnRenamed("id", "dst"), "dst").groupBy(*keys, F.col("src").alias("id"), "t").agg(F.sum(F.expr("w * loss")).alias("around"))
    order = Window.partitionBy(*keys, "id").orderBy("t")
    late = loss.join(around, [*keys, "id", "t"], "left").withColumn("late", F.coalesce(F.lag("around").over(order), F.lit(0.0)))
    grown = F.sum((1 - k1) * F.col("late") + k1 * F.col("loss")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return late.select(*keys, "id", "t", grown.alias("atrophy"))


def simulate_atrophy(paths: DataFrame, regions: DataFrame, seeds: list[int], t_total: int = 1000, dt: float = 0.1, p_stay: float = 0.5, v: float = 1.0, k: float = 0.0, k1: float = 0.5, trans_rate: float = 1.0, init_number: float = 1.0) -> DataFrame:
    """``(seed, id, t, atrophy)``: filling, spreading and loss in turn, for a run from each seed region."""
    agents = misfolded_spread(paths, regions, seeds, t_total, dt, p_stay, v, k, trans_rate, init_number)
    fc = F.coalesce(F.col("fc"), F.lit(0.0)) if "fc" in paths.columns else F.lit(0.0)
    edges = paths.filter("src <> dst").select("src", "dst", (F.col("w") * F.exp(k * fc)).alias("w"))
    return atrophy(edges, agents, dt, k1)

