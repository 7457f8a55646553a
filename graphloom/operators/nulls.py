"""Random networks that keep degrees, lengths or strengths.

Each is a chain of random swaps and so a task by itself; replicates go side by side.  Results are
``(replicate, src, dst, w)`` and take one seed for all replicates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.linalg import MAX_DENSE
from graphloom.model import edges_of
from graphloom.shipping import Network, collected, replicates

EDGES = "replicate long, src long, dst long, w double"
ENERGIES: dict[str, Callable[[np.ndarray], float]] = {
    "sse": lambda d: float((d**2).sum()),
    "max": lambda d: float(np.abs(d).max()),
    "mae": lambda d: float(np.abs(d).mean()),
    "mse": lambda d: float((d**2).mean()),
    "rmse": lambda d: float(np.sqrt((d**2).mean())),
}
#: What each deviation adds to the energies that are sums over nodes.
_PARTS: dict[str, Callable[[float], float]] = {"sse": lambda x: x * x, "mse": lambda x: x * x, "rmse": lambda x: x * x, "mae": abs}


def _dense(edges: DataFrame) -> Network:
    net = Network(collected(edges_of(edges).filter("w <> 0")))
    if len(net) > MAX_DENSE:
        raise ValueError(f"{len(net)} nodes; this operator holds the whole matrix and takes {MAX_DENSE} at most")
    return net


def _frame(net: Network, w: np.ndarray, replicate: int, **more: float) -> pd.DataFrame:
    i, j = np.nonzero(w)
    return pd.DataFrame({"replicate": replicate, "src": net.ids[i], "dst": net.ids[j], "w": w[i, j], **more})


def linked(w: np.ndarray, start: int, goals: tuple[int, ...]) -> bool:
    """Whether all goals can be reached from a node."""
    seen = np.zeros(len(w), bool)
    seen[start] = True
    front = seen.copy()
    while front.any() and not all(seen[g] for g in goals):
        front = (w[front] != 0).any(axis=0) & ~seen
        seen |= front
    return all(seen[g] for g in goals)


def _exchange(w: np.ndarray, a: int, b: int, c: int, d: int, directed: bool) -> None:
    """Edges a-b and c-d become a-d and c-b, each with its weight."""
    for x, y, z in ((a, b, d), (c, d, b)):
        w[x, z], w[x, y] = w[x, y], 0
        if not directed:
            w[z, x], w[y, x] = w[x, z], 0


def rewired(w: np.ndarray, sweeps: float, rng: np.random.Generator, directed: bool, connected: bool) -> tuple[np.ndarray, int]:
    """Swap the ends of pairs of edges, ``sweeps`` times for each edge; the new network and how many swaps were made.

    It ends early, with fewer swaps, if 100 draws in a row give no two edges of four different ends.

    Connected: an undirected swap is only made if it leaves each of its ends linked to the others, a directed one if
    both sources still reach their old targets, so no two nodes that were linked come apart.
    """
    w = w.copy()
    n = len(w)
    src, dst = np.nonzero(w if directed else np.tril(w))
    m, done = len(src), 0
    if m < 2:
        return w, 0
    tries = int(round(n * m / (n * (n - 1))))
    for _ in range(int(m * sweeps)):
        for _ in range(tries + 1):
            for _ in range(100):
                e, f = rng.integers(m), rng.integers(m)
                a, b, c, d = src[e], dst[e], src[f], dst[f]
                if len({a, b, c, d}) == 4:
                    break
            else:
                return w, done
            turn = not directed and rng.random() > 0.5
            if turn:
                c, d = d, c
            if w[a, d] or w[c, b]:
                continue
            _exchange(w, a, b, c, d, directed)
            if connected and not (linked(w, a, (b,)) and linked(w, c, (d,)) and (directed or linked(w, a, (c,)))):
                _exchange(w, a, d, c, b, directed)  # back
                continue
            if turn:
                src[f], dst[f] = c, d
            dst[e], dst[f] = d, b
            done += 1
            break
    return w, done


def _rewire(edges: DataFrame, itr: float, n_replicates: int, seed: int, directed: bool, connected: bool) -> DataFrame:
    net = _dense(edges)

    def run(k: int) -> pd.DataFrame:
        w, done = rewired(net.matrix(), itr, np.random.default_rng((seed, k)), directed, connected)
        return _frame(net, w, k, swaps=done)

    return replicates(edges.sparkSession, n_replicates, run, EDGES + ", swaps long")


def randmio_und(edges: DataFrame, itr: float = 10, n_replicates: int = 1, seed: int = 0) -> DataFrame:
    """``(replicate, src, dst, w, swaps)``: an undirected network with the same degrees; ``itr`` swaps are tried for each edge."""
    return _rewire(edges, itr, n_replicates, seed, False, False)


def randmio_und_connected(edges: DataFrame, itr: float = 10, n_replicates: int = 1, seed: int = 0) -> DataFrame:
    """As ``randmio_und``, without coming apart."""
    return _rewire(edges, itr, n_replicates, seed, False, True)


def randmio_dir(edges: DataFrame, itr: float = 10, n_replicates: int = 1, seed: int = 0) -> DataFrame:
    """As ``randmio_und`` for a directed network: in- and out-degrees stay."""
    return _rewire(edges, itr, n_replicates, seed, True, False)


def randmio_dir_connected(edges: DataFrame, itr: float = 10, n_replicates: int = 1, seed: int = 0) -> DataFrame:
    return _rewire(edges, itr, n_replicates, seed, True, True)


def match_length_degree_distribution(
    edges: DataFrame, distances: DataFrame, nbins: int = 10, nswap: int = 1000, replacement: bool = False, weighted: bool = True, n_replicates: int = 1, seed: int = 0
) -> DataFrame:
    """``(replicate, src, dst, w, swaps)``: an undirected network with the same degrees and about the same edge lengths.

    Lengths are cut into ``nbins`` equal bins.  Edges x-y and u-v become x-u and y-v only if x-u is in the bin of x-y
    and y-v in that of u-v, and both are free.  ``weighted`` gives the weights in the order of length to the new edges in
    the order of theirs; otherwise weights are 1.  With fewer swaps than ``nswap`` no edge was left to swap.
    """
    net = _dense(edges)
    table = collected(edges_of(distances))
    d = np.zeros((len(net), len(net)))
    known = table[table["src"].isin(net.ids) & table["dst"].isin(net.ids)]
    d[np.searchsorted(net.ids, known["src"]), np.searchsorted(net.ids, known["dst"])] = known["w"]
    borders = np.linspace(d[d != 0].min(), d[d != 0].max(), nbins + 1)
    bins = np.where(d < borders[0], 0, np.minimum(np.searchsorted(borders, d, side="right"), nbins))

    def run(k: int) -> pd.DataFrame:
        rng, w = np.random.default_rng((seed, k)), net.matrix()
        x, y = np.nonzero(np.triu(w, 1))
        there = np.triu(w, 1) != 0
        swaps = 0
        while len(x) >= 2 and swaps < nswap:
            r = int(rng.integers(len(x)))
            a, b = x[r], y[r]
            fits = (x != a) & (x != b) & (y != a) & (y != b) & (bins[a, b] == bins[a, x]) & (bins[x, y] == bins[b, y])
            fits &= ~there[np.minimum(a, x), np.maximum(a, x)] & ~there[np.minimum(b, y), np.maximum(b, y)]
            free = np.flatnonzero(fits)
            if not len(free):
                x, y = np.delete(x, r), np.delete(y, r)
                continue
            o = int(rng.choice(free))
            u, v = x[o], y[o]
            first, second = tuple(sorted((a, u))), tuple(sorted((b, v)))
            there[a, b] = there[u, v] = False
            there[first] = there[second] = True
            swaps += 1
            if replacement:
                (x[r], y[r]), (x[o], y[o]) = first, second
            else:
                x, y = np.delete(x, (r, o)), np.delete(y, (r, o))
        new = np.zeros_like(w)
        if weighted:
            old_i, old_j = np.nonzero(np.triu(w, 1))
            new_i, new_j = np.nonzero(there)
            at = np.argsort(d[new_i, new_j], kind="stable")
            new[new_i[at], new_j[at]] = w[old_i, old_j][np.argsort(d[old_i, old_j], kind="stable")]
        else:
            new[there] = 1
        return _frame(net, new + new.T, k, swaps=swaps)

    return replicates(edges.sparkSession, n_replicates, run, EDGES + ", swaps long")


def annealed(goals: list[np.ndarray], start: np.ndarray, ends: np.ndarray, directed: bool, energy: str | Callable, nstage: int, niter: int, temp: float, frac: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Swap the weights of edges until strengths are near the goals; the best weights and their energy.

    A swap changes the strengths of four nodes at most.  For the energies that are sums over nodes only these are
    taken anew; the largest deviation, and functions of one's own, are taken over all nodes.
    """
    i, j = (x.tolist() for x in ends)
    n = len(goals[0])
    w = start.tolist()
    if directed:
        off = [(np.bincount(ends[0], start, n) - goals[0]).tolist(), (np.bincount(ends[1], start, n) - goals[1]).tolist()]
    else:
        off = [(np.bincount(ends[0], start, n) + np.bincount(ends[1], start, n) - goals[0]).tolist()]
    part = _PARTS.get(energy) if isinstance(energy, str) else None
    whole = ENERGIES[energy] if isinstance(energy, str) else energy
    sums = [sum(map(part, x)) for x in off] if part else []

    def measure() -> float:
        if not part:
            return sum(whole(np.array(x)) for x in off)
        return sum(x if energy == "sse" else x / n if energy != "rmse" else max(x, 0.0) ** 0.5 / n**0.5 for x in sums)

    def shift(e: int, f: int, change: float) -> None:
        for side, x in ((0, i), (-1, j)):
            deviations = off[side]
            for at, by in ((x[e], change), (x[f], -change)):
                if part:
                    sums[side] += part(deviations[at] + by) - part(deviations[at])
                deviations[at] += by

    now = best = measure()
    kept = list(w)
    for _ in range(nstage):
        draws, chances = rng.integers(len(w), size=(niter, 2)), rng.random(niter)
        for (e, f), chance in zip(draws.tolist(), chances.tolist(), strict=True):
            change = w[f] - w[e]
            if not change:
                continue
            before = list(sums)
            shift(e, f, change)
            then = measure()
            if then < now or chance < np.exp(-(then - now) / temp):
                now = then
                w[e], w[f] = w[f], w[e]
                if now < best:
                    best, kept = now, list(w)
            else:
                shift(e, f, -change)
                sums[:] = before
        temp *= frac
    w = np.array(kept)
    if directed:
        final = [np.bincount(ends[0], w, n) - goals[0], np.bincount(ends[1], w, n) - goals[1]]
    else:
        final = [np.bincount(ends[0], w, n) + np.bincount(ends[1], w, n) - goals[0]]
    return w, float(sum(whole(x) for x in final))


def _anneal(edges: DataFrame, directed: bool, rewiring_iter: float, nstage: int, niter: int, temp: float, frac: float, energy_type: str, energy_func: Callable | None, start: DataFrame | None, connected: bool | None, n_replicates: int, seed: int) -> DataFrame:
    if not 0 < frac <= 1:
        raise ValueError(f"frac must lie within 0 and 1, not {frac}")
    if energy_func is None and energy_type not in ENERGIES:
        raise ValueError(f"energy_type is one of {sorted(ENERGIES)}, not {energy_type}")
    net = _dense(edges)
    goal = net.matrix()
    if not directed and not np.allclose(goal, goal.T):
        raise ValueError("the network is not symmetric")
    given = None if start is None else Network(collected(edges_of(start)), net.ids).matrix()
    if connected is None:
        connected = linked(goal + goal.T, 0, tuple(range(len(goal))))

    def run(k: int) -> pd.DataFrame:
        rng = np.random.default_rng((seed, k))
        b = rewired(goal, rewiring_iter, rng, directed, connected)[0] if given is None else given
        ends = np.nonzero(b if directed else np.triu(b, 1))
        goals = [goal.sum(axis=1), goal.sum(axis=0)] if directed else [goal.sum(axis=1)]
        energy: str | Callable = energy_type
        if energy_func is not None:
            first = goals[0]
            energy = lambda off: energy_func(first, first + off)
        w, least = annealed(goals, b[ends], ends, directed, energy, nstage, niter, temp, frac, rng)
        new = np.zeros_like(b)
        new[ends] = w
        return _frame(net, new if directed else new + new.T, k, energy=least)

    return replicates(edges.sparkSession, n_replicates, run, EDGES + ", energy double")


def strength_preserving_rand_sa(edges: DataFrame, rewiring_iter: float = 10, nstage: int = 100, niter: int = 10_000, temp: float = 1000, frac: float = 0.5, energy_type: str = "sse", energy_func: Callable | None = None, start: DataFrame | None = None, connected: bool | None = None, n_replicates: int = 1, seed: int = 0) -> DataFrame:
    """``(replicate, src, dst, w, energy)``: rewired, then annealed so that strengths come near those of the network.

    ``energy_func(goal, strengths)`` replaces the measure named by ``energy_type``; ``start`` replaces the rewiring.
    """
    return _anneal(edges, False, rewiring_iter, nstage, niter, temp, frac, energy_type, energy_func, start, connected, n_replicates, seed)


def strength_preserving_rand_sa_mse_opt(edges: DataFrame, rewiring_iter: float = 10, nstage: int = 100, niter: int = 10_000, temp: float = 1000, frac: float = 0.5, start: DataFrame | None = None, connected: bool | None = None, n_replicates: int = 1, seed: int = 0) -> DataFrame:
    """As ``strength_preserving_rand_sa`` for the mean squared error."""
    return _anneal(edges, False, rewiring_iter, nstage, niter, temp, frac, "mse", None, start, connected, n_replicates, seed)


def strength_preserving_rand_sa_dir(edges: DataFrame, rewiring_iter: float = 10, nstage: int = 100, niter: int = 10_000, temp: float = 1000, frac: float = 0.5, energy_type: str = "sse", energy_func: Callable | None = None, start: DataFrame | None = None, connected: bool = True, n_replicates: int = 1, seed: int = 0) -> DataFrame:
    """As ``strength_preserving_rand_sa`` for in- and out-strengths of a directed network; the energy is the sum of both."""
    return _anneal(edges, True, rewiring_iter, nstage, niter, temp, frac, energy_type, energy_func, start, connected, n_replicates, seed)


def degree_table(found: DataFrame) -> DataFrame:
    """``(replicate, id, in_degree, out_degree)`` of the results above."""
    out = found.groupBy("replicate", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = found.groupBy("replicate", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return into.join(out, ["replicate", "id"], "full").select("replicate", "id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def weight_table(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``(replicate, w, n, changed)``: how often the results above have each weight, and whether swaps left another network."""
    kept = found.join(edges_of(edges).select("src", "dst"), ["src", "dst"], "left_semi").groupBy("replicate").agg(F.count(F.lit(1)).alias("kept"))
    facts = found.groupBy("replicate").agg(F.count(F.lit(1)).alias("all"), F.max("swaps").alias("swaps")).join(kept, "replicate", "left")
    changed = facts.select("replicate", ((F.col("swaps") > 0) & (F.coalesce("kept", F.lit(0)) < F.col("all"))).alias("changed"))
    return found.groupBy("replicate", "w").agg(F.count(F.lit(1)).alias("n")).join(changed, "replicate").select("replicate", "w", "n", "changed")
