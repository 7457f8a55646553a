"""Shortest paths, greedy navigation and what is computed along paths.

A path is ``(src, dst, dist, hops, path)`` with the nodes from src to dst; failed ones have ``hops = -1``, infinite
``dist`` and an empty path.  Of several shortest paths that with the fewest hops is taken, then the first in the order
of its nodes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.iterate import cut
from graphloom.model import INF, beside, edges_of, ids_of, require, safe_div
from graphloom.operators.graph import wedges
from graphloom.shipping import MAX_SENT, Network, collected, for_each

PATHS = "src long, dst long, dist double, hops int, path array<long>"


def every_id(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    return ids_of(edges) if nodes is None else ids_of(edges).unionByName(require(nodes, "id").select(F.col("id").cast("long").alias("id"))).distinct()


def shortest_paths(lengths: DataFrame, nodes: DataFrame | None = None, max_sent: int = MAX_SENT) -> DataFrame:
    """``(src, dst, dist, hops, path)`` of all pairs that a path links, a node and itself among them.

    Edges of length 0 or NULL are none.  Networks of at most ``max_sent`` edges without negative lengths are sent to
    the tasks, which search from one source each; larger ones, and those with negative lengths, are relaxed by joins,
    one round for each hop of the longest path.
    """
    e = edges_of(lengths).filter("w <> 0")
    ids = every_id(e, nodes)
    facts = e.agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least")).first()
    if facts["n"] > max_sent or (facts["least"] or 0) < 0:
        return _relaxed(e, ids)
    net = Network(e.toPandas())

    def run(sources: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([row for s in sources.tolist() for row in _from_source(net, s)], columns=["src", "dst", "dist", "hops", "path"])

    return for_each(ids, run, PATHS)


def _from_source(net: Network, source: int) -> list[tuple]:
    at = int(np.searchsorted(net.ids, source))
    if at == len(net) or net.ids[at] != source:
        return [(source, source, 0.0, 0, [source])]
    names, start, to, w = net.ids.tolist(), net.start.tolist(), net.to.tolist(), net.w.tolist()
    found: dict[int, tuple] = {}
    heap: list[tuple] = [(0.0, 0, (at,))]
    while heap:
        dist, hops, path = heapq.heappop(heap)
        here = path[-1]
        if here in found:
            continue
        found[here] = dist, hops, path
        for k in range(start[here], start[here + 1]):
            if to[k] not in found:
                heapq.heappush(heap, (dist + w[k], hops + 1, (*path, to[k])))
    return [(source, names[t], d, h, [names[i] for i in p]) for t, (d, h, p) in found.items()]


def _relaxed(e: DataFrame, ids: DataFrame) -> DataFrame:
    """Relaxation by joins: only what became shorter in one round is carried on in the next."""
    label = F.struct("dist", "hops", "path").alias("best")
    state = cut(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.struct(F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.array("id").alias("path")).alias("best")))
    n = state.count()
    front = state
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"), "w")
    for _ in range(n + 1):
        offers = (
            front.join(step, "dst")
            .select("src", F.col("next").alias("dst"), (F.col("best.dist") + F.col("w")).alias("dist"), (F.col("best.hops") + 1).alias("hops"), F.concat("best.path", F.array("next")).alias("path"))
            .groupBy("src", "dst").agg(F.min(label).alias("offer"))
        )
        both = cut(state.join(offers, ["src", "dst"], "full").select("src", "dst", F.least("best", "offer").alias("best"), (F.col("best").isNull() | (F.col("offer") < F.col("best"))).alias("better")))
        state, front = both.select("src", "dst", "best"), both.filter("better").select("src", "dst", "best")
        if not front.take(1):
            return state.select("src", "dst", "best.*")
    raise ValueError("the network has a cycle of negative length")


def all_pairs(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """Paths with a failed row for each pair that has none."""
    pairs = ids.select(F.col("id").alias("src")).crossJoin(ids.select(F.col("id").alias("dst")))
    return pairs.join(paths, ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("dist", F.lit(INF)).alias("dist"), F.coalesce("hops", F.lit(-1)).alias("hops"), F.coalesce("path", F.expr("cast(array() as array<long>)")).alias("path")
    )


def distance_wei_floyd(lengths: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(src, dst, dist, pred)`` for all pairs: infinite if unreachable; ``pred`` is the node before dst, or -9999."""
    rows = all_pairs(shortest_paths(lengths, nodes), every_id(edges_of(lengths), nodes))
    return rows.select("src", "dst", "dist", F.when(F.col("hops") > 0, F.expr("element_at(path, -2)")).otherwise(-9999).cast("long").alias("pred"))


def retrieve_shortest_path(source: int, target: int, distances: DataFrame) -> DataFrame:
    """``(step, id)``: the nodes of one path by the ``pred`` of ``distance_wei_floyd``; one row of -1 if there is none."""
    rows = collected(require(distances, "src", "dst", "pred").filter(F.col("src") == source))
    before = dict(zip(rows["dst"].tolist(), rows["pred"].tolist(), strict=True))
    path = [target]
    while path[-1] != source:
        step = before.get(path[-1], -9999)
        if step == -9999:
            path = [-1]
            break
        path.append(step)
    spark = distances.sparkSession
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, id long")


def navigation_wu(distances: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, max_sent: int = MAX_SENT) -> DataFrame:
    """``(src, dst, dist, hops, path)`` of greedy walks: each step goes to the neighbour that is nearest to the target.

    The least id wins ties.  A walk fails where there is no neighbour or the next node was visited before; a node
    reaches itself without a step.  ``distances`` has a row for each pair that is not at distance 0.  The walks to one
    target are followed together.  Networks of at most ``max_sent`` edges are sent to the tasks, which are given the
    distances to one target each; of larger ones, each edge is joined with each target.
    """
    e = edges_of(edges).filter("w <> 0").select("src", "dst")
    d = edges_of(distances)
    ids = every_id(edges_of(edges), nodes)
    step = d.select("src", "dst", F.col("w").alias("step"))
    if e.limit(max_sent + 1).count() <= max_sent:
        net = Network(collected(e.join(step, ["src", "dst"], "left").select("src", "dst", F.coalesce("step", F.lit(0.0)).alias("w")), max_sent))
        away = d.select(F.col("dst").alias("target"), F.col("src").alias("cur"), F.col("w").alias("d"))
        every = ids.select(F.col("id").alias("target"), F.lit(None).cast("long").alias("cur"), F.lit(None).cast("double").alias("d"))
        names = ids.select(F.lit(0).alias("k"), "id").groupBy("k").agg(F.sort_array(F.collect_list("id")).alias("ids")).first()
        sources = np.array(names.ids if names else [], np.int64)
        rows = every.unionByName(away.join(ids.select(F.col("id").alias("target")), "target", "left_semi"))
        return rows.groupBy("target").applyInPandas(lambda part: _walks(_nearest(part, net, sources)), PATHS)
    pairs = ids.select(F.col("id").alias("cur")).crossJoin(ids.select(F.col("id").alias("target")))
    near = e.select(F.col("src").alias("cur"), F.col("dst").alias("nbr")).crossJoin(ids.select(F.col("id").alias("target")))
    away = d.select(F.col("src").alias("nbr"), F.col("dst").alias("target"), F.col("w").alias("d"))
    best = near.join(away, ["nbr", "target"], "left").groupBy("cur", "target").agg(F.min(F.struct(F.coalesce("d", F.lit(0.0)).alias("d"), "nbr")).alias("b")).select("cur", "target", F.col("b.nbr").alias("nxt"))
    step = step.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), "step")
    rows = pairs.join(best, ["cur", "target"], "left").join(step, ["cur", "nxt"], "left").select("target", "cur", "nxt", F.coalesce("step", F.lit(0.0)).alias("step"))
    return rows.groupBy("target").applyInPandas(_walks, PATHS)


def _nearest(part: pd.DataFrame, net: Network, sources: np.ndarray) -> pd.DataFrame:
    """``(target, cur, nxt, step)`` for one target: the neighbour nearest to it, the least id of equals, of each node."""
    known = part[part["cur"].notna()]
    away = np.zeros(len(net))
    at = np.searchsorted(net.ids, known["cur"].to_numpy(np.int64))
    there = (at < len(net)) & (net.ids[np.minimum(at, len(net) - 1)] == known["cur"].to_numpy(np.int64)) if len(net) else np.zeros(len(at), bool)
    away[at[there]] = known["d"].to_numpy(float)[there]
    some = np.flatnonzero(np.diff(net.start))
    out = pd.DataFrame({"target": part["target"].iloc[0], "cur": sources, "nxt": None, "step": 0.0}).astype({"nxt": "Float64"}).set_index("cur")
    if len(some):
        order = np.lexsort((net.to, away[net.to], net.frm))  # a node's edges stay together, the best first
        first = order[net.start[some]]
        best = pd.DataFrame({"nxt": net.ids[net.to[first]].astype(object), "step": net.w[first]}, index=net.ids[some])
        out = out.drop(columns=["nxt", "step"]).join(best).astype({"step": float}).fillna({"step": 0.0})
    return out.reset_index()


def _walks(part: pd.DataFrame) -> pd.DataFrame:
    target = int(part["target"].iloc[0])
    after = {int(c): (int(n), float(s)) for c, n, s in zip(part["cur"], part["nxt"], part["step"], strict=True) if n == n and n is not None}
    rows = []
    for source in sorted(part["cur"].tolist()):
        at, dist, path, seen = source, 0.0, [source], {source}
        while at != target:
            nxt, step = after.get(at, (at, 0.0))
            if nxt in seen:
                path = []
                break
            path.append(nxt)
            seen.add(nxt)
            dist, at = dist + step, nxt
        rows.append((source, target, dist if path else INF, len(path) - 1, path))
    return pd.DataFrame(rows, columns=["src", "dst", "dist", "hops", "path"])


def navigation_success(paths: DataFrame) -> DataFrame:
    """``(id, success)``: the share of targets that walks from a node reach; the row without an id is of all walks."""
    ok = F.avg(F.when(F.col("hops") >= 0, 1.0).otherwise(0.0)).alias("success")
    return paths.groupBy(F.col("src").alias("id")).agg(ok).unionByName(paths.agg(ok).select(F.lit(None).cast("long").alias("id"), "success"))


def _steps(paths: DataFrame) -> DataFrame:
    """``(src, dst, k, a, b)``: the steps of paths of one hop at least."""
    walk = F.expr("transform(sequence(1, hops), k -> struct(k AS k, path[k - 1] AS a, path[k] AS b))")
    return paths.filter("hops > 0").select("src", "dst", F.explode(walk).alias("s")).select("src", "dst", "s.k", "s.a", "s.b")


def get_navigation_path_length(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(src, dst, length)``: paths measured by other lengths, 0 where they have none; failed paths are infinite."""
    other = edges_of(lengths).select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    sums = _steps(paths).join(other, ["a", "b"], "left").groupBy("src", "dst").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("s"))
    return paths.select("src", "dst", "hops").join(sums, ["src", "dst"], "left").select("src", "dst", F.when(F.col("hops") < 0, INF).otherwise(F.coalesce("s", F.lit(0.0))).alias("length"))


def path_transitivity(lengths: DataFrame) -> DataFrame:
    """``(src, dst, w)``: the mean matching of all pairs of nodes along the shortest path, for each linked pair.

    The matching of a pair is the sum of both lengths to common neighbours over both strengths without the edge
    between them; it is 0 without common neighbours.  Pairs that no path links are left out.  Undirected.
    """
    e = edges_of(lengths).filter("w <> 0")
    common = wedges(e).filter("i < j").groupBy("i", "j").agg(F.sum(F.expr("wi + wj")).alias("s"))
    strength = e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("s"))
    si, sj = strength.selectExpr("id AS i", "s AS si"), strength.selectExpr("id AS j", "s AS sj")
    direct = e.selectExpr("src AS i", "dst AS j", "w")
    m = common.join(si, "i").join(sj, "j").join(direct, ["i", "j"], "left").select("i", "j", safe_div(F.col("s"), F.expr("si + sj - 2 * coalesce(w, 0)")).alias("m"))
    paths = shortest_paths(e).filter("src < dst")
    places = F.expr("flatten(transform(sequence(0, hops - 1), k -> transform(slice(path, k + 2, hops), x -> struct(least(path[k], x) AS i, greatest(path[k], x) AS j))))")
    pairs = paths.select("src", "dst", "hops", F.explode(places).alias("p")).select("src", "dst", "hops", "p.i", "p.j")
    half = pairs.join(m, ["i", "j"], "left").groupBy("src", "dst", "hops").agg(F.sum(F.coalesce("m", F.lit(0.0))).alias("s")).select("src", "dst", F.expr("2 * s / (hops * (hops + 1))").alias("w"))
    return half.unionByName(half.selectExpr("dst AS src", "src AS dst", "w"))


def is_symmetric(edges: DataFrame) -> bool:
    """Whether weights of both directions agree up to rounding."""
    e = edges_of(edges)
    back = e.selectExpr("dst AS src", "src AS dst", "w AS v")
    off = e.join(back, ["src", "dst"], "full").filter("abs(coalesce(w, 0) - coalesce(v, 0)) > 1e-8 + 1e-5 * abs(coalesce(v, 0))")
    return not off.take(1)


def search_information(edges: DataFrame, lengths: DataFrame, has_memory: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """``(src, dst, w)`` for pairs of different nodes: bits needed to follow the shortest path in a random walk.

    With memory, a walk does not return at once: each step's chance is divided by 1 less that of the step before.  A
    symmetric network takes one path for both directions.  Infinite without a path, or where a step has no chance.
    """
    e = edges_of(edges)
    rows = e.groupBy("src").agg(F.sum("w").alias("s"))
    chance = e.join(rows, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), safe_div(F.col("w"), F.col("s")).alias("p"))
    paths = shortest_paths(lengths, nodes).filter("src <> dst")
    if is_symmetric(edges):
        paths = paths.filter("src < dst")
        paths = paths.unionByName(paths.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", "hops", F.reverse("path").alias("path")))
    steps = _steps(paths).join(chance, ["a", "b"], "left").select("src", "dst", "k", F.coalesce("p", F.lit(0.0)).alias("p"))
    if has_memory:
        before = F.coalesce(F.lag("p").over(Window.partitionBy("src", "dst").orderBy("k")), F.lit(0.0))
        steps = steps.withColumn("q", before).select("src", "dst", safe_div(F.col("p"), 1 - F.col("q")).alias("p"))
    bits = steps.groupBy("src", "dst").agg(F.sum(F.when(F.col("p") > 0, -F.log2(F.when(F.col("p") > 0, F.col("p")))).otherwise(INF)).alias("w"))
    ids = every_id(e, nodes).unionByName(ids_of(edges_of(lengths))).distinct()
    pairs = ids.selectExpr("id AS src").crossJoin(ids.selectExpr("id AS dst")).filter("src <> dst")
    return pairs.join(bits, ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(INF)).alias("w"))


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """``(id, component)``: the least id that a node is linked to by edges other than 0, in either direction.

    Each round takes the least root among neighbours, then that of the root itself.
    """
    e = edges_of(edges)
    links = e.filter("w <> 0 AND src <> dst").select("src", "dst")
    links = cut(links.unionByName(links.selectExpr("dst AS src", "src AS dst")).distinct())
    roots = cut(every_id(e, nodes).select("id", F.col("id").alias("root")))
    for _ in range(rounds):
        near = links.join(roots, links.dst == roots.id).groupBy("src").agg(F.min("root").alias("near"))
        least = roots.join(near, roots.id == near.src, "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("least"))
        jump = least.select(F.col("id").alias("least"), F.col("least").alias("further"))
        after = cut(least.join(jump, "least", "left").select("id", "root", F.least("least", F.coalesce("further", "least")).alias("now")))
        roots = after.select("id", F.col("now").alias("root"))
        if not after.filter("now <> root").take(1):
            return roots.select("id", F.col("root").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def number_of_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(n_components)``."""
    return components(edges, nodes).agg(F.count_distinct("component").alias("n_components"))


def mean_of_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(value)``: the sum over pairs of different nodes over n (n - 1)."""
    n = require(nodes, "id").distinct().agg(F.count(F.lit(1)).alias("n"))
    total = pairs.filter("src <> dst").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("s"))
    return beside(total, n).select(safe_div(F.col("s"), F.expr("n * (n - 1)")).alias("value"))
