"""The registry of queries: name, Spark callable and, where SQL can express it, the DuckDB text.

Doubles are rounded alike on both sides; what is not finite is NULL.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import community, construction, diffusion, display, graph, netstats, nulls, parcels, routing, spatial, spreading, statistics
from graphloom.plans.tables import Tables, with_views
from graphloom.sources import cifti, files, formats, registry

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    def cell(name: str, kind: str):
        c = F.col(f"`{name}`")
        return (F.round(F.when(F.abs(c) < float("inf"), c), digits) + F.lit(0.0)).alias(name) if kind == "double" else c

    return df.select(*[cell(n, k) for n, k in df.dtypes])


def r(expression: str, name: str, digits: int = 6) -> str:
    """SQL for a rounded double, NULL if it is not finite."""
    return f"CASE WHEN isfinite(CAST({expression} AS DOUBLE)) THEN ROUND(CAST({expression} AS DOUBLE), {digits}) + 0.0 END AS {name}"


def add(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    _QUERIES[name] = lambda spark, folder: rounded(run(Tables(spark, folder)), digits)
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


V = with_views
EDGE = f"src, dst, {r('w', 'w')}"

# Degrees and mixing
add("degrees_und", lambda t: graph.degrees_und(t.back(), t.ids()), V("SELECT id, COUNT(src) AS degree FROM ids LEFT JOIN back ON dst = id GROUP BY id"))
add("degrees_dir", lambda t: graph.degrees_dir(t.arcs(), t.ids()), V("SELECT id, i AS in_degree, o AS out_degree, i + o AS degree FROM (SELECT id, (SELECT COUNT(*) FROM arcs WHERE dst = id) AS i, (SELECT COUNT(*) FROM arcs WHERE src = id) AS o FROM ids)"))
add("binarize", lambda t: graph.binarize(t.arcs()), V("SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM arcs WHERE w > 0"))
add("graph_laplacian", lambda t: graph.graph_laplacian(t.trade()), V(f"SELECT {EDGE} FROM (SELECT src, dst, SUM(w) AS w FROM (SELECT dst AS src, dst, w FROM trade UNION ALL SELECT src, dst, -w FROM trade) GROUP BY 1, 2)"))
add("assortativity_und", lambda t: graph.assortativity_und(t.annotations(), t.both()), V(f"SELECT {r('SUM(w * (a.x - m) * (b.x - m)) / SUM(w * (b.x - m) * (b.x - m))', 'assortativity')} FROM sym JOIN ann a ON a.id = src JOIN ann b ON b.id = dst, (SELECT SUM(w * x) / SUM(w) AS m FROM sym JOIN ann ON id = dst)"))
add("assortativity_dir", lambda t: graph.assortativity_dir(t.annotations(), t.trade()), V(f"SELECT {r('SUM(w * (a.x - mo) * (b.x - mi)) / SQRT(SUM(w * (a.x - mo) * (a.x - mo)) * SUM(w * (b.x - mi) * (b.x - mi)))', 'assortativity')} FROM trade JOIN ann a ON a.id = src JOIN ann b ON b.id = dst, (SELECT SUM(w * a.x) / SUM(w) AS mo, SUM(w * b.x) / SUM(w) AS mi FROM trade JOIN ann a ON a.id = src JOIN ann b ON b.id = dst)"))
add(
    "matching_index",
    lambda t: graph.matching_index(t.back()),
    V(f"SELECT i AS src, j AS dst, {r('2 * c / (si.s + sj.s - 2 * COALESCE(w, 0))', 'w', 9)} FROM (SELECT a.src AS i, b.src AS j, COUNT(*) AS c FROM back a JOIN back b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2) LEFT JOIN back ON src = i AND dst = j JOIN st si ON si.src = i JOIN st sj ON sj.src = j WHERE si.s + sj.s <> 2 * COALESCE(w, 0)", ("st", "SELECT src, SUM(w) AS s FROM back GROUP BY 1")),
    9,
)
add(
    "rich_feeder_peripheral",
    lambda t: graph.rich_feeder_peripheral(t.both(), t.back(), t.ids()).select("threshold", "kind", "value"),
    V(
        f"SELECT CAST(threshold AS INTEGER) AS threshold, kind, {r('median(w)', 'value')} FROM (SELECT threshold, w, CASE WHEN a.k >= threshold AND b.k >= threshold THEN 'rich' WHEN a.k >= threshold OR b.k >= threshold THEN 'feeder' ELSE 'peripheral' END AS kind FROM sym JOIN deg a ON a.id = src JOIN deg b ON b.id = dst, (SELECT UNNEST(range((SELECT MAX(k) FROM deg))) AS threshold) WHERE src < dst) GROUP BY 1, 2",
        ("deg", "SELECT id, COUNT(src) AS k FROM ids LEFT JOIN back ON dst = id GROUP BY id"),
    ),
)
add("rich_feeder_peripheral_tests", lambda t: graph.rich_feeder_peripheral(t.both(), t.back(), t.ids(), "mean"))

# Values on networks
CENTRED = ("z", "SELECT id, x - (SELECT AVG(x) FROM ann) AS x, y - (SELECT AVG(y) FROM ann) AS y FROM ann")
PAIR = "sym JOIN z a ON a.id = src JOIN z b ON b.id = dst"
def _maps(t: Tables) -> DataFrame:
    return t.annotations().select("id", F.posexplode(F.array("x", "y", F.expr("x + y")))).select(F.col("pos").alias("map_id"), "id", F.col("col").alias("x"))


def _full(t: Tables) -> DataFrame:
    """A network of positive definite weights, so that each value has a positive variance on it."""
    e = t.both()
    return e.select("src", "dst", (F.col("w") / e.agg(F.max("w")).first()[0]).alias("w")).unionByName(t.ids().selectExpr("id AS src", "id AS dst", "50.0D AS w"))


FULL = ("fullnet", "SELECT src, dst, w / (SELECT MAX(w) FROM sym) AS w FROM sym UNION ALL SELECT id, id, 50.0 FROM ids")
add("network_pearsonr", lambda t: netstats.network_pearsonr(t.annotations(), _full(t)), V(f"SELECT {r('SUM(w * a.x * b.y) / SQRT(SUM(w * a.x * b.x)) / SQRT(SUM(w * a.y * b.y))', 'r')} FROM fullnet JOIN z a ON a.id = src JOIN z b ON b.id = dst", CENTRED, FULL))
add(
    "network_pearsonr_pairwise",
    lambda t: netstats.network_pearsonr_pairwise(_maps(t), _full(t)),
    V(
        f"SELECT a.m AS map_a, a.n AS map_b, {r('a.s / SQRT(b.s) / SQRT(c.s)', 'r')} FROM prod a JOIN prod b ON b.m = a.m AND b.n = a.m JOIN prod c ON c.m = a.n AND c.n = a.n",
        CENTRED, FULL, ("maps", "SELECT 0 AS m, id, x FROM z UNION ALL SELECT 1, id, y FROM z UNION ALL SELECT 2, id, x + y FROM z"),
        ("prod", "SELECT a.m, b.m AS n, SUM(w * a.x * b.x) AS s FROM fullnet JOIN maps a ON a.id = src JOIN maps b ON b.id = dst GROUP BY 1, 2"),
    ),
)
add("effective_resistance", lambda t: netstats.effective_resistance(t.both(), directed=False), digits=9)
add("effective_resistance_foster", lambda t: (lambda e: e.join(netstats.effective_resistance(e, directed=False).withColumnRenamed("w", "r"), ["src", "dst"]).agg((F.sum(F.expr("w * r")) / 2).alias("total")))(t.both()), V(f"SELECT {r('COUNT(DISTINCT src) - 1', 'total')} FROM sym"))
add("network_polarisation", lambda t: netstats.network_polarisation(spatial._centred(t.annotations()), t.both(), directed=False), digits=9)
add("network_variance", lambda t: netstats.network_variance(t.annotations(), t.distances()), V(f"SELECT {r('0.5 * SUM(a.x * b.x * w * w) / (SELECT SUM(x) * SUM(x) FROM ann)', 'variance', 4)} FROM dm JOIN ann a ON a.id = src JOIN ann b ON b.id = dst"), 4)
add(
    "network_covariance",
    lambda t: netstats.network_covariance((lambda e: e.select("src", "dst", (F.col("w") / e.agg(F.sum("w")).first()[0]).alias("w")))(t.trade()), t.distances()),
    V(
        f"SELECT {r('0.5 * SUM((a.p * b.q - COALESCE(j.w, 0)) * d.w * d.w)', 'covariance', 4)}, {r('0.5 * SUM(a.p * b.p * d.w * d.w)', 'var_p', 4)}, {r('0.5 * SUM(a.q * b.q * d.w * d.w)', 'var_q', 4)} FROM dm d JOIN pq a ON a.id = d.src JOIN pq b ON b.id = d.dst LEFT JOIN joint j ON j.src = d.src AND j.dst = d.dst",
        ("joint", "SELECT src, dst, w / (SELECT SUM(w) FROM trade) AS w FROM trade"),
        ("pq", "SELECT id, COALESCE((SELECT SUM(w) FROM joint WHERE src = id), 0) AS p, COALESCE((SELECT SUM(w) FROM joint WHERE dst = id), 0) AS q FROM ids"),
    ),
    4,
)

# Spatial autocorrelation
Q = "(SELECT SUM(x * x) AS q, COUNT(*) AS n FROM z)"
add("morans_i", lambda t: spatial.morans_i(t.annotations(), t.both()), V(f"SELECT {r('ANY_VALUE(n) * SUM(w * a.x * b.x) / (ANY_VALUE(q) * SUM(w))', 'morans_i')} FROM {PAIR}, {Q}", CENTRED))
add("local_morans_i", lambda t: spatial.local_morans_i(t.annotations(), t.both()), V(f"SELECT a.id, {r('ANY_VALUE(a.x) * COALESCE(SUM(w * b.x), 0) / (ANY_VALUE(q) / (ANY_VALUE(n) - 1))', 'morans_i', 3)} FROM z a LEFT JOIN sym ON src = a.id LEFT JOIN z b ON b.id = dst, {Q} GROUP BY a.id", CENTRED), 3)
add("gearys_c", lambda t: spatial.gearys_c(t.annotations(), t.both()), V(f"SELECT {r('(ANY_VALUE(n) - 1) * SUM(w * (a.x - b.x) * (a.x - b.x)) / (2 * SUM(w) * ANY_VALUE(q))', 'gearys_c')} FROM {PAIR}, {Q}", CENTRED))
add("local_gearys_c", lambda t: spatial.local_gearys_c(t.annotations(), t.both()), V(f"SELECT a.id, {r('COALESCE(SUM(w * (a.x - b.x) * (a.x - b.x)), 0) / (ANY_VALUE(q) / (ANY_VALUE(n) - 1))', 'gearys_c', 3)} FROM z a LEFT JOIN sym ON src = a.id LEFT JOIN z b ON b.id = dst, {Q} GROUP BY a.id", CENTRED), 3)
LAGS = ("lags", "SELECT a.id, COALESCE(SUM(w), 0) AS rs, COALESCE(SUM(w * b.x), 0) AS lx, COALESCE(SUM(w * b.y), 0) AS ly FROM z a LEFT JOIN sym ON src = a.id LEFT JOIN z b ON b.id = dst GROUP BY a.id")
NORMS = "(SELECT COUNT(*) AS n, SQRT(SUM(x * x)) AS qx, SQRT(SUM(y * y)) AS qy FROM z)"
add("lees_l", lambda t: spatial.lees_l(t.annotations(), t.both()), V(f"SELECT {r('ANY_VALUE(n) * SUM(lx * ly) / (SUM(rs * rs) * ANY_VALUE(qx) * ANY_VALUE(qy))', 'lees_l')} FROM lags, {NORMS}", CENTRED, LAGS))
add("local_lees_l", lambda t: spatial.local_lees_l(t.annotations(), t.both()), V(f"SELECT id, {r('n * lx * ly / (qx * qy)', 'lees_l', 1)} FROM lags, {NORMS}", CENTRED, LAGS), 1)


# Paths
def path_views(base: str, name: str = "p", rounds: int = 5) -> list[tuple[str, str]]:
    """Views p0 to p5 of shortest paths (src, dst, d, p) by squaring."""
    views = [(f"{name}0", f"SELECT id AS src, id AS dst, CAST(0 AS DOUBLE) AS d, [id] AS p FROM ids UNION ALL SELECT src, dst, w, [src, dst] FROM {base}")]
    for k in range(rounds):
        views.append((f"{name}{k + 1}", f"SELECT a.src, b.dst, MIN(a.d + b.d) AS d, ARG_MIN(list_concat(a.p, b.p[2:]), a.d + b.d) AS p FROM {name}{k} a JOIN {name}{k} b ON a.dst = b.src GROUP BY 1, 2"))
    return views


P = path_views("len")
add("distance_wei_floyd", lambda t: routing.distance_wei_floyd(t.lengths(), t.ids()), V(f"SELECT a.id AS src, b.id AS dst, {r('d', 'dist', 9)}, CASE WHEN LENGTH(p) > 1 THEN p[-2] ELSE -9999 END AS pred FROM ids a CROSS JOIN ids b LEFT JOIN p5 ON src = a.id AND dst = b.id", *P), 9)
add("shortest_paths", lambda t: routing.shortest_paths(t.lengths(), t.ids()).select("src", "dst", "dist", "hops", F.array_join("path", ",").alias("path")), V(f"SELECT src, dst, {r('d', 'dist', 9)}, CAST(LENGTH(p) - 1 AS INTEGER) AS hops, array_to_string(p, ',') AS path FROM p5", *P), 9)
add("shortest_paths_relaxed", lambda t: routing.shortest_paths(t.lengths(), t.ids(), max_sent=0).select("src", "dst", "dist", "hops", F.array_join("path", ",").alias("path")), _SQL["shortest_paths"], 9)
add(
    "retrieve_shortest_path",
    lambda t: routing.retrieve_shortest_path(0, 13, routing.distance_wei_floyd(t.lengths(), t.ids())),
    V("SELECT CAST(k AS INTEGER) AS step, p[k + 1] AS id FROM p5, UNNEST(range(LENGTH(p))) u(k) WHERE src = 0 AND dst = 13 UNION ALL SELECT 0, -1 WHERE NOT EXISTS (SELECT 1 FROM p5 WHERE src = 0 AND dst = 13)", *P),
)
WALK = [
    ("nh", "SELECT cur, target, nbr AS nxt, COALESCE(h.w, 0) AS step, COALESCE(l.w, 0) AS alt FROM (SELECT back.src AS cur, i.id AS target, back.dst AS nbr, ROW_NUMBER() OVER (PARTITION BY back.src, i.id ORDER BY COALESCE(dm.w, 0), back.dst) AS k FROM back CROSS JOIN ids i LEFT JOIN dm ON dm.src = back.dst AND dm.dst = i.id) LEFT JOIN dm h ON h.src = cur AND h.dst = nbr LEFT JOIN len l ON l.src = cur AND l.dst = nbr WHERE k = 1"),
    ("walk(s, t, cur, d, alt, p)", "SELECT a.id, b.id, a.id, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), [a.id] FROM ids a CROSS JOIN ids b UNION ALL SELECT s, t, nxt, d + step, walk.alt + nh.alt, list_append(p, nxt) FROM walk JOIN nh ON nh.cur = walk.cur AND nh.target = t WHERE walk.cur <> t AND NOT list_contains(p, nxt)"),
    ("nav", "SELECT a.id AS src, b.id AS dst, COALESCE(d, 'inf'::DOUBLE) AS dist, COALESCE(alt, 'inf'::DOUBLE) AS alt, CAST(COALESCE(LENGTH(p) - 1, -1) AS INTEGER) AS hops, COALESCE(array_to_string(p, ','), '') AS path FROM ids a CROSS JOIN ids b LEFT JOIN walk ON s = a.id AND t = b.id AND cur = t"),
]
add("navigation_wu", lambda t: routing.navigation_wu(t.distances(), t.back(), t.ids()).select("src", "dst", "dist", "hops", F.array_join("path", ",").alias("path")), V(f"SELECT src, dst, {r('dist', 'dist', 4)}, hops, path FROM nav", *WALK, recursive=True), 4)
add("navigation_success", lambda t: routing.navigation_success(routing.navigation_wu(t.distances(), t.back(), t.ids())), V(f"SELECT src AS id, {r('AVG(CASE WHEN hops >= 0 THEN 1.0 ELSE 0.0 END)', 'success')} FROM nav GROUP BY src UNION ALL SELECT NULL, {r('AVG(CASE WHEN hops >= 0 THEN 1.0 ELSE 0.0 END)', 'success')} FROM nav", *WALK, recursive=True))
add("navigation_path_length", lambda t: routing.get_navigation_path_length(routing.navigation_wu(t.distances(), t.back(), t.ids()), t.lengths()), V(f"SELECT src, dst, {r('alt', 'length', 9)} FROM nav", *WALK, recursive=True), 9)
add(
    "path_transitivity",
    lambda t: routing.path_transitivity(t.lengths()),
    V(
        f"SELECT src, dst, {r('2 * SUM(COALESCE(m, 0)) / (ANY_VALUE(k) * (ANY_VALUE(k) - 1))', 'w', 9)} FROM (SELECT src, dst, LENGTH(p) AS k, LEAST(p[i], p[j]) AS a, GREATEST(p[i], p[j]) AS b FROM (SELECT * FROM p5 WHERE src < dst), UNNEST(range(1, LENGTH(p) + 1)) x(i), UNNEST(range(1, LENGTH(p) + 1)) y(j) WHERE i < j UNION ALL SELECT dst, src, LENGTH(p), LEAST(p[i], p[j]), GREATEST(p[i], p[j]) FROM (SELECT * FROM p5 WHERE src < dst), UNNEST(range(1, LENGTH(p) + 1)) x(i), UNNEST(range(1, LENGTH(p) + 1)) y(j) WHERE i < j) LEFT JOIN mm ON mi = a AND mj = b GROUP BY src, dst",
        *P, ("st", "SELECT src, SUM(w) AS s FROM len GROUP BY 1"),
        ("mm", "SELECT i AS mi, j AS mj, c / (si.s + sj.s - 2 * COALESCE(w, 0)) AS m FROM (SELECT a.src AS i, b.src AS j, SUM(a.w + b.w) AS c FROM len a JOIN len b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2) LEFT JOIN len ON src = i AND dst = j JOIN st si ON si.src = i JOIN st sj ON sj.src = j"),
    ),
    9,
)
for memory in (False, True):
    add(
        "search_information" + "_memory" * memory,
        lambda t, memory=memory: routing.search_information(t.back(), t.lengths(), memory, t.ids()),
        V(
            f"SELECT a.id AS src, b.id AS dst, {r('bits', 'w')} FROM ids a JOIN ids b ON a.id <> b.id LEFT JOIN (SELECT src, dst, SUM(-LOG2(q{' / (1 - COALESCE(before, 0))' * memory})) AS bits FROM (SELECT h.src, h.dst, tp.q, LAG(tp.q) OVER (PARTITION BY h.src, h.dst ORDER BY h.k) AS before FROM (SELECT src, dst, i AS k, p[i] AS a, p[i + 1] AS b FROM way, UNNEST(range(1, LENGTH(p))) u(i)) h JOIN tp ON tp.src = h.a AND tp.dst = h.b) GROUP BY 1, 2) s ON s.src = a.id AND s.dst = b.id",
            *P, ("tp", "SELECT src, dst, w / SUM(w) OVER (PARTITION BY src) AS q FROM back"),
            ("way", "SELECT src, dst, p FROM p5 WHERE src < dst UNION ALL SELECT dst, src, list_reverse(p) FROM p5 WHERE src < dst"),
        ),
    )
REACH = path_views("unit", "u")
add("components", lambda t: routing.components(t.back(), t.ids()), V("SELECT src AS id, MIN(dst) AS component FROM u5 GROUP BY 1", ("unit", "SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM back"), *REACH))
add("number_of_components", lambda t: routing.number_of_components(t.back(), t.ids()), V("SELECT COUNT(DISTINCT c) AS n_components FROM (SELECT MIN(dst) AS c FROM u5 GROUP BY src)", ("unit", "SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM back"), *REACH))


# Diffusion
def series_views(base: str, name: str, terms: int) -> list[tuple[str, str]]:
    """Views of the terms of a matrix exponential, and <name> of their sum."""
    views = [(f"{name}0", "SELECT DISTINCT src, src AS dst, CAST(1 AS DOUBLE) AS w FROM " + base)]
    views += [(f"{name}{k}", f"SELECT a.src, b.dst, SUM(a.w * b.w) / {k} AS w FROM {name}{k - 1} a JOIN {base} b ON a.dst = b.src GROUP BY 1, 2") for k in range(1, terms)]
    return [*views, (name, "SELECT src, dst, SUM(w) AS w FROM (" + " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(terms)) + ") GROUP BY 1, 2")]


FILL = "SELECT a.src, b.src AS dst, {0} FROM (SELECT DISTINCT src FROM back) a CROSS JOIN (SELECT DISTINCT src FROM back) b LEFT JOIN {1} e ON e.src = a.src AND e.dst = b.src"
add("communicability_bin", lambda t: diffusion.communicability_bin(graph.binarize(t.back())), V(FILL.format(r("COALESCE(e.w, 0)", "w", 5), "ex"), ("one", "SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM back"), *series_views("one", "ex", 60)), 5)
add("communicability_bin_normalized", lambda t: diffusion.communicability_bin(graph.binarize(t.back()), normalize=True), digits=9)
add("communicability_wei", lambda t: diffusion.communicability_wei(t.back()), V(FILL.format(r("COALESCE(e.w, 0)", "w", 9), "ex") + " WHERE a.src <> b.src", ("st", "SELECT src AS id, SUM(w) AS s FROM back GROUP BY 1"), ("nrm", "SELECT src, dst, w / SQRT(a.s * b.s) AS w FROM back JOIN st a ON a.id = src JOIN st b ON b.id = dst"), *series_views("nrm", "ex", 24)), 9)
add("mean_first_passage_time", lambda t: diffusion.mean_first_passage_time(t.both()), digits=5)
add("diffusion_efficiency", lambda t: diffusion.diffusion_efficiency(t.both()), digits=8)
add("global_diffusion_efficiency", lambda t: diffusion.global_diffusion_efficiency(t.both()), digits=8)
STEPS = 10
add(
    "resource_efficiency_bin",
    lambda t: diffusion.resource_efficiency_bin(t.back()),
    V(
        f"SELECT h.src, h.dst, {r('CASE WHEN v.p >= 1 THEN 1 ELSE LN(1 - LEAST(v.p, 0.999999999999)) / LN(0.5) END', 'w', 9)}, {r('v.p', 'prob', 9)} FROM (SELECT src, dst, LENGTH(p) - 1 AS k FROM u5 WHERE src <> dst) h JOIN v ON v.k = h.k AND v.node = h.src AND v.target = h.dst",
        ("unit", "SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM back"), *REACH, ("dg", "SELECT src, COUNT(*) AS k FROM back GROUP BY 1"),
        ("v0", "SELECT DISTINCT src AS target, src AS node, CAST(1 AS DOUBLE) AS p FROM back"),
        *[(f"v{i}", f"SELECT target, back.src AS node, SUM(p) / ANY_VALUE(dg.k) AS p FROM v{i - 1} JOIN back ON back.dst = node JOIN dg ON dg.src = back.src WHERE back.src <> target GROUP BY 1, 2 UNION ALL SELECT target, target, 1.0 FROM v0") for i in range(1, STEPS)],
        ("v", " UNION ALL ".join(f"SELECT {i} AS k, * FROM v{i}" for i in range(1, STEPS))),
    ),
    9,
)
add(
    "flow_graph",
    lambda t: diffusion.flow_graph(t.back()),
    V(
        FILL.format(r("(SELECT SUM(w) FROM back) * (COALESCE(e.w, 0) * sb.s + COALESCE(f.w, 0) * sa.s) / (2 * (SELECT SUM(w) FROM back))", "w", 4), "ex") + " LEFT JOIN ex f ON f.src = b.src AND f.dst = a.src JOIN st sa ON sa.id = a.src JOIN st sb ON sb.id = b.src",
        ("st", "SELECT dst AS id, SUM(w) AS s FROM back GROUP BY 1"),
        ("lap", "SELECT src, dst, SUM(w) AS w FROM (SELECT src, dst, w / s AS w FROM back JOIN st ON id = dst UNION ALL SELECT id, id, -1.0 FROM st) GROUP BY 1, 2"),
        *series_views("lap", "ex", 40),
    ),
    4,
)


# Spreading
def _world(t: Tables) -> tuple[DataFrame, DataFrame]:
    b = t.back()
    paths = b.select("src", "dst", (F.col("w") / 100).alias("w"), (1 + F.abs(F.col("src") - F.col("dst"))).cast("double").alias("length"))
    regions = t.annotations().join(b.selectExpr("src AS id").distinct(), "id", "left_semi").select("id", (1 + F.col("id") % 5).cast("double").alias("size"), F.col("x").alias("clearance"), F.col("y").alias("synthesis"))
    return paths, regions


def _seeds(t: Tables) -> list[int]:
    return sorted(x.src for x in t.back().select("src").distinct().collect())


add("normal_spread", lambda t: spreading.normal_spread(*_world(t)), digits=4)
add("misfolded_spread", lambda t: spreading.misfolded_spread(*_world(t), _seeds(t)), digits=4)
add("simulate_atrophy", lambda t: spreading.simulate_atrophy(*_world(t), _seeds(t)))
add(
    "atrophy",
    lambda t: spreading.atrophy(t.both(), t.agents(), by=()),
    V(
        f"SELECT id, t, {r('SUM(0.5 * COALESCE(late, 0) + 0.5 * loss) OVER (PARTITION BY id ORDER BY t)', 'atrophy')} FROM (SELECT id, t, loss, LAG(around) OVER (PARTITION BY id ORDER BY t) AS late FROM ls LEFT JOIN (SELECT sym.src AS node, t AS tt, SUM(w / s * loss) AS around FROM sym JOIN cs ON cs.id = sym.src JOIN ls l ON l.id = sym.dst GROUP BY 1, 2) ON node = id AND tt = t)",
        ("ls", "SELECT id, t, 1 - EXP(-misfolded / (normal + misfolded) * 0.1) AS loss FROM agents"), ("cs", "SELECT dst AS id, SUM(w) AS s FROM sym GROUP BY 1"),
    ),
)

# Communities
add("contingency", lambda t: community.contingency(t.partitions().filter("part = 0"), t.partitions().filter("part = 1")), V("SELECT a.label AS label_x, b.label AS label_y, COUNT(*) AS n FROM parts a JOIN parts b ON a.id = b.id WHERE a.part = 0 AND b.part = 1 GROUP BY 1, 2"))
add("get_relabels", lambda t: community.get_relabels(t.partitions().filter("part = 0"), t.partitions().filter("part = 3")), V("SELECT DISTINCT label AS label_x, 40 - 10 * label AS label_y, CAST(0 AS BIGINT) AS cost FROM regs"))
add("match_cluster_labels", lambda t: community.match_cluster_labels(t.partitions().filter("part = 0"), t.partitions().filter("part = 3")), V("SELECT id, 40 - 10 * label AS label FROM regs"))
add("match_assignments", lambda t: community.match_assignments(t.partitions(), seed=1))
add("reorder_assignments", lambda t: community.reorder_assignments(t.partitions(), t.regions(), seed=1))
add("agreement_matrix", lambda t: community.agreement_matrix(t.partitions()), V("SELECT a.id AS src, b.id AS dst, CAST(COUNT(*) AS DOUBLE) AS w FROM parts a JOIN parts b ON a.part = b.part AND a.label = b.label AND a.id <> b.id GROUP BY 1, 2"))
add(
    "unique_partitions",
    lambda t: community.unique_partitions(t.partitions()),
    V("SELECT part, id, label FROM can WHERE part IN (SELECT MIN(part) FROM (SELECT part, string_agg(label, ',' ORDER BY id) AS s FROM can GROUP BY 1) GROUP BY s)", ("can", "SELECT part, id, DENSE_RANK() OVER (PARTITION BY part ORDER BY f) - 1 AS label FROM (SELECT part, id, MIN(id) OVER (PARTITION BY part, label) AS f FROM parts)")),
)
ZRAND = [
    ("mg", "SELECT part, SUM(k) AS n, SUM(k * k) AS s2, SUM(k * k * k) AS s3 FROM (SELECT part, label, CAST(COUNT(*) AS DOUBLE) AS k FROM cust GROUP BY 1, 2) GROUP BY 1"),
    ("ce", "SELECT pa, pb, SUM(k * k) AS c2 FROM (SELECT a.part AS pa, b.part AS pb, a.label, b.label AS lb, CAST(COUNT(*) AS DOUBLE) AS k FROM cust a JOIN cust b ON a.id = b.id AND a.part < b.part GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"),
    ("zs", "SELECT pa, pb, x.n, x.n * (x.n - 1) / 2 AS m, (x.s2 - x.n) / 2 AS m1, (y.s2 - x.n) / 2 AS m2, (c2 - x.n) / 2 AS wab, x.n * (x.n * x.n - 3 * x.n - 2) AS base, x.s3 AS x3, y.s3 AS y3 FROM ce JOIN mg x ON x.part = pa JOIN mg y ON y.part = pb"),
    ("zt", "SELECT *, base - 8 * (n + 1) * m1 + 4 * x3 AS c1, base - 8 * (n + 1) * m2 + 4 * y3 AS c2, (4 * m1 - 2 * m) ** 2 AS p1, (4 * m2 - 2 * m) ** 2 AS p2 FROM zs"),
    ("zr", "SELECT pa AS part_a, pb AS part_b, (wab - m1 * m2 / m) / SQRT(m / 16 - p1 * p2 / (256 * m * m) + c1 * c2 / (16 * n * (n - 1) * (n - 2)) + (p1 - 4 * c1 - 4 * m) * (p2 - 4 * c2 - 4 * m) / (64 * n * (n - 1) * (n - 2) * (n - 3))) AS z FROM zt"),
]
add("zrand_partitions", lambda t: community.zrand_partitions(t.customers()), V(f"SELECT part_a, part_b, {r('z', 'z', 3)} FROM zr", *ZRAND), 3)
add("zrand", lambda t: community.zrand(t.customers().filter("part = 0"), t.customers().filter("part = 1")), V(f"SELECT {r('z', 'z', 3)} FROM zr WHERE part_a = 0 AND part_b = 1", *ZRAND), 3)
add(
    "get_modularity",
    lambda t: community.get_modularity(t.both(), t.regions()),
    V(f"SELECT label, {r('(SUM(i) - SUM(ko) * SUM(ki) / ANY_VALUE(s)) / ANY_VALUE(s)', 'q', 9)} FROM (SELECT label, COALESCE((SELECT SUM(w) FROM sym JOIN regs b ON b.id = dst WHERE src = regs.id AND b.label = regs.label), 0) AS i, COALESCE((SELECT SUM(w) FROM sym WHERE src = regs.id), 0) AS ko, COALESCE((SELECT SUM(w) FROM sym WHERE dst = regs.id), 0) AS ki FROM regs), (SELECT SUM(w) AS s FROM sym) GROUP BY label"),
    9,
)
add("get_modularity_z", lambda t: community.get_modularity_z(t.both(), t.regions()))
add("get_modularity_sig", lambda t: community.get_modularity_sig(t.both(), t.regions()))
add("community_louvain", lambda t: community.community_louvain(t.back(), runs=4))
add("consensus_clustering", lambda t: community.consensus_clustering(community.agreement_matrix(t.partitions()).selectExpr("src", "dst", "w / 4 AS w"), t.ids(), 0.5))
add("find_consensus", lambda t: community.find_consensus(t.partitions()))
add("consensus_modularity", lambda t: community.consensus_modularity(t.back())[0])

# Construction
add("get_triu", lambda t: construction.get_triu(t.trade()), V(f"SELECT {EDGE} FROM trade WHERE dst - src >= 1"))
add("binarize_network", lambda t: construction.binarize_network(t.both(), t.ids(), 20), V("SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM back"))
add("threshold_network", lambda t: construction.threshold_network(t.both(), t.ids(), 25))
add(
    "spanning_tree_weight",
    lambda t: construction.spanning_tree(t.both()).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")),
    V(
        f"SELECT {r('SUM(w)', 'w')}, COUNT(*) AS n FROM sym WHERE src < dst AND NOT EXISTS (SELECT 1 FROM m5 WHERE m5.src = sym.src AND m5.dst = sym.dst AND m5.b > sym.w)",
        ("m0", "SELECT src, dst, w AS b FROM sym"),
        *[(f"m{k + 1}", f"SELECT src, dst, MAX(b) AS b FROM (SELECT src, dst, b FROM m{k} UNION ALL SELECT x.src, y.dst, LEAST(x.b, y.b) FROM m{k} x JOIN m{k} y ON x.dst = y.src WHERE x.src <> y.dst) GROUP BY 1, 2") for k in range(5)],
    ),
)
add("func_consensus", lambda t: construction.func_consensus(t.series(), n_boot=0), V(f"SELECT src, dst, {r('AVG(CASE WHEN isfinite(c) THEN c END)', 'w')} FROM (SELECT a.subject, a.id AS src, b.id AS dst, CASE WHEN a.id = b.id THEN 1 ELSE corr(a.v, b.v) END AS c FROM series a JOIN series b ON a.subject = b.subject AND a.t = b.t GROUP BY 1, 2, 3) GROUP BY 1, 2"))
add("func_consensus_bootstrap", lambda t: construction.func_consensus(t.series(), n_boot=1000))
add("ecdf", lambda t: construction.ecdf(t("lineitem"), "l_quantity"), V(f"SELECT CAST(q AS DOUBLE) AS q, {r('prob', 'prob', 9)} FROM (SELECT l_quantity AS q, SUM(COUNT(*)) OVER (ORDER BY l_quantity) / (SELECT COUNT(*) FROM lineitem) AS prob FROM lineitem GROUP BY 1 UNION ALL SELECT MIN(l_quantity), 0 FROM lineitem)"), 9)
CONSENSUS = [
    ("pr", "SELECT src, dst, w AS d, CAST(src % 2 = dst % 2 AS INTEGER) AS intra, COALESCE(c, 0) AS c, COALESCE(tot, 0) AS tot FROM dm LEFT JOIN (SELECT src, dst, COUNT(*) AS c, SUM(w) AS tot FROM stack WHERE src < dst GROUP BY 1, 2) USING (src, dst) WHERE src < dst AND w <> 0"),
    ("ms", "SELECT intra, SUM(c) AS tc, MIN(d) AS least, CAST(SUM(c) AS DOUBLE) / (SELECT COUNT(DISTINCT subject) FROM stack) AS m FROM pr WHERE c > 0 GROUP BY 1"),
    ("bn", "SELECT x.intra, d, round_even(CAST(u AS DOUBLE) / CAST(tc AS DOUBLE) * m, 0) AS b, m FROM (SELECT intra, d, SUM(SUM(c)) OVER (PARTITION BY intra ORDER BY d) AS u FROM pr WHERE c > 0 GROUP BY 1, 2) x JOIN ms ON ms.intra = x.intra UNION ALL SELECT intra, least, 0, m FROM ms"),
    ("lm", "SELECT intra, b, MIN(d) AS lo, MAX(d) AS hi FROM bn WHERE b < FLOOR(m) GROUP BY 1, 2"),
    ("pk", "SELECT DISTINCT src, dst, tot FROM (SELECT src, dst, tot, ROW_NUMBER() OVER (PARTITION BY pr.intra, b ORDER BY c DESC, CASE WHEN c > 0 THEN tot / c END DESC NULLS LAST, src, dst) AS k FROM pr JOIN lm ON lm.intra = pr.intra AND d >= lo AND d <= hi) WHERE k = 1"),
]
for weighted in (False, True):
    add(
        "struct_consensus" + "_weighted" * weighted,
        lambda t, weighted=weighted: construction.struct_consensus(t.stack(), t.distances(), t.ids().selectExpr("id", "id % 2 AS hemi"), weighted=weighted),
        V(f"SELECT src, dst, {r('tot / (SELECT COUNT(DISTINCT subject) FROM stack)' if weighted else '1', 'w')} FROM (SELECT src, dst, tot FROM pk UNION ALL SELECT dst, src, tot FROM pk)", *CONSENSUS),
    )

# Null models: degrees stay
KEPT = "SELECT replicate, id, (SELECT COUNT(*) FROM {0} WHERE dst = id) AS in_degree, (SELECT COUNT(*) FROM {0} WHERE src = id) AS out_degree FROM (SELECT DISTINCT src AS id FROM {0} UNION SELECT DISTINCT dst FROM {0}), (SELECT UNNEST(range(2)) AS replicate)"
for name, run, base in (
    ("randmio_und", nulls.randmio_und, "back"),
    ("randmio_und_connected", nulls.randmio_und_connected, "back"),
    ("randmio_dir", nulls.randmio_dir, "arcs"),
    ("randmio_dir_connected", nulls.randmio_dir_connected, "arcs"),
):
    add(f"{name}_weights", lambda t, run=run, base=base: nulls.weight_table(run(getattr(t, base)(), 5, 2), getattr(t, base)()), V(f"SELECT replicate, w, n, true AS changed FROM (SELECT w, COUNT(*) AS n FROM {base} GROUP BY 1), (SELECT UNNEST(range(2)) AS replicate)"))
    add(f"{name}_degrees", lambda t, run=run, base=base: nulls.degree_table(run(getattr(t, base)(), 5, 2)), V(KEPT.format(base)))
add("match_length_degree_distribution_degrees", lambda t: nulls.degree_table(nulls.match_length_degree_distribution(t.back(), t.distances(), n_replicates=2)), V(KEPT.format("back")))
add("strength_preserving_rand_sa", lambda t: nulls.strength_preserving_rand_sa(t.back(), n_replicates=2))
add("strength_preserving_rand_sa_mse_opt", lambda t: nulls.strength_preserving_rand_sa_mse_opt(t.back(), n_replicates=2))
add("strength_preserving_rand_sa_dir", lambda t: nulls.strength_preserving_rand_sa_dir(t.arcs(), n_replicates=2))

# Statistics
X, Y = ["l_quantity", "l_discount"], "l_extendedprice"
add("efficient_pearsonr", lambda t: statistics.efficient_pearsonr(t("lineitem"), [Y], [*X, "l_tax"]).drop("p"), V(" UNION ALL ".join(f"SELECT '{Y}' AS a, '{c}' AS b, {r(f'corr({Y}, {c})', 'r')}, COUNT(*) AS n FROM lineitem" for c in [*X, "l_tax"])))
add("efficient_pearsonr_p", lambda t: statistics.efficient_pearsonr(t.annotations(), ["x"], ["y"]))
add("weighted_pearsonr", lambda t: statistics.weighted_pearsonr(t("lineitem"), Y, "l_tax", "l_quantity"), V(f"SELECT {r('(swxy / sw - swx / sw * swy / sw) / SQRT((swxx / sw - (swx / sw) ** 2) * (swyy / sw - (swy / sw) ** 2))', 'r')} FROM (SELECT SUM(l_quantity) AS sw, SUM(l_quantity * {Y}) AS swx, SUM(l_quantity * l_tax) AS swy, SUM(l_quantity * {Y} * l_tax) AS swxy, SUM(l_quantity * {Y} * {Y}) AS swxx, SUM(l_quantity * l_tax * l_tax) AS swyy FROM lineitem)"))
add("make_correlated_xy", lambda t: statistics.make_correlated_xy(t.spark, 0.85, 1000, seed=1234))
add("permtest_1samp", lambda t: statistics.permtest_1samp(t.annotations(), "x", "id", 4500.0))
add("permtest_rel", lambda t: statistics.permtest_rel(t.annotations(), "x", "y", "id"))
add("permtest_pearsonr", lambda t: statistics.permtest_pearsonr(t.annotations(), "x", "y", "id"))


def _rotations(t: Tables) -> DataFrame:
    return t.ids().select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("perm"), F.col("id").alias("position")).select("perm", "position", F.expr("(position + perm + 1) % 25").alias("row"))


add(
    "permtest_pearsonr_resamples",
    lambda t: statistics.permtest_pearsonr(t.annotations(), "x", "y", "id", 20, _rotations(t)),
    V(f"SELECT {r('ANY_VALUE(o)', 'r')}, {r('(1 + SUM(CASE WHEN ABS(c) >= ABS(o) THEN 1 ELSE 0 END)) / 21.0', 'p')} FROM (SELECT k, corr(a.x, b.y) AS c FROM ann a JOIN (SELECT UNNEST(range(20)) AS k) ON true JOIN ann b ON a.id = (b.id + k + 1) % 25 GROUP BY 1), (SELECT corr(x, y) AS o FROM ann)"),
)
add("add_constant", lambda t: statistics.add_constant(t.annotations()), V(f"SELECT id, {r('x', 'x')}, {r('y', 'y')}, CAST(1 AS DOUBLE) AS const FROM ann"))
add(
    "residualize",
    lambda t: statistics.residualize(t("lineitem"), ["l_quantity"], [Y]).select("l_orderkey", "l_linenumber", f"{Y}_residual"),
    V(f"SELECT l_orderkey, l_linenumber, {r(f'({Y} - b * l_quantity - m) / s', f'{Y}_residual')} FROM lineitem, (SELECT b, AVG({Y} - b * l_quantity) AS m, stddev_pop({Y} - b * l_quantity) AS s FROM lineitem, (SELECT regr_slope({Y}, l_quantity) AS b FROM lineitem) GROUP BY b)"),
)
add(
    "dominance",
    lambda t: statistics.get_dominance_stats(t("lineitem"), X, Y, use_adjusted_r_sq=False).filter("kind = 'r_sq'").select(F.array_join(F.col("predictors").cast("array<string>"), ",").alias("predictors"), "value"),
    V(f"SELECT predictors, {r('value', 'value')} FROM (SELECT '0' AS predictors, a * a AS value FROM c UNION ALL SELECT '1', b * b FROM c UNION ALL SELECT '0,1', (a * a + b * b - 2 * a * b * g) / (1 - g * g) FROM c)", ("c", f"SELECT corr({Y}, {X[0]}) AS a, corr({Y}, {X[1]}) AS b, corr({X[0]}, {X[1]}) AS g FROM lineitem")),
)
add("dominance_full", lambda t: statistics.get_dominance_stats(t("lineitem"), [*X, "l_tax"], Y).withColumn("predictors", F.array_join(F.col("predictors").cast("array<string>"), ",")))

# Units and parcels
IGNORE = "', '".join(parcels.IGNORED_LABELS)
for how, sql in (("mean", "AVG(x)"), ("median", "quantile_cont(x, 0.5)")):
    add(f"vertices_to_parcels_{how}", lambda t, how=how: parcels.vertices_to_parcels(t.vertices(), t.parcels(), agg_method=how), V(f"SELECT parc.hemi, parc.key, label, {r(sql, 'x')} FROM parc LEFT JOIN vert ON vert.hemi = parc.hemi AND vert.key = parc.key WHERE label NOT IN ('{IGNORE}') GROUP BY 1, 2, 3"))
add(
    "vertices_to_parcels_mode",
    lambda t: parcels.vertices_to_parcels(t.vertices(), t.parcels(), ("y",), background=0.0, agg_method="mode"),
    V(f"SELECT parc.hemi, parc.key, label, {r('y', 'y')} FROM parc LEFT JOIN (SELECT hemi, key, y, ROW_NUMBER() OVER (PARTITION BY hemi, key ORDER BY COUNT(*) DESC, y) AS k FROM vert WHERE y <> 0 GROUP BY 1, 2, 3) m ON m.hemi = parc.hemi AND m.key = parc.key AND k = 1 WHERE label NOT IN ('{IGNORE}')"),
)
add(
    "parcels_to_vertices",
    lambda t: parcels.parcels_to_vertices(t.parcels().filter("label <> 'unknown'").select("hemi", "key", F.col("key").cast("double").alias("x")), t.vertices(), t.parcels(), fill=-1.0),
    V("SELECT vert.hemi, vertex, vert.key, CAST(CASE WHEN vert.key = 3 THEN -1 ELSE vert.key END AS DOUBLE) AS x FROM vert"),
)
add("extract_labels", lambda t: parcels.extract_labels(t.parcels()), V(f"SELECT hemi, key, label FROM parc WHERE label NOT IN ('{IGNORE}')"))
add("extract_surface_labels", lambda t: parcels.extract_surface_labels(t.vertices(), t.parcels()), V(f"SELECT hemi, key, label FROM parc WHERE label NOT IN ('{IGNORE}') AND EXISTS (SELECT 1 FROM vert WHERE vert.hemi = parc.hemi AND vert.key = parc.key)"))


def _rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t("customer")
    return c.selectExpr("c_custkey AS row", "c_acctbal AS x").unionByName(t("supplier").selectExpr("s_suppkey + 1000000000 AS row", "s_acctbal AS x")), c.selectExpr("IF(c_custkey % 2 = 0, 'L', 'R') AS structure", "c_custkey AS row", "c_custkey div 2 * 3 AS vertex")


def _voxels(t: Tables) -> DataFrame:
    """A voxel for each supplier, and one for each part that has no value."""
    return t("supplier").selectExpr("s_suppkey % 10 AS i", "s_suppkey div 10 % 10 AS j", "s_suppkey div 100 AS k", "s_suppkey + 1000000000 AS row").unionByName(t("part").selectExpr("p_partkey % 10 AS i", "p_partkey div 10 % 10 AS j", "-1 - p_partkey div 100 AS k", "-1 - p_partkey AS row"))


VOXELS = "SELECT s_suppkey % 10 AS i, s_suppkey // 10 % 10 AS j, s_suppkey // 100 AS k, s_acctbal AS x FROM supplier UNION ALL SELECT p_partkey % 10, p_partkey // 10 % 10, -1 - p_partkey // 100, NULL FROM part"
add("extract_surface", lambda t: parcels.extract_surface(*_rows(t), "L"), V(f"SELECT CAST(v AS INTEGER) AS vertex, {r('COALESCE(c_acctbal, 0)', 'x')} FROM (SELECT UNNEST(range((SELECT MAX(c_custkey // 2 * 3) + 1 FROM customer WHERE c_custkey % 2 = 0))) AS v) LEFT JOIN (SELECT c_custkey // 2 * 3 AS vx, c_acctbal FROM customer WHERE c_custkey % 2 = 0) ON vx = v"))
add("extract_volume", lambda t: parcels.extract_volume(_rows(t)[0], _voxels(t)), f"SELECT i, j, k, {r('COALESCE(x, 0)', 'x')} FROM ({VOXELS})")
add("describe", lambda t: parcels.describe(*_rows(t), _voxels(t)), f"SELECT CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'R' END AS structure, COUNT(*) AS n_rows, COUNT(c_acctbal) AS n_values FROM customer GROUP BY 1 UNION ALL SELECT 'VOLUME', COUNT(*), COUNT(x) FROM ({VOXELS})")
add("deconstruct", lambda t: _deconstructed(t), f"SELECT 'volume' AS part, COUNT(*) AS n, {r('SUM(COALESCE(x, 0))', 'x', 2)} FROM ({VOXELS}) UNION ALL SELECT 'L', MAX(c_custkey // 2 * 3) + 1, {r('SUM(c_acctbal)', 'x', 2)} FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'R', MAX(c_custkey // 2 * 3) + 1, {r('SUM(c_acctbal)', 'x', 2)} FROM customer WHERE c_custkey % 2 = 1", 2)


def _deconstructed(t: Tables) -> DataFrame:
    """Rows and sums of the three parts."""
    out = None
    for name, part in zip(("volume", "L", "R"), parcels.deconstruct(*_rows(t), _voxels(t), "L", "R"), strict=True):
        one = part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))
        out = one if out is None else out.unionByName(one)
    return out


# A network that grows with the tables: customers and suppliers
add("market_degrees", lambda t: graph.degrees_und(t.dealt(), t.traders()), V("SELECT id, COUNT(src) AS degree FROM traders LEFT JOIN market ON dst = id GROUP BY id"))
add("market_laplacian_diagonal", lambda t: graph.graph_laplacian(t.market()).filter("src = dst"), V(f"SELECT dst AS src, dst, {r('SUM(w)', 'w')} FROM market GROUP BY dst"))
add("market_assortativity", lambda t: graph.assortativity_und(t.traders(), t.dealt()), V(f"SELECT {r('SUM(w * (a.x - m) * (b.x - m)) / SUM(w * (b.x - m) * (b.x - m))', 'assortativity')} FROM market JOIN traders a ON a.id = src JOIN traders b ON b.id = dst, (SELECT SUM(w * x) / SUM(w) AS m FROM market JOIN traders ON id = dst)"))
ZM = ("zm", "SELECT id, x - (SELECT AVG(x) FROM traders) AS x FROM traders")
QM = "(SELECT SUM(x * x) AS q, COUNT(*) AS n FROM zm)"
add("market_morans_i", lambda t: spatial.morans_i(t.traders(), t.dealt()), V(f"SELECT {r('ANY_VALUE(n) * SUM(w * a.x * b.x) / (ANY_VALUE(q) * SUM(w))', 'morans_i')} FROM market JOIN zm a ON a.id = src JOIN zm b ON b.id = dst, {QM}", ZM))
add("market_local_gearys_c", lambda t: spatial.local_gearys_c(t.traders(), t.dealt()), V(f"SELECT a.id, {r('COALESCE(SUM(w * (a.x - b.x) * (a.x - b.x)), 0) / (ANY_VALUE(q) / (ANY_VALUE(n) - 1))', 'gearys_c', 2)} FROM zm a LEFT JOIN market ON src = a.id LEFT JOIN zm b ON b.id = dst, {QM} GROUP BY a.id", ZM), 2)
add("market_modularity", lambda t: community.get_modularity(t.dealt(), t.traders().select("id", "label")), V(f"SELECT label, {r('(i - ko * ko / s) / s', 'q', 9)} FROM (SELECT label, COALESCE(SUM(w) FILTER (other = label), 0) AS i, COALESCE(SUM(w), 0) AS ko FROM traders LEFT JOIN (SELECT src, w, b.label AS other FROM market JOIN traders b ON b.id = dst) ON src = id GROUP BY label), (SELECT SUM(w) AS s FROM market)"), 9)
FAR = ("far(id, other)", "SELECT id, id FROM traders UNION SELECT far.id, strong.dst FROM far JOIN strong ON strong.src = other")
add("market_components", lambda t: routing.components(t.strong(), t.traders()), V("SELECT id, MIN(other) AS component FROM far GROUP BY 1", FAR, recursive=True))
add("market_matching_index", lambda t: graph.matching_index(t.strong()), V(f"SELECT i AS src, j AS dst, {r('2 * c / (si.s + sj.s)', 'w', 9)} FROM (SELECT a.src AS i, b.src AS j, COUNT(*) AS c FROM strong a JOIN strong b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2) JOIN st si ON si.src = i JOIN st sj ON sj.src = j", ("st", "SELECT src, SUM(w) AS s FROM strong GROUP BY 1")), 9)
add("market_binarized", lambda t: construction.binarize_network(t.market(), t.traders(), 1), V("SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM market WHERE w > (SELECT quantile_cont(COALESCE(w, 0), 0.99) FROM (SELECT a.id AS src, b.id AS dst FROM traders a JOIN traders b ON a.id < b.id) LEFT JOIN market USING (src, dst))"))
TREE = "SELECT COUNT(*) - COUNT(DISTINCT component) AS n FROM (SELECT id, MIN(other) AS component FROM far GROUP BY 1)"
add("market_spanning_forest", lambda t: construction.spanning_tree(t.strong()).agg(F.count(F.lit(1)).alias("n")), V(TREE, FAR, recursive=True))
add("market_sorted", lambda t: display.sort_communities(t.market(), t.traders().select("id", "label")).withColumn("place", F.col("place").cast("long")), V("SELECT id, label, CAST(ROW_NUMBER() OVER (ORDER BY label, s DESC, id DESC) - 1 AS BIGINT) AS place FROM (SELECT id, label, COALESCE(SUM(w), 0) AS s FROM traders LEFT JOIN (SELECT src, w, a.label AS la, b.label AS lb FROM market JOIN traders a ON a.id = src JOIN traders b ON b.id = dst) ON src = id AND la = lb GROUP BY 1, 2)"))

# Display
add("grid_communities", lambda t: display.grid_communities(t.regions()), V("SELECT CAST((SELECT COUNT(*) FROM regs b WHERE b.label < a.label) AS BIGINT) AS bound FROM (SELECT DISTINCT label FROM regs) a UNION ALL SELECT COUNT(*) FROM regs"))
ORDER = ("so", "SELECT id, label, ROW_NUMBER() OVER (ORDER BY label, s DESC, id DESC) - 1 AS place FROM (SELECT regs.id, regs.label, COALESCE((SELECT SUM(w) FROM sym JOIN regs b ON b.id = dst WHERE src = regs.id AND b.label = regs.label), 0) AS s FROM regs)")
add("sort_communities", lambda t: display.sort_communities(t.both(), t.regions()).withColumn("place", F.col("place").cast("long")), V("SELECT id, label, CAST(place AS BIGINT) AS place FROM so", ORDER))
add("mod_heatmap", lambda t: display.mod_heatmap(t.both(), t.regions()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "w"), V(f"SELECT CAST(a.place AS BIGINT) AS row, CAST(b.place AS BIGINT) AS col, {r('w', 'w')} FROM sym JOIN so a ON a.id = src JOIN so b ON b.id = dst", ORDER))
add("colour_limits", lambda t: display.colour_limits(t("lineitem"), Y), f"SELECT {r(f'quantile_cont({Y}, 0.025)', 'low', 4)}, {r(f'quantile_cont({Y}, 0.975)', 'high', 4)} FROM lineitem", 4)
add("mask_medial_wall", lambda t: display.mask_medial_wall(t.vertices().select("hemi", "vertex", "x"), t.vertices().filter("key = 3")), V(f"SELECT hemi, vertex, {r('CASE WHEN key <> 3 THEN x END', 'x')} FROM vert"))
add(
    "parcellation_keys",
    lambda t: display.parcellation_keys(t("part").selectExpr("CASE p_partkey % 4 WHEN 0 THEN concat('schaefer', p_size, 'x17') WHEN 1 THEN concat('Schaefer', p_size) WHEN 2 THEN concat('cammoun', p_size) ELSE p_name END AS name")),
    "SELECT CASE p_partkey % 4 WHEN 0 THEN 'schaefer' || p_size || 'x17' WHEN 1 THEN 'Schaefer' || p_size WHEN 2 THEN 'cammoun' || p_size ELSE p_name END AS name, CASE p_partkey % 4 WHEN 2 THEN 'cammoun' WHEN 3 THEN 'path' ELSE 'schaefer' END AS atlas, CASE p_partkey % 4 WHEN 0 THEN p_size || 'Parcels17Networks' WHEN 1 THEN p_size || 'Parcels7Networks' WHEN 2 THEN 'scale' || p_size ELSE p_name END AS key FROM part",
)

# Sources
add(
    "registry_address",
    lambda t: t("nation").select("n_nationkey", registry.address(F.expr("IF(n_nationkey % 2 = 0, 'osf', 'zenodo-file')"), F.array(F.col("n_name"), F.col("n_regionkey").cast("string"))).alias("address")),
    "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'https://files.osf.io/v1/resources/' || n_name || '/providers/osfstorage/' || n_regionkey ELSE 'https://zenodo.org/record/' || n_name || '/files/' || n_regionkey || '?download=1' END AS address FROM nation",
)
add("session_connectivity", lambda t: registry.session_connectivity(t.series().withColumnRenamed("subject", "session")), V(f"SELECT a.subject AS session, a.id AS src, b.id AS dst, {r('corr(a.v, b.v)', 'w')} FROM series a JOIN series b ON a.subject = b.subject AND a.t = b.t AND a.id > b.id GROUP BY 1, 2, 3"))
add("subscale_sums", lambda t: registry.subscale_sums(t("lineitem").withColumnRenamed("l_orderkey", "session"), {"rates": ["l_discount", "l_tax"]}, t("orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS session")), f"SELECT l_orderkey AS session, {r('l_discount + l_tax', 'rates')} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")


# Scans: files of the tables' values are written to the shared folder and read back
def _matrix(t: Tables) -> tuple[list[int], list[list[float]]]:
    ids = sorted(x.id for x in t.ids().collect())
    w = {(x.src, x.dst): x.w for x in t.trade().collect()}
    return ids, [[float(w.get((a, b), 0)) for b in ids] for a in ids]


def _scanned(t: Tables, read: Callable[[str], DataFrame], content: bytes, suffix: str) -> DataFrame:
    return read(formats.put(t.spark, content, suffix)).drop("path")


GRID = f"SELECT a.id AS src, b.id AS dst, {r('COALESCE(w, 0)', 'w')} FROM ids a CROSS JOIN ids b LEFT JOIN trade ON src = a.id AND dst = b.id"
add("read_matrix", lambda t: _scanned(t, lambda p: files.read_matrix(t.spark, p), "\n".join(",".join(map(str, row)) for row in _matrix(t)[1]).encode(), ".csv"), V(GRID))
add("read_npy", lambda t: _scanned(t, lambda p: files.read_npy(t.spark, p), formats.npy(_matrix(t)[1]), ".npy"), V(GRID))


def _nations(t: Tables) -> tuple[list[int], list[tuple[int, str]]]:
    """The region of each nation, as the key of a vertex, and the regions' names."""
    return [x.k for x in t("nation").orderBy("n_nationkey").selectExpr("n_regionkey AS k").collect()], [(x.r_regionkey, x.r_name) for x in t("region").orderBy("r_regionkey").collect()]


KEYS = "SELECT 'L' AS hemi, CAST(n_nationkey AS BIGINT) AS vertex, CAST(n_regionkey AS BIGINT) AS key FROM nation"
NAMED = "SELECT 'L' AS hemi, CAST(r_regionkey AS BIGINT) AS key, r_name AS label FROM region"
for suffix, write in ((".annot", formats.annot), (".label.gii", formats.gifti)):
    name = suffix.split(".")[-1]
    add(f"read_{name}_vertices", lambda t, suffix=suffix, write=write: _scanned(t, lambda p: files.load_parcellation(t.spark, p, "L")[0], write(*_nations(t)), suffix), KEYS)
    add(f"read_{name}_parcels", lambda t, suffix=suffix, write=write: _scanned(t, lambda p: files.load_parcellation(t.spark, p, "L")[1], write(*_nations(t)), suffix), NAMED)


def _cifti(t: Tables) -> bytes:
    """Nations on the surface, in the order of their keys, then regions in the volume; the values are regions."""
    keys, table = _nations(t)
    data = np.array([[*keys, *[k for k, _ in table]], [*[10.0 * k for k in keys], *[-1.0] * len(table)]], float)
    return formats.cifti(data, [("CIFTI_STRUCTURE_CORTEX_LEFT", 2 * len(keys), [2 * i for i in range(len(keys))])], [("CIFTI_STRUCTURE_THALAMUS_LEFT", [(k, k + 1, k + 2) for k, _ in table])], table)


add("read_cifti_values", lambda t: _scanned(t, lambda p: cifti.read_values(t.spark, p), _cifti(t), ".dlabel.nii"), "SELECT CAST(0 AS BIGINT) AS map, CAST(n_nationkey AS BIGINT) AS row, CAST(n_regionkey AS DOUBLE) AS x FROM nation UNION ALL SELECT 1, n_nationkey, 10.0 * n_regionkey FROM nation UNION ALL SELECT 0, 25 + r_regionkey, r_regionkey FROM region UNION ALL SELECT 1, 25 + r_regionkey, -1 FROM region")
add("read_cifti_places", lambda t: _scanned(t, lambda p: cifti.read_places(t.spark, p), _cifti(t), ".dlabel.nii"), "SELECT 'CIFTI_STRUCTURE_CORTEX_LEFT' AS structure, CAST(n_nationkey AS BIGINT) AS row, CAST(2 * n_nationkey AS BIGINT) AS vertex, CAST(50 AS BIGINT) AS n_vertices FROM nation")
add("read_cifti_voxels", lambda t: _scanned(t, lambda p: cifti.read_voxels(t.spark, p), _cifti(t), ".dlabel.nii"), "SELECT 'CIFTI_STRUCTURE_THALAMUS_LEFT' AS structure, CAST(25 + r_regionkey AS BIGINT) AS row, CAST(r_regionkey AS BIGINT) AS i, CAST(r_regionkey + 1 AS BIGINT) AS j, CAST(r_regionkey + 2 AS BIGINT) AS k FROM region")
add("read_cifti_labels", lambda t: _scanned(t, lambda p: cifti.read_labels(t.spark, p).filter("map = 1"), _cifti(t), ".dlabel.nii"), "SELECT CAST(1 AS BIGINT) AS map, CAST(r_regionkey AS BIGINT) AS key, r_name AS label FROM region")
add("read_dlabel_vertices", lambda t: _scanned(t, lambda p: files.load_parcellation(t.spark, p, "L", "CIFTI_STRUCTURE_CORTEX_LEFT")[0], _cifti(t), ".dlabel.nii"), "SELECT 'L' AS hemi, CAST(v AS BIGINT) AS vertex, CAST(COALESCE(n_regionkey, 0) AS BIGINT) AS key FROM (SELECT UNNEST(range(50)) AS v) LEFT JOIN nation ON 2 * n_nationkey = v")
add("read_registry", lambda t: registry.load_registry(t.spark, formats.put(t.spark, json.dumps({x.n_name: {"v": {"url-type": "osf", "url": [str(x.n_nationkey), "f"], "md5": "m", "rel-path": x.n_name}} for x in t("nation").collect()}).encode(), ".json")).select("dataset", "version", F.array_join("url", ",").alias("url"), "rel_path"), "SELECT n_name AS dataset, 'v' AS version, n_nationkey || ',f' AS url, n_name AS rel_path FROM nation")
add("surface_files", lambda t: registry.surface_files(t.spark, "fslr_curated").groupBy("version", "density").agg(F.count(F.lit(1)).alias("n")), "SELECT version, density, CAST(n AS BIGINT) AS n FROM (VALUES ('fslr4k', '4k', 12), ('fslr8k', '8k', 12), ('fslr32k', '32k', 14), ('fslr164k', '164k', 14)) v(version, density, n)")
add("annotated_vertices", lambda t: display.annotated_vertices(t("nation").filter("n_nationkey <> 3").selectExpr("row_number() OVER (ORDER BY n_nationkey) - 1 AS place", "CAST(n_regionkey AS double) AS x").unionByName(t("nation").filter("n_nationkey <> 3").selectExpr("row_number() OVER (ORDER BY n_nationkey) + 23 AS place", "10.0D * n_regionkey AS x")), t.vertices(), t.parcels()), V("SELECT vert.hemi, vertex, CASE WHEN vert.key <> 3 THEN CAST(n_regionkey * (CASE WHEN vert.hemi = 'L' THEN 1 ELSE 10 END) AS DOUBLE) END AS x FROM vert LEFT JOIN nation ON n_nationkey = vert.key"))
