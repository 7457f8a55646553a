"""Percentiles by counting, and how much the joins of large networks move."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.model import ends
from graphloom.operators import display, spatial
from graphloom.plans import catalog, tables
from graphloom.ranks import percentiles

SHARES = (0.0, 0.025, 0.5, 0.975, 1.0)
rng = np.random.default_rng(5)
TABLES = {
    "distinct": rng.normal(size=5000),
    "tied": rng.integers(-3, 4, 1000) / 4,
    "close": 1 + np.arange(3000) * 2.0**-52,
    "wide": np.concatenate([-(10.0 ** rng.uniform(-320, 308, 700)), [-0.0, 0.0, 5e-324, -5e-324], 10.0 ** rng.uniform(-320, 308, 700)]),
    "infinite": np.array([-np.inf] * 3 + [1.0, 2.0] + [np.inf] * 3),
    "one": np.array([-7.5]),
    "none": np.array([]),
}


@pytest.mark.parametrize("name", TABLES)
def test_percentiles(spark, name):
    rows = [(float(v),) for v in TABLES[name]] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "v double").repartition(3)
    x = F.when(~F.isnan("v"), F.col("v"))
    want = df.agg(*[F.percentile(x, F.lit(s)) for s in SHARES]).first()
    assert percentiles(df, F.col("v"), SHARES) == list(want)


def test_colour_limits_without_one_task_for_all_values(spark):
    df = spark.range(20000, numPartitions=4).select((F.col("id") * 1.5).alias("x"))
    got = display.colour_limits(df)
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == ["low", "high"] and np.allclose(got.first(), np.percentile(np.arange(20000) * 1.5, [2.5, 97.5]))
    with pytest.raises(ValueError):
        display.colour_limits(df, high=101)


def moves(spark, name):
    """The plan of a market query where no join may broadcast: its shuffles of edges, and whether it reads a checkpoint."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum("Exchange hashpartitioning(src" in line or "Exchange hashpartitioning(dst" in line for line in plan.split("\n")), "ExistingRDD" in plan


def test_local_gearys_c_moves_edges_once_by_each_end(spark):
    by_ends, checkpoint = moves(spark, "market_local_gearys_c")
    assert by_ends == 4 and not checkpoint  # edges and node values, by dst and by src


@pytest.mark.parametrize("by", ["src", "dst"])
def test_ends_of_missing_and_repeated_edges(spark, by):
    e = spark.createDataFrame([(1, 2, 2.0), (1, 2, 3.0), (2, 2, 1.0), (1, 9, 5.0), (9, 1, 5.0), (2, 1, None)], "src long, dst long, w double").repartition(by)
    v = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, None)], "id long, x double")
    got = sorted((tuple(r) for r in ends(e, v).collect()), key=str)
    assert got == [(1, 2, 2.0, 0.5, 2.0), (1, 2, 3.0, 0.5, 2.0), (2, 1, None, 2.0, 0.5), (2, 2, 1.0, 2.0, 2.0)]


def test_dealt_is_the_market(spark):
    t = tables.Tables(spark, "/root/testdata/sf0.001")
    assert t.dealt().exceptAll(t.market()).count() == t.market().exceptAll(t.dealt()).count() == 0


def test_morans_i_sums_up_before_edges_move(spark):
    by_ends, checkpoint = moves(spark, "market_morans_i")
    assert by_ends == 3 and not checkpoint  # edges and node values by dst, then sums by src


def test_morans_i_by_sums(spark):
    e = [(1, 2, 2.0), (1, 2, 3.0), (2, 2, 1.0), (1, 9, 5.0), (9, 1, 5.0), (3, 1, -4.0)]
    x = {1: 0.5, 2: 2.0, 3: -1.0, 4: 7.0}
    m = sum(x.values()) / 4
    z = {k: v - m for k, v in x.items()}
    kept = [(a, b, w) for a, b, w in e if a in z and b in z]
    want = 4 * sum(w * z[a] * z[b] for a, b, w in kept) / (sum(v * v for v in z.values()) * sum(w for _, _, w in kept))
    edges, nodes = spark.createDataFrame(e, "src long, dst long, w double"), spark.createDataFrame(list(x.items()), "id long, x double")
    assert np.isclose(spatial.morans_i(nodes, edges).first()[0], want)
    local = {r.id: r.morans_i for r in spatial.local_morans_i(nodes, edges).collect()}
    var = sum(v * v for v in z.values()) / 3
    assert all(np.isclose(local[k], z[k] * sum(w * z[b] for a, b, w in kept if a == k) / var) for k in z)
    assert spatial.morans_i(nodes, edges.limit(0)).first()[0] is None
