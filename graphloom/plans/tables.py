"""Networks, node values, partitions and series made of the star schema's tables, in Spark and as SQL views."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.iterate import cut

#: Added to a supplier's key, so that it is no customer's.
SUPPLIERS = 1_000_000_000


def once(method: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """The table is derived, and cut, at its first use by a query; further uses read the same."""

    @wraps(method)
    def get(self: Tables) -> DataFrame:
        if method.__name__ not in self.made:
            self.made[method.__name__] = method(self)
        return self.made[method.__name__]

    return get


class Tables:
    """The derived tables of one folder; what several steps of a query read is cut from its lineage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def ids(self) -> DataFrame:
        return self("nation").select(F.col("n_nationkey").cast("long").alias("id"))

    def trade(self) -> DataFrame:
        """Quantity from the customer's to the supplier's nation.  Node tables and supplier are small beside lineitem."""
        lines = self("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        orders = self("orders").select("o_orderkey", "o_custkey").join(self("customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
        rows = lines.join(orders, F.expr("l_orderkey = o_orderkey")).join(self("supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
        return rows.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("l_quantity").alias("w"))

    @once
    def arcs(self) -> DataFrame:
        """The strongest 30 % of trade, without self-loops; directed."""
        t = cut(self.trade())
        return cut(t.crossJoin(F.broadcast(t.agg(F.percentile("w", F.lit(0.7)).alias("bar")))).filter("w > bar AND src <> dst").select("src", "dst", "w"))

    @once
    def both(self) -> DataFrame:
        """Trade of both directions, without self-loops."""
        t = self.trade().filter("src <> dst")
        return cut(t.unionByName(t.selectExpr("dst AS src", "src AS dst", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))

    @once
    def back(self) -> DataFrame:
        """The pairs above the 80th percentile of all pairs."""
        from graphloom.operators.construction import binarize_network

        b = self.both()
        return cut(b.join(binarize_network(b, self.ids(), 20).select("src", "dst"), ["src", "dst"]))

    def lengths(self) -> DataFrame:
        return self.back().select("src", "dst", (1000.0 / F.col("w")).alias("w"))

    @once
    def annotations(self) -> DataFrame:
        """``(id, x, y)``: mean balance of a nation's customers and suppliers, 0 without any."""

        def mean(table: str, key: str, value: str, name: str) -> DataFrame:
            return self(table).groupBy(F.col(key).cast("long").alias("id")).agg((F.sum(F.col(value).cast("decimal(15,2)")).cast("double") / F.count(F.lit(1))).alias(name))

        x, y = mean("customer", "c_nationkey", "c_acctbal", "x"), mean("supplier", "s_nationkey", "s_acctbal", "y")
        return cut(self.ids().join(x, "id", "left").join(y, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")))

    @once
    def distances(self) -> DataFrame:
        """``(src, dst, w)``: how far apart the customers' balances of two nations are."""
        x = self.annotations()
        return cut(x.selectExpr("id AS src", "x AS a").crossJoin(x.selectExpr("id AS dst", "x AS b")).filter("src <> dst").selectExpr("src", "dst", "abs(a - b) AS w"))

    def regions(self) -> DataFrame:
        return self("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("label"))

    def partitions(self) -> DataFrame:
        """Four partitions of the nations; the last is the first with other labels."""
        n = self("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("r"))
        return n.select("id", F.posexplode(F.array(F.col("r"), F.col("id") % 3, F.expr("id div 4"), 40 - 10 * F.col("r")))).select(F.col("pos").cast("long").alias("part"), "id", F.col("col").alias("label"))

    def customers(self) -> DataFrame:
        """Three partitions of the customers."""
        c = self("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("n"))
        return c.select("id", F.posexplode(F.array(F.col("n"), F.col("n") % 5, F.col("id") % 7))).select(F.col("pos").cast("long").alias("part"), "id", F.col("col").alias("label"))

    @once
    def stack(self) -> DataFrame:
        """``(subject, src, dst, w)``: both directions' trade by order priority, what is above 60 % of the mean only."""
        orders = self("orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("subject")).join(self("customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
        rows = self("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(orders, F.expr("l_orderkey = o_orderkey")).join(self("supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
        one = rows.filter("c_nationkey <> s_nationkey").groupBy("subject", F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("l_quantity").alias("w"))
        sums = cut(one.unionByName(one.selectExpr("subject", "dst AS src", "src AS dst", "w")).groupBy("subject", "src", "dst").agg(F.sum("w").alias("w")))
        return sums.crossJoin(F.broadcast(sums.agg((0.6 * F.avg("w")).alias("bar")))).filter("w > bar").select("subject", "src", "dst", "w")

    def series(self) -> DataFrame:
        """``(subject, id, t, v)``: value of events by week, kind and hour."""
        kind = F.expr("CASE event_type WHEN 'click' THEN 0L WHEN 'error' THEN 1L WHEN 'purchase' THEN 2L WHEN 'signup' THEN 3L ELSE 4L END")
        hour = F.expr("datediff(ts, date'2024-01-01') * 24L + hour(ts)")
        e = self("events").select(kind.alias("id"), hour.alias("t"), "value").select(F.expr("t div 168").alias("subject"), "id", "t", "value")
        return e.groupBy("subject", "id", "t").agg(F.sum("value").alias("v"))

    def agents(self) -> DataFrame:
        """``(id, t, normal, misfolded)``: events, and errors among them, by user group and day."""
        day = F.expr("datediff(ts, date'2024-01-01')")
        e = self("events").select((F.col("user_id") % 25).alias("id"), day.alias("t"), F.expr("int(event_type = 'error')").alias("bad"))
        return e.groupBy("id", "t").agg(F.sum(1 - F.col("bad")).cast("double").alias("normal"), F.sum("bad").cast("double").alias("misfolded"))

    @once
    def market(self) -> DataFrame:
        """Quantity between customers and suppliers, both ways; nodes and edges grow with the tables."""
        orders = self("orders").select("o_orderkey", "o_custkey")
        lines = self("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(orders, F.expr("l_orderkey = o_orderkey"))
        one = lines.groupBy(F.col("o_custkey").cast("long").alias("src"), (F.col("l_suppkey") + SUPPLIERS).cast("long").alias("dst")).agg(F.sum("l_quantity").alias("w"))
        return cut(one.unionByName(one.selectExpr("dst AS src", "src AS dst", "w")))

    def dealt(self) -> DataFrame:
        """The market for a query that reads it in one plan: not cut, and its rows lie by ``dst``, so a first join by it moves none."""
        orders = self("orders").select("o_orderkey", "o_custkey")
        lines = self("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(orders, F.expr("l_orderkey = o_orderkey"))
        c, s = F.col("o_custkey").cast("long"), (F.col("l_suppkey") + SUPPLIERS).cast("long")
        ways = lines.select(F.stack(F.lit(2), c, s, s, c).alias("src", "dst"), "l_quantity")
        return ways.repartition("dst").groupBy("src", "dst").agg(F.sum("l_quantity").alias("w"))

    def strong(self) -> DataFrame:
        """Market pairs of a quantity of 50 or more."""
        return self.market().filter("w >= 50")

    def traders(self) -> DataFrame:
        """``(id, x, label)``: balance and nation of customers and suppliers."""
        c = self("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").cast("double").alias("x"), F.col("c_nationkey").cast("long").alias("label"))
        return c.unionByName(self("supplier").select((F.col("s_suppkey") + SUPPLIERS).cast("long").alias("id"), F.col("s_acctbal").cast("double").alias("x"), F.col("s_nationkey").cast("long").alias("label")))

    def vertices(self) -> DataFrame:
        side = F.when(F.col("c_custkey") % 2 == 0, "L").otherwise("R")
        return self("customer").select(side.alias("hemi"), F.col("c_custkey").alias("vertex"), F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("x"), F.floor(F.col("c_acctbal") / 1000).cast("double").alias("y"))

    def parcels(self) -> DataFrame:
        label = F.when(F.col("n_nationkey") == 3, "unknown").otherwise(F.col("n_name"))
        return self("nation").select(F.explode(F.array(F.lit("L"), F.lit("R"))).alias("hemi"), F.col("n_nationkey").alias("key"), label.alias("label"))


VIEWS = {
    "market": "SELECT CAST(c AS BIGINT) AS src, CAST(s AS BIGINT) AS dst, w FROM (SELECT o_custkey AS c, l_suppkey + 1000000000 AS s, SUM(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) UNION ALL SELECT CAST(s AS BIGINT), CAST(c AS BIGINT), w FROM (SELECT o_custkey AS c, l_suppkey + 1000000000 AS s, SUM(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "strong": "SELECT src, dst, w FROM market WHERE w >= 50",
    "traders": "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_nationkey AS BIGINT) AS label FROM customer UNION ALL SELECT CAST(s_suppkey + 1000000000 AS BIGINT), CAST(s_acctbal AS DOUBLE), CAST(s_nationkey AS BIGINT) FROM supplier",
    "ids": "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation",
    "trade": "SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, SUM(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "arcs": "SELECT src, dst, w FROM trade WHERE src <> dst AND w > (SELECT quantile_cont(w, 0.7) FROM trade)",
    "sym": "SELECT src, dst, SUM(w) AS w FROM (SELECT src, dst, w FROM trade UNION ALL SELECT dst, src, w FROM trade) WHERE src <> dst GROUP BY 1, 2",
    "bar": "SELECT quantile_cont(COALESCE(w, 0), 0.8) AS b FROM (SELECT a.id AS src, c.id AS dst FROM ids a JOIN ids c ON a.id < c.id) LEFT JOIN sym USING (src, dst)",
    "back": "SELECT src, dst, w FROM sym, bar WHERE w > b",
    "len": "SELECT src, dst, 1000.0 / w AS w FROM back",
    "ann": """SELECT id, COALESCE(cx, 0) AS x, COALESCE(sy, 0) AS y FROM ids
        LEFT JOIN (SELECT c_nationkey, CAST(SUM(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) / COUNT(*) AS cx FROM customer GROUP BY 1) ON id = c_nationkey
        LEFT JOIN (SELECT s_nationkey, CAST(SUM(CAST(s_acctbal AS DECIMAL(15,2))) AS DOUBLE) / COUNT(*) AS sy FROM supplier GROUP BY 1) ON id = s_nationkey""",
    "dm": "SELECT a.id AS src, b.id AS dst, ABS(a.x - b.x) AS w FROM ann a JOIN ann b ON a.id <> b.id",
    "regs": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS label FROM nation",
    "parts": "SELECT CAST(0 AS BIGINT) AS part, id, label FROM regs UNION ALL SELECT 1, id, id % 3 FROM regs UNION ALL SELECT 2, id, id // 4 FROM regs UNION ALL SELECT 3, id, 40 - 10 * label FROM regs",
    "cust": "SELECT CAST(0 AS BIGINT) AS part, c_custkey AS id, CAST(c_nationkey AS BIGINT) AS label FROM customer UNION ALL SELECT 1, c_custkey, c_nationkey % 5 FROM customer UNION ALL SELECT 2, c_custkey, c_custkey % 7 FROM customer",
    "rawstack": """SELECT subject, src, dst, SUM(w) AS w FROM (
        SELECT subject, s AS src, d AS dst, w FROM (SELECT CAST(o_orderpriority[1:1] AS BIGINT) AS subject, CAST(c_nationkey AS BIGINT) AS s, CAST(s_nationkey AS BIGINT) AS d, l_quantity AS w
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)
        UNION ALL
        SELECT subject, d, s, w FROM (SELECT CAST(o_orderpriority[1:1] AS BIGINT) AS subject, CAST(c_nationkey AS BIGINT) AS s, CAST(s_nationkey AS BIGINT) AS d, l_quantity AS w
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)) GROUP BY 1, 2, 3""",
    "stack": "SELECT subject, src, dst, w FROM rawstack WHERE w > (SELECT 0.6 * AVG(w) FROM rawstack)",
    "series": """SELECT t // 168 AS subject, id, t, SUM(value) AS v FROM (
        SELECT CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS id, epoch_us(ts) // 3600000000 - 473352 AS t, value FROM events) GROUP BY 1, 2, 3""",
    "agents": "SELECT user_id % 25 AS id, CAST(epoch_us(ts) // 86400000000 - 19723 AS INTEGER) AS t, CAST(SUM(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS DOUBLE) AS normal, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) AS misfolded FROM events GROUP BY 1, 2",
    "vert": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'R' END AS hemi, c_custkey AS vertex, c_nationkey AS key, c_acctbal AS x, FLOOR(c_acctbal / 1000) AS y FROM customer",
    "parc": "SELECT hemi, n_nationkey AS key, CASE WHEN n_nationkey = 3 THEN 'unknown' ELSE n_name END AS label FROM nation, (VALUES ('L'), ('R')) v(hemi)",
}


def with_views(query: str, *more: tuple[str, str], recursive: bool = False) -> str:
    """The query after the views that it and they use; ``more`` are views of its own, in order."""
    import re

    need: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(VIEWS[name])

    visit(query + " ".join(t for _, t in more))
    views = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in VIEWS if n in need] + [f"{n} AS {'' if '(' in n else 'MATERIALIZED '}({t})" for n, t in more]
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(views) + "\n" if views else "") + query
