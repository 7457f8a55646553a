"""The data model: which columns an edge, node, partition or series table has, and arithmetic that never raises.

* edges ``(src, dst, w)``: row i of a matrix is ``src``, column ``dst``; a missing row is 0.  Undirected networks have
  both directions.  Edges count as present if ``w > 0`` or ``w <> 0``, as each operator says.
* nodes ``(id, x)``: one value for each node; ``(map_id, id, x)`` for several maps.
* assignments ``(part, id, label)``: several partitions of the same nodes.
* series ``(subject, id, t, v)``.

The nodes of a network are the ids of its node table; operators that take only edges use the ids found in them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, in this order; an error that lists what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df.select(*columns)


def edges_of(df: DataFrame, value: str = "w") -> DataFrame:
    """``(src, dst, w)`` with long ids and double weights."""
    require(df, "src", "dst", value)
    return df.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col(value).cast("double").alias("w"))


def nodes_of(df: DataFrame, value: str = "x") -> DataFrame:
    require(df, "id", value)
    return df.select(F.col("id").cast("long").alias("id"), F.col(value).cast("double").alias("x"))


def ids_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def safe_div(num: Column, den: Column) -> Column:
    """A quotient by the rules of floating point: x/0 is infinite with the sign of x, 0/0 is NaN."""
    num, den = num.cast("double"), den.cast("double")
    return (
        F.when(den != 0, num / F.when(den != 0, den))
        .when(num.isNull() | den.isNull(), F.lit(None).cast("double"))
        .when(num > 0, F.lit(INF)).when(num < 0, F.lit(-INF)).otherwise(F.lit(NAN))
    )


def null_div(num: Column, den: Column) -> Column:
    """A quotient that is NULL where the divisor is 0."""
    den = den.cast("double")
    return num.cast("double") / F.when(den != 0, den)


def ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst, w, xs, xd)``: edges with the values of both ends.

    Node tables are small beside edge tables and Spark broadcasts them where their size allows; otherwise both joins
    shuffle by id: first by ``dst``, where edges that come by ``dst`` stay, then by ``src``, so that a sum by ``src``
    needs no further shuffle.
    """
    s, d = nodes.select(F.col("id").alias("src"), F.col("x").alias("xs")), nodes.select(F.col("id").alias("dst"), F.col("x").alias("xd"))
    return edges.join(d, "dst").join(s, "src").select("src", "dst", "w", "xs", "xd")


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Each row with the columns of a table of one row, such as an aggregate over everything."""
    return df.crossJoin(F.broadcast(one_row))


def is_nan(x: float | None) -> bool:
    return x is None or math.isnan(x)
