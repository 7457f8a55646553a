"""What a picture of a network or surface needs: orders, borders, limits and gathered values.  Drawing is left to others."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.iterate import in_order
from graphloom.model import edges_of, require
from graphloom.ranks import percentiles


def grid_communities(labels: DataFrame) -> DataFrame:
    """``(bound)``: where each community begins when ids are sorted by label, and the number of ids."""
    counts = require(labels, "id", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ends = in_order(counts, "label", sum_of="n", name="upto").select((F.col("upto") - F.col("n")).alias("bound"))
    return ends.unionByName(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bound")))


def sort_communities(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, label, place)``: ids by label, then by falling mean weight to their own community; the higher id comes first among equals."""
    c = require(labels, "id", "label")
    e = edges_of(edges).join(c.selectExpr("id AS src", "label AS a"), "src").join(c.selectExpr("id AS dst", "label AS b"), "dst").filter("a = b")
    tie = e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("s"))
    rows = c.join(tie, "id", "left").select("id", "label", F.coalesce("s", F.lit(0.0)).alias("s"))
    return in_order(rows, "label", F.desc("s"), F.desc("id")).select("id", "label", "place")


def mod_heatmap(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(row, col, w)``: the network in that order."""
    place = sort_communities(edges, labels).select("id", "place")
    e = edges_of(edges)
    return e.join(place.selectExpr("id AS src", "place AS row"), "src").join(place.selectExpr("id AS dst", "place AS col"), "dst").select("row", "col", "w")


def colour_limits(values: DataFrame, value: str = "x", low: float = 2.5, high: float = 97.5) -> DataFrame:
    """``(low, high)``: percentiles without NaN and NULL; found at once, by tasks that only count."""
    found = percentiles(values, F.col(value), (low / 100, high / 100))
    return values.sparkSession.range(0, 1, 1, 1).select(*[F.lit(x).cast("double").alias(name) for name, x in zip(("low", "high"), found)])


def mask_medial_wall(vertices: DataFrame, wall: DataFrame, value: str = "x") -> DataFrame:
    """The vertices with NULL for those of ``wall`` ``(hemi, vertex)``."""
    marked = vertices.join(require(wall, "hemi", "vertex").distinct().withColumn("_wall", F.lit(True)), ["hemi", "vertex"], "left")
    return marked.withColumn(value, F.when(F.col("_wall").isNull(), F.col(value))).drop("_wall").select(*vertices.columns)


def annotated_vertices(values: DataFrame, vertices: DataFrame, parcels: DataFrame, order: str = "lr", drop: tuple[str, ...] = ("unknown", "corpuscallosum", "Background+FreeSurfer_Defined_Medial_Wall"), mask: str | None = None) -> DataFrame:
    """``(hemi, vertex, x)``: each vertex with its parcel's value; NULL for dropped parcels and those that ``mask`` marks.

    ``values`` ``(place, x)`` are those of all parcels that are not dropped, by key, one hemisphere after the other:
    left first if ``order`` is ``lr``.  ``mask`` names a column of ``values``, above 0 for what is not shown.
    """
    if order not in ("lr", "rl"):
        raise ValueError(f"order is 'lr' or 'rl', not {order!r}")
    kept = require(parcels, "hemi", "key", "label").filter(~F.col("label").isin(*drop)).select("hemi", "key")
    side = F.col("hemi") if order == "lr" else F.when(F.col("hemi") == "R", "A").otherwise("B")
    placed = in_order(kept.withColumn("side", side), "side", "key").drop("side")
    given = values.select(F.col("place").cast("long").alias("place"), F.lit(True).alias("there"), (F.when(F.coalesce(F.col(mask), F.lit(0)) <= 0, F.col("x")) if mask else F.col("x")).cast("double").alias("x"))
    if given.join(placed, "place", "full").groupBy("place").agg(F.count("there").alias("a"), F.count("hemi").alias("b")).filter("a <> 1 OR b <> 1").take(1):
        raise ValueError("there is not one value for each parcel")
    return require(vertices, "hemi", "vertex", "key").join(placed.join(given, "place"), ["hemi", "key"], "left").select("hemi", "vertex", "x")


def parcellation_key(name: str) -> tuple[str, str]:
    """(atlas, key) of a short name: ``schaefer400x7``, ``schaefer400``, ``cammoun033`` or ``mmpall``; others are paths."""
    lower = name.lower()
    if lower == "mmpall":
        return "mmpall", ""
    for atlas, pattern, key in (("schaefer", r"schaefer(\d+)(?:x(\d+))?", "{0}Parcels{1}Networks"), ("cammoun", r"cammoun(\d+)", "scale{0}")):
        if lower.startswith(atlas):
            found = re.fullmatch(pattern, lower)
            if not found:
                raise ValueError(f"{name!r} is no name of a {atlas} parcellation")
            return atlas, key.format(*[g or "7" for g in found.groups()])
    return "path", name


def parcellation_keys(names: DataFrame, column: str = "name") -> DataFrame:
    """The same for a column: ``(name, atlas, key)``; NULL key for what cannot be read."""
    n = F.lower(F.col(column))
    size, networks = F.regexp_extract(n, r"^schaefer(\d+)(?:x(\d+))?$", 1), F.regexp_extract(n, r"^schaefer(\d+)x(\d+)$", 2)
    scale = F.regexp_extract(n, r"^cammoun(\d+)$", 1)
    atlas = F.when(n == "mmpall", "mmpall").when(n.startswith("schaefer"), "schaefer").when(n.startswith("cammoun"), "cammoun").otherwise("path")
    key = (
        F.when(atlas == "mmpall", "").when(atlas == "path", F.col(column))
        .when((atlas == "schaefer") & (size != ""), F.concat(size, F.lit("Parcels"), F.when(networks == "", "7").otherwise(networks), F.lit("Networks")))
        .when((atlas == "cammoun") & (scale != ""), F.concat(F.lit("scale"), scale))
    )
    return names.select(F.col(column).alias("name"), atlas.alias("atlas"), key.alias("key"))
