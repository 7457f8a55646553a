"""Values of fine-grained units and of the parcels they belong to.

``vertices`` are ``(hemi, vertex, key)`` with values; ``parcels`` are ``(hemi, key, label)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import require

#: Labels of what is no parcel.
IGNORED_LABELS = ("unknown", "corpuscallosum", "Background+FreeSurfer_Defined_Medial_Wall", "???", "Unknown", "Medial_wall", "Medial wall", "medial_wall")
_AGGREGATES = {"mean": lambda x: F.avg(x), "median": lambda x: F.percentile(x, F.lit(0.5)), "mode": lambda x: F.mode(x, True)}


def extract_labels(parcels: DataFrame, ignore: tuple[str, ...] = IGNORED_LABELS) -> DataFrame:
    """The parcels whose label is not to be ignored."""
    return parcels.filter(~F.coalesce(F.col("label").isin(*ignore), F.lit(False))) if ignore else parcels


def extract_surface_labels(vertices: DataFrame, parcels: DataFrame, ignore: tuple[str, ...] = IGNORED_LABELS) -> DataFrame:
    """Of these, the ones that some vertex has."""
    return extract_labels(parcels, ignore).join(require(vertices, "hemi", "key").distinct(), ["hemi", "key"], "left_semi")


def vertices_to_parcels(vertices: DataFrame, parcels: DataFrame, values: tuple[str, ...] = ("x",), hemi: str = "both", background: float | None = None, ignore: tuple[str, ...] = IGNORED_LABELS, agg_method: str = "mean") -> DataFrame:
    """``(hemi, key, label, *values)``: the mean, median or mode of each parcel's vertices.

    NaN, NULL and ``background`` values do not count; the mode is the least of equally frequent values.  A parcel
    without values, or without vertices, has NULL.  ``hemi`` is ``both``, ``L`` or ``R``.
    """
    if agg_method not in _AGGREGATES:
        raise ValueError(f"agg_method is one of {sorted(_AGGREGATES)}, not {agg_method!r}")
    if hemi not in ("both", "L", "R"):
        raise ValueError(f"hemi is 'both', 'L' or 'R', not {hemi!r}")
    kept = extract_labels(require(parcels, "hemi", "key", "label"), ignore)
    v = require(vertices, "hemi", "key", *values)
    if hemi != "both":
        kept, v = kept.filter(F.col("hemi") == hemi), v.filter(F.col("hemi") == hemi)

    def counted(c: str):
        x = F.col(c).cast("double")
        drop = F.isnan(x) | (x == background) if background is not None else F.isnan(x)
        return F.when(~drop, x)

    sums = v.groupBy("hemi", "key").agg(*[_AGGREGATES[agg_method](counted(c)).alias(c) for c in values])
    return kept.join(sums, ["hemi", "key"], "left").select("hemi", "key", "label", *values)


def parcels_to_vertices(values: DataFrame, vertices: DataFrame, parcels: DataFrame, columns: tuple[str, ...] = ("x",), fill: float | None = float("nan"), ignore: tuple[str, ...] = IGNORED_LABELS) -> DataFrame:
    """``(hemi, vertex, key, *columns)``: each vertex with its parcel's value ``(hemi, key, *columns)``, or ``fill``.

    Raises unless there is one value for each parcel that is not ignored.
    """
    kept = extract_labels(require(parcels, "hemi", "key", "label"), ignore).select("hemi", "key")
    given = require(values, "hemi", "key", *columns)
    if given.groupBy("hemi", "key").count().join(kept.withColumn("known", F.lit(1)), ["hemi", "key"], "full").filter("`count` IS NULL OR `count` <> 1 OR known IS NULL").take(1):
        raise ValueError("values and parcels differ")
    marked = given.withColumn("found", F.lit(True))
    rows = require(vertices, "hemi", "vertex", "key").join(marked, ["hemi", "key"], "left")
    filled = [F.when(F.col("found"), F.col(c).cast("double")).otherwise(F.lit(fill).cast("double")).alias(c) for c in columns]
    return rows.select("hemi", "vertex", "key", *filled)


def extract_volume(values: DataFrame, voxels: DataFrame) -> DataFrame:
    """``(i, j, k, x)`` of the volume's ``(i, j, k, row)``; 0 for a voxel without a value ``(row, x)``."""
    return require(voxels, "i", "j", "k", "row").join(require(values, "row", "x"), "row", "left").select("i", "j", "k", F.coalesce("x", F.lit(0.0)).alias("x"))


def extract_surface(values: DataFrame, places: DataFrame, structure: str) -> DataFrame:
    """``(vertex, x)`` for each vertex up to the last one of a structure of ``(structure, row, vertex)``, 0 without a value.

    Raises for a structure that has no place.
    """
    own = require(places, "structure", "row", "vertex").filter(F.col("structure") == structure)
    if not own.take(1):
        raise ValueError(f"no structure {structure}")
    every = own.agg(F.max("vertex").alias("top")).select(F.explode(F.expr("sequence(0, int(top))")).alias("vertex"))
    found = own.join(require(values, "row", "x"), "row").groupBy("vertex").agg(F.max("x").alias("x"))
    return every.join(found, "vertex", "left").select("vertex", F.coalesce("x", F.lit(0.0)).alias("x"))


def deconstruct(values: DataFrame, places: DataFrame, voxels: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The volume and both surfaces of values by row."""
    return extract_volume(values, voxels), extract_surface(values, places, left), extract_surface(values, places, right)


def describe(values: DataFrame, places: DataFrame, voxels: DataFrame) -> DataFrame:
    """``(structure, n_rows, n_values)``: what a file of rows holds; the volume is ``VOLUME``."""
    rows = require(places, "structure", "row").unionByName(require(voxels, "row").select(F.lit("VOLUME").alias("structure"), "row"))
    return rows.join(require(values, "row", "x"), "row", "left").groupBy("structure").agg(F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n_values"))
