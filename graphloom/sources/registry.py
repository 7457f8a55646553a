"""A registry of data sets as a table: where each version is to be had, and how it is checked.

The registry is a JSON file of nested names; a leaf has ``url-type``, ``url``, ``md5``, ``uncompress`` and ``rel-path``.
Nothing is fetched: what is missing from the data folder is listed with its address, and what has been fetched can be
checked, unpacked and expanded to the files of each surface and hemisphere.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import require

SCHEMA = "dataset string, version string, url_type string, url array<string>, md5 string, uncompress boolean, rel_path string"
#: Addresses by type; {} are the parts of a leaf's ``url`` in turn.
ADDRESSES = {
    "osf": ("https://files.osf.io/v1/resources/", "/providers/osfstorage/", ""),
    "github-release": ("https://github.com/", "/", "/archive/refs/tags/", ".tar.gz"),
    "github-archive": ("https://github.com/", "/", "/archive/", ".tar.gz"),
    "zenodo-file": ("https://zenodo.org/record/", "/files/", "?download=1"),
}


def leaves(tree: dict, path: tuple[str, ...] = ()) -> Iterator[tuple]:
    if "url-type" in tree:
        yield path[0], "/".join(path[1:]), tree["url-type"], [str(u) for u in tree["url"]], tree.get("md5"), bool(tree.get("uncompress", False)), tree.get("rel-path")
        return
    for name, below in tree.items():
        if isinstance(below, dict):
            yield from leaves(below, (*path, name))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of a registry file, one row each."""
    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(list(leaves(json.loads(text["value"]))) if text else [], SCHEMA)


def address(url_type: Column, url: Column) -> Column:
    """The address of a leaf; NULL for a type that is not known."""
    out = None
    for kind, parts in ADDRESSES.items():
        pieces = [F.lit(parts[0])]
        for i, part in enumerate(parts[1:]):
            pieces += [F.get(url, F.lit(i)), F.lit(part)]
        out = F.when(url_type == kind, F.concat(*pieces)) if out is None else out.when(url_type == kind, F.concat(*pieces))
    return out


def dataset_info(registry: DataFrame, name: str) -> DataFrame:
    """The versions of a data set with their addresses; an error that lists the names if there is no such set."""
    found = registry.filter(F.col("dataset") == name)
    if not found.take(1):
        raise KeyError(f"{name} is none of {sorted(r.dataset for r in registry.select('dataset').distinct().collect())}")
    return found.withColumn("address", address(F.col("url_type"), F.col("url")))


def data_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder given, or that of the session's ``graphloom.data.dir``, or one in the home folder."""
    return folder or spark.conf.get("graphloom.data.dir", None) or str(Path.home() / "graphloom-data")


def resolve(spark: SparkSession, registry: DataFrame, name: str, version: str | None = None, folder: str | None = None) -> DataFrame:
    """``(dataset, version, path, address, present)``: where versions are, and whether the files are there already."""
    rows = dataset_info(registry, name)
    if version is not None:
        rows = rows.filter(F.col("version") == version)
        if not rows.take(1):
            raise KeyError(f"{name} has no version {version}")
    base = data_dir(spark, folder)
    listed = [(r.dataset, r.version, f"{base}/{r.rel_path}", r.address, Path(base, r.rel_path or "").exists()) for r in rows.collect()]
    return spark.createDataFrame(listed, "dataset string, version string, path string, address string, present boolean")


def session_connectivity(series: DataFrame) -> DataFrame:
    """``(session, src, dst, w)``, src > dst: each session's correlations of ``(session, id, t, v)``."""
    s = require(series, "session", "id", "t", "v")
    return s.withColumnRenamed("id", "src").join(s.selectExpr("session", "t", "id AS dst", "v AS y"), ["session", "t"]).filter("src > dst").groupBy("session", "src", "dst").agg(F.corr("v", "y").alias("w"))


def subscale_sums(answers: DataFrame, subscales: dict[str, list[str]], sessions: DataFrame) -> DataFrame:
    """``(session, *subscales)``: sums of item columns for the sessions listed."""
    kept = answers.join(require(sessions, "session").distinct(), "session", "left_semi")
    return kept.select("session", *[sum((F.col(c).cast("double") for c in items[1:]), F.col(items[0]).cast("double")).alias(name) for name, items in subscales.items()])


_CURATED = {"white": "white.surf", "midthickness": "midthickness.surf", "pial": "pial.surf", "inflated": "inflated.surf", "veryinflated": "veryinflated.surf", "sphere": "sphere.surf", "medial": "desc-nomedialwall_dparc.label", "sulc": "desc-sulc_midthickness.shape", "vaavg": "desc-vaavg_midthickness.shape"}
_MIDDLE = ("midthickness", "inflated", "veryinflated", "sphere", "medial", "sulc", "vaavg")
#: By family of templates: file names below a version's folder, kinds of surfaces, and versions with their densities.  In the
#: names {hemi} is L or R, {side} lh or rh, {file} the file name of a kind.
LAYOUTS: dict[str, tuple[str, tuple[str, ...], dict[str, str]]] = {
    "fsaverage": ("surf/{side}.{kind}", ("orig", "white", "smoothwm", "pial", "inflated", "sphere"), {f"fsaverage{k}": "" for k in ("", 3, 4, 5, 6)}),
    "fsaverage_curated": ("tpl-fsaverage_den-{density}_hemi-{hemi}_{file}.gii", ("white", "pial", "inflated", "sphere", "medial", "sulc", "vaavg"), {"fsaverage": "164k", "fsaverage6": "41k", "fsaverage5": "10k", "fsaverage4": "3k"}),
    "fslr_curated": ("tpl-fsLR_den-{density}_hemi-{hemi}_{file}.gii", _MIDDLE, {"fslr4k": "4k", "fslr8k": "8k", "fslr32k": "32k", "fslr164k": "164k"}),
    "civet": ("tpl-civet_space-ICBM152_hemi-{hemi}_den-{density}_{kind}.obj", ("mid", "white"), {"civet41k": "41k", "civet164k": "164k"}),
    "civet_curated": ("tpl-civet_den-{density}_hemi-{hemi}_{file}.gii", ("white", *_MIDDLE), {"civet41k": "41k", "civet164k": "164k"}),
    "conte69": ("tpl-conte69_space-MNI305_variant-fsLR32k_{kind}.{hemi}.surf.gii", ("midthickness", "inflated", "vinflated"), {"": "32k"}),
    "yerkes19": ("tpl-yerkes19_space-fsLR32k_{kind}.{hemi}.surf.gii", ("midthickness", "inflated", "vinflated"), {"": "32k"}),
    "mmpall": ("atl-MMPAll_space-{version}_hemi-{hemi}_deterministic.label.gii", ("label",), {"fslr32k": "32k"}),
    "cammoun_gcs": ("atl-Cammoun2012_res-{kind}_hemi-{hemi}_probabilistic.gcs", ("033", "060", "125", "250", "500"), {"gcs": ""}),
    "aparc": ("label/{side}.aparc.annot", ("aparc",), {f"fsaverage{k}": "" for k in ("", 5, 6)}),
}


def surface_files(spark: SparkSession, family: str, version: str | None = None, folder: str = "", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``(family, version, density, kind, hemi, path, present)``: a version's files for each kind of surface and hemisphere.

    ``folder`` is the version's; without a version all of the family are listed, each in a folder of its name.
    """
    if family not in LAYOUTS:
        raise KeyError(f"{family} is none of {sorted(LAYOUTS)}")
    pattern, known, versions = LAYOUTS[family]
    if version is not None and version not in versions:
        raise ValueError(f"{version} is none of {sorted(versions)}")
    rows = []
    for v in [version] if version is not None else versions:
        density = versions[v]
        for kind in kinds or known:
            if kind not in known:
                raise ValueError(f"{kind} is none of {known}")
            if kind == "veryinflated" and v in ("fslr4k", "fslr8k"):  # have none
                continue
            for hemi in "LR":
                name = pattern.format(hemi=hemi, side=f"{hemi.lower()}h", kind=kind, file=_CURATED.get(kind, kind), density=density, version=v)
                path = "/".join(x for x in (folder, v if version is None else "", name) if x)
                rows.append((family, v, density, kind, hemi, path, Path(path).exists()))
    return spark.createDataFrame(rows, "family string, version string, density string, kind string, hemi string, path string, present boolean")


def verified(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The rows of ``(path, md5)`` with ``intact``: whether the file has the sum; NULL without a sum, false without a file.

    Files are read where they lie, one task for each.
    """
    paths = [r.path for r in listed.select("path").distinct().collect() if Path(r.path).is_file()]
    sums = spark.createDataFrame([], "path string, found string")
    if paths:
        sums = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.md5("content").alias("found"))
    return listed.join(sums, "path", "left").withColumn("intact", F.when(F.col("md5").isNotNull(), F.coalesce(F.col("found") == F.col("md5"), F.lit(False)))).drop("found")


def install(archive: str, target: str, url_type: str = "osf", rename: str | None = None, force: bool = False, md5: str | None = None) -> str:
    """Unpack an archive that has been fetched to the folder ``target``; what is there stays unless ``force`` is given.

    ``rename`` is the archive's folder that becomes the target.  A file with another ``md5`` is refused.
    """
    goal = Path(target)
    if goal.exists():
        if not force:
            return str(goal)
        shutil.rmtree(goal)
    if md5 is not None:
        with open(archive, "rb") as f:
            if hashlib.file_digest(f, "md5").hexdigest() != md5:
                raise ValueError(f"{archive} has another md5 than {md5}")
    shutil.unpack_archive(archive, goal.parent, format="zip" if url_type == "zenodo-file" else "gztar")
    if rename is not None:
        shutil.move(goal.parent / rename, goal)
    return str(goal)


def references(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """``(dataset, category, bibkey, citation)`` of a file of citations: by data set and category, a list of entries."""
    text = spark.read.text(path, wholetext=True).first()
    tree = json.loads(text["value"]) if text else {}
    if name is not None and name not in tree:
        raise KeyError(f"{name} is none of {sorted(tree)}")
    rows = [(d, c, x.get("bibkey"), x.get("citation")) for d, by in tree.items() if name in (None, d) for c, items in by.items() for x in items]
    return spark.createDataFrame(rows, "dataset string, category string, bibkey string, citation string")


def subject_dir(subject: str, folder: str | None = None) -> str:
    """The folder of a subject's surfaces below ``folder``, or ``$SUBJECTS_DIR``, or where the driver runs."""
    base = Path(folder) if folder is not None and Path(folder).is_dir() else Path(os.environ.get("SUBJECTS_DIR", Path.cwd()))
    if not (base / subject).is_dir():
        raise FileNotFoundError(f"no subject {subject} in {base}")
    return str((base / subject).resolve())
