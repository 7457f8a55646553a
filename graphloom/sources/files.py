"""Readers of files: matrices as text or NumPy arrays, and label files of surfaces.

Binary formats come through Spark's ``binaryFile`` source, one task for each file.
"""

from __future__ import annotations

import base64
import io
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.parcels import IGNORED_LABELS, extract_labels, extract_surface_labels
from graphloom.sources import cifti


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(path, src, dst, w)`` of text matrices, a line for each row; what is no number is NULL."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\s+$", ""), "\n")).alias("src", "line"))
    cells = lines.select("path", F.col("src").cast("long").alias("src"), F.posexplode(F.split(F.trim("line"), sep if sep.strip() else r"\s+")).alias("dst", "cell"))
    return cells.select("path", "src", F.col("dst").cast("long").alias("dst"), F.trim("cell").try_cast("double").alias("w"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(path, src, dst, w)`` of arrays of one or two dimensions."""

    def parse(parts):
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                a = np.atleast_2d(np.load(io.BytesIO(bytes(content)), allow_pickle=False)).astype(float)
                i, j = np.indices(a.shape)
                yield pd.DataFrame({"path": name, "src": i.ravel(), "dst": j.ravel(), "w": a.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, src long, dst long, w double")


def parse_annot(content: bytes) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Key of each vertex and (key, label) of a surface annotation with a colour table; -1 for a vertex without one."""
    at = 0

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack(">i", content[at - 4 : at])[0]

    def text() -> str:
        nonlocal at
        n = number()
        at += n
        return content[at - n : at].rstrip(b"\0").decode()

    n = number()
    pairs = np.frombuffer(content, ">i4", 2 * n, at).reshape(n, 2)
    at += 8 * n
    if not number():
        raise ValueError("there is no colour table")
    size = number()
    table = []
    if size > 0:  # the first version: names in order
        text()
        for key in range(size):
            table.append((key, text(), number() | number() << 8 | number() << 16))
            number()
    else:
        number()
        text()
        for _ in range(number()):
            key = number()
            table.append((key, text(), number() | number() << 8 | number() << 16))
            number()
    of_colour = {colour: key for key, _, colour in table}
    keys = np.full(n, -1, np.int64)
    keys[pairs[:, 0]] = [of_colour.get(int(c), -1) for c in pairs[:, 1]]
    return keys, [(key, label) for key, label, _ in table]


def parse_gifti_labels(content: bytes) -> list[tuple[int, str]]:
    """(key, label) of the label table of a GIFTI file."""
    found = ET.fromstring(content).find("LabelTable")
    if found is None:
        raise ValueError("there is no label table")
    return [(int(x.get("Key", x.get("Index", -1))), (x.text or "").strip()) for x in found.findall("Label")]


def parse_gifti_values(content: bytes) -> list[np.ndarray]:
    """The data arrays of a GIFTI file."""
    kinds = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8"}
    out = []
    for x in ET.fromstring(content).iter("DataArray"):
        shape = [int(x.get(f"Dim{k}", 1)) for k in range(int(x.get("Dimensionality", 1)))]
        text, encoding = (x.findtext("Data") or "").strip(), x.get("Encoding", "ASCII")
        if encoding == "ASCII":
            values = np.array(text.split(), float)
        else:
            raw = base64.b64decode(text)
            raw = zlib.decompress(raw) if encoding == "GZipBase64Binary" else raw
            values = np.frombuffer(raw, np.dtype(kinds[x.get("DataType", "")]).newbyteorder(">" if x.get("Endian") == "BigEndian" else "<"))
        out.append(values.reshape(shape, order="F" if x.get("ArrayIndexingOrder") == "ColumnMajorOrder" else "C"))
    return out


def check_parc_files(files: str | list[str] | tuple[str, ...], hemi: str) -> None:
    """Raises unless the files are ``.annot``, ``.gii`` or ``.dlabel.nii``, two of them for both hemispheres unless one file has both."""
    if hemi not in ("both", "L", "R"):
        raise ValueError(f"hemi is 'both', 'L' or 'R', not {hemi!r}")
    several = [str(f) for f in files] if isinstance(files, (list, tuple)) else [str(files)]
    if hemi == "both" and len(several) != 2 and not several[0].endswith("dlabel.nii"):
        raise ValueError("both hemispheres take two files, or one .dlabel.nii")
    for f in several:
        if not f.endswith(("gii", "dlabel.nii", "annot")):
            raise ValueError(f"{f} is no .annot, .gii or .dlabel.nii file")


def load_parcellation(spark: SparkSession, path: str, hemi: str, structure: str | None = None, ignore: tuple[str, ...] = IGNORED_LABELS) -> tuple[DataFrame, DataFrame]:
    """``(hemi, vertex, key)`` and ``(hemi, key, label)`` of one hemisphere's parcellation.

    Of a ``.dlabel.nii`` file the ``structure`` is read, by the labels of its first map, and those that some vertex has
    are listed; vertices without a row have key 0.  ``ignore`` are labels of what is no parcel.
    """
    check_parc_files(path, hemi if hemi != "both" else "L")
    if path.endswith("dlabel.nii"):
        if structure is None:
            raise ValueError("a .dlabel.nii file takes the name of a structure")
        values = cifti.read_values(spark, path).filter("map = 0").select("row", "x")
        places = cifti.read_places(spark, path).filter(F.col("structure") == structure)
        if not places.take(1):
            raise ValueError(f"no structure {structure}")
        every = places.agg(F.max("n_vertices").alias("n")).select(F.explode(F.expr("sequence(0L, n - 1)")).alias("vertex"))
        found = places.join(values, "row").select("vertex", F.col("x").cast("long").alias("key"))
        vertices = every.join(found, "vertex", "left").select(F.lit(hemi).alias("hemi"), "vertex", F.coalesce("key", F.lit(0)).cast("long").alias("key"))
        parcels = cifti.read_labels(spark, path).filter("map = 0").select(F.lit(hemi).alias("hemi"), "key", "label")
        return vertices, extract_surface_labels(vertices, parcels, ignore)
    return read_annot_vertices(spark, path, hemi), extract_labels(read_parcels(spark, path, hemi), ignore)


def read_parcels(spark: SparkSession, path: str, hemi: str) -> DataFrame:
    """``(hemi, key, label)`` of ``.annot`` or ``.gii`` files."""

    def parse(parts):
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                rows = parse_annot(bytes(content))[1] if name.endswith(".annot") else parse_gifti_labels(bytes(content))
                yield pd.DataFrame({"hemi": hemi, "key": [k for k, _ in rows], "label": [v for _, v in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "hemi string, key long, label string")


def read_annot_vertices(spark: SparkSession, path: str, hemi: str) -> DataFrame:
    """``(hemi, vertex, key)`` of ``.annot`` or ``.gii`` files; of these the first array has the keys."""

    def parse(parts):
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                keys = parse_annot(bytes(content))[0] if name.endswith(".annot") else parse_gifti_values(bytes(content))[0].ravel().astype(np.int64)
                yield pd.DataFrame({"hemi": hemi, "vertex": np.arange(len(keys)), "key": keys})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "hemi string, vertex long, key long")
