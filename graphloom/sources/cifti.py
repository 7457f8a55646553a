"""CIFTI-2 files as tables: values by row, and what each row stands for.

A file is a NIfTI-2 header, an extension with XML that names the rows, and a matrix.  Files come through Spark's
``binaryFile`` source, one task for each.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_XML_CODE = 32


@dataclass
class Cifti:
    """``data`` has the file's first axis in rows and its second in columns; ``axes`` are their XML elements."""

    data: np.ndarray
    axes: dict[int, ET.Element]

    def axis(self, kind: str) -> tuple[int, ET.Element] | None:
        """The first axis of brain models (``BRAIN_MODELS``), ``LABELS``, ``SCALARS``, ``SERIES`` or ``PARCELS``."""
        return next(((k, x) for k, x in sorted(self.axes.items()) if x.get("IndicesMapToDataType", "").endswith(kind)), None)


def parse_cifti(content: bytes) -> Cifti:
    order = next((o for o in "<>" if struct.unpack(o + "i", content[:4])[0] == 540), None)
    if order is None or not content[4:8].startswith(b"n+2"):
        raise ValueError("not a CIFTI-2 file")
    (kind,) = struct.unpack(order + "h", content[12:14])
    if kind not in _KINDS:
        raise ValueError(f"data type {kind} is not known")
    dims = struct.unpack(order + "8q", content[16:80])
    (offset,) = struct.unpack(order + "q", content[168:176])
    slope, intercept = struct.unpack(order + "2d", content[176:192])
    shape = dims[5 : dims[0] + 1]
    xml, at = None, 544
    while content[540] and at + 8 <= offset:
        size, code = struct.unpack(order + "2i", content[at : at + 8])
        if size < 8:
            break
        if code == _XML_CODE:
            xml = content[at + 8 : at + size].rstrip(b"\0")
        at += size
    if xml is None:
        raise ValueError("there is no CIFTI extension")
    data = np.frombuffer(content, np.dtype(_KINDS[kind]).newbyteorder(order), int(np.prod(shape)), offset).reshape(shape, order="F").astype(float)
    if slope and (slope, intercept) != (1.0, 0.0) and np.isfinite(slope):
        data = data * slope + intercept
    axes = {}
    for found in ET.fromstring(xml).iter("MatrixIndicesMap"):
        for k in found.get("AppliesToMatrixDimension", "").split(","):
            axes[int(k)] = found
    return Cifti(data, axes)


def _models(axis: ET.Element) -> Iterator[tuple[str, int, np.ndarray, int | None]]:
    """(structure, first row, vertices or voxels, vertices of the surface or None) of each brain model."""
    for m in axis.findall("BrainModel"):
        surface = m.get("ModelType", "").endswith("SURFACE")
        numbers = np.array((m.findtext("VertexIndices" if surface else "VoxelIndicesIJK") or "").split(), np.int64)
        yield m.get("BrainStructure", ""), int(m.get("IndexOffset", 0)), numbers if surface else numbers.reshape(-1, 3), int(m.get("SurfaceNumberOfVertices", 0)) if surface else None


def _rows(spark: SparkSession, path: str, read: Callable[[Cifti], pd.DataFrame], schema: str) -> DataFrame:
    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                found = read(parse_cifti(bytes(content)))
                found.insert(0, "path", name)
                yield found

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, f"path string, {schema}")


def _brain(c: Cifti) -> tuple[np.ndarray, ET.Element]:
    """The matrix with brain rows in rows, and their axis."""
    found = c.axis("BRAIN_MODELS")
    if found is None:
        raise ValueError("no axis has brain models")
    return (c.data if found[0] == 0 else c.data.T), found[1]


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """``(path, map, row, x)``: the value of each brain row in each map, time point or other row."""

    def read(c: Cifti) -> pd.DataFrame:
        data, _ = _brain(c)
        row, number = np.indices(data.shape)
        return pd.DataFrame({"map": number.ravel(), "row": row.ravel(), "x": data.ravel()})

    return _rows(spark, path, read, "map long, row long, x double")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """``(path, structure, row, vertex, n_vertices)`` of the rows on surfaces."""

    def read(c: Cifti) -> pd.DataFrame:
        parts = [pd.DataFrame({"structure": s, "row": first + np.arange(len(at)), "vertex": at, "n_vertices": n}) for s, first, at, n in _models(_brain(c)[1]) if n is not None]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["structure", "row", "vertex", "n_vertices"])

    return _rows(spark, path, read, "structure string, row long, vertex long, n_vertices long")


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """``(path, structure, row, i, j, k)`` of the rows in the volume."""

    def read(c: Cifti) -> pd.DataFrame:
        parts = [pd.DataFrame({"structure": s, "row": first + np.arange(len(at)), "i": at[:, 0], "j": at[:, 1], "k": at[:, 2]}) for s, first, at, n in _models(_brain(c)[1]) if n is None]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["structure", "row", "i", "j", "k"])

    return _rows(spark, path, read, "structure string, row long, i long, j long, k long")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(path, map, key, label)`` of the label tables; none for a file without labels."""

    def read(c: Cifti) -> pd.DataFrame:
        found = c.axis("LABELS")
        maps = found[1].findall("NamedMap") if found else []
        rows = [(k, int(x.get("Key", -1)), (x.text or "").strip()) for k, m in enumerate(maps) for x in m.iter("Label")]
        return pd.DataFrame(rows, columns=["map", "key", "label"])

    return _rows(spark, path, read, "map long, key long, label string")


def describe_file(spark: SparkSession, path: str) -> DataFrame:
    """``(path, axis, kind, name, first, last)``: what each axis holds; structures with their rows, labels with their keys."""

    def read(c: Cifti) -> pd.DataFrame:
        rows = []
        for k, x in sorted(c.axes.items()):
            kind = x.get("IndicesMapToDataType", "").removeprefix("CIFTI_INDEX_TYPE_")
            rows.append((k, kind, None, 0, c.data.shape[k] - 1))
            rows += [(k, kind, s, first, first + len(at) - 1) for s, first, at, _ in _models(x)]
            rows += [(k, kind, (y.text or "").strip(), int(y.get("Key", -1)), int(y.get("Key", -1))) for m in x.findall("NamedMap")[:1] for y in m.iter("Label")]
        return pd.DataFrame(rows, columns=["axis", "kind", "name", "first", "last"])

    return _rows(spark, path, read, "axis int, kind string, name string, first long, last long")
