"""Writers of the binary formats that ``files`` and ``cifti`` read, one file at a time."""

from __future__ import annotations

import base64
import io
import struct
import uuid
import zlib
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import SparkSession

from graphloom.iterate import shared_dir


def put(spark: SparkSession, content: bytes, suffix: str) -> str:
    """Write a file to the shared folder; its path."""
    path = f"{shared_dir(spark).rstrip('/')}/file-{uuid.uuid4().hex}{suffix}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    stream.write(content)
    stream.close()
    return path


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def annot(keys: list[int], table: list[tuple[int, str]]) -> bytes:
    """An annotation: the key of each vertex, and (key, label); labels have made-up colours."""
    word = lambda s: struct.pack(">i", len(s.encode()) + 1) + s.encode() + b"\0"
    colour = lambda key: key * 7919 % 0xFFFFFF + 1
    body = struct.pack(">i", len(keys)) + b"".join(struct.pack(">ii", v, colour(k)) for v, k in enumerate(keys))
    rows = b"".join(struct.pack(">i", k) + word(name) + struct.pack(">iiii", colour(k) & 255, colour(k) >> 8 & 255, colour(k) >> 16, 0) for k, name in table)
    return body + struct.pack(">iii", 1, -2, len(table)) + word("table") + struct.pack(">i", len(table)) + rows


def gifti(keys: list[int], table: list[tuple[int, str]]) -> bytes:
    """A label file: the key of each vertex, compressed, and the label table."""
    labels = "".join(f'<Label Key="{k}">{escape(name)}</Label>' for k, name in table)
    data = base64.b64encode(zlib.compress(np.array(keys, "<i4").tobytes())).decode()
    return f'<GIFTI><LabelTable>{labels}</LabelTable><DataArray DataType="NIFTI_TYPE_INT32" Dimensionality="1" Dim0="{len(keys)}" Encoding="GZipBase64Binary" Endian="LittleEndian"><Data>{data}</Data></DataArray></GIFTI>'.encode()


def cifti(data: np.ndarray, surfaces: list[tuple[str, int, list[int]]], volumes: list[tuple[str, list[tuple[int, int, int]]]], labels: list[tuple[int, str]] | None = None, order: str = "<") -> bytes:
    """A CIFTI-2 file of ``data``, maps in rows and brain rows in columns.

    ``surfaces`` are (structure, vertices of the surface, those with a row), ``volumes`` (structure, voxels), in the order
    of rows.
    """
    models, at = "", 0
    for name, n, vertices in surfaces:
        models += f'<BrainModel IndexOffset="{at}" IndexCount="{len(vertices)}" ModelType="CIFTI_MODEL_TYPE_SURFACE" BrainStructure="{name}" SurfaceNumberOfVertices="{n}"><VertexIndices>{" ".join(map(str, vertices))}</VertexIndices></BrainModel>'
        at += len(vertices)
    for name, voxels in volumes:
        models += f'<BrainModel IndexOffset="{at}" IndexCount="{len(voxels)}" ModelType="CIFTI_MODEL_TYPE_VOXELS" BrainStructure="{name}"><VoxelIndicesIJK>{chr(10).join(" ".join(map(str, v)) for v in voxels)}</VoxelIndicesIJK></BrainModel>'
        at += len(voxels)
    table = "" if labels is None else "<LabelTable>" + "".join(f'<Label Key="{k}">{escape(x)}</Label>' for k, x in labels) + "</LabelTable>"
    maps = "".join(f"<NamedMap><MapName>m{k}</MapName>{table}</NamedMap>" for k in range(data.shape[0]))
    kind = "SCALARS" if labels is None else "LABELS"
    xml = f'<CIFTI Version="2"><Matrix><MatrixIndicesMap AppliesToMatrixDimension="0" IndicesMapToDataType="CIFTI_INDEX_TYPE_{kind}">{maps}</MatrixIndicesMap><MatrixIndicesMap AppliesToMatrixDimension="1" IndicesMapToDataType="CIFTI_INDEX_TYPE_BRAIN_MODELS">{models}</MatrixIndicesMap></Matrix></CIFTI>'.encode()
    xml += b"\0" * (-(len(xml) + 8) % 16)
    head = bytearray(540)
    struct.pack_into(order + "i8shh", head, 0, 540, b"n+2\0\r\n\x1a\n", 64, 64)
    struct.pack_into(order + "8q", head, 16, 6, 1, 1, 1, 1, *data.shape, 1)
    offset = 544 + 8 + len(xml)
    struct.pack_into(order + "q2d", head, 168, offset, 1.0, 0.0)
    return bytes(head) + b"\1\0\0\0" + struct.pack(order + "2i", len(xml) + 8, 32) + xml + np.asfortranarray(data, np.dtype("f8").newbyteorder(order)).tobytes(order="F")
