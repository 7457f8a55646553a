"""What the operators of this subpackage share: column picking, lineage cuts and vectorised word hashing.

Words.  A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text;
``WORD_PATTERN`` is the same definition as a regular expression over ``text.lower()``.  Word ``i`` of a text is the
unit in which positions are counted.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[0-9a-z\x80-\U0010ffff]+"

#: Bytes of text hashed at once; bounds the memory of a Python worker whatever the Arrow batch holds.
SLICE_BYTES = 2_000_000

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 2**64)
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None
_tables: dict[str, SparkContext] = {}


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names of the keywords: ``pick(docs, doc_id="doc_id", text="text")``."""
    missing = [c for c in columns.values() if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the input has {df.columns}")
    return df.select(*[df[f"`{c}`"].alias(k) for k, c in columns.items()])


def pick_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id long, text string)``; ids may be integers of any width, other kinds are refused."""
    picked = pick(docs, doc_id="doc_id", text="text")
    kinds = dict(picked.dtypes)
    if kinds["doc_id"] not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"doc_id must be an integer, not {kinds['doc_id']}")
    if kinds["text"] not in ("string", "void"):
        raise ValueError(f"text must be a string, not {kinds['text']}")
    return picked.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is not in the one column of ``ids``; NULL ids stay, and columns may have any names."""
    columns = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    gone = ids.toDF("gone").distinct()
    return inner.join(gone, inner[f"c{columns.index('doc_id')}"] == gone["gone"], "left_anti").toDF(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only a local session may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that lost executors cost nothing that is finished."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: a cut that packs its rows and may prune columns.

    The table is deleted when the driver's Python ends, or before that by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_forget_all)
    _tables[path] = spark.sparkContext
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the tables that a result of ``table`` reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        for known in list(_tables):
            if path.endswith(known.split(":", 1)[-1]):
                _delete(known)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark deletes the shuffle files of plans that are no longer held.

    Some are let go by the first collection only, and so found by the second.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _delete(path: str) -> None:
    context = _tables.pop(path)
    if context._jvm is not None:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _forget_all() -> None:
    for path in list(_tables):
        if SparkContext._active_spark_context is _tables[path]:
            _delete(path)


def content_hash(text: Column) -> Column:
    """128-bit hash of the bytes of a text, as 16 bytes."""
    return F.unhex(F.md5(text))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, _U(_BASE))
        down = np.full(size, _U(_BASE_INV))
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


class Words:
    """The words of several texts: 64-bit ``hashes``, and ``bounds`` so that text k has words bounds[k]:bounds[k+1].

    ``starts`` and ``ends`` are byte offsets of the words in the lower-cased UTF-8 bytes ``data``; ``text_starts``
    has the byte offset of each text.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        lower = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
        joined = pc.binary_join_element_wise(lower, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        n = len(joined)
        if n == 0:
            self.data = np.zeros(0, np.uint8)
            self.starts = self.ends = self.text_starts = np.zeros(0, np.int64)
            self.bounds = np.zeros(1, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            self._total = np.zeros(1, np.uint64)
            return
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + n + 1]
        data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = _IS_WORD[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]  # every text ends with a blank, so ends match starts
        up, down = _power_tables(len(data) + 1)
        sums = _BYTE_CODE[data]
        sums *= up[: len(data)]
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(sums, out=total[1:])
        self.data, self.starts, self.ends, self.text_starts = data, starts, ends, offsets[:-1]
        self._total = total
        self.hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        self.bounds = np.searchsorted(starts, offsets)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the bytes from ``starts`` to ``ends``."""
        return (self._total[ends] - self._total[starts]) * _power_tables(len(self._total))[1][starts]

    def text_of_word(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words; entry i is of words i to i + k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(hashes) + 1)
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n] + _U(k))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``limit`` bytes in all; one longer text makes a part by itself."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes + 1)
    at = 0
    while at < n:
        used = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, used + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
