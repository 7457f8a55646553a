"""Operators 9 and 10: token ids packed into fixed-length windows.

Both split a document of more than ``length`` tokens losslessly into pieces of ``length`` and a rest.  A window has
the columns

* ``window_id``: unique, the same at every run over the same files,
* ``doc_ids``: the document of each segment in turn,
* ``doc_offsets``: where the segment begins among its document's ids, 0 unless it continues a long document,
* ``cu_seqlens``: cumulative segment lengths from 0, so segment i is ``ids[cu_seqlens[i]:cu_seqlens[i + 1]]``,
* ``position_resets``: where position ids return to 0, the beginning of each segment,
* ``n_tokens``: ids in use, and ``ids``: one row of the id matrix, ``length`` little-endian unsigned integers of
  ``id_bytes(n_ids)`` bytes, filled up with ``end_id``.

Each document is followed by ``end_id``.  NULL and empty texts have no tokens and are in no window.  A very long text is
split, never cut.  A document with a NULL id is packed under a NULL id; repeated rows are packed as often as they come.
Of windows that fit equally well the earliest is taken, and pieces of equal length keep their order.

The ranks file of the tokenizer must be readable under the same path on all executors, or be sent there with
``SparkContext.addFile``, by whose bare name it is then given.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import pick_documents, slices, table
from graphloom.llm.tokens import RANKS_FILE, TOKENIZER_DIR, BytePairs, tokenizer

WINDOW = 2048
END_ID = 50256
#: Ids that best-fit-decreasing sorts and packs at once in a task; bounds its memory.
BLOCK_IDS = 16_000_000
OPEN_WINDOWS = 64
#: Partitions whose open windows are merged by one task.
MERGE_FAN_IN = 64
#: Best-fit-decreasing windows that are less full than this are packed again with those of other tasks.
FULL = 0.9

SCHEMA = (
    "window_id long, n_tokens int, doc_ids array<long>, doc_offsets array<int>, "
    "cu_seqlens array<int>, position_resets array<int>, ids binary"
)
_ARROW = pa.schema(
    [
        ("window_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_offsets", pa.list_(pa.int32())),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("ids", pa.binary()),
    ]
)

_ARROW_OPEN = _ARROW.append(pa.field("is_open", pa.bool_()))

Piece = tuple[int | None, int, np.ndarray]  # document, offset in it, ids


def id_type(n_ids: int) -> np.dtype:
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


class CapacityTree:
    """A segment tree over room 0 to ``length``: the windows with the least room that still suffices."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: dict[int, deque[int]] = {}

    def add(self, room: int, window: int) -> None:
        self.windows.setdefault(room, deque()).append(window)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of least room >= need; the earliest window of equal room."""
        at, count = need + self.size, self.count
        while not count[at]:
            while at & 1:
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.size:
            at <<= 1
            if not count[at]:
                at += 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.windows[room].popleft()


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Indexes of pieces by window; pieces by falling length, equal ones in their order."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist()
    tree, windows, sizes = CapacityTree(length), [], np.asarray(lengths).tolist()
    for i in order:
        need = sizes[i]
        found = tree.take(need) if need < length else None
        if found is None:
            windows.append([i])
            room, w = length, len(windows) - 1
        else:
            room, w = found
            windows[w].append(i)
        if room > need:
            tree.add(room - need, w)
    return windows


class OpenWindows:
    """Bounded-space online best fit: ``place`` returns the window that had to be closed, if any."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.open: list[tuple[list[Piece], int]] = []  # pieces, room

    def place(self, piece: Piece) -> list[Piece] | None:
        need = len(piece[2])
        if need == self.length:
            return [piece]
        best = min((i for i, (_, room) in enumerate(self.open) if room >= need), key=lambda i: self.open[i][1], default=None)
        if best is not None:
            pieces, room = self.open[best]
            pieces.append(piece)
            if room > need:
                self.open[best] = pieces, room - need
                return None
            del self.open[best]
            return pieces
        closed = None
        if len(self.open) == self.most:
            fullest = min(range(self.most), key=lambda i: self.open[i][1])
            closed = self.open.pop(fullest)[0]
        self.open.append(([piece], self.length - need))
        return closed


def _encoder(ranks: str) -> BytePairs:
    """The tokenizer of a ranks file, given by its path or as the name of a file added to the context."""
    return tokenizer(ranks if os.path.dirname(ranks) else SparkFiles.get(ranks))


def _pieces(batch: pa.RecordBatch, ranks: str, end_id: int, length: int, kind: np.dtype) -> Iterator[Piece]:
    for part in slices(batch):
        ids, bounds = _encoder(ranks).encode(part.column("text"))
        ids = ids.astype(kind)
        stop = np.array([end_id], kind)
        for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            whole = np.concatenate((ids[a:b], stop))
            for at in range(0, len(whole), length):
                yield doc, at, whole[at : at + length]


def _rows(windows: list[list[Piece]], first_id: int, length: int, end_id: int, kind: np.dtype, schema: pa.Schema = _ARROW, **more: list) -> pa.RecordBatch:
    cums = [np.cumsum([0, *(len(p[2]) for p in w)]).tolist() for w in windows]
    fill = np.full(length, end_id, kind)
    columns = {
        "window_id": list(range(first_id, first_id + len(windows))),
        "n_tokens": [c[-1] for c in cums],
        "doc_ids": [[p[0] for p in w] for w in windows],
        "doc_offsets": [[p[1] for p in w] for w in windows],
        "cu_seqlens": cums,
        "position_resets": [c[:-1] for c in cums],
        "ids": [np.concatenate([*(p[2] for p in w), fill[: length - c[-1]]]).tobytes() for w, c in zip(windows, cums, strict=True)],
    } | more
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _partition_base() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32


def _pack_decreasing(batches: Iterator[pa.RecordBatch], ranks: str, end_id: int, length: int) -> Iterator[pa.RecordBatch]:
    kind = id_type(max(_encoder(ranks).n_ids, end_id + 1))
    number, block, held = _partition_base(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        windows = best_fit_decreasing(np.array([len(p[2]) for p in block]), length)
        for at in range(0, len(windows), 2000):
            part = [[block[i] for i in w] for w in windows[at : at + 2000]]
            is_open = [sum(len(p[2]) for p in w) < FULL * length for w in part]
            yield _rows(part, number, length, end_id, kind, _ARROW_OPEN, is_open=is_open)
            number += len(part)

    for batch in batches:
        for piece in _pieces(batch, ranks, end_id, length, kind):
            block.append(piece)
            held += len(piece[2])
            if held >= BLOCK_IDS:
                yield from flush()
                block, held = [], 0
    yield from flush()


def pack_best_fit_decreasing(docs: DataFrame, ranks: str | None = None, length: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Operator 9: token ids in windows, packed best-fit-decreasing with a segment tree over the room left.

    Packing is by task, in blocks of ``BLOCK_IDS`` ids.  The last windows of a block can be far from full: those less than
    ``FULL`` are packed again, best-fit-decreasing, together with those of ``MERGE_FAN_IN - 1`` other tasks, and only
    these are shuffled.  See the module for the columns.
    """
    ranks = ranks or f"{TOKENIZER_DIR}/{RANKS_FILE}"
    run = partial(_pack_decreasing, ranks=ranks, end_id=end_id, length=length)
    return _with_merged(pick_documents(docs).mapInArrow(run, f"{SCHEMA}, is_open boolean"), ranks, length, end_id)


def _pack_online(batches: Iterator[pa.RecordBatch], ranks: str, end_id: int, length: int, most: int) -> Iterator[pa.RecordBatch]:
    kind = id_type(max(_encoder(ranks).n_ids, end_id + 1))
    state, number, done = OpenWindows(length, most), _partition_base(), []
    for batch in batches:
        for piece in _pieces(batch, ranks, end_id, length, kind):
            closed = state.place(piece)
            if closed:
                done.append(closed)
                if len(done) == 1000:
                    yield _rows(done, number, length, end_id, kind, _ARROW_OPEN, is_open=[False] * len(done))
                    number, done = number + len(done), []
    yield _rows(done, number, length, end_id, kind, _ARROW_OPEN, is_open=[False] * len(done))
    left = [pieces for pieces, _ in state.open]
    yield _rows(left, number + len(done), length, end_id, kind, _ARROW_OPEN, is_open=[True] * len(left))


def _merge_open(group: pa.Table, length: int, end_id: int, kind: str) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["window_id"])
    pieces: list[Piece] = []
    for r in rows:
        ids, cum = np.frombuffer(r["ids"], kind), r["cu_seqlens"]
        pieces += [(d, o, ids[a:b]) for d, o, a, b in zip(r["doc_ids"], r["doc_offsets"], cum[:-1], cum[1:], strict=True)]
    windows = [[pieces[i] for i in w] for w in best_fit_decreasing(np.array([len(p[2]) for p in pieces]), length)]
    if len(windows) >= len(rows):  # nothing is saved
        return group.select(_ARROW.names).cast(_ARROW)
    out = _rows(windows, 0, length, end_id, np.dtype(kind))
    return pa.Table.from_batches([out.set_column(0, "window_id", pa.array([r["window_id"] for r in rows[: len(windows)]], pa.int64()))])


def pack_online(
    docs: DataFrame, ranks: str | None = None, length: int = WINDOW, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS
) -> DataFrame:
    """Operator 10: bounded-space online packing.

    Every task keeps at most ``open_windows`` windows.  A piece goes where it leaves the least room; when it fits
    nowhere and all are in use, the fullest is closed.  What is open at a task's end is packed again together with
    that of ``MERGE_FAN_IN - 1`` other tasks; only these windows are shuffled.  See the module for the columns.
    """
    ranks = ranks or f"{TOKENIZER_DIR}/{RANKS_FILE}"
    run = partial(_pack_online, ranks=ranks, end_id=end_id, length=length, most=open_windows)
    return _with_merged(pick_documents(docs).mapInArrow(run, f"{SCHEMA}, is_open boolean"), ranks, length, end_id)


def _with_merged(packed: DataFrame, ranks: str, length: int, end_id: int) -> DataFrame:
    """The windows, those that are open merged with those of other tasks."""
    first = table(packed)
    task = F.shiftright("window_id", 32)
    ends = first.filter("is_open").agg(F.min(task).alias("a"), F.max(task).alias("b")).first()
    if ends.a == ends.b:  # no other task has any
        return first.drop("is_open")
    kind = id_type(max(_encoder(ranks).n_ids, end_id + 1)).str

    def merge(group: pa.Table) -> pa.Table:
        return _merge_open(group, length, end_id, kind)

    merged = first.filter("is_open").drop("is_open").groupBy(F.floor(task / MERGE_FAN_IN).alias("merge")).applyInArrow(merge, SCHEMA)
    return first.filter("not is_open").drop("is_open").unionByName(merged)


def write_id_matrices(packed: DataFrame, folder: str) -> None:
    """Write windows as Parquet with one row of the id matrix each; ``read_id_matrix`` gives a file's matrix."""
    packed.write.mode("overwrite").parquet(folder)


def read_id_matrix(path: str, n_ids: int) -> np.ndarray:
    """The windows-by-length id matrix of one written file."""
    import pyarrow.parquet as pq

    rows = pq.read_table(path, columns=["ids"])["ids"].to_pylist()
    return np.frombuffer(b"".join(rows), id_type(n_ids)).reshape(len(rows), -1) if rows else np.zeros((0, 0), id_type(n_ids))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit_decreasing(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(spark.read.parquet(f"{sf_dir}/documents.parquet"))
