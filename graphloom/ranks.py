"""Exact percentiles of a column without one task, or the driver, for all of its values."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the values' places in the order of doubles that a round settles: each task counts 2^16 bins an interval.
BITS = 16
_LEAST = -(1 << 63)


def _keys(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))


def _double(key: int) -> float:
    bits = np.int64(key)
    return float((bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFF_FFFF_FFFF_FFFF))).view(np.float64))


def _counts(values: DataFrame, starts: list[int], width: int) -> dict[int, list[tuple[int, int]]]:
    """By interval of ``width`` bits from each start: the parts of it that have values, in order, and how many."""
    shift = max(0, width - BITS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((len(starts), 1 << min(BITS, width)), np.int64)
        for batch in batches:
            key = _keys(batch.column(0).to_numpy(zero_copy_only=False))
            for i, start in enumerate(starts):
                at = key.view(np.uint64) - np.uint64(start % (1 << 64))  # beyond the interval, it is beyond its width
                own = at if width == 64 else at[at < np.uint64(1 << width)]
                bins[i] += np.bincount((own >> np.uint64(shift)).astype(np.int64), minlength=bins.shape[1])
        i, b = np.nonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(b, pa.int64()), pa.array(bins[i, b], pa.int64())], ["i", "b", "n"])

    if width < 64:  # the ends may be no numbers, beyond the infinite
        ends = [(_double(s), _double(s + (1 << width) - 1)) for s in starts]
        inside = [F.col("x").between(-math.inf if math.isnan(a) else a, math.inf if math.isnan(b) else b) for a, b in ends]
        values = values.filter(reduce(operator.or_, inside))
    found = values.mapInArrow(count, "i long, b long, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toArrow().sort_by([("i", "ascending"), ("b", "ascending")])
    out: dict[int, list[tuple[int, int]]] = {s: [] for s in starts}
    for i, b, n in zip(*(found.column(c).to_pylist() for c in ("i", "b", "n"))):
        out[starts[i]].append((starts[i] + (b << shift), n))
    return out


def percentiles(df: DataFrame, x: Column, shares: Sequence[float]) -> list[float | None]:
    """The interpolated percentiles of what is neither NULL nor NaN, as ``percentile`` gives them; None without any.

    Tasks count by the first 16 bits of the values' places in the order of doubles, then by the next 16 within the
    intervals that hold the ranks, and so on; after four rounds an interval is one value.  Each round reads ``df`` again.
    """
    if not all(0 <= share <= 1 for share in shares):
        raise ValueError(f"percentiles lie within 0 and 1, not {list(shares)}")
    values = df.select(x.cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    width, counts = 64, _counts(values, [_LEAST], 64)
    n = sum(k for _, k in counts[_LEAST])
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * share for share in shares]
    inside = {rank: (_LEAST, rank) for p in places for rank in (math.floor(p), math.ceil(p))}  # the interval, and the rank within it
    while True:
        width = max(0, width - BITS)
        for rank, (start, left) in inside.items():
            for part, k in counts[start]:
                if left < k:
                    break
                left -= k
            inside[rank] = part, left
        if not width:
            break
        counts = _counts(values, sorted({start for start, _ in inside.values()}), width)
    found = {rank: _double(start) for rank, (start, _) in inside.items()}
    out: list[float | None] = []
    for p in places:
        low, high = found[math.floor(p)], found[math.ceil(p)]
        out.append(low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return out
