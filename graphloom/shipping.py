"""Work that needs a whole network in each task: the network is sent along, if it is small enough."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Edges, or rows of a table, that may be sent to every task: 24 bytes each.
MAX_SENT = 2_000_000


def collected(df: DataFrame, limit: int = MAX_SENT) -> pd.DataFrame:
    """All rows, or an error before they are fetched if there are more than ``limit``."""
    n = df.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} rows; this operator sends its whole input to each task")
    return df.toPandas()


class Network:
    """A network by rows: neighbours of node number i are ``to[start[i]:start[i + 1]]``, in rising order."""

    def __init__(self, edges: pd.DataFrame, ids: np.ndarray | None = None):
        src, dst = edges["src"].to_numpy(np.int64), edges["dst"].to_numpy(np.int64)
        self.ids = np.unique(np.concatenate((src, dst) if ids is None else (src, dst, np.asarray(ids, np.int64))))
        a, b = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.lexsort((b, a))
        self.frm, self.to, self.w = a[order], b[order], edges["w"].to_numpy(float)[order]
        self.start = np.searchsorted(self.frm, np.arange(len(self.ids) + 1))

    def __len__(self) -> int:
        return len(self.ids)

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self), len(self)))
        np.add.at(out, (self.frm, self.to), self.w)
        return out


def for_each(keys: DataFrame, run: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``run`` gives for each batch of the keys of a one-column table, spread over tasks."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield run(part.iloc[:, 0].to_numpy())

    return keys.mapInPandas(batches, schema)


def replicates(spark: SparkSession, n: int, run: Callable[[int], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``run`` gives for 0 to n - 1, each in a task by itself as far as there are cores."""
    slots = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    return for_each(spark.range(0, n, 1, slots), lambda ids: pd.concat([run(int(i)) for i in ids], ignore_index=True), schema)
