"""Sequential work on many small groups, without the cost of a call between JVM and Python, or of one in Python, for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators.tiles import column


def changes(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Places from which on rows have other keys, of which none is null, than the row before, without the first."""
    n = len(table)
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys if n > 1 else ():
        values = column(table, k)
        new |= pc.not_equal(values.slice(1), values.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Rows that work gives for whole groups, some at a time: from a table of them in order, and the number of each row's
    group, from 0.

    Groups come sorted within a partition, many to a batch; what a batch leaves of its last group waits for the next, so
    a group is held whole and no more than that. Rows with a null key are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = changes(batch, keys)
            # a group of many batches is put together once
            joins = not rest or not len(changes(pa.Table.from_batches([rest[-1].slice(len(rest[-1]) - 1), batch.slice(0, 1)]), keys))
            last = int(edges[-1]) if len(edges) else 0 if joins else None
            if last == 0:
                rest.append(batch)
                continue
            whole = pa.Table.from_batches([*rest, batch.slice(0, last or 0)])
            yield from done(whole)
            rest = [batch.slice(last or 0)]
        if rest:
            yield from done(pa.Table.from_batches(rest))

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.zeros(len(table), np.int64)
        group[changes(table, keys)] = 1
        yield from work(table.combine_chunks(), np.cumsum(group)).to_batches()

    whole = df.dropna(subset=list(keys))
    return whole.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
