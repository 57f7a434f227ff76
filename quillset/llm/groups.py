"""Stream the key groups of a sorted partition through an Arrow function."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups: each table holds one or more groups of equal ``keys``, none of them cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            change |= ~np.asarray(pc.equal(column.slice(1), column.slice(0, batch.num_rows - 1)).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
        cuts = np.flatnonzero(change) + 1
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def gathered(tables: Iterable[pa.Table], least_rows: int = 50_000) -> Iterator[pa.Table]:
    """Consecutive tables joined until they have ``least_rows``, so that each call on them has some work."""
    held, n = [], 0
    for table in tables:
        held.append(table)
        n += table.num_rows
        if n >= least_rows:
            yield pa.concat_tables(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the end."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, np.int64)


def map_sorted_groups(df: DataFrame, keys: list[str], order: list[str], function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function`` over tables of whole groups, each sorted by ``order`` within its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            yield from function(table.combine_chunks())

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of ``n`` nodes' component over links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    return root
