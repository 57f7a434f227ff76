"""Connected components by alternating star operations, all of it joins and aggregates.

Large-star links every larger neighbour of a node to the node's smallest neighbour,
small-star does so for the smaller ones; the two shrink any graph to stars in a
logarithmic number of rounds. No neighbour list is gathered: each step is a partially
aggregated minimum and an equi-join whose hot keys AQE can split.

Once at most SMALL links are left, which is counted, one task unites them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillset.storage import remove, written


#: Links that a single task may hold (16 bytes each).
SMALL = 20_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): every node with the smallest one it reaches, of a bounded number of links."""
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})])
    nodes, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    a, b = ends[: table.num_rows], ends[table.num_rows :]
    least = np.arange(len(nodes))
    while True:
        low, before = np.minimum(least[a], least[b]), least.copy()
        for side in (a, b):
            np.minimum.at(least, least[side], low)
        while not np.array_equal(least, least[least]):
            least = least[least]
        if np.array_equal(before, least):
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], ["u", "v"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(edges: DataFrame, max_rounds: int = 60, small: int | None = None) -> DataFrame:
    """(id, component) for every node of ``edges`` (src, dst): component is the smallest id it reaches.

    Null ends and self links are ignored; repeated links count once. An empty input
    gives an empty result. ``small`` links, SMALL if not given, are left to one task.
    """
    small = SMALL if small is None else small
    ends = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null and src <> dst")
    spark = edges.sparkSession
    now, path = written(ends.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] <= small:
            every = written(now.select("u", "v").coalesce(1).mapInArrow(_united, "u long, v long"), "links")[0] if state[0] else now
            return every.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, old = state, path
        now, path = written(_small(_large(now)), "links")
        state = _state(now)
        remove(spark, old)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
