"""Order-dependent passes over the rows of a page or project, streamed through sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import batched, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fold(rows: DataFrame, by: list[str], order: list[Column | str], each: Callable[[tuple, Iterable], Iterator[tuple]], schema: str, parts: int | None = None) -> DataFrame:
    """What ``each(key, rows)`` yields for every group, its rows coming one after another in ``order``.

    A task holds one batch and whatever ``each`` keeps, not the group, and small groups
    share a batch. Rows with a null among ``by`` belong to no group and are left out.
    Groups whose work is larger than their rows tell are dealt to that many ``parts``, however small they are.
    """
    names = StructType.fromDDL(schema).names
    at = [rows.columns.index(c) for c in by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (row for pdf in batches for row in pdf.itertuples(index=False, name="Row"))
        groups = groupby(stream, key=lambda row: tuple(row[i] for i in at))
        made = (out for key, group in groups for out in each(key, group))
        for chunk in batched(made, 10_000):
            # objects, so that large numbers beside nulls stay whole
            yield pd.DataFrame(chunk, columns=names, dtype=object)

    placed = rows.where(F.expr(" and ".join(f"`{c}` is not null" for c in by)))
    dealt = placed.repartition(parts, *by) if parts else placed.repartition(*by)
    return dealt.sortWithinPartitions(*by, *order).mapInPandas(run, schema)
