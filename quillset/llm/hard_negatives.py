"""Hard negatives by k-means inverted lists with stored radii.

Vectors are placed in the cell of their nearest centroid (Lloyd's k-means, fitted on a
bounded, hash-ordered sample, at most MAX_CELLS of them) and every cell keeps the radius
of all its vectors. For an anchor a and a cell with centroid c and radius r, Cauchy-Schwarz
puts all scores between a.c - |a|r and a.c + |a|r. An anchor visits cells by that upper
bound: first the FIRST best ones, whose results give a kth score; then all others but
those whose bound falls strictly below it or whose interval misses the window. So the
result is exact, ties included.

A visit is a row: lists are split by hash into blocks of BLOCK vectors, a task holds one
block and streams its visitors past it, and it answers with k rows for a visitor at most,
none of them below the score that the visitor brought.

Scores are integers: products run in double precision where no sum can exceed 2**53, else in
Python's integers; a score beyond 64 bits is given as the largest or smallest of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillset.llm.groups import bounds
from quillset.llm.textkernel import as_binary, from_binary
from quillset.storage import materialise

#: Vectors that centroids are fitted on, vectors a cell should hold, cells at most (they are handed to all tasks), vectors of a block.
SAMPLE, CELL_ROWS, MAX_CELLS, BLOCK = 20_000, 1_000, 2_048, 4_096
#: Cells that an anchor visits before it has a kth score.
FIRST = 4
#: Anchors of a block of visitors that are compared at once.
AT_ONCE = 256
LONG = np.iinfo(np.int64)
LEAST = int(LONG.min)
WANTS = "array<struct<ceiling:bigint,least:bigint>>"
VISITOR = f"id long, label string, dims int, vector binary, wants {WANTS}"


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``k`` centroids of the rows of ``x``; an emptied cell takes a row that is far from its own."""
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home, away = nearest(x, centre)
        count = np.bincount(home, minlength=k)
        total = np.stack([np.bincount(home, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        empty = np.flatnonzero(count == 0)
        total[empty] = x[np.argsort(-away, kind="stable")[: len(empty)]]
        centre = total / np.maximum(count, 1)[:, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and the distance to it; looks at 2**22 distances at a time."""
    home, away, step = np.empty(len(x), np.int32), np.empty(len(x)), max(1, (1 << 22) // max(len(centre), 1))
    half = (centre * centre).sum(axis=1) / 2
    for s in range(0, len(x), step):
        part = x[s : s + step]
        home[s : s + step] = (half - part @ centre.T).argmin(axis=1)
        away[s : s + step] = np.sqrt(((part - centre[home[s : s + step]]) ** 2).sum(axis=1))
    return home, away


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows, as long."""
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    wide = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(wide, LEAST, LONG.max).astype(np.int64)


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _vectors(batch: pa.RecordBatch, rows: np.ndarray, dims: int) -> np.ndarray:
    return from_binary(batch.column(batch.schema.get_field_index("vector")).take(pa.array(rows)), np.float64, dims) if dims else np.zeros((len(rows), 0))


def prepared(vectors: DataFrame, anchor: Column) -> DataFrame:
    """(id, label, anchor, dims, vector) of the rows that take part; components are floor(256 * x), as doubles in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            begin = np.asarray(lists.offsets).astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)[begin[0] : begin[-1]] if len(lists) else np.zeros(0)
            limit = np.finfo(np.float64).max
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(256.0 * values), -limit, limit) + 0.0
            edges = (begin - begin[0]) * 8
            blob = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(whole))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(begin).astype(np.int32)), blob], ["id", "label", "anchor", "dims", "vector"])

    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    columns = vectors.where(fine).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), e.cast("array<double>").alias("embedding"))
    return columns.mapInArrow(run, "id long, label string, anchor boolean, dims int, vector binary")


def fit(rows: DataFrame, sample: int, cell_rows: int) -> dict[int, np.ndarray]:
    """Centroids by number of components, from ``sample`` vectors at most; where the sample has none, all are in one cell around 0."""
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vector", "id"), "id").limit(sample).select("dims", "vector").toPandas()
    centres = {}
    for dims, part in drawn.groupby("dims"):
        k = min(round(n * len(part) / len(drawn) / cell_rows), len(part) // 4, MAX_CELLS)
        if k > 1 and dims:
            x = np.stack([np.frombuffer(v, np.float64) for v in part["vector"]])
            if np.abs(x).max() < 1e100:
                centres[int(dims)] = kmeans(x, k)
    return centres


def placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with their cell and their distance to its centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = _rows(batch, "dims")
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _vectors(batch, at, int(d))
                with np.errstate(over="ignore"):
                    cell[at], away[at] = nearest(x, shared.value.get(int(d), np.zeros((1, int(d)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return rows.mapInArrow(run, "id long, label string, anchor boolean, dims int, vector binary, cell int, away double")


def visits(anchors: DataFrame, cells: dict[int, tuple], choose: Callable) -> DataFrame:
    """``anchors`` (VISITOR) once for each cell that choose(wants, middle, half) gives; scores lie within middle -+ half."""
    shared = anchors.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(s, AT_ONCE)
                dims = _rows(batch, "dims")
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    cell, centre, radius = shared.value[int(d)]
                    a = _vectors(batch, at, int(d))
                    with np.errstate(over="ignore", invalid="ignore"):
                        middle, half = a @ centre.T, np.sqrt((a * a).sum(axis=1))[:, None] * radius
                        # sums of doubles are rounded: widen the interval by more than that
                        half = half + 1e-9 * (np.abs(a) @ np.abs(centre).T + half) + 1e-6
                    odd = ~(np.isfinite(middle) & np.isfinite(half))
                    middle[odd], half[odd] = 0, np.inf
                    part = batch.take(pa.array(at))
                    wants = part.column(part.schema.get_field_index("wants")).to_pylist()
                    found = [np.asarray(choose(w, middle[i], half[i]), np.int64) for i, w in enumerate(wants)]
                    taken = part.take(pa.array(np.repeat(np.arange(len(at)), [len(f) for f in found])))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell[np.concatenate(found)])], [*taken.schema.names, "cell"])

    return anchors.select("id", "label", "dims", "vector", "wants").mapInArrow(run, f"{VISITOR}, cell int")


def first_cells(wants: list[dict], middle: np.ndarray, half: np.ndarray, floor: Callable[[int], int]) -> set[int]:
    """The FIRST best cells of each ceiling: by upper bound, and among those that reach the ceiling by the middle's distance to it."""
    out: set[int] = set()
    for want in wants:
        ceiling = want["ceiling"]
        upper = np.minimum(middle + half, ceiling)
        open_ = np.flatnonzero((middle + half >= floor(ceiling)) & (middle - half <= ceiling))
        order = np.lexsort((np.abs(middle - min(ceiling, 2.0**62))[open_], -upper[open_]))[:FIRST]
        out.update(open_[order].tolist())
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and ceiling, with their rank; equal scores go by the smaller id."""
    order = Window.partitionBy("anchor_id", "ceiling").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, cells: dict[int, tuple], to_blocks: Callable[[DataFrame], DataFrame], members: DataFrame, keys: list[str], k: int, mode: str, floor: Callable[[int], int]) -> DataFrame:
    """best() of all rows for the ``wants`` of ``anchors``, in two rounds of visits.

    to_blocks gives visitors, which have a cell, the blocks of that cell; floor(ceiling) is the least score that counts.
    """
    first = lambda wants, middle, half: sorted(first_cells(wants, middle, half, floor))

    def rest(wants: list[dict], middle: np.ndarray, half: np.ndarray) -> list[int]:
        # a bound strictly below the kth score ends the visits, an equal one doesn't: ids decide between ties
        reached = np.zeros(len(middle), bool)
        for want in wants:
            reached |= (middle + half >= want["least"]) & (middle - half <= want["ceiling"])
        reached[sorted(first_cells(wants, middle, half, floor))] = False
        return np.flatnonzero(reached)

    opened = materialise(best(answers(members, to_blocks(visits(anchors, cells, first)), keys, k, mode), k), "first-visits")
    kth = opened.where(F.col("rank") == k).select(F.col("anchor_id").alias("id"), "ceiling", F.col("score").alias("kth"))
    asked = anchors.select("id", F.explode("wants").alias("w")).select("id", F.col("w.ceiling").alias("ceiling"), F.col("w.least").alias("least"))
    raised = asked.join(kth, ["id", "ceiling"], "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ceiling", F.greatest("least", "kth").alias("least")))).alias("wants"))
    again = anchors.drop("wants").join(raised, "id")
    later = answers(members, to_blocks(visits(again, cells, rest)), keys, k, mode)
    return materialise(best(opened.drop("rank").unionByName(later), k), "best")


def answers(members: DataFrame, visitors: DataFrame, keys: list[str], k: int, mode: str) -> DataFrame:
    """The ``k`` best rows of each block for each visitor and ceiling.

    members: keys, id, label, dims, vector. visitors: keys, id, label, dims, vector, wants (array of structs
    of ceiling and least). mode "same" takes rows of the visitor's label, "other" those of others
    with 80 * ceiling <= 100 * score; both score <= ceiling and >= least, and never rows of the visitor's id.
    """
    columns = [*keys, *(c for c in ("id", "label", "dims", "vector") if c not in keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, ids, labels = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = [batch.column(batch.schema.get_field_index(c)).dictionary_encode().indices.to_numpy() for c in keys]
            side = _rows(batch, "side")
            cut = bounds(*code, side)
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(int(s), int(e - s))
                key = tuple(part.column(part.schema.get_field_index(c))[0].as_py() for c in keys)
                dims = part.column(part.schema.get_field_index("dims"))[0].as_py()
                if side[s] == 0:
                    y, i, g = _vectors(part, np.arange(part.num_rows), dims), _rows(part, "id"), _rows(part, "label")
                    # a block may come in several batches
                    x, ids, labels = (y, i, g) if key != at else (np.concatenate([x, y]), np.concatenate([ids, i]), np.concatenate([labels, g]))
                    at = key
                    continue
                if key != at:
                    continue
                for b in range(0, part.num_rows, AT_ONCE):
                    some = part.slice(b, AT_ONCE)
                    score = products(_vectors(some, np.arange(some.num_rows), dims), x)
                    out = []
                    for r, (who, label, wants) in enumerate(zip(_rows(some, "id").tolist(), _rows(some, "label").tolist(), some.column(some.schema.get_field_index("wants")).to_pylist(), strict=True)):
                        fits = (labels == label) if mode == "same" else (labels != label)
                        pool = np.flatnonzero(fits & (ids != who) & (score[r] >= min(w["least"] for w in wants)))
                        if not len(pool):
                            continue
                        pool = pool[np.lexsort((ids[pool], ~score[r][pool]))]
                        have = score[r][pool]
                        for want in wants:
                            # scores fall along pool
                            first = int(np.searchsorted(~have, ~np.int64(want["ceiling"])))
                            for j in range(first, min(first + k, len(pool))):
                                if have[j] < want["least"]:
                                    break
                                out.append((who, want["ceiling"], int(ids[pool[j]]), int(have[j])))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["anchor_id", "ceiling", "id", "score"])

    held = members.select(*columns, F.lit(0).alias("side"), F.lit(None).cast(WANTS).alias("wants"))
    comers = visitors.select(*columns, F.lit(1).alias("side"), "wants")
    rows = held.unionByName(comers).repartition(*keys).sortWithinPartitions(*keys, "side")
    return rows.mapInArrow(run, "anchor_id long, ceiling long, id long, score long")


def hard_negatives(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 5, percent: int = 80, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, embedding, label) where ``anchor`` holds.

    A score is the integer inner product of vectors whose components are floor(256 * x). An
    anchor's positives are its ``positives`` best rows of the same label, and a positive's hard
    negatives the ``negatives`` best rows of other labels with percent / 100 * positive score
    <= score <= positive score; equal scores go by the smaller vec_id. Both searches are exact.

    Rows with a null vec_id, label or vector or with any null or non-finite component take no part,
    an ``anchor`` that is null doesn't hold, and only vectors of equally many components (none
    included, which score 0) have a score. A repeated vec_id is one anchor (that of its smallest
    label and vector), never its own positive or negative, and counts as several rows for others. A
    positive of negative score has no negatives. Further columns, whatever their names, are
    ignored; an empty table gives an empty table.
    """

    def floor(ceiling: int) -> int:
        return -(-percent * ceiling // 100)

    rows = materialise(prepared(vectors, anchor), "whole-vectors")
    centres = fit(rows, sample, cell_rows)
    index = materialise(placed(rows, centres), "lists")
    sizes = index.groupBy("dims", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).orderBy("dims", "cell").toPandas()
    cells = {}
    for dims, part in sizes.groupby("dims"):
        cell = part["cell"].to_numpy().astype(np.int32)
        cells[int(dims)] = cell, centres.get(int(dims), np.zeros((1, int(dims))))[cell], part["radius"].to_numpy()
    salt, parts = F.xxhash64("id", F.lit(7)), F.ceil(F.col("n") / F.lit(block)).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))

    def in_blocks(lists: DataFrame, keys: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        members = index.join(lists, keys).withColumn("block", F.pmod(salt, parts).cast("int"))
        return members, lambda visitors: visitors.join(lists, keys).withColumn("block", every)

    asked = index.where("anchor").groupBy("id").agg(F.min(F.struct("label", "dims", "vector")).alias("a")).select("id", "a.*")
    seeking = materialise(asked.withColumn("wants", F.array(F.struct(F.lit(int(LONG.max)).alias("ceiling"), F.lit(LEAST).alias("least")))), "anchors")
    by_label = materialise(index.groupBy("dims", "label", "cell").agg(F.count("*").alias("n")), "label-lists")
    members, to_blocks = in_blocks(by_label, ["dims", "label", "cell"])
    positive = search(seeking, cells, to_blocks, members, ["dims", "label", "cell", "block"], positives, "same", lambda _: LEAST)

    by_cell = index.sparkSession.createDataFrame([(int(r.dims), int(r.cell), int(r.n)) for r in sizes.itertuples()], "dims int, cell int, n long")
    members, to_blocks = in_blocks(by_cell, ["dims", "cell"])
    p = F.col("score")
    # percent / 100 * p, rounded up, without a product that overflows
    least = F.expr("score div 100") * percent + F.ceil(p % 100 * percent / 100).cast("long")
    windows = positive.where(p >= 0).groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct(p.alias("ceiling"), least.alias("least")))).alias("wants"))
    negative = search(materialise(seeking.drop("wants").join(windows, "id"), "windows"), cells, to_blocks, members, ["dims", "cell", "block"], negatives, "other", floor)
    chosen = positive.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("ceiling"))
    out = chosen.join(negative.select("anchor_id", "ceiling", "id", "score", "rank"), ["anchor_id", "ceiling"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("ceiling").alias("positive_score"), F.col("score").alias("negative_score"))
