"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one kept per group.

Equal vectors of a label are collapsed first. Cells are fitted per label on a bounded,
hash-ordered sample; every vector gets a home cell, and visits each lower-numbered cell
of its label whose border is within the margin (the distance to the plane between the
two centroids), so a pair is compared exactly once, in the lower of its two homes. Cells
that come out too large are cut again by k-means on a sample of their own, in tasks, so
the number of cells grows with the data and their size doesn't.

The margin: two linked vectors differ by at most r = sqrt(2 - 2 * cosine), so a margin of r
loses nothing. In many dimensions little of a difference lies along one border's normal,
about r / sqrt(dimensions); the margin is SIGMAS times that, and r where that is less. The
dimensions that count are the participation ratio of the sample's variances.

A cell is compared in blocks: a task holds one block of members and streams the members
of earlier blocks and the visitors past it. It emits a sum of links for each vector and a
spanning set of links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillset.operators.graph import components
from quillset.llm.groups import bounds, local_roots, map_sorted_groups
from quillset.storage import materialise
from quillset.llm.textkernel import as_binary, from_binary

#: Vectors that cells are fitted on, at most; and how many vectors a cell should hold.
SAMPLE, CELL_ROWS = 20_000, 1_000
#: Members of a cell that a task holds.
BLOCK = 1_024
#: Standard deviations of a linked pair's distance along a border's normal that the margin spans.
SIGMAS = 3.5
#: A cell of more than so many times CELL_ROWS is cut again.
TOO_LARGE = 4


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; safe for very large and small components."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids; an emptied cell takes the vector that is furthest from its own."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = x @ centre.T
        home = near.argmax(axis=1)
        total = np.stack([np.bincount(home, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        length = np.sqrt((total * total).sum(axis=1))
        empty = np.flatnonzero(length < 1e-12)
        if len(empty):
            total[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
            length = np.sqrt((total * total).sum(axis=1))
        centre = total / length[:, None]
    return centre


def margin_of(x: np.ndarray, cosine: float) -> float:
    """How far from a border a vector may be that has a link across it; x: a sample of unit vectors."""
    r = float(np.sqrt(max(2 - 2 * cosine, 0)))
    spread = np.linalg.eigvalsh(np.cov(x, rowvar=False)) if x.shape[1] > 1 and len(x) > 1 else np.ones(1)
    dimensions = spread.sum() ** 2 / max((spread**2).sum(), 1e-300)
    return min(r, SIGMAS * r / np.sqrt(max(dimensions, 1)))


def fit_cells(distinct: DataFrame, n: int, sample: int, cell_rows: int, cosine: float) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """(centroids, margin) by (label, dimensions), from at most ``sample`` vectors; labels the sample misses have one cell."""
    rows = distinct.orderBy(F.xxhash64("h1", F.lit(9)), "id").limit(sample).select("label", F.size("embedding").alias("dims"), "embedding").toPandas()
    cells = {}
    for (label, dims), part in rows.groupby(["label", "dims"], sort=True):
        k = min(round(n * len(part) / len(rows) / cell_rows), len(part) // 8)
        if k > 1:
            x = unit(np.stack(part["embedding"].to_numpy()))
            cells[label, int(dims)] = spherical_kmeans(x, k), margin_of(x, cosine)
    return cells


def place(x: np.ndarray, role: np.ndarray, centre: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, role): members (role 0) live in the nearest cell and visit the lower ones near by, visitors (1) visit all near ones."""
    who = np.arange(len(x))
    near = x @ centre.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 1e-18))
    border = (near[who, home][:, None] - near) / apart[home]
    cell = np.arange(len(centre))
    i, c = np.nonzero((border <= margin) & ((cell < home[:, None]) | (role[:, None] == 1) & (cell != home[:, None])))
    return np.concatenate([who, i]), np.concatenate([home, c]).astype(np.int32), np.concatenate([role, np.ones(len(i), role.dtype)])


def assign(distinct: DataFrame, cells: dict) -> DataFrame:
    """(label, dims, cell, sub, role, id, copies, vector): role 0 at home, 1 as a visitor."""
    shared = distinct.sparkSession.sparkContext.broadcast(cells)
    names = ["label", "dims", "cell", "sub", "role", "id", "copies", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, ids, copies = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            code = label.dictionary_encode()
            known, code = code.dictionary.to_pylist(), code.indices.to_numpy()
            lists = batch.column(3)
            dims = np.diff(np.asarray(lists.offsets))
            begin = np.asarray(lists.offsets)[:-1] - (lists.offsets[0].as_py() if len(lists) else 0)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((dims, code))
            cut = bounds(code[order], dims[order])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                rows = order[s:e]
                d = int(dims[rows[0]])
                x = unit(values[begin[rows][:, None] + np.arange(d)])
                who, cell, role = np.arange(len(rows)), np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
                if (known[code[rows[0]]], d) in shared.value:
                    who, cell, role = place(x, role, *shared.value[known[code[rows[0]]], d])
                r = rows[who]
                yield pa.RecordBatch.from_arrays([label.take(pa.array(r)), pa.array(dims[r].astype(np.int32)), pa.array(cell), pa.array(np.zeros(len(r), np.int32)), pa.array(role), pa.array(ids[r]), pa.array(copies[r]), as_binary(x[who])], names)

    columns = distinct.select("label", "id", "copies", F.col("embedding").cast("array<double>"))
    return columns.mapInArrow(run, CELL_SCHEMA)


CELL_SCHEMA = "label string, dims int, cell int, sub int, role int, id long, copies long, vector binary"
CELL = ["label", "dims", "cell"]


def cut_cells(rows: DataFrame, sample: int, cell_rows: int, cosine: float) -> DataFrame:
    """``rows`` of assign() with the cells of over TOO_LARGE * ``cell_rows`` members cut into sub-cells.

    Each such cell is fitted in one task, on about ``sample`` of its vectors; its rows are then
    placed in parts of bounded size, past which the fitted centroids come first.
    """
    sizes = rows.where("role = 0").groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") > TOO_LARGE * cell_rows)
    sizes = materialise(sizes, "large-cells")
    if not sizes.limit(1).count():
        return rows
    drawn = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("n")

    def fit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        code = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        cut = bounds(code, table["dims"].to_numpy(), table["cell"].to_numpy())
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            part = table.slice(int(s), int(e - s))
            x = from_binary(part["vector"], np.float64, part["dims"][0].as_py())
            k = max(1, min(round(part["n"][0].as_py() / cell_rows), len(x) // 8))
            blob = np.concatenate([[margin_of(x, cosine)], spherical_kmeans(x, k).ravel()])
            head = part.slice(0, 1).select([*CELL, "n"]).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in head.columns), as_binary(blob[None])], [*CELL, "n", "centres"])

    sampled = rows.where("role = 0").join(sizes, CELL).where(drawn).select(*CELL, "n", "vector")
    fitted = materialise(map_sorted_groups(sampled, CELL, [], fit, "label string, dims int, cell int, n long, centres binary"), "sub-cells")
    parts = F.ceil(F.col("n") / F.lit(50 * cell_rows)).cast("int")
    columns = [*CELL, "part", "role", "id", "copies", "vector"]
    large = rows.join(fitted.select(*CELL, "n"), CELL).withColumn("part", F.pmod(F.xxhash64("id", F.lit(13)), parts).cast("int"))
    heads = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*CELL, "part", F.lit(-1).alias("role"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("copies"), F.col("centres").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, margin = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            role = batch.column(4).to_numpy()
            # a head opens its cell's part; the rows after it are that part's
            cut = np.unique(np.concatenate([[0], np.flatnonzero(role == -1), np.flatnonzero(role == -1) + 1, [len(role)]]))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                d = batch.column(1)[int(s)].as_py()
                if role[s] == -1:
                    blob = np.frombuffer(batch.column(7)[int(s)].as_py(), np.float64)
                    margin, centre = float(blob[0]), blob[1:].reshape(-1, d)
                    continue
                part = batch.slice(int(s), int(e - s))
                x = from_binary(part.column(7), np.float64, d)
                who, sub, r = place(x, role[s:e], centre, margin)
                taken = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(sub), pa.array(r.astype(np.int32)), taken.column(5), taken.column(6), as_binary(x[who])], ["label", "dims", "cell", "sub", "role", "id", "copies", "vector"])

    keys = [*CELL, "part"]
    placed = large.select(columns).unionByName(heads.select(columns)).repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(run, CELL_SCHEMA)
    return rows.join(sizes, CELL, "left_anti").select("label", "dims", "cell", "sub", "role", "id", "copies", "vector").unionByName(placed)


class Block:
    """One block of a cell's members, which others stream past."""

    def __init__(self, cosine: float) -> None:
        self.cosine, self.x, self.ids, self.copies = cosine, [], [], []
        self.closed, self.out = False, []

    def close(self) -> None:
        self.closed = True
        self.x, self.ids, self.copies = (np.concatenate(v) if v else np.zeros(0) for v in (self.x, self.ids, self.copies))
        m = len(self.ids)
        linked = self.x @ self.x.T >= self.cosine if m else np.zeros((0, 0), bool)
        np.fill_diagonal(linked, False)
        self.links = linked @ self.copies if m else np.zeros(0, np.int64)
        self.root = local_roots(m, *np.nonzero(linked))

    def feed(self, role: int, x: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        if role == 0:
            self.x.append(x)
            self.ids.append(ids)
            self.copies.append(copies)
            return
        if not self.closed:
            self.close()
        m = len(self.ids)
        for a in range(0, len(ids), BLOCK):
            y, i, c = x[a : a + BLOCK], ids[a : a + BLOCK], copies[a : a + BLOCK]
            linked = y @ self.x.T >= self.cosine if m else np.zeros((len(i), 0), bool)
            if not linked.any():
                continue
            self.links = self.links + linked.T @ c
            v, w = np.nonzero(linked)
            root = local_roots(m + len(i), np.concatenate([np.arange(m), w]), np.concatenate([self.root, m + v]))
            self.root = root[:m]
            hit = np.flatnonzero(linked.any(axis=1))
            self.out.append((i[hit], (linked @ self.copies)[hit], self.ids[root[m + hit]]))

    def end(self) -> pa.RecordBatch:
        if not self.closed:
            self.close()
        hit = np.flatnonzero(self.links > 0)
        self.out.append((self.ids[hit], self.links[hit], self.ids[self.root[hit]]))
        i, n, r = (np.concatenate(v).astype(np.int64) for v in zip(*self.out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(n), pa.array(r)], ["id", "links", "root"])


def compare(placed: DataFrame, cosine: float) -> DataFrame:
    """(id, links, root) of each task; placed: rows of assign() with a block."""
    keys = [*CELL, "sub", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            numbers = {c: columns[c].to_numpy() for c in (*keys[1:], "role", "id", "copies")}
            code = columns["label"].dictionary_encode().indices.to_numpy()
            cut = bounds(code, *(numbers[c] for c in (*keys[1:], "role")))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                key = (columns["label"][int(s)].as_py(), *(int(numbers[c][s]) for c in keys[1:]))
                if key != at:
                    if block is not None:
                        yield block.end()
                    at, block = key, Block(cosine)
                block.feed(int(numbers["role"][s]), from_binary(columns["vector"].slice(s, e - s), np.float64, key[1]), numbers["id"][s:e], numbers["copies"][s:e])
        if block is not None:
            yield block.end()

    return placed.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(run, "id long, links long, root long")


def embedding_duplicates(vectors: DataFrame, *, cosine: float = 0.93, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels (of any type, and equally many components) are compared, by
    cosine in double precision; links are those found of at least ``cosine``. Vectors that
    are null, empty, zero or have null or non-finite components, and rows without vec_id, link with
    nothing and are kept. component_id is the smallest vec_id that links reach. Repeated
    rows count as separate vectors. Further columns, whatever their names, are ignored. An empty
    table gives an empty table.
    """
    e = F.col("embedding")
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~odd & F.exists(e, lambda v: v != 0)
    fine = F.coalesce(fine, F.lit(False))
    hashed = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), "embedding", fine.alias("fine")).withColumns({"h1": F.when(F.col("fine"), F.xxhash64("label", "embedding")), "h2": F.when(F.col("fine"), F.xxhash64(F.lit("second"), "embedding", "label"))})
    distinct = materialise(hashed.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "vectors")
    n = distinct.count()
    cells = fit_cells(distinct, n, sample, cell_rows, cosine) if n else {}
    rows = cut_cells(materialise(assign(distinct, cells), "cells"), sample, cell_rows, cosine)
    rows = materialise(rows, "placed")
    cell = [*CELL, "sub"]
    blocks = rows.where("role = 0").groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    known = rows.join(blocks, cell)
    own = F.pmod(F.xxhash64("id", F.lit(4)), F.col("blocks")).cast("int")
    homes = known.where("role = 0").withColumn("block", own)
    later = homes.where("block < blocks - 1").withColumns({"role": F.lit(1), "block": F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1))})
    visits = known.where("role = 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = materialise(compare(homes.unionByName(later).unionByName(visits), cosine), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    reps = distinct.select("h1", "h2", "id", "copies").join(links, "id", "left").join(groups, "id", "left")
    reps = reps.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = hashed.select("vec_id", "h1", "h2").join(reps, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
