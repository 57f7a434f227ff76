"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

1. Each text's distinct shingles give a set size, a 128-bit fingerprint of the set, 16 x 8
   minimum hashes and a 2-bit sketch of all 128. Texts with equal sets are collapsed to
   the smallest doc_id.
2. Forest: every tree orders the signatures by its own 8 values. All trees are sorted in
   one range shuffle whose last sort column is the id, so a run of equal signatures,
   however long, spreads over tasks. Each row meets the next WINDOW rows that share at
   least the least depth; a pair is a candidate if its sketches agree enough. In a sparse
   region the window spans the whole bucket; in a crowded one it holds those with the
   longest common prefix, rows that agree in all 8 values meet beyond the window, too, and the region's
   rows go through CROWD_TREES further trees, of other choices among their 128 values, in
   which full agreement is asked. Only a spanning set of candidate links leaves a task.
3. The candidate graph's components hold the candidates. In each, full sets are compared
   with the smallest member's in salted blocks; texts not linked to it meet all others
   whose sketches agree enough.
4. Components of the confirmed links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillset.operators.graph import components
from quillset.llm.groups import bounds, local_roots, map_sorted_groups
from quillset.storage import materialise
from quillset.llm.textkernel import U64, Poly, as_binary, distinct, flat, from_binary, mix, shingles, slices, words

TREES, DEPTH, CROWD_TREES = 16, 8, 32
#: Rows that a row meets in its region; regions with more are crowded.
WINDOW = 32
#: Rows of the sorted trees that a task holds, about.
FOREST_ROWS = 2_000_000
#: Texts of a candidate group that one task compares.
BLOCK = 400


def least_depth(percent: int) -> int:
    """Leading values that a pair must share: as many as leave a pair at the limit unseen in all trees with a chance under 5e-5."""
    j = percent / 100
    return max([1, *(d for d in range(1, DEPTH) if (1 - j**d) ** TREES < 5e-5)])


def sketch_match(percent: int) -> int:
    """Agreement out of 128 that a pair's sketches need: 4.75 standard deviations under what similarity ``percent`` gives."""
    q = percent / 100 + (1 - percent / 100) / 4
    return int(128 * q - 4.75 * (128 * q * (1 - q)) ** 0.5)


def set_rows(batch: pa.RecordBatch, size: int, poly: Poly) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a batch with a text column: (first row, past row, text index, distinct shingle hash)."""
    data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        doc, _, _, word = words(part, offsets[a : b + 1] - offsets[a], poly)
        doc, value = shingles(doc, word, size, True, b - a)
        yield a, b, *distinct(doc, value)


def fingerprints(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits of each set (order-free sums of mixed hashes), as two columns."""
    return np.stack([np.add.reduceat(mix(value ^ U64(s)), starts) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], axis=1)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, fp, mins, bits): mins are 128 16-bit values, bits their sketch."""
    multipliers = np.random.default_rng(77).integers(1 << 40, 1 << 62, TREES * DEPTH, dtype=np.int64).astype(U64) * U64(2) + U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Poly(11)
        for batch in batches:
            n = batch.num_rows
            count, fp, mins = np.zeros(n, np.int64), np.zeros((n, 2), U64), np.zeros((n, TREES * DEPTH), np.uint16)
            for a, _, doc, value in set_rows(batch, size, poly):
                if not len(doc):
                    continue
                cut = bounds(doc)
                rows, starts = a + doc[cut[:-1]], cut[:-1]
                count[rows] = np.diff(cut)
                fp[rows] = fingerprints(value, starts)
                for j, m in enumerate(multipliers):
                    mins[rows, j] = (mix(np.minimum.reduceat(value * m, starts)) & U64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), as_binary(fp), as_binary(mins), as_binary(sketch(mins))], ["doc_id", "n_shingles", "fp", "mins", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, fp binary, mins binary, bits binary")


def sketch(mins: np.ndarray) -> np.ndarray:
    """Two bit planes of 128 bits each, as 4 64-bit numbers."""
    value = mins.astype(np.uint32) * np.uint32(0x9E3779B1)
    planes = [np.packbits((value >> np.uint32(k)) & np.uint32(1), axis=1) for k in (20, 27)]
    return np.concatenate(planes, axis=1)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of 128 values two rows of sketches (4 64-bit numbers each) agree in."""
    unlike = a ^ b
    return 128 - np.bitwise_count(unlike[..., :2] | unlike[..., 2:]).sum(axis=-1).astype(np.int64)


def tree_rows(reps: DataFrame, crowded: bool) -> DataFrame:
    """A row for each text and tree: (tree, key, bits, id). ``crowded``: the further trees."""
    picks = np.arange(TREES * DEPTH).reshape(TREES, DEPTH)
    if crowded:
        rng = np.random.default_rng(78)
        picks = np.stack([rng.choice(TREES * DEPTH, DEPTH, replace=False) for _ in range(CROWD_TREES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bits = batch.column(0), batch.column(2)
            mins = from_binary(batch.column(1), np.uint16, TREES * DEPTH)
            for t, pick in enumerate(picks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), as_binary(mins[:, pick].astype(">u2")), bits, ids], ["tree", "key", "bits", "id"])

    return reps.select("id", "mins", "bits").mapInArrow(run, "tree int, key binary, bits binary, id long")


FOUND = "src long, dst long, tree int, key binary, bits binary"


def run_links(bits: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a run whose sketches agree enough, a block of rows at a time."""
    left, right = [], []
    step = max(1, 500_000 // len(bits))
    for a in range(0, len(bits), step):
        i, j = np.nonzero(agreement(bits[a : a + step, None], bits[None, a:]) >= least)
        left.append((a + i)[i < j])
        right.append((a + j)[i < j])
    return np.concatenate(left), np.concatenate(right)


def neighbours(depth: int, least: int):
    """Of a sorted partition: spanning candidate links (src, dst), the rows at its two ends (tree, key, bits of src), and the crowded rows (src alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        tree, ids = table["tree"].to_numpy(), table["id"].to_numpy()
        key = from_binary(table["key"], ">u2", DEPTH)
        bits = from_binary(table["bits"], np.uint64, 4)
        n = len(ids)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w in range(1, min(WINDOW, n - 1) + 1):
            i = np.flatnonzero((tree[w:] == tree[:-w]) & (key[w:, :depth] == key[:-w, :depth]).all(axis=1))
            if not len(i):
                break
            i = i[agreement(bits[i], bits[i + w]) >= least]
            left.append(i)
            right.append(i + w)
        root = local_roots(n, np.concatenate(left), np.concatenate(right))
        cut = bounds(tree, *key.T)
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if e - s > WINDOW + 1 and (root[s:e] != root[s]).any():
                i, j = run_links(bits[s:e], least)
                left.append(s + i)
                right.append(s + j)
        root = local_roots(n, np.concatenate(left), np.concatenate(right))
        child = np.flatnonzero(root != np.arange(n))
        edge = np.unique(np.concatenate([np.arange(min(WINDOW, n)), np.arange(max(n - WINDOW, 0), n)]))
        region = bounds(tree, *key[:, :depth].T)
        size = np.diff(region)
        crowd = np.unique(ids[np.repeat(size > WINDOW, size)])
        nothing = lambda m: (pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()))
        names = ["src", "dst", "tree", "key", "bits"]
        yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]]), *nothing(len(child))], names)
        at = pa.array(edge)
        yield from table.select(["id", "tree", "key", "bits"]).take(at).rename_columns(["src", "tree", "key", "bits"]).add_column(1, "dst", pa.nulls(len(edge), pa.int64())).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array(crowd), pa.nulls(len(crowd), pa.int64()), *nothing(len(crowd))], names)

    return run


def forest(reps: DataFrame, n: int, depth: int, least: int, crowded: bool) -> DataFrame:
    """Candidate links, and src alone for rows of crowded regions. The rows at the partitions' ends meet in a second, small pass."""
    n = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // FOREST_ROWS)
    rows = tree_rows(reps, crowded).repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = materialise(rows.mapInArrow(neighbours(depth, least), FOUND), "forest")
    ends = found.where("key is not null").select("tree", "key", "bits", F.col("src").alias("id"))
    across = ends.repartition("tree").sortWithinPartitions("tree", "key", "id").mapInArrow(neighbours(depth, least), FOUND)
    return found.where("key is null").select("src", "dst").unionAll(across.where("dst is not null").select("src", "dst"))


def candidate_links(reps: DataFrame, percent: int) -> DataFrame:
    """Links between texts that may be similar; reps: (id, mins, bits)."""
    least = sketch_match(percent)
    first = materialise(forest(reps, TREES * reps.count(), least_depth(percent), least, False), "candidates")
    crowd = reps.join(first.where("dst is null").select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    links = first.where("dst is not null")
    many = first.where("dst is null").select("src").distinct().count()
    if many:
        links = links.unionAll(forest(crowd, CROWD_TREES * many, DEPTH, least, True).where("dst is not null"))
    return links.distinct()


def sets_of(members: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """members (id, fp, ...) with their sorted distinct shingle hashes."""
    extra = [c for c in members.columns if c not in ("id", "fp")]
    joined = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(members, "id").select("text", "id", "fp", *extra)
    kinds = dict(members.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Poly(11)
        for batch in batches:
            for a, b, doc, value in set_rows(batch, size, poly):
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                full = np.flatnonzero(np.diff(cut) > 0)
                fp = np.zeros((b - a, 2), U64)
                if len(full):
                    fp[full] = fingerprints(value, cut[:-1][full])
                part = batch.slice(a, b - a)
                same = pc.equal(as_binary(fp), part.column(2))
                values = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], values], [*part.schema.names[1:], "set"]).filter(same)

    return joined.mapInArrow(run, ", ".join(["id long", "fp binary", *(f"{c} {kinds[c]}" for c in extra), "set binary"]))


def common(query: np.ndarray, values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Size of the intersection of one set with each of several (concatenated, cut)."""
    at = np.searchsorted(query, values)
    at[at == len(query)] = 0
    hits = np.concatenate([[0], np.cumsum(query[at] == values)])
    return hits[cut[1:]] - hits[cut[:-1]]


def block_links(percent: int, among: bool):
    """Links within a block of a candidate group: visitors (role 1) against members (role 0); members that stay apart among themselves if ``among``."""
    least = sketch_match(percent)

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cluster, block = table["cluster"].to_numpy(), table["block"].to_numpy()
        ids, role, comp = table["id"].to_numpy(), table["role"].to_numpy(), table["comp"].to_numpy()
        bits = from_binary(table["bits"], np.uint64, 4)
        data, offsets = flat(table["set"])
        values = np.frombuffer(data.tobytes(), U64)
        offsets = offsets // 8
        out_a, out_b = [], []
        cuts = bounds(cluster, block)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s < 2:
                continue
            local, mine = values[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]
            sizes = np.diff(mine)
            group = np.unique(comp[s:e], return_inverse=True)[1]
            members = np.flatnonzero(role[s:e] == 0)

            def meet(i: int, group=group, sizes=sizes, local=local, mine=mine, members=members, s=s) -> None:
                near = members[(group[members] != group[i]) & (100 * np.minimum(sizes[members], sizes[i]) >= percent * np.maximum(sizes[members], sizes[i]))]
                near = near[agreement(bits[s + near], bits[s + i]) >= least]
                if not len(near):
                    return
                span = mine[near + 1] - mine[near]
                cut = np.concatenate([[0], np.cumsum(span)])
                picked = local[np.repeat(mine[near] - cut[:-1], span) + np.arange(cut[-1])]
                inter = common(local[mine[i] : mine[i + 1]], picked, cut)
                linked = near[100 * inter >= percent * (sizes[near] + sizes[i] - inter)]
                for g in np.unique(group[linked]):
                    out_a.append(ids[s + i])
                    out_b.append(ids[s + linked[group[linked] == g][0]])
                    group[group == g] = group[i]

            for i in np.flatnonzero(role[s:e] == 1):
                meet(i)
            if among:
                lead = group[np.flatnonzero(role[s:e] == 1)] if (role[s:e] == 1).any() else np.zeros(0, int)
                for i in members:
                    if group[i] not in lead:
                        meet(i)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["src", "dst"])

    return compare


def confirmed_links(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (src, dst) that the full sets confirm, enough to join all that are linked; members: (id, fp, bits, cluster)."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sets = materialise(sets_of(placed, docs, size), "sets")
    lead = sets.where("id = cluster").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["cluster", "block", "id", "role", "comp", "bits", "set"]
    first = sets.where("id <> cluster").withColumns({"role": F.lit(0), "comp": F.col("id")}).select(columns).unionAll(lead.withColumns({"role": F.lit(1), "comp": F.col("id")}).select(columns))
    links = materialise(map_sorted_groups(first, ["cluster", "block"], ["id"], block_links(percent, True), "src long, dst long"), "confirmed")
    large = sets.where("blocks > 1")
    if large.limit(1).count():
        known = components(links)
        named = large.join(known.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        apart = named.where("comp <> cluster").withColumn("home", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> home")
        if apart.limit(1).count():
            second = named.withColumn("role", F.lit(0)).select(columns).unionAll(apart.withColumn("role", F.lit(1)).select(columns))
            links = links.unionAll(map_sorted_groups(second, ["cluster", "block"], ["id"], block_links(percent, False), "src long, dst long"))
    return links


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    A text's set holds the distinct runs of ``shingle`` words (A-Z lower-cased; words are
    runs of anything but 0x20 and 0x09-0x0D), or its whole sequence if it has fewer. Two
    texts are linked if 100 * common >= percent * united; an empty set links with nothing.
    component_id is the smallest doc_id that links reach, kept marks it. Rows that share a
    doc_id are kept or dropped together; a row without doc_id has a null component and is
    kept. Null texts have an empty set; texts of any length are read whole. Further columns,
    whatever their names, are ignored. An empty table gives an empty table.
    """
    signed = materialise(signatures(docs, shingle), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = materialise(full.groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("mins").alias("mins"), F.first("bits").alias("bits")), "distinct-sets")
    clusters = components(candidate_links(reps, percent))
    members = reps.select("id", "fp", "bits").join(clusters.withColumnRenamed("component", "cluster"), "id")
    found = components(confirmed_links(members, docs, shingle, percent))
    named = reps.select("fp", F.col("id").alias("rep")).join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "fp").join(named, (signed.fp == named.fp) & (signed.n_shingles > 0) & signed.doc_id.isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
