"""Shards by a k-d tree over metadata: nodes are split at weighted medians along their widest dimension.

Every document is a point: one coordinate of COORDINATE bits for each dimension (hashes of
strings, logarithms of numbers between the smallest and the largest), and its size is its
weight. Equal texts share a point, that of the least value of each dimension among them.
A node that is to become k leaves is cut where k // 2 of k parts of its bytes lie below,
along the dimension in which its points span most.

Cuts go through a key: coordinate, hash of the text, hash of the id. The median is found by
digits of DIGIT bits: a histogram for all nodes of a level at once (bytes by node and digit,
summed before the shuffle), then one within the digit's bin that the median falls into,
until that bin has at most ``slack`` of a leaf's bytes. Nothing is sorted. As the text's hash
comes before the id's, a cut goes through a group of equal texts only where that group is
heavier than the slack.

Each level reads a table of some 60 bytes a document three or four times. The driver holds one row a
node, and tasks are sent the level's cuts: both are bounded by the number of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quillset.storage import materialise

COORDINATE, DIGIT, DIGITS = 10, 10, 4
TAIL = DIGIT * DIGITS
#: Rows of a shard's part that is numbered at once, and parts of a shard at least.
PART_ROWS, PARTS = 200_000, 32


def bits(seed: int, *of: Column) -> Column:
    """A hash of 2 * DIGIT bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 64 - 2 * DIGIT)


def points(docs: DataFrame, dims: list[str], text: str, id_: str) -> DataFrame:
    """(doc_id, size, text_crc32, c0, c1, ..., tail): a row for each document."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    numeric = {d for d in dims if isinstance(docs.schema[d].dataType, NumericType)}
    value = lambda d: F.col(d).cast("double") if d in numeric else F.col(d).cast("string")
    known = docs.select(
        F.col(id_).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("h"), *(value(d).alias(f"d{i}") for i, d in enumerate(dims)))
    known = materialise(known, "sizes")
    shared = known.groupBy("h").agg(*(F.min(f"d{i}").alias(f"d{i}") for i in range(len(dims))))
    high = (1 << COORDINATE) - 1
    # NaN counts as the largest number, so the span is of the others
    size = {i: F.signum(f"d{i}") * F.log2(1 + F.abs(F.col(f"d{i}"))) for i, d in enumerate(dims) if d in numeric}
    finite = {i: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) for i, v in size.items()}
    spans = shared.agg(F.lit(0), *(f(v) for v in finite.values() for f in (F.min, F.max))).first()
    placed = []
    for i in range(len(dims)):
        if i in size:
            k = 1 + 2 * list(size).index(i)
            low, top = spans[k] or 0.0, spans[k + 1] or 0.0
            c = F.least(F.greatest((size[i] - low) / max(top - low, 1e-9), F.lit(0.0)), F.lit(1.0)) * high
        else:
            c = F.when(F.col(f"d{i}").isNotNull(), F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col(f"d{i}")), 64 - COORDINATE))
        placed.append(F.coalesce(F.floor(c), F.lit(0)).cast("int").alias(f"c{i}"))
    tail = F.shiftleft(bits(6, F.col("h")), 2 * DIGIT) + bits(7, F.col("doc_id").cast("string"))
    group = shared.select("h", *placed)
    return known.select("doc_id", "size", "text_crc32", "h").join(group, "h").select("doc_id", "size", "text_crc32", *(f"c{i}" for i in range(len(dims))), tail.alias("tail"))


def medians(rows: DataFrame, nodes: dict[int, dict], slack: float) -> dict[int, int]:
    """The cut of each node: keys below it go left. nodes: dim, ideal (bytes to the left), of each node to split; rows: node, size, key."""
    spark = rows.sparkSession
    cuts: dict[int, int] = {}
    open_ = {node: {"prefix": 0, "below": 0} for node in nodes}
    for shift in range(TAIL, -1, -DIGIT):
        known = spark.createDataFrame([(node, s["prefix"], float(nodes[node]["ideal"] - s["below"])) for node, s in open_.items()], "node int, prefix long, ideal double")
        within = rows.join(F.broadcast(known), "node")
        if shift < TAIL:
            within = within.where(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
        bins = within.groupBy("node", "ideal", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes"))
        order = Window.partitionBy("node").orderBy("bin")
        reached = bins.withColumn("up_to", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # the first bin that reaches the ideal
        crossing = reached.where((F.col("up_to") >= F.col("ideal")) & (F.col("up_to") - F.col("bytes") < F.col("ideal")))
        for r in crossing.collect():
            if shift == 0 or r.bytes <= slack:
                start, end = r.up_to - r.bytes, r.up_to
                cuts[r.node] = (r.bin + (r.ideal - start > end - r.ideal)) << shift
                del open_[r.node]
            else:
                open_[r.node] = {"prefix": r.bin, "below": open_[r.node]["below"] + r.up_to - r.bytes}
        if not open_:
            break
    return cuts


def shard_documents(docs: DataFrame, *, shards: int | None = 8, target_bytes: int | None = None, dims: tuple[str, ...] = ("lang", "source", "n_chars"), slack: float = 0.01, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``: leaves of a k-d tree over ``dims``, numbered from 0.

    size is the UTF-8 length of the text plus one. There are ``shards`` leaves, or as many as
    hold ``target_bytes`` each; their sizes are as near to each other as the largest document and
    ``slack`` of a leaf at each level allow. slot numbers the rows of a shard from 0 without a gap, in the
    order of a hash. Rows of equal texts share a shard unless their bytes exceed the slack and a
    cut falls on them. A null text is empty; a null among ``dims`` is the smallest value; null and
    repeated ids are rows like others (equal rows may swap slots). Empty and very long texts are points
    like others. Further columns are ignored; an empty table gives an empty table.
    """
    where = materialise(points(docs, list(dims), text, id).withColumn("node", F.lit(0)), "points")
    total, n = where.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    leaves = shards if target_bytes is None else max(1, -(-total // target_bytes))
    slack_bytes = slack * total / leaves
    c = [f"c{i}" for i in range(len(dims))]
    # node -> (first leaf, leaves); children are numbered onwards, and a node of one leaf is done
    tree, last = {0: (0, leaves)}, 0
    while n and any(k > 1 for _, k in tree.values()):
        split = {node: v for node, v in tree.items() if v[1] > 1}
        spans = where.groupBy("node").agg(F.sum("size").alias("bytes"), F.array(*(F.max(x) - F.min(x) for x in c)).alias("spans")).collect()
        nodes = {r.node: {"dim": r.spans.index(max(r.spans)), "ideal": r.bytes * (split[r.node][1] // 2) / split[r.node][1]} for r in spans if r.node in split}
        chosen = where.sparkSession.createDataFrame([(node, v["dim"]) for node, v in nodes.items()], "node int, dim int")
        along = F.shiftleft(F.element_at(F.array(*c), F.col("dim") + 1).cast("long"), TAIL) + F.col("tail")
        cuts = medians(where.join(F.broadcast(chosen), "node").select("node", "size", along.alias("key")), nodes, slack_bytes)
        rows, grown = [], {node: v for node, v in tree.items() if v[1] == 1}
        for node, (first, k) in split.items():
            if node in cuts:
                rows.append((node, nodes[node]["dim"], cuts[node], last + 1, last + 2))
                grown |= {last + 1: (first, k // 2), last + 2: (first + k // 2, k - k // 2)}
                last += 2
        tree = grown
        cut = where.sparkSession.createDataFrame(rows, "node int, dim int, cut long, low int, high int")
        side = F.coalesce(F.when(along < F.col("cut"), F.col("low")).otherwise(F.col("high")), F.col("node"))
        where = materialise(where.join(F.broadcast(cut), "node", "left").select("doc_id", "size", "text_crc32", *c, "tail", side.alias("node")), "points")
    numbered = where.sparkSession.createDataFrame([(node, first) for node, (first, _) in tree.items()], "node int, shard int")
    return slots(where.join(F.broadcast(numbered), "node").select("doc_id", "size", "text_crc32", "shard"), n, leaves)


def slots(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``rows`` with a slot, numbered within parts of a shard from where the parts before end."""
    parts = max(PARTS, -(-n // (PART_ROWS * shards)))
    h = F.xxhash64(F.lit(8), F.col("doc_id").cast("string"), "text_crc32", "size")
    dealt = rows.withColumn("h", h).withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "doc_id", "text_crc32", "size"))
    ranked = dealt.withColumn("n", within).join(starts, ["shard", "part"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("n") - 1).alias("slot"))
