"""Stored changes: noise filters that keep their reasons, queries, statistics, triage, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillset.operators.compare import box_classes, boxes, overlapping
from quillset.storage import exists, materialise, remove


def style_collapse(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): two or more cosmetic changes of a pair and kind become one that spans them."""
    w = Window.partitionBy("pair_id", "kind")
    many = changes.where("is_cosmetic").withColumn("n", F.count("*").over(w))
    suppressed = many.where("n >= 2").select("pair_id", "change_id", F.lit("style_collapse").alias("filter_name"), F.concat_ws(" ", F.lit("one of"), F.col("n").cast("string"), F.lit("alike")).alias("reason"))
    merged = many.where("n >= 2").groupBy("pair_id", "kind").agg(
        F.min("change_id").alias("change_id"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.count("*").alias("merged")
    )
    single = many.where("n < 2").unionByName(changes.where("not is_cosmetic"), allowMissingColumns=True).select("pair_id", "kind", "change_id", "x", "y", "w", "h", F.lit(1).cast("long").alias("merged"))
    return single.unionByName(merged), suppressed


def background_collapse(changes: DataFrame, sheet_area: float, share: float = 0.15) -> DataFrame:
    """Per pair: how many boxes cover at least ``share`` of the sheet, and the box around them."""
    large = changes.where(F.col("w") * F.col("h") >= share * sheet_area)
    return large.groupBy("pair_id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


def load_changes(changes: DataFrame, *, pair_id: int | None = None, streams: tuple[str, ...] = (), kind: str | None = None, category: str | None = None, include_cosmetic: bool = False) -> DataFrame:
    """Changes by the filters given, cosmetic ones hidden by default; the filters reach the scan."""
    out = changes if include_cosmetic else changes.where(~F.col("is_cosmetic"))
    for column, value in (("pair_id", pair_id), ("kind", kind), ("category", category)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if streams:
        out = out.where(F.col("stream").isin(*streams))
    return out.orderBy(F.desc("confidence"), "change_id")


def change_statistics(changes: DataFrame) -> DataFrame:
    """facet, value, n: totals and counts by kind, category and stream, from one pass over grouping sets."""
    sets = changes.groupingSets([[], [F.col("kind")], [F.col("category")], [F.col("stream")], [F.col("is_cosmetic")]], F.col("kind"), F.col("category"), F.col("stream"), F.col("is_cosmetic")).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 7, "kind").when(F.col("g") == 11, "category").when(F.col("g") == 13, "stream").when(F.col("g") == 14, "is_cosmetic").otherwise("total")
    return sets.select(facet.alias("facet"), F.coalesce("kind", "category", "stream", F.col("is_cosmetic").cast("string"), F.lit("all")).alias("value"), "n")


def filtered_by_reason(suppressed: DataFrame) -> DataFrame:
    return suppressed.groupBy("filter_name").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("pairs"))


def triage(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """changes with user_status: the latest decision (by seq) of each, else open."""
    latest = decisions.groupBy("change_id").agg(F.max_by("user_status", "seq").alias("user_status"))
    return changes.join(latest, "change_id", "left").withColumn("user_status", F.coalesce("user_status", F.lit("open")))


def latest_runs(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("pair_id").orderBy(F.desc("started"), F.desc("run_id"))
    return runs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def save_changes(changes: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the pairs at hand and leave the others.

    Rows are dealt to ``buckets`` folders by their pair; those that hold a pair at hand are read, put together anew in the
    shared folder and then overwritten. A pair is cleared by clear_changes(); rows without pair_id are one more pair.
    """
    rows = changes.withColumn("bucket", F.pmod(F.xxhash64("pair_id"), F.lit(buckets)).cast("int"))
    replace_pairs(rows, rows.select("pair_id", "bucket").distinct(), path)


def clear_changes(pairs: DataFrame, path: str, buckets: int = 64) -> None:
    """Remove the changes of ``pairs`` (pair_id) from a folder of save_changes()."""
    gone = pairs.select("pair_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("pair_id"), F.lit(buckets)).cast("int"))
    replace_pairs(None, gone, path)


def replace_pairs(rows: DataFrame | None, pairs: DataFrame, path: str) -> None:
    """Write the buckets of ``pairs`` (pair_id, bucket) with ``rows`` in place of what these pairs had."""
    spark = pairs.sparkSession
    pairs = materialise(pairs, "pairs")
    if exists(spark, path):
        stored = spark.read.option("basePath", path).parquet(path)
        same = stored.alias("s").join(pairs.alias("p"), F.col("s.pair_id").eqNullSafe(F.col("p.pair_id")), "left_anti")
        left = same.join(pairs.select("bucket").distinct(), "bucket", "left_semi")
        rows = left if rows is None else rows.unionByName(left, allowMissingColumns=True)
    if rows is None:
        return
    # dynamic overwriting doesn't reach a bucket without rows; there are ``buckets`` at most
    rows = materialise(rows, "saved-changes")
    emptied = pairs.select("bucket").distinct().join(rows, "bucket", "left_anti")
    for bucket in [r.bucket for r in emptied.collect()]:
        remove(spark, f"{path}/bucket={bucket}")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def precision_recall(cases: DataFrame) -> DataFrame:
    """One row from (truth, reported) booleans: counts, precision and recall (1 where nothing was asked)."""
    hit = F.count_if(F.col("truth") & F.col("reported"))
    n = cases.agg(F.count_if("truth").alias("expected"), F.count_if("reported").alias("reported"), hit.alias("hits"))
    return n.withColumns({"precision": F.coalesce(F.try_divide("hits", "reported"), F.lit(1.0)), "recall": F.coalesce(F.try_divide("hits", "expected"), F.lit(1.0))})


def score_cases(reported: DataFrame, truth: DataFrame, least_iou: float = 0.3, least_inside: float = 0.6, cell: float = 256.0) -> DataFrame:
    """pair_id, expected, reported, matched, covered, false_positives, missed of each case.

    reported: pair_id, change_id (unique, in the order of the report), truth: pair_id, truth_id (unique), both with x, y, w, h.
    A report takes all planted changes that it meets (IoU, or share of the smaller box) and that none before it has
    taken; so a planted change belongs to the first report that meets it, which is a minimum over the met
    pairs. A report that gets none is a false positive. Cases may have rows on one side only. Equal boxes meet the
    same, and only the first report of a box can take, so boxes are joined once and count as often as they are there.
    """
    planted = materialise(box_classes(truth, "truth_id"), "planted-boxes")
    met = overlapping(boxes(planted, "l", "truth_id"), boxes(box_classes(reported, "change_id"), "r", "change_id"), cell, least_iou, least_inside)
    first = met.groupBy("pair_id", "l_id").agg(F.min("r_id").alias("taker")).join(planted.select("pair_id", F.col("truth_id").alias("l_id"), "n"), ["pair_id", "l_id"])
    hits = first.groupBy("pair_id").agg(F.count_distinct("taker").alias("matched"), F.sum("n").alias("covered"))
    sizes = truth.groupBy("pair_id").agg(F.count("*").alias("expected")).join(reported.groupBy("pair_id").agg(F.count("*").alias("reported")), "pair_id", "full_outer")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("expected", "reported", "matched", "covered")}
    rows = sizes.join(hits, "pair_id", "left").select("pair_id", *(v.alias(c) for c, v in n.items()))
    return rows.withColumns({"false_positives": F.col("reported") - F.col("matched"), "missed": F.col("expected") - F.col("covered")})


def score_matrix(cases: DataFrame) -> DataFrame:
    """One row over all score_cases(): sums, precision and recall of the sums (1 where nothing was asked), and the share of cases without any fault."""
    counts = ("expected", "reported", "matched", "covered", "false_positives", "missed")
    clean = (F.col("false_positives") == 0) & (F.col("missed") == 0)
    total = cases.agg(F.count("*").alias("cases"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts), F.coalesce(F.avg(clean.cast("double")), F.lit(1.0)).alias("clean_share"))
    one = F.lit(1.0)
    return total.withColumns({"precision": F.coalesce(F.try_divide("matched", "reported"), one), "recall": F.coalesce(F.try_divide("covered", "expected"), one)})
