"""The register: latest sheets of two issues, reconciled by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillset.functions.numbers import compare_revisions, normalise_number, parse_revision

ATTENTION = ("unidentified", "unreadable", "same_rev_different_file", "removed", "in_list_not_in_folder")
COMPARABLE = ("revised", "same_rev_different_file", "status_change")
PARTIAL_RATIO = 0.6


def latest_per_number(sheets: DataFrame) -> DataFrame:
    """One row for each (side, number): of equal contents the first path, then the highest revision, then the last path."""
    known = sheets.where(F.col("drawing_no").isNotNull() & F.col("is_readable")).withColumns({"number_key": normalise_number(F.col("drawing_no")), "rev": parse_revision(F.col("revision"))})
    same = Window.partitionBy("side", "number_key", F.coalesce("content_hash", F.concat(F.lit("path:"), "abs_path"))).orderBy("abs_path")
    copies = known.withColumn("copy", F.row_number().over(same))
    best = Window.partitionBy("side", "number_key").orderBy(F.col("copy") > 1, F.desc(F.coalesce("rev.ordinal", F.lit(-1))), F.desc("abs_path"))
    every = Window.partitionBy("side", "number_key")
    ranked = copies.withColumns({"rank": F.row_number().over(best), "n_duplicates": F.sum((F.col("copy") > 1).cast("long")).over(every), "n_superseded": F.sum((F.col("copy") == 1).cast("long")).over(every) - 1})
    return ranked.where("rank = 1").drop("copy", "rank")


def status(old: Column, new: Column, issue: str) -> Column:
    """Status of a number from the latest old and new sheets (null where missing)."""
    moved = compare_revisions(old["rev"], new["rev"])
    gone = {"full": "removed"}.get(issue, "not_reissued")
    return (
        F.when(old.isNull(), "new")
        .when(new.isNull(), gone)
        .when(moved == "status_change", "status_change")
        .when(moved.isin("newer", "older"), "revised")
        .when(F.coalesce(old["content_hash"] == new["content_hash"], F.lit(False)), "unchanged")
        .otherwise("same_rev_different_file")
    )


def reconcile(sheets: DataFrame, issue: str = "full", drawing_list: DataFrame | None = None) -> DataFrame:
    """Register rows: number_key, drawing_no, status, old_revision, new_revision, old_path, new_path, is_older, in_list, needs_attention.

    The full outer match of both sides' latest sheets, of which each number has at most one
    a side, is one aggregation by number, so the sheets are read and ranked once; sheets without number (or not
    readable) are rows of their own; with a list, numbers on it alone are added and new
    numbers off it are marked.
    """
    keep = F.struct("drawing_no", "revision", "rev", "content_hash", "abs_path")
    latest = latest_per_number(sheets)
    o, n = F.col("o"), F.col("n")
    both = latest.groupBy("number_key").agg(*(F.max(F.when(F.col("side") == side, keep)).alias(name) for side, name in (("old", "o"), ("new", "n"))))
    rows = both.select(
        "number_key", F.coalesce("n.drawing_no", "o.drawing_no").alias("drawing_no"), status(o, n, issue).alias("status"),
        F.col("o.revision").alias("old_revision"), F.col("n.revision").alias("new_revision"), F.col("o.abs_path").alias("old_path"), F.col("n.abs_path").alias("new_path"),
        F.coalesce(compare_revisions(o["rev"], n["rev"]) == "older", F.lit(False)).alias("is_older"),
    )
    rows = rows.withColumn("in_list", F.lit(None).cast("boolean"))
    if drawing_list is not None:
        wanted = drawing_list.select(normalise_number(F.col("drawing_no")).alias("number_key"), F.col("drawing_no").alias("list_no"), "row_number")
        wanted = wanted.groupBy("number_key").agg(F.min_by("list_no", "row_number").alias("list_no"))
        joined = rows.drop("in_list").join(wanted, "number_key", "left").withColumn("in_list", F.col("list_no").isNotNull()).drop("list_no")
        rows = joined.withColumn("status", F.when((F.col("status") == "new") & ~F.col("in_list"), "in_folder_not_in_list").otherwise(F.col("status")))
        missing = list_missing(sheets, drawing_list)
        rows = rows.unionByName(missing.select("number_key", F.col("drawing_no"), F.lit("in_list_not_in_folder").alias("status"), F.lit(True).alias("in_list"), F.lit(False).alias("is_older")), allowMissingColumns=True)
    path = F.col("abs_path")
    loose = sheets.where(F.col("drawing_no").isNull() | ~F.col("is_readable")).select(
        F.lit(None).cast("string").alias("number_key"), F.lit(None).cast("string").alias("drawing_no"), F.when(F.col("is_readable"), "unidentified").otherwise("unreadable").alias("status"),
        F.when(F.col("side") == "old", F.col("revision")).alias("old_revision"), F.when(F.col("side") == "new", F.col("revision")).alias("new_revision"),
        F.when(F.col("side") == "old", path).alias("old_path"), F.when(F.col("side") == "new", path).alias("new_path"), F.lit(False).alias("is_older"), F.lit(None).cast("boolean").alias("in_list"),
    )
    return rows.unionByName(loose).withColumn("needs_attention", F.col("status").isin(*ATTENTION))


def list_missing(sheets: DataFrame, drawing_list: DataFrame) -> DataFrame:
    """List numbers that neither side has: an anti-join; of repeated numbers the first row."""
    have = sheets.where(F.col("drawing_no").isNotNull() & F.col("is_readable")).select(normalise_number(F.col("drawing_no")).alias("number_key"))
    listed = drawing_list.withColumn("number_key", normalise_number(F.col("drawing_no"))).groupBy("number_key").agg(F.min_by("drawing_no", "row_number").alias("drawing_no"))
    return listed.join(have, "number_key", "left_anti")


def summary(register: DataFrame) -> DataFrame:
    """status, n: how many rows of each status, with attention and comparable totals as rows of their own."""
    counts = register.groupBy("status").agg(F.count("*").alias("n"))
    extra = register.agg(F.count_if("needs_attention").alias("a"), F.count_if(F.col("status").isin(*COMPARABLE)).alias("c"))
    totals = extra.select(F.explode(F.array(F.struct(F.lit("(attention)").alias("status"), F.col("a").alias("n")), F.struct(F.lit("(comparable)").alias("status"), F.col("c").alias("n")))).alias("t")).select("t.status", "t.n")
    return counts.unionByName(totals)


def issue_question(sheets: DataFrame) -> DataFrame:
    """One row: raw sheet counts and whether the new issue is so small that it may be partial."""
    n = sheets.agg(F.count_if(F.col("side") == "old").alias("old_count"), F.count_if(F.col("side") == "new").alias("new_count"))
    return n.withColumn("looks_partial", (F.col("old_count") > 0) & (F.col("new_count") < F.col("old_count") * PARTIAL_RATIO))


def dominant_scheme(sheets: DataFrame) -> DataFrame:
    """side, scheme: the most frequent known revision scheme; ties by name."""
    known = sheets.withColumn("scheme", parse_revision(F.col("revision"))["scheme"]).where("scheme <> 'unknown'").groupBy("side", "scheme").agg(F.count("*").alias("n"))
    best = Window.partitionBy("side").orderBy(F.desc("n"), "scheme")
    return known.withColumn("r", F.row_number().over(best)).where("r = 1").select("side", "scheme", "n")


def grid(register: DataFrame, *, status: str | None = None, attention_only: bool = False, search: str | None = None, by: str = "drawing_no") -> DataFrame:
    """The register for review: rows of a status, those that need attention, those whose number or title contains a text (any case); attention first, then by a column."""
    out = register if status is None else register.where(F.col("status") == status)
    if attention_only:
        out = out.where("needs_attention")
    if search:
        hit = F.lit(False)
        for c in ("drawing_no", "title", "note"):
            if c in out.columns:
                hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(search.lower())), F.lit(False))
        out = out.where(hit)
    return out.orderBy(F.desc("needs_attention"), F.asc_nulls_last(by))


def ordered(register: DataFrame) -> DataFrame:
    """The register's own order: what needs attention, then by number in code-point order."""
    return grid(register)


def summary_sentence(counts: DataFrame) -> DataFrame:
    """One row with a sentence of the counts (status, n), in the order in which a reader asks for them."""
    order = ("revised", "new", "removed", "not_reissued", "unchanged", "status_change", "same_rev_different_file", "in_list_not_in_folder", "in_folder_not_in_list", "unidentified", "unreadable")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.concat_ws(" ", F.col("n").cast("string"), F.replace(F.col("status"), F.lit("_"), F.lit(" "))).alias("t")))), lambda x: x["t"])
    return counts.where("n > 0").agg(F.concat(F.array_join(parts, ", "), F.lit(".")).alias("sentence"))
