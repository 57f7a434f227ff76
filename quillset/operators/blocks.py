"""Title blocks: zones, labels and the values beside them, and which reading of a number is believed.

items: sheet_id, item_id, text, fx, fy (fractions of the page, y up), fh.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillset.functions.numbers import find_numbers, is_plausible_number, normalise_number

# Where title blocks lie (x from, x to, y from, y to), words that only they have, labels from the most
# specific on, distances between a label and its value, shapes of a revision and words that look like one.
ZONES = {"bottom_right": (0.70, 1.0, 0.0, 0.35), "right": (0.75, 1.0, 0.0, 1.0), "bottom": (0.0, 1.0, 0.0, 0.20), "whole_sheet": (0.0, 1.0, 0.0, 1.0)}
BLOCK_WORDS = ("drawing", "dwg", "drg", "sheet", "document", "project", "rev", "revision", "scale", "date", "drawn", "checked", "approved", "title", "client", "consultant", "architect", "status")
NUMBER_LABELS = ("drawing no", "drawing number", "dwg no", "drg no", "sheet no", "document no")
TITLE_LABELS = ("drawing title", "sheet title", "title", "description")
BELOW, RIGHT, COLUMN, OFF_AXIS = 0.06, 0.18, 0.08, 4.0
WRAP_COLUMN, WRAP_GAP, WRAP_HEIGHT = 0.006, 1.8, 0.3
REVISION_PATTERNS = (r"\b(?:REV(?:ISION)?\.?\s*[:\-]?\s*)([A-Z]{1,2}\d{0,2})\b", r"\b([PCTS]\d{2})\b", r"\b(?:REV(?:ISION)?\.?\s*[:\-]?\s*)(\d{1,2})\b")
REVISION_SHAPE = r"^([A-Z]{1,2}\d{0,2}|\d{1,2})$"
REVISION_STOPWORDS = ("URGENT", "ISSUE", "DATE", "BY", "OF", "NO", "TO", "AS", "IN", "ON", "NTS")
CONFIDENCE = {"user": 1.0, "titleblock": 0.95, "zone": 0.75, "drawing_list": 0.7, "sheet_text": 0.6, "filename": 0.55}


def is_plausible_revision(text: Column) -> Column:
    t = F.btrim(F.upper(F.trim(text)), F.lit(".:-"))
    return (F.length(t) <= 4) & ~t.isin(*REVISION_STOPWORDS) & t.rlike(REVISION_SHAPE)


def find_revision(text: Column) -> Column:
    """The first plausible revision of the first pattern that has one; null if none has."""
    upper = F.upper(text)
    return F.coalesce(*(F.get(F.filter(F.regexp_extract_all(upper, F.lit(p), F.lit(1)), is_plausible_revision), 0) for p in REVISION_PATTERNS))


def is_plausible_title(text: Column) -> Column:
    t = F.trim(text)
    return F.length(t).between(3, 80) & ~t.endswith(".") & t.rlike(r"\p{L}")


def is_anchor_text(text: Column) -> Column:
    """Two characters or more, with a letter or digit among them."""
    return (F.length(text) >= 2) & text.rlike(r"[\p{L}\p{Nd}]")


def zone_rows(items: DataFrame) -> DataFrame:
    """items repeated for each zone that they lie in."""
    inside = F.filter(F.array(*(F.when(F.col("fx").between(x0, x1) & F.col("fy").between(y0, y1), F.lit(n)) for n, (x0, x1, y0, y1) in ZONES.items())), lambda z: z.isNotNull())
    return items.withColumn("zone", F.explode(inside))


def zone_scores(items: DataFrame) -> DataFrame:
    """sheet_id, zone, n, score, rank: by how many different words of title blocks a zone has; the whole sheet comes last."""
    lowered = F.lower("text")
    words = F.filter(F.array(*map(F.lit, BLOCK_WORDS)), lambda w: F.contains(lowered, w))
    n = zone_rows(items).groupBy("sheet_id", "zone").agg(F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set(words)))).alias("score"))
    order = Window.partitionBy("sheet_id").orderBy(F.col("zone") == "whole_sheet", F.desc("score"), "zone")
    return n.withColumn("rank", F.row_number().over(order))


def label_hit(text: Column, labels: tuple[str, ...]) -> Column:
    """struct(i, part): which label a text is, and whether it says more; null if none."""
    t = F.btrim(F.lower(F.trim(text)), F.lit(" .:_-"))
    order = [F.when(t == label, F.struct(F.lit(i).alias("i"), F.lit(0).alias("part"))).when(t.startswith(label) & (F.length(t) <= len(label) + 4), F.struct(F.lit(i).alias("i"), F.lit(1).alias("part"))) for i, label in enumerate(labels)]
    return F.when((F.length(t) <= 40) & (t != ""), F.array_min(F.array_compact(F.array(*order))))


def find_labels(items: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """sheet_id, item_id, label, fx, fy: the label of each sheet: the most specific, an exact one first, then the lowest."""
    hits = items.withColumn("hit", label_hit(F.col("text"), labels)).where("hit is not null")
    first = Window.partitionBy("sheet_id").orderBy("hit.i", "hit.part", "fy", "item_id")
    named = F.element_at(F.array(*map(F.lit, labels)), F.col("hit.i") + 1)
    return hits.withColumn("r", F.row_number().over(first)).where("r = 1").select("sheet_id", "item_id", named.alias("label"), "fx", "fy")


def label_cost(lx: Column, ly: Column) -> Column:
    """How far an item stands under a label or right of it; null if it stands elsewhere."""
    down, aside, across, off = ly - F.col("fy"), F.abs(F.col("fx") - lx), F.col("fx") - lx, F.abs(F.col("fy") - ly)
    return F.when((down > 0) & (down <= BELOW) & (aside <= COLUMN), down + OFF_AXIS * aside).when((across > 0) & (across <= RIGHT) & (off <= BELOW / 3), across + OFF_AXIS * off)


def values_near(labels: DataFrame, items: DataFrame, accept: Column) -> DataFrame:
    """sheet_id, value_id, value, cost: the nearest acceptable text under the label in its column, or right of it on its line.

    Being off the label's axis counts OFF_AXIS times.
    """
    at = labels.select("sheet_id", F.col("item_id").alias("label_id"), F.col("fx").alias("lx"), F.col("fy").alias("ly"))
    met = items.where(accept & (F.trim("text") != "")).join(at.hint("merge"), "sheet_id").where("item_id <> label_id")
    best = met.withColumn("cost", label_cost(F.col("lx"), F.col("ly"))).where("cost is not null").groupBy("sheet_id").agg(F.min(F.struct("cost", "item_id", "text")).alias("b"))
    return best.select("sheet_id", F.col("b.item_id").alias("value_id"), F.trim("b.text").alias("value"), F.col("b.cost").alias("cost"))


def wrapped_titles(values: DataFrame, items: DataFrame) -> DataFrame:
    """sheet_id, title: the value (one a sheet) and, if there is one, its second line: same left edge, close below, of like height.

    Items meet their sheet's value by a shuffle: exploded items are more than their estimate, and no table of them may be broadcast.
    """
    sheet = Window.partitionBy("sheet_id")
    met = items.select("sheet_id", "item_id", "text", "fx", "fy", "fh").join(values.select("sheet_id", "value_id", "value").hint("merge"), "sheet_id")
    own = F.max(F.when(F.col("item_id") == F.col("value_id"), F.struct("fx", "fy", "fh"))).over(sheet)
    first = met.withColumn("own", own).where("own is not null")
    gap, high = F.col("own.fy") - F.col("fy"), F.col("own.fh")
    follows = (high > 0) & (gap > 0) & (gap <= high * WRAP_GAP) & (F.abs(F.col("fx") - F.col("own.fx")) <= WRAP_COLUMN) & (F.abs(F.col("fh") - high) <= high * WRAP_HEIGHT) & is_plausible_title(F.col("text"))
    second = F.min(F.when(follows, F.struct(gap.alias("gap"), "item_id", F.trim("text").alias("t")))).alias("s")
    return first.groupBy("sheet_id").agg(F.min("value").alias("value"), second).select("sheet_id", F.concat_ws(" ", "value", "s.t").alias("title"))


def sheet_numbers(items: DataFrame, files: DataFrame) -> DataFrame:
    """sheet_id, drawing_no, source, confidence, number_mismatch.

    The value at a label in a title-block zone, else a number in such a zone (best zones first), else one
    anywhere on the sheet, else the file name's (files: sheet_id, filename_number). A mismatch is a number
    from the sheet that reads otherwise than the file name's.
    """
    sheet = Window.partitionBy("sheet_id")
    zones = {z: F.coalesce(F.col("fx").between(x0, x1) & F.col("fy").between(y0, y1), F.lit(False)) for z, (x0, x1, y0, y1) in ZONES.items() if z != "whole_sheet"}
    lowered = F.lower("text")
    words = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.contains(lowered, F.lit(w)), F.lit(1 << i)).otherwise(F.lit(0)) for i, w in enumerate(BLOCK_WORDS)))
    accept = is_plausible_number(F.col("text")) & (F.trim("text") != "")
    read = items.select("sheet_id", "item_id", "text", "fx", "fy", *(c.alias(f"in_{z}") for z, c in zones.items()), F.coalesce(words, F.lit(0)).alias("words"), F.get(find_numbers(F.col("text")), 0).alias("n"), label_hit(F.col("text"), NUMBER_LABELS).alias("hit"), accept.alias("accept"))
    within = reduce(lambda a, b: a | b, (F.col(f"in_{z}") for z in zones))
    label = F.min(F.when(within & F.col("hit").isNotNull(), F.struct("hit.i", "hit.part", "fy", "item_id", "fx"))).over(sheet).alias("label")
    # all that a sheet's items share comes by windows over one shuffle, so that texts are read once
    scores = [F.bit_count(F.bit_or(F.when(F.col(f"in_{z}"), F.col("words"))).over(sheet)).alias(f"score_{z}") for z in zones]
    seen = read.select("*", label, *scores)
    zone = F.array_min(F.array_compact(F.array(*(F.when(F.col(f"in_{z}"), F.struct((-F.col(f"score_{z}")).alias("s"), F.lit(z).alias("z"))) for z in zones))))
    cost = F.when(within & F.col("accept") & (F.col("item_id") != F.col("label.item_id")), label_cost(F.col("label.fx"), F.col("label.fy")))
    value = F.min(F.when(cost.isNotNull(), F.struct(cost.alias("cost"), "item_id", "text"))).alias("value")
    place = [-F.col("fy"), F.col("fx"), F.col("item_id")]
    zoned = F.min_by("n", F.when(within & F.col("n").isNotNull(), F.struct(zone.alias("zone"), *place))).alias("by_zone")
    anywhere = F.min_by("n", F.when(F.col("n").isNotNull(), F.struct(*place))).alias("by_text")
    found = seen.groupBy("sheet_id").agg(value, zoned, anywhere).withColumn("value", F.trim("value.text"))
    found = found.select("sheet_id", F.coalesce(F.get(find_numbers(F.col("value")), 0), F.upper("value")).alias("by_label"), "by_zone", "by_text")
    known = files.select("sheet_id", "filename_number").join(found.hint("merge"), "sheet_id", "left")
    readings = (("by_label", "titleblock", "titleblock"), ("by_zone", "titleblock", "zone"), ("by_text", "sheet_text", "sheet_text"), ("filename_number", "filename", "filename"))
    best = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("n"), F.lit(s).alias("s"), F.lit(CONFIDENCE[k]).alias("c"))) for c, s, k in readings))
    differs = (F.col("b.s") != "filename") & (normalise_number(F.col("b.n")) != normalise_number(F.col("filename_number")))
    return known.withColumn("b", best).select("sheet_id", F.col("b.n").alias("drawing_no"), F.coalesce("b.s", F.lit("none")).alias("source"), F.coalesce("b.c", F.lit(0.0)).alias("confidence"), F.coalesce(differs, F.lit(False)).alias("number_mismatch"))


def example_pattern(example: str) -> str:
    """A pattern that fits numbers written like the example: its letters, digits and marks by kind."""
    import re

    parts = re.findall(r"[A-Za-z]+|\d+|[^A-Za-z\d]+", example.strip().upper())
    return "".join("[A-Z]+" if p[0].isalpha() else r"\d+" if p[0].isdigit() else re.escape(p) for p in parts)


def correct_by_example(sheets: DataFrame, example: str) -> DataFrame:
    """Unidentified sheets (sheet_id, drawing_no, stem) with the first part of their file name that is written like the example."""
    found = F.regexp_extract(F.upper("stem"), f"({example_pattern(example)})", 1)
    return sheets.withColumn("drawing_no", F.coalesce("drawing_no", F.when(found != "", found)))


def manual_numbers(sheets: DataFrame, corrections: DataFrame) -> DataFrame:
    """sheets with the number that a user entered last (corrections: sheet_id, drawing_no, seq) in place of what was read."""
    last = corrections.groupBy("sheet_id").agg(F.max_by("drawing_no", "seq").alias("entered"))
    out = sheets.join(last, "sheet_id", "left")
    return out.withColumns({"source": F.when(F.col("entered").isNotNull(), "user").otherwise(F.col("source")), "confidence": F.when(F.col("entered").isNotNull(), 1.0).otherwise(F.col("confidence")), "drawing_no": F.coalesce("entered", "drawing_no")}).drop("entered")
