"""Zones of a sheet: title block and its fields, revision table with its rows, frame, and what is protected from masks.

items: sheet_id, item_id (unique, in reading order), text, t (its normal form), x, y, w, h; segments: sheet_id, x0, y0,
x1, y1. All lengths are fractions of the page, y grows downwards. Everything is keyed by sheet_id:
labels are matched by expressions, clustered by a grid join and components, lines and rows of text are
cut at gaps by windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillset.functions.geometry import Box
from quillset.functions.measures import normalise_text
from quillset.operators.compare import CELL_LINKS, grid_join
from quillset.operators.graph import components
from quillset.storage import materialise

# The labels that tell the zones, in the order in which they are tried, and the sizes that bound them.
TITLE_BLOCK_LABELS = (
    "DRAWING NO", "DRAWING NUMBER", "DWG NO", "DRG NO", "SHEET NO", "SHEET NUMBER", "SCALE", "DRAWN", "CHECKED",
    "APPROVED", "DATE", "PROJECT", "CLIENT", "REV", "REVISION", "TITLE", "DESIGNED",
)
FIELD_LABELS = {
    "revision": ("REV", "REVISION", "REV."),
    "date": ("DATE", "ISSUE DATE"),
    "drawn_by": ("DRAWN", "DRAWN BY", "DESIGNED"),
    "checked_by": ("CHECKED", "CHKD", "APPROVED", "AUTHORISED"),
    "sheet_number": ("DRAWING NO", "DWG NO", "DRG NO", "SHEET NO"),
    "scale": ("SCALE",),
}
TABLE_HEADERS = ("REV", "REVISION", "DATE", "DESCRIPTION", "AMENDMENT", "AMENDMENTS", "ISSUE", "BY", "CHK", "APP")
TABLE_ANCHORS = ("DESCRIPTION", "AMENDMENT", "AMENDMENTS", "REVISION", "ISSUE")
PROTECTED_LABELS = {
    "north_arrow": ("NORTH", "TRUE NORTH", "PROJECT NORTH"),
    "scale_bar": ("SCALE BAR", "GRAPHIC SCALE", "METRES", "METERS"),
    "key_plan": ("KEY PLAN", "LOCATION PLAN", "SITE KEY", "KEY DIAGRAM"),
    "general_notes": ("GENERAL NOTES", "NOTES", "NOTE:", "NOTES:", "SPECIFICATION NOTES"),
}
REACH = {"north_arrow": 0.05, "scale_bar": 0.05, "key_plan": 0.09}
ROW_DATE = r"(?i)\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s*(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s*\d{2,4})\b"
ROW_REVISION = r"^(P?\d{1,2}|[A-Z]\d?|C\d{2})$"
LONG_LINE, SAME_LINE, SLOPE = 0.30, 0.004, 0.02
FRAME_EDGE, FRAME_BAND = 0.08, 0.005
CLUSTER_REACH, SNAP, BLOCK_PAD, LARGEST_BLOCK = 0.22, 0.12, 0.012, 0.45
NOTES_GAP_LINES, NOTES_REACH = 3.0, 0.45

ZONE = ("sheet_id", "kind", "label", "x0", "y0", "x1", "y1", "confidence", "protected")


def first_label(text: Column, labels: tuple[str, ...]) -> Column:
    """The first of ``labels`` that a short normalised text starts with; null if none."""
    known = F.coalesce(*(F.when(text.startswith(k), k) for k in labels))
    return F.when((text != "") & (F.char_length(text) <= 40), known)


def label_hits(items: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Items with the label (keyword) that they start with."""
    return items.withColumn("keyword", first_label(F.col("t"), labels)).where("keyword is not null")


def edge_score(box: Box) -> Column:
    """1 in the lower right corner of the page, 0 in the upper left one."""
    x, y = box.centre
    return (x + y) / 2


def long_lines(segments: DataFrame) -> DataFrame:
    """sheet_id, horizontal, at: positions of straight lines of LONG_LINE and more, those within SAME_LINE of the one before as their mean."""
    dx, dy = (F.abs(F.col(f"{c}1") - F.col(f"{c}0")) for c in "xy")
    flat, upright = (dx >= LONG_LINE) & (dy <= SLOPE * dx), (dy >= LONG_LINE) & (dx <= SLOPE * dy)
    at = F.when(flat, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2)
    lines = segments.where(flat | upright).select("sheet_id", flat.alias("horizontal"), at.alias("at"))
    return islands(lines, ["sheet_id", "horizontal"], "at", F.lit(SAME_LINE)).groupBy("sheet_id", "horizontal", "island").agg(F.avg("at").alias("at")).drop("island")


def islands(rows: DataFrame, by: list[str], at: str, gap: Column) -> DataFrame:
    """``rows`` with an island, numbered along ``at``: a new one begins where the distance to the row before exceeds ``gap``."""
    order = Window.partitionBy(*by).orderBy(at)
    opens = F.coalesce(F.col(at) - F.lag(at).over(order) > gap, F.lit(False))
    # equal positions have equal numbers, since the default frame takes them together
    return rows.withColumn("_opens", opens.cast("int")).withColumn("island", F.sum("_opens").over(order)).drop("_opens")


def label_clusters(hits: DataFrame, reach: float = CLUSTER_REACH) -> DataFrame:
    """``hits`` with a cluster: single links between labels whose centres are within ``reach`` on both axes."""
    centre = Box.of().centre
    at = hits.select("sheet_id", F.col("item_id").alias("id"), centre[0].alias("cx"), centre[1].alias("cy"))

    def box(p: str, half: float) -> DataFrame:
        return at.select("sheet_id", F.col("id").alias(f"{p}_id"), (F.col("cx") - half).alias(f"{p}_x"), (F.col("cy") - half).alias(f"{p}_y"), F.lit(2 * half).alias(f"{p}_w"), F.lit(2 * half).alias(f"{p}_h"))

    met = grid_join(box("l", reach), box("r", 0.0), 2 * reach, by="sheet_id").where("l_id < r_id").select(F.col("l_id").alias("src"), F.col("r_id").alias("dst"))
    known = components(met, small=CELL_LINKS).distinct().withColumnRenamed("id", "item_id")
    return hits.join(known, "item_id", "left").withColumn("cluster", F.coalesce("component", "item_id")).drop("component")


def around(prefix: str = "") -> list[Column]:
    """Corners x0, y0, x1, y1 around the boxes of a group, as aggregates."""
    return [F.min("x").alias(f"{prefix}x0"), F.min("y").alias(f"{prefix}y0"), F.max(F.col("x") + F.col("w")).alias(f"{prefix}x1"), F.max(F.col("y") + F.col("h")).alias(f"{prefix}y1")]


def title_blocks(items: DataFrame, lines: DataFrame) -> DataFrame:
    """sheet_id, x0, y0, x1, y1, confidence of the sheets that have one: of the clusters of two labels and more the one with most labels, twice its edge score added.

    It is grown a little and to the ruled lines that enclose it, as far as these are near by: its far
    sides end at the page's edge otherwise. Of equal clusters the one of the smallest item_id counts.
    """
    hits = materialise(label_hits(items, TITLE_BLOCK_LABELS), "labels")
    grouped = label_clusters(hits).groupBy("sheet_id", "cluster").agg(F.count_distinct("keyword").alias("n"), *around()).where("n >= 2")
    score = F.col("n") + (F.col("x0") + F.col("x1") + F.col("y0") + F.col("y1")) / 2
    best = Window.partitionBy("sheet_id").orderBy(F.desc(score), "cluster")
    chosen = grouped.withColumn("r", F.row_number().over(best)).where("r = 1")
    padded = chosen.select("sheet_id", "n", *((F.col(c) + (BLOCK_PAD if c[1] == "1" else -BLOCK_PAD)).alias(c) for c in ("x0", "y0", "x1", "y1")))
    beside = padded.join(lines, "sheet_id", "left").groupBy(*padded.columns).agg(
        F.count("at").alias("lines"),
        *(F.max(F.when((F.col("horizontal") == (c == "y0")) & (F.col("at") < F.col(c) - 1e-6), F.col("at"))).alias(f"n{c}") for c in ("x0", "y0")),
        *(F.min(F.when((F.col("horizontal") == (c == "y1")) & (F.col("at") > F.col(c) + 1e-6), F.col("at"))).alias(f"n{c}") for c in ("x1", "y1")),
    )

    def snapped(c: str) -> Column:
        near = F.abs(F.col(f"n{c}") - F.col(c)) <= SNAP
        return F.when(near, F.col(f"n{c}")).otherwise(F.lit(1.0) if c[1] == "1" else F.col(c))

    found = F.col("lines") > 0
    small = (snapped("x1") - snapped("x0")) * (snapped("y1") - snapped("y0")) <= LARGEST_BLOCK
    sure = F.least(F.lit(0.98), 0.5 + 0.12 * F.col("n"))
    confidence = F.when(found, F.least(F.lit(0.99), sure + 0.1)).otherwise(sure)
    return clipped(beside.select("sheet_id", *(F.when(found & small, snapped(c)).otherwise(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")), confidence.alias("confidence")))


def clipped(zones: DataFrame) -> DataFrame:
    return zones.withColumns({c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) for c in ("x0", "y0", "x1", "y1")})


def named(zones: DataFrame, kind: str, label: Column, confidence: Column, protected: bool = False) -> DataFrame:
    return clipped(zones.withColumns({"kind": F.lit(kind), "label": label, "confidence": confidence, "protected": F.lit(protected)})).select(*ZONE)


def frames(lines: DataFrame) -> DataFrame:
    """Four bands along the border of sheets that have lines near all four edges; what they enclose is no zone."""
    near = {"left": (False, "<"), "top": (True, "<"), "right": (False, ">"), "bottom": (True, ">")}
    edges = lines.groupBy("sheet_id").agg(*(
        (F.min if side == "<" else F.max)(F.when((F.col("horizontal") == flat) & ((F.col("at") <= FRAME_EDGE) if side == "<" else (F.col("at") >= 1 - FRAME_EDGE)), F.col("at"))).alias(edge)
        for edge, (flat, side) in near.items()
    )).where(" and ".join(f"{edge} is not null" for edge in near))
    zero, one, band = F.lit(0.0), F.lit(1.0), F.lit(FRAME_BAND)
    bands = {"top": (zero, zero, one, F.col("top") + band), "bottom": (zero, F.col("bottom") - band, one, one), "left": (zero, zero, F.col("left") + band, one), "right": (F.col("right") - band, zero, one, one)}
    each = F.array(*(F.struct(F.lit(edge).alias("edge"), *(v.alias(c) for v, c in zip(box, ("x0", "y0", "x1", "y1"), strict=True))) for edge, box in bands.items()))
    return named(edges.select("sheet_id", F.explode(each).alias("b")).select("sheet_id", "b.*"), "frame", F.concat(F.lit("Sheet frame: "), F.col("edge")), F.lit(0.9))


def title_fields(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """The fields of a title block: the first label of each within it, with room below and to the right."""
    text = F.col("t")
    each = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), first_label(text, labels).alias("keyword")) for f, labels in FIELD_LABELS.items())), lambda s: s["keyword"].isNotNull())
    hits = items.withColumn("f", F.explode(each)).join(blocks.select("sheet_id", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1"))), "sheet_id")
    x, y = Box.of().centre
    within = hits.where(x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1")))
    first = within.withColumn("r", F.row_number().over(Window.partitionBy("sheet_id", "f.field").orderBy("item_id"))).where("r = 1")
    right, below = F.least(F.col("x") + F.col("w") + 0.09, "bx1"), F.least(F.col("y") + F.col("h") + 0.035, "by1")
    boxed = first.select("sheet_id", "f.field", (F.col("x") - 0.004).alias("x0"), (F.col("y") - 0.004).alias("y0"), right.alias("x1"), below.alias("y1"))
    return named(boxed, "field", F.concat(F.lit("Title block: "), F.translate("field", "_", " ")), F.lit(0.85))


def table_items(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """The items of each sheet's revision table: those around its header, which is the one closest to the lower right, near the title block if any is."""
    heads = label_hits(items, TABLE_HEADERS).where(F.col("keyword").isin(*TABLE_ANCHORS)).join(blocks.select("sheet_id", ((F.col("x0") + F.col("x1")) / 2).alias("bx"), ((F.col("y0") + F.col("y1")) / 2).alias("by")), "sheet_id", "left")
    x, y = Box.of().centre
    near = F.coalesce((F.abs(y - F.col("by")) < 0.35) | (F.abs(x - F.col("bx")) < 0.35), F.lit(False))
    best = Window.partitionBy("sheet_id").orderBy(F.desc(near), F.desc(edge_score(Box.of())), "item_id")
    line = F.greatest("h", F.lit(0.008))
    corner = [F.least(F.col("x") - 0.10, F.lit(1.0)), F.col("y") - 1.5 * line, F.least(F.col("x") + F.col("w") + 0.22, F.lit(1.0)), F.col("y") + F.col("h") + 10 * line]
    band = heads.withColumn("r", F.row_number().over(best)).where("r = 1").select("sheet_id", *(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)).alias(f"b{n}") for c, n in zip(corner, ("x0", "y0", "x1", "y1"), strict=True)))
    inside = items.drop("t").join(band, "sheet_id").where(x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1")))
    return inside.withColumn("n", F.count("*").over(Window.partitionBy("sheet_id"))).where("n >= 2").select("sheet_id", "item_id", "text", normalise_text(F.col("text")).alias("t"), "x", "y", "w", "h")


def revision_rows(inside: DataFrame) -> DataFrame:
    """sheet_id, row, revision, date, description of table_items(): rows are cut where the gap exceeds 0.8 of the median height.

    In a row the first text that reads as a revision is it, the first other one with a date is the date,
    and what is left describes. Rows with two headers and more say nothing of a revision.
    """
    tolerance = F.greatest(F.lit(0.006), 0.8 * F.median("h").over(Window.partitionBy("sheet_id")))
    rows = islands(inside.withColumns({"mid": F.col("y") + F.col("h") / 2, "gap": tolerance}), ["sheet_id"], "mid", F.col("gap"))
    told = rows.withColumns({"header": F.when(F.col("t").isin(*TABLE_HEADERS), F.col("t")), "rev": F.col("t").rlike(ROW_REVISION), "dated": F.col("text").rlike(ROW_DATE)}).withColumn("t", F.trim("text"))
    order = Window.partitionBy("sheet_id", "island").orderBy("x", "item_id").rowsBetween(Window.unboundedPreceding, 0)
    first_rev = F.col("rev") & (F.sum(F.col("rev").cast("int")).over(order) == 1)
    marked = told.withColumn("is_rev", first_rev).withColumn("other", F.col("dated") & ~F.col("is_rev"))
    marked = marked.withColumn("is_date", F.col("other") & (F.sum(F.col("other").cast("int")).over(order) == 1))
    parts = F.array_sort(F.collect_list(F.when(~F.col("is_rev") & ~F.col("is_date") & (F.col("t") != ""), F.struct("x", "item_id", "t"))))
    found = marked.groupBy("sheet_id", "island").agg(
        F.coalesce(F.max(F.when(F.col("is_rev"), F.col("t"))), F.lit("")).alias("revision"), F.coalesce(F.max(F.when(F.col("is_date"), F.col("t"))), F.lit("")).alias("date"),
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("description"), F.count_distinct("header").alias("headers"),
    ).where("headers < 2 and concat(revision, date, description) <> ''")
    return found.select("sheet_id", F.row_number().over(Window.partitionBy("sheet_id").orderBy("island")).alias("row"), "revision", "date", "description")


def notes_columns(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Each heading's (item_id) box with the texts of its column below it, down to the first gap of NOTES_GAP_LINES line heights."""
    head = hits.select("sheet_id", "item_id", *(F.col(c).alias(f"h{c}") for c in "xywh")).withColumns({"hx1": F.col("hx") + F.col("hw"), "hy1": F.col("hy") + F.col("hh"), "line": F.greatest("hh", F.lit(0.004))})
    mid = F.col("y") + F.col("h") / 2
    below = items.select("sheet_id", F.col("item_id").alias("other"), *"xywh").join(head, "sheet_id").where(F.col("x").between(F.col("hx") - 0.02, F.col("hx") + 0.30) & mid.between(F.col("hy1"), F.col("hy1") + NOTES_REACH))
    order = Window.partitionBy("item_id").orderBy("y", "other")
    bottom = F.greatest("hy1", F.max(F.col("y") + F.col("h")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    gaps = below.withColumn("gap", (F.col("y") - bottom > F.col("line") * NOTES_GAP_LINES).cast("int")).withColumn("gaps", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    reached = gaps.where("gaps = 0").groupBy("item_id").agg(*around("n"))
    out = head.join(reached, "item_id", "left")
    edge = {"x0": F.least("hx", "nx0"), "y0": F.least("hy", "ny0"), "x1": F.greatest("hx1", "nx1"), "y1": F.greatest("hy1", "ny1")}
    return out.select("sheet_id", "item_id", *((v + (0.01 if c[1] == "1" else -0.01)).alias(c) for c, v in edge.items()))


def protected_regions(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """North arrows, scale bars, key plans and notes: the first label of each kind whose region isn't wholly the title block's, cut off where that begins.

    A lone N of 1.6 times the median height is a north arrow, too.
    """
    text = F.col("t")
    each = F.filter(F.array(*(F.struct(F.lit(k).alias("what"), first_label(text, labels).alias("keyword")) for k, labels in PROTECTED_LABELS.items())), lambda s: s["keyword"].isNotNull())
    hits = items.withColumn("f", F.explode(each)).select("sheet_id", "item_id", "f.what", *"xywh")
    reach = F.create_map(*(F.lit(v) for kv in REACH.items() for v in kv))[F.col("what")]

    def grown(rows: DataFrame, by: Column) -> DataFrame:
        return rows.withColumns({"x0": F.col("x") - by, "y0": F.col("y") - by, "x1": F.col("x") + F.col("w") + by, "y1": F.col("y") + F.col("h") + by})

    columns = ["sheet_id", "item_id", "what", "x0", "y0", "x1", "y1", "confidence"]
    plain = grown(hits.where("what <> 'general_notes'"), reach).withColumn("confidence", F.lit(0.8)).select(columns)
    notes = notes_columns(items, hits.where("what = 'general_notes'")).withColumns({"what": F.lit("general_notes"), "confidence": F.lit(0.8)}).select(columns)
    middle = items.where("h > 0").groupBy("sheet_id").agg(F.median("h").alias("middle"))
    lone = items.where(text == "N").join(middle, "sheet_id").where("h >= 1.6 * middle").withColumn("r", F.row_number().over(Window.partitionBy("sheet_id").orderBy("item_id"))).where("r = 1")
    arrow = grown(lone, F.lit(0.05)).withColumns({"what": F.lit("lone_north"), "confidence": F.lit(0.7)}).select(columns)
    all_ = plain.unionByName(notes).unionByName(arrow).join(blocks.select("sheet_id", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1"))), "sheet_id", "left")
    meets = F.coalesce((F.col("x0") <= F.col("bx1")) & (F.col("bx0") <= F.col("x1")) & (F.col("y0") <= F.col("by1")) & (F.col("by0") <= F.col("y1")), F.lit(False))
    above, left = meets & (F.col("y0") < F.col("by0")), meets & (F.col("y0") >= F.col("by0")) & (F.col("x0") < F.col("bx0"))
    cut = all_.withColumns({"y1": F.when(above, F.col("by0")).otherwise(F.col("y1")), "x1": F.when(left, F.col("bx0")).otherwise(F.col("x1")), "stays": ~meets | above | left})
    first = cut.where("stays").withColumn("r", F.row_number().over(Window.partitionBy("sheet_id", "what").orderBy("item_id"))).where("r = 1")
    label = F.initcap(F.translate(F.when(F.col("what") == "lone_north", "north_arrow").otherwise(F.col("what")), "_", " "))
    return named(first, "protected", label, F.col("confidence"), protected=True)


def detect_zones(items: DataFrame, segments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(zones, revision rows) of all sheets; zones: ZONE with a zone_id, in the form that masks read.

    Sheets without title block get none; sheets without lines are judged by their texts alone. Rows with a
    null among their numbers or texts tell nothing. An empty table gives empty tables.
    """
    rows = items.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ("sheet_id", "item_id", "text", *"xywh"))))
    known = materialise(rows.select("sheet_id", "item_id", "text", normalise_text(F.col("text")).alias("t"), *(F.col(c).cast("double").alias(c) for c in "xywh")), "zone-items")
    spark = items.sparkSession
    lines = materialise(long_lines(segments), "lines") if segments is not None else spark.createDataFrame([], "sheet_id long, horizontal boolean, at double")
    blocks = materialise(title_blocks(known, lines), "title-blocks")
    inside = materialise(table_items(known, blocks), "table-items")
    table = inside.groupBy("sheet_id").agg(*around())
    zones = [
        frames(lines), named(blocks, "titleblock", F.lit("Title block"), F.col("confidence")), title_fields(known, blocks),
        named(table, "revision_table", F.lit("Revision history"), F.lit(0.8)), protected_regions(known, blocks),
    ]
    every = reduce(DataFrame.unionByName, zones)
    order = Window.partitionBy("sheet_id").orderBy("kind", "label", "x0", "y0", "x1", "y1")
    return every.withColumn("zone_id", F.row_number().over(order).cast("long")), revision_rows(inside)


def as_masks(zones: DataFrame) -> DataFrame:
    """Zones of a pair's new sheet (sheet_id is the pair_id) as masks.apply_mask() takes them."""
    kind = F.when(F.col("protected"), "keep").otherwise(F.col("kind"))
    return zones.select(F.col("sheet_id").alias("pair_id"), "zone_id", kind.alias("kind"), "x0", "y0", "x1", "y1", F.lit(True).alias("enabled"), "protected", F.lit(False).alias("ink_only"), F.array().cast("array<string>").alias("words"))
