"""Queries on the zones of sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillset.operators import masks, zones
from quillset.plans.registry import Registry
from quillset.sources.bindings import bound

query = Registry()


def _first(labels: tuple[str, ...]) -> str:
    """SQL: the first of the labels that t starts with."""
    return "CASE WHEN t <> '' AND length(t) <= 40 THEN [k FOR k IN [" + ", ".join(f"'{k}'" for k in labels) + "] IF starts_with(t, k)][1] END"


CORNERS = ("x0", "y0", "x1", "y1")


def _clip(*corners: str) -> str:
    """SQL: four expressions as corners within the page."""
    return ", ".join(f"round(least(greatest({c}, 0), 1), 6) AS {name}" for c, name in zip(corners, CORNERS, strict=True))


READ = rf"""i AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy, x + w AS r, y + h AS b, upper(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM PAGE_ITEMS),
 ln AS (SELECT sheet_id, abs(y1 - y0) <= 0.02 * abs(x1 - x0) AS flat, CASE WHEN abs(y1 - y0) <= 0.02 * abs(x1 - x0) THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS pos FROM PAGE_LINES
  WHERE abs(x1 - x0) >= 0.3 AND abs(y1 - y0) <= 0.02 * abs(x1 - x0) OR abs(y1 - y0) >= 0.3 AND abs(x1 - x0) <= 0.02 * abs(y1 - y0)),
 lo AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY sheet_id, flat ORDER BY pos) > 0.004, false)::INT AS opens FROM ln),
 lg AS (SELECT *, sum(opens) OVER (PARTITION BY sheet_id, flat ORDER BY pos) AS g FROM lo), l AS (SELECT sheet_id, flat, avg(pos) AS pos FROM lg GROUP BY sheet_id, flat, g),
 h AS (SELECT * FROM (SELECT *, {_first(zones.TITLE_BLOCK_LABELS)} AS kw FROM i) WHERE kw IS NOT NULL),
 n AS (SELECT a.item_id AS a, b.item_id AS b FROM h a JOIN h b ON a.sheet_id = b.sheet_id AND abs(a.cx - b.cx) <= 0.22 AND abs(a.cy - b.cy) <= 0.22),
 rr(id, root) AS (SELECT item_id, item_id FROM h UNION SELECT n.b, rr.root FROM rr JOIN n ON n.a = rr.id),
 cl AS (SELECT id AS item_id, min(root) AS cluster FROM rr GROUP BY 1),
 cg AS (SELECT sheet_id, cluster, count(DISTINCT kw) AS n, min(x) AS x0, min(y) AS y0, max(r) AS x1, max(b) AS y1 FROM h JOIN cl USING (item_id) GROUP BY 1, 2 HAVING count(DISTINCT kw) >= 2),
 pd AS (SELECT sheet_id, n, x0 - 0.012 AS x0, y0 - 0.012 AS y0, x1 + 0.012 AS x1, y1 + 0.012 AS y1 FROM cg QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY n + (x0 + x1 + y0 + y1) / 2 DESC, cluster) = 1),
 ne AS (SELECT pd.*, (SELECT count(*) FROM l WHERE l.sheet_id = pd.sheet_id) AS k, (SELECT max(pos) FROM l WHERE l.sheet_id = pd.sheet_id AND NOT flat AND pos < x0 - 1e-6) AS nx0, (SELECT max(pos) FROM l WHERE l.sheet_id = pd.sheet_id AND flat AND pos < y0 - 1e-6) AS ny0,
  (SELECT min(pos) FROM l WHERE l.sheet_id = pd.sheet_id AND NOT flat AND pos > x1 + 1e-6) AS nx1, (SELECT min(pos) FROM l WHERE l.sheet_id = pd.sheet_id AND flat AND pos > y1 + 1e-6) AS ny1 FROM pd),
 sn AS (SELECT *, CASE WHEN abs(nx0 - x0) <= 0.12 THEN nx0 ELSE x0 END AS sx0, CASE WHEN abs(ny0 - y0) <= 0.12 THEN ny0 ELSE y0 END AS sy0, CASE WHEN abs(nx1 - x1) <= 0.12 THEN nx1 ELSE 1 END AS sx1, CASE WHEN abs(ny1 - y1) <= 0.12 THEN ny1 ELSE 1 END AS sy1 FROM ne),
 tb AS (SELECT sheet_id, least(0.99, least(0.98, 0.5 + 0.12 * n) + CASE WHEN k > 0 THEN 0.1 ELSE 0 END) AS confidence,
  {", ".join(f"least(greatest(CASE WHEN k > 0 AND (sx1 - sx0) * (sy1 - sy0) <= 0.45 THEN s{c} ELSE {c} END, 0), 1) AS {c}" for c in CORNERS)} FROM sn),
 th AS (SELECT i.*, coalesce(abs(cy - (tb.y0 + tb.y1) / 2) < 0.35 OR abs(cx - (tb.x0 + tb.x1) / 2) < 0.35, false) AS near, {_first(zones.TABLE_HEADERS)} AS kw FROM i LEFT JOIN tb USING (sheet_id)),
 an AS (SELECT sheet_id, x - 0.1 AS ax0, y - 1.5 * greatest(h, 0.008) AS ay0, r + 0.22 AS ax1, b + 10 * greatest(h, 0.008) AS ay1 FROM th WHERE kw IN {zones.TABLE_ANCHORS} QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY near DESC, (cx + cy) / 2 DESC, item_id) = 1),
 tt AS (SELECT i.* FROM i JOIN an USING (sheet_id) WHERE cx BETWEEN greatest(ax0, 0) AND least(ax1, 1) AND cy BETWEEN greatest(ay0, 0) AND least(ay1, 1) QUALIFY count(*) OVER (PARTITION BY sheet_id) >= 2)"""


def _each(of: dict[str, tuple[str, ...]]) -> str:
    return " UNION ALL ".join(f"SELECT i.*, '{name}' AS f, {_first(labels)} AS kw FROM i" for name, labels in of.items())


ZONES = f"""WITH RECURSIVE {READ},
 fe AS (SELECT sheet_id, min(pos) FILTER (NOT flat AND pos <= 0.08) AS l, max(pos) FILTER (NOT flat AND pos >= 0.92) AS r, min(pos) FILTER (flat AND pos <= 0.08) AS t, max(pos) FILTER (flat AND pos >= 0.92) AS b FROM l GROUP BY 1),
 fr AS (SELECT sheet_id, unnest([{{'e': 'top', 'x0': 0.0, 'y0': 0.0, 'x1': 1.0, 'y1': t + 0.005}}, {{'e': 'bottom', 'x0': 0.0, 'y0': b - 0.005, 'x1': 1.0, 'y1': 1.0}}, {{'e': 'left', 'x0': 0.0, 'y0': 0.0, 'x1': l + 0.005, 'y1': 1.0}}, {{'e': 'right', 'x0': r - 0.005, 'y0': 0.0, 'x1': 1.0, 'y1': 1.0}}]) AS z FROM fe WHERE l + r + t + b IS NOT NULL),
 fd AS (SELECT e.*, tb.x1 AS bx1, tb.y1 AS by1 FROM ({_each(zones.FIELD_LABELS)}) e JOIN tb ON tb.sheet_id = e.sheet_id AND kw IS NOT NULL AND cx BETWEEN tb.x0 AND tb.x1 AND cy BETWEEN tb.y0 AND tb.y1 QUALIFY row_number() OVER (PARTITION BY e.sheet_id, f ORDER BY item_id) = 1),
 ph AS (SELECT * FROM ({_each(zones.PROTECTED_LABELS)}) WHERE kw IS NOT NULL),
 nb AS (SELECT p.item_id AS head, i.*, p.b AS pb, greatest(p.h, 0.004) AS line FROM ph p JOIN i ON p.f = 'general_notes' AND i.sheet_id = p.sheet_id AND i.x BETWEEN p.x - 0.02 AND p.x + 0.30 AND i.cy BETWEEN p.b AND p.b + 0.45),
 ng AS (SELECT *, (y - greatest(pb, coalesce(max(b) OVER (PARTITION BY head ORDER BY y, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), pb)) > 3 * line)::INT AS gap FROM nb),
 nc AS (SELECT head, min(x) AS nx0, min(y) AS ny0, max(r) AS nx1, max(b) AS ny1 FROM (SELECT *, sum(gap) OVER (PARTITION BY head ORDER BY y, item_id ROWS UNBOUNDED PRECEDING) AS gaps FROM ng) WHERE gaps = 0 GROUP BY 1),
 pr AS (SELECT sheet_id, item_id, f, 0.8 AS c, x - e AS x0, y - e AS y0, r + e AS x1, b + e AS y1 FROM (SELECT *, CASE f WHEN 'key_plan' THEN 0.09 ELSE 0.05 END AS e FROM ph WHERE f <> 'general_notes')
  UNION ALL SELECT sheet_id, item_id, f, 0.8, least(x, coalesce(nx0, x)) - 0.01, least(y, coalesce(ny0, y)) - 0.01, greatest(r, coalesce(nx1, r)) + 0.01, greatest(b, coalesce(ny1, b)) + 0.01 FROM ph LEFT JOIN nc ON nc.head = ph.item_id WHERE f = 'general_notes'
  UNION ALL SELECT sheet_id, item_id, 'lone', 0.7, x - 0.05, y - 0.05, r + 0.05, b + 0.05 FROM (SELECT *, median(h) FILTER (h > 0) OVER (PARTITION BY sheet_id) AS mid FROM i) WHERE t = 'N' AND h >= 1.6 * mid QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY item_id) = 1),
 pm AS (SELECT pr.*, tb.x0 AS bx0, tb.y0 AS by0, coalesce(pr.x0 <= tb.x1 AND tb.x0 <= pr.x1 AND pr.y0 <= tb.y1 AND tb.y0 <= pr.y1, false) AS meets FROM pr LEFT JOIN tb USING (sheet_id)),
 pc AS (SELECT sheet_id, f, c, x0, y0, CASE WHEN meets AND y0 >= by0 THEN bx0 ELSE x1 END AS x1, CASE WHEN meets AND y0 < by0 THEN by0 ELSE y1 END AS y1 FROM pm WHERE NOT meets OR y0 < by0 OR x0 < bx0 QUALIFY row_number() OVER (PARTITION BY sheet_id, f ORDER BY item_id) = 1)
 SELECT sheet_id, 'frame' AS kind, 'Sheet frame: ' || z.e AS label, {_clip("z.x0", "z.y0", "z.x1", "z.y1")}, 0.9 AS confidence, false AS protected FROM fr
 UNION ALL SELECT sheet_id, 'titleblock', 'Title block', {_clip(*CORNERS)}, round(confidence, 6), false FROM tb
 UNION ALL SELECT sheet_id, 'field', 'Title block: ' || replace(f, '_', ' '), {_clip("x - 0.004", "y - 0.004", "least(r + 0.09, bx1)", "least(b + 0.035, by1)")}, 0.85, false FROM fd
 UNION ALL SELECT sheet_id, 'revision_table', 'Revision history', round(min(x), 6), round(min(y), 6), round(max(r), 6), round(max(b), 6), 0.8, false FROM tt GROUP BY sheet_id
 UNION ALL SELECT sheet_id, 'protected', CASE f WHEN 'lone' THEN 'North Arrow' WHEN 'north_arrow' THEN 'North Arrow' WHEN 'scale_bar' THEN 'Scale Bar' WHEN 'key_plan' THEN 'Key Plan' ELSE 'General Notes' END, {_clip(*CORNERS)}, c, true FROM pc"""


@query(ZONES)
def sheet_zones(spark, d):
    found, _ = zones.detect_zones(bound(spark, d, "page_items"), bound(spark, d, "page_lines"))
    return found.select("sheet_id", "kind", "label", *(F.round(c, 6).alias(c) for c in (*CORNERS, "confidence")), "protected")


@query(
    rf"""WITH RECURSIVE {READ},
 ro AS (SELECT *, coalesce(cy - lag(cy) OVER (PARTITION BY sheet_id ORDER BY cy) > greatest(0.006, 0.8 * median(h) OVER (PARTITION BY sheet_id)), false)::INT AS opens FROM tt),
 rw AS (SELECT *, sum(opens) OVER (PARTITION BY sheet_id ORDER BY cy) AS g, regexp_matches(t, '{zones.ROW_REVISION}') AS rev, regexp_matches(text, '{zones.ROW_DATE}') AS dated FROM ro),
 ra AS (SELECT *, rev AND count(*) FILTER (rev) OVER w = 1 AS is_rev FROM rw WINDOW w AS (PARTITION BY sheet_id, g ORDER BY x, item_id ROWS UNBOUNDED PRECEDING)),
 rb AS (SELECT *, dated AND NOT is_rev AND count(*) FILTER (dated AND NOT is_rev) OVER w = 1 AS is_date FROM ra WINDOW w AS (PARTITION BY sheet_id, g ORDER BY x, item_id ROWS UNBOUNDED PRECEDING)),
 rc AS (SELECT sheet_id, g, coalesce(max(trim(text)) FILTER (is_rev), '') AS revision, coalesce(max(trim(text)) FILTER (is_date), '') AS date, coalesce(string_agg(trim(text), ' ' ORDER BY x, item_id) FILTER (NOT is_rev AND NOT is_date AND trim(text) <> ''), '') AS description,
  count(DISTINCT t) FILTER (t IN {zones.TABLE_HEADERS}) AS headers FROM rb GROUP BY 1, 2)
 SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY g) AS row, revision, date, description FROM rc WHERE headers < 2 AND revision || date || description <> ''"""
)
def revision_table_rows(spark, d):
    return zones.detect_zones(bound(spark, d, "page_items"), bound(spark, d, "page_lines"))[1]


@query(
    f"""WITH z AS ({ZONES}), i AS (SELECT sheet_id, item_id, x + w / 2 AS cx, y + h / 2 AS cy FROM PAGE_ITEMS),
 m AS (SELECT i.sheet_id, item_id, bool_or(coalesce(NOT protected, false)) AND NOT bool_or(coalesce(protected, false)) AS masked FROM i LEFT JOIN z ON z.sheet_id = i.sheet_id AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY 1, 2)
 SELECT sheet_id, count(*) AS n, count(*) FILTER (NOT masked) AS compared FROM m GROUP BY 1"""
)
def zone_masked_items(spark, d):
    """How many of each sheet's texts its zones mask, and how many protected regions keep."""
    items = bound(spark, d, "page_items")
    found, _ = zones.detect_zones(items, bound(spark, d, "page_lines"))
    boxes = items.withColumnRenamed("sheet_id", "pair_id")
    left = masks.apply_mask(boxes, zones.as_masks(found), "item_id", 1.0, 1.0)
    return boxes.groupBy("pair_id").agg(F.count("*").alias("n")).join(left.groupBy("pair_id").agg(F.count("*").alias("compared")), "pair_id", "left").select(F.col("pair_id").alias("sheet_id"), "n", F.coalesce("compared", F.lit(0)).alias("compared"))
