"""Queries on the text stream, dimensions, noise filters and whole comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillset.functions import measures
from quillset.operators import compare, comparison, graph, hatch, noise, store, textdiff
from quillset.plans.registry import Registry
from quillset.sources.bindings import bound, table

query = Registry()


def _rows(spark, d):
    """The change log with the columns that noise filters read."""
    c = bound(spark, d, "changes")
    k = F.col("change_id")
    stream = F.when(k % 4 == 0, "text").when(k % 4 == 1, "vector").otherwise("raster")
    return c.select("pair_id", "change_id", stream.alias("stream"), F.when(k % 12 == 1, "style_only").otherwise(F.lower("kind")).alias("kind"), F.when(k % 24 == 1, "line weight").when(k % 12 == 1, "line type").alias("wording"), "x", "y", *(F.when(k % 7 == 2, F.col(s) / 15).otherwise(F.col(s)).alias(s) for s in "wh"), "confidence", "is_cosmetic", F.lit(None).cast("double").alias("area"))


ROWS = """r AS (SELECT pair_id, change_id, CASE change_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'vector' ELSE 'raster' END AS stream, CASE WHEN change_id % 12 = 1 THEN 'style_only' ELSE lower(kind) END AS kind,
 CASE WHEN change_id % 24 = 1 THEN 'line weight' WHEN change_id % 12 = 1 THEN 'line type' END AS wording, x, y, CASE WHEN change_id % 7 = 2 THEN w / 15 ELSE w END AS w, CASE WHEN change_id % 7 = 2 THEN h / 15 ELSE h END AS h, is_cosmetic FROM CHANGES)"""


@query()
def text_changes(spark, d):
    return textdiff.text_changes(bound(spark, d, "text_items")).withColumns({c: F.round(c, 6) for c in ("similarity", "score")})


@query()
def text_identical_pairs(spark, d):
    return textdiff.identical_pairs(bound(spark, d, "text_items"))


def _dimension_edits(spark, d):
    """Texts that changed under one item_id, with their class and difference, placed where the new one stands."""
    items = bound(spark, d, "text_items")
    old = items.where("side = 'old'").select("pair_id", "item_id", F.col("text").alias("old_text"))
    pairs = items.where("side = 'new'").join(old, ["pair_id", "item_id"]).where("text <> old_text")
    change = measures.numeric_change(F.col("old_text"), F.col("text"), F.col("text").startswith("FFL"))
    return pairs.select("pair_id", F.col("item_id").alias("id"), measures.classify(F.col("text"))["category"].alias("category"), change["delta_mm"].alias("delta_mm"), "x", "y", "w", "h")


def _moved_lines(spark, d):
    """New segments that stand elsewhere than the old one of their path."""
    place = [F.least("x0", "x1"), F.least("y0", "y1")]
    s = bound(spark, d, "segments")
    old = s.where("side = 'old'").select("pair_id", "path_id", *(c.alias(n) for c, n in zip(place, ("was_x", "was_y"), strict=True)))
    moved = s.where("side = 'new'").join(old, ["pair_id", "path_id"]).where((place[0] != F.col("was_x")) | (place[1] != F.col("was_y")))
    return moved.select("pair_id", F.lit("line").alias("geometry_type"), (F.least("x0", "x1") / 10).alias("x"), (F.least("y0", "y1") / 10).alias("y"), (F.abs(F.col("x1") - F.col("x0")) / 10).alias("w"), (F.abs(F.col("y1") - F.col("y0")) / 10).alias("h"))


EDITS = """e AS (SELECT n.pair_id, n.item_id AS id, upper(n.text) AS u, o.text AS o, n.text AS n, n.x, n.y, n.w, n.h FROM ITEMS n JOIN ITEMS o ON o.pair_id = n.pair_id AND o.item_id = n.item_id AND o.side = 'old' AND n.side = 'new' AND o.text <> n.text),
 c AS (SELECT *, CASE WHEN starts_with(u, 'FFL') THEN 'level' WHEN regexp_full_match(u, 'D-?\\d+') THEN 'tag' ELSE 'dimension' END AS category,
  CASE WHEN starts_with(u, 'FFL') THEN (regexp_extract(n, '([0-9.]+)$', 1)::DOUBLE - regexp_extract(o, '([0-9.]+)$', 1)::DOUBLE) * 1000 WHEN regexp_full_match(u, '\\d+') THEN n::DOUBLE - o::DOUBLE END AS delta FROM e),
 sg AS (SELECT * FROM SEGMENTS),
 l AS (SELECT n.pair_id, least(n.x0, n.x1) / 10 AS gx, least(n.y0, n.y1) / 10 AS gy, abs(n.x1 - n.x0) / 10 AS gw, abs(n.y1 - n.y0) / 10 AS gh FROM sg n JOIN sg o ON n.pair_id = o.pair_id AND n.path_id = o.path_id AND n.side = 'new' AND o.side = 'old' WHERE (least(n.x0, n.x1), least(n.y0, n.y1)) <> (least(o.x0, o.x1), least(o.y0, o.y1)))"""


@query(
    f"""WITH {EDITS}, j AS (SELECT c.pair_id, id, any_value(category) AS category, any_value(delta) AS delta, count(gx) AS near FROM c LEFT JOIN l ON c.pair_id = l.pair_id AND x - 12 <= gx + gw AND gx <= x + w + 12 AND y - 12 <= gy + gh AND gy <= y + h + 12 GROUP BY 1, 2)
 SELECT pair_id, id, CASE WHEN category = 'tag' THEN 'unknown' WHEN near > 0 THEN 'consistent' ELSE 'dimension_text_only' END AS flag, CASE WHEN category = 'tag' THEN 0 ELSE near END AS n_near,
  round(CASE WHEN category = 'dimension' AND near = 1 AND delta <> 0 THEN delta END, 6) AS quantity_mm FROM j"""
)
def dimension_crosscheck(spark, d):
    return textdiff.dimension_crosscheck(_dimension_edits(spark, d), _moved_lines(spark, d), 12.0).withColumn("quantity_mm", F.round("quantity_mm", 6))


@query(
    f"""WITH {EDITS}, s AS (SELECT n.pair_id, n.item_id AS id, n.x, n.y, n.w, n.h FROM ITEMS n JOIN ITEMS o ON o.pair_id = n.pair_id AND o.item_id = n.item_id AND o.side = 'old' AND n.side = 'new' AND o.text = n.text AND o.x = n.x WHERE regexp_full_match(n.text, '\\d+'))
 SELECT s.pair_id, id, count(*) AS n_near FROM s JOIN l ON s.pair_id = l.pair_id AND x - 12 <= gx + gw AND gx <= x + w + 12 AND y - 12 <= gy + gh AND gy <= y + h + 12 GROUP BY 1, 2"""
)
def stale_dimensions(spark, d):
    items = bound(spark, d, "text_items")
    old = items.where("side = 'old'").select("pair_id", "item_id", F.col("text").alias("old_text"), F.col("x").alias("old_x"))
    same = items.where("side = 'new'").join(old, ["pair_id", "item_id"]).where("text = old_text and x = old_x")
    dimensions = same.where(measures.classify(F.col("text"))["category"] == "dimension").where(F.col("text").rlike(r"^\d+$"))
    return textdiff.stale_dimensions(dimensions.select("pair_id", F.col("item_id").alias("id"), "x", "y", "w", "h"), _moved_lines(spark, d), 12.0)


@query(
    """WITH s AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM SEGMENTS), t AS (SELECT * FROM s WHERE len <= 30),
 e AS (SELECT s.pair_id, s.side, s.path_id, n, CASE WHEN n = 0 THEN s.x0 ELSE s.x1 END AS px, CASE WHEN n = 0 THEN s.y0 ELSE s.y1 END AS py FROM s, (VALUES (0), (1)) AS v(n) WHERE s.len >= 60),
 h AS (SELECT DISTINCT e.pair_id, e.side, e.path_id, n FROM e JOIN t ON e.pair_id = t.pair_id AND e.side = t.side AND px BETWEEN least(t.x0, t.x1) - 250 AND greatest(t.x0, t.x1) + 250 AND py BETWEEN least(t.y0, t.y1) - 250 AND greatest(t.y0, t.y1) + 250)
 SELECT pair_id, side, path_id FROM h GROUP BY ALL HAVING count(*) = 2"""
)
def dimension_lines(spark, d):
    return textdiff.dimension_lines(bound(spark, d, "segments"), tick=30.0, reach=250.0, least=60.0)


@query(
    f"""WITH {ROWS}, s AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS n FROM r WHERE wording = 'line weight')
 SELECT pair_id, change_id, kind, x, y, w, h FROM r ANTI JOIN (SELECT change_id FROM s WHERE n >= 2) USING (change_id)
 UNION ALL SELECT pair_id, min(change_id), 'style_only', min(x), min(y), max(x + w) - min(x), max(y + h) - min(y) FROM s WHERE n >= 2 GROUP BY pair_id"""
)
def line_weight_collapse(spark, d):
    return noise.style_collapse("line weight")(_rows(spark, d)).kept.select("pair_id", "change_id", "kind", "x", "y", "w", "h")


def _layers(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select((k % 50).alias("pair_id"), F.when(k % 2 == 0, "old").otherwise("new").alias("side"), F.concat(F.lit("L"), (k % 13).cast("string")).alias("name"), (k % 1300 < 1200).alias("visible"))


def _content(spark, d):
    return bound(spark, d, "changes").groupBy("pair_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).select("pair_id", "x", "y", F.lit(900.0).alias("w"), F.lit(700.0).alias("h"))


LAYERS = """ly AS (SELECT o_orderkey % 50 AS pair_id, o_orderkey % 2 = 0 AS is_old, 'L' || (o_orderkey % 13) AS name, o_orderkey % 1300 < 1200 AS visible FROM orders),
 tg AS (SELECT pair_id, name, coalesce(bool_or(visible) FILTER (is_old), false) AS o, coalesce(bool_or(visible) FILTER (NOT is_old), false) AS n FROM ly GROUP BY ALL HAVING o <> n),
 rg AS (SELECT pair_id, min(x) - 12 AS rx, min(y) - 12 AS ry, 924.0 AS rw, 724.0 AS rh FROM CHANGES GROUP BY 1)"""


@query(
    f"""WITH {ROWS}, {LAYERS}, g AS (SELECT r.pair_id, change_id FROM r JOIN rg USING (pair_id) WHERE stream <> 'text' AND pair_id IN (SELECT pair_id FROM tg) AND greatest(0, least(x + w, rx + rw) - greatest(x, rx)) * greatest(0, least(y + h, ry + rh) - greatest(y, ry)) >= 0.8 * w * h)
 SELECT pair_id, kind, count(*) AS n FROM (SELECT pair_id, kind FROM r ANTI JOIN g USING (change_id) UNION ALL SELECT pair_id, 'layer_visibility_changed' FROM tg) GROUP BY ALL"""
)
def layer_absorb(spark, d):
    return noise.layer_toggle(_layers(spark, d), _content(spark, d))(_rows(spark, d)).kept.groupBy("pair_id", "kind").agg(F.count("*").alias("n"))


def _plain_texts(spark, d):
    return _rows(spark, d).where("stream = 'text'").select("pair_id", F.col("change_id").alias("id"), "x", "y", F.lit(40.0).alias("w"), F.lit(30.0).alias("h"))


@query(
    f"""WITH {ROWS}, t AS (SELECT pair_id, x - 7.8 AS tx, y - 7.8 AS ty, 55.6 AS tw, 45.6 AS th FROM r WHERE stream = 'text')
 SELECT DISTINCT r.pair_id, change_id FROM r JOIN t USING (pair_id) WHERE stream = 'raster' AND greatest(0, least(x + w, tx + tw) - greatest(x, tx)) * greatest(0, least(y + h, ty + th) - greatest(y, ty)) > 0.8 * w * h"""
)
def font_substitution(spark, d):
    return noise.font_substitution(_plain_texts(spark, d))(_rows(spark, d)).suppressed.select("pair_id", "change_id")


@query(
    f"""WITH {ROWS}, i AS (SELECT *, w * h AS px FROM r WHERE stream = 'raster'), m AS (SELECT * FROM i WHERE px < 60 AND px >= 30)
 SELECT pair_id, change_id FROM i WHERE px < 30 UNION ALL
 SELECT pair_id, change_id FROM m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.pair_id = m.pair_id AND i.change_id <> m.change_id AND i.px >= 30 AND i.x <= m.x + m.w + 20 AND m.x - 20 <= i.x + i.w AND i.y <= m.y + m.h + 20 AND m.y - 20 <= i.y + i.h)"""
)
def speckle(spark, d):
    return noise.speckle(60.0, 20.0)(_rows(spark, d)).suppressed.select("pair_id", "change_id")


@query(
    f"""WITH {ROWS}, l AS (SELECT * FROM r WHERE stream = 'raster' AND w * h >= 3000)
 SELECT pair_id, kind, count(*) AS n, sum(w * h) AS area FROM (SELECT pair_id, kind, w, h FROM r ANTI JOIN l USING (change_id) UNION ALL SELECT pair_id, 'background_updated', max(x + w) - min(x), max(y + h) - min(y) FROM l GROUP BY 1) GROUP BY ALL"""
)
def background_update(spark, d):
    kept = noise.background_update(20_000.0)(_rows(spark, d)).kept
    return kept.groupBy("pair_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("area")).withColumn("area", F.round("area", 6))


def _pixels(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    unique = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    ink = (k * 7 + n) % 3 == 0
    return unique.select((k % 50).alias("pair_id"), k.alias("x"), n.alias("y"), (F.col("p") % 256).alias("old_r"), (F.col("p") * 3 % 256).alias("old_g"), (F.col("p") * 7 % 256).alias("old_b"), *(F.when(k % 50 < 25, F.col("p") * m % 256).otherwise(F.col("p") % 256).alias(f"new_{c}") for m, c in ((1, "r"), (3, "g"), (7, "b"))), ink.alias("old_ink"), (ink & ((k % 50 % 4 != 0) | (k % 11 != 0))).alias("new_ink"))


@query(
    """WITH u AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
 c AS (SELECT *, [p % 256, p * 3 % 256, p * 7 % 256] AS o, CASE WHEN k % 50 < 25 THEN [p % 256, p * 3 % 256, p * 7 % 256] ELSE [p % 256] END AS w, (k * 7 + n) % 3 = 0 AS oi FROM u),
 s AS (SELECT k % 50 AS pair_id, CASE WHEN list_max(o) = 0 THEN 0 ELSE (list_max(o) - list_min(o)) * 255.0 / list_max(o) END AS a, CASE WHEN list_max(w) = 0 THEN 0 ELSE (list_max(w) - list_min(w)) * 255.0 / list_max(w) END AS b, oi, oi AND (k % 50 % 4 <> 0 OR k % 11 <> 0) AS ni FROM c)
 SELECT pair_id, abs(avg(a) - avg(b)) > 4 AND coalesce(count(*) FILTER (oi AND ni) / nullif(count(*) FILTER (oi OR ni), 0), 1) > 0.95 AS plot_changed FROM s GROUP BY 1"""
)
def plot_settings(spark, d):
    return noise.plot_settings(_pixels(spark, d))


def _ink(spark, d):
    """Ink pixels of ten pairs: (old, new), with the pixels that differ."""
    ink = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("pair_id"), (F.col("l_partkey") * 7 % 97).alias("x"), (F.col("l_orderkey") * 13 % 89).alias("y"), (F.col("l_linenumber") % 2 == 0).alias("is_old")).distinct()
    return ink.where("is_old").drop("is_old"), ink.where("not is_old").drop("is_old")


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey % 10 AS pair_id, l_partkey * 7 % 97 AS x, l_orderkey * 13 % 89 AS y, l_linenumber % 2 = 0 AS o FROM lineitem),
 a AS (SELECT pair_id, x, y FROM i WHERE o), b AS (SELECT pair_id, x, y FROM i WHERE NOT o), c AS ((FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a)),
 v AS (SELECT range - 3 AS v FROM range(7)), k AS (SELECT x.v AS i, y.v AS j FROM v x, v y WHERE x.v ** 2 + y.v ** 2 <= 9),
 t AS (SELECT DISTINCT a.pair_id, a.x + i AS x, a.y + j AS y FROM a JOIN b USING (pair_id, x, y), k),
 n AS (SELECT c.pair_id, c.x + i AS x, c.y + j AS y FROM c, k WHERE abs(i) <= 1 AND abs(j) <= 1 AND (i <> 0 OR j <> 0)), f AS (SELECT pair_id, x, y FROM n GROUP BY ALL HAVING count(*) = 8)
 SELECT c.pair_id, round(avg((f.x IS NULL)::INT), 6) AS thin_share, round(avg((t.x IS NOT NULL)::INT), 6) AS tracing_share FROM c LEFT JOIN f USING (pair_id, x, y) LEFT JOIN t USING (pair_id, x, y) GROUP BY 1"""
)
def residual_shares(spark, d):
    old, new = _ink(spark, d)
    changed = old.exceptAll(new).unionByName(new.exceptAll(old))
    shares = noise.residual_shares(changed, old, new)
    return shares.select("pair_id", *(F.round(c, 6).alias(c) for c in ("thin_share", "tracing_share")))


PLOTS = """u AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
 pc AS (SELECT *, [p % 256, p * 3 % 256, p * 7 % 256] AS o, CASE WHEN k % 50 < 25 THEN [p % 256, p * 3 % 256, p * 7 % 256] ELSE [p % 256] END AS w, (k * 7 + n) % 3 = 0 AS oi FROM u),
 ps AS (SELECT k % 50 AS pair_id, CASE WHEN list_max(o) = 0 THEN 0 ELSE (list_max(o) - list_min(o)) * 255.0 / list_max(o) END AS a, CASE WHEN list_max(w) = 0 THEN 0 ELSE (list_max(w) - list_min(w)) * 255.0 / list_max(w) END AS b, oi, oi AND (k % 50 % 4 <> 0 OR k % 11 <> 0) AS ni FROM pc),
 pp AS (SELECT pair_id FROM ps GROUP BY 1 HAVING abs(avg(a) - avg(b)) > 4 AND coalesce(count(*) FILTER (oi AND ni) / nullif(count(*) FILTER (oi OR ni), 0), 1) > 0.95)"""


def _inside(box: str, share: str) -> str:
    """SQL: the share of (x, y, w, h) that lies in a box with columns of a prefix."""
    b = {c: f"{box}{c}" for c in "xywh"}
    return f"greatest(0, least(x + w, {b['x']} + {b['w']}) - greatest(x, {b['x']})) * greatest(0, least(y + h, {b['y']} + {b['h']}) - greatest(y, {b['y']})) {share} * w * h"


@query(
    f"""WITH {ROWS}, {LAYERS}, {PLOTS},
 a0 AS (SELECT *, pair_id % 17 = 3 AS aside, CASE WHEN pair_id % 17 = 3 AND stream <> 'text' THEN 'detect_alignment_residual' END AS t0 FROM r),
 a1 AS (SELECT *, CASE WHEN t0 IS NULL AND stream <> 'text' AND w * h > 0 AND pair_id IN (SELECT pair_id FROM tg) AND EXISTS (SELECT 1 FROM rg WHERE rg.pair_id = a0.pair_id AND {_inside("r", ">= 0.8")}) THEN 'filter_layer_toggle' END AS t1 FROM a0),
 b AS (SELECT pair_id, stream, kind, wording, x, y, w, h, change_id FROM a1 WHERE coalesce(t0, t1) IS NULL AND NOT aside
  UNION ALL SELECT pair_id, 'vector', 'layer_visibility_changed', name, rx + 12, ry + 12, 900, 700, NULL FROM tg LEFT JOIN rg USING (pair_id) WHERE pair_id % 17 <> 3),
 s AS (SELECT *, CASE WHEN kind = 'style_only' AND contains(wording, 'line weight') THEN 'line weight' WHEN kind = 'style_only' AND contains(wording, 'line type') THEN 'line type' END AS style FROM b),
 s2 AS (SELECT *, style IS NOT NULL AND count(style) OVER (PARTITION BY pair_id, style) >= 2 AS t2 FROM s),
 c AS (SELECT *, CASE WHEN stream = 'raster' AND pair_id IN (SELECT pair_id FROM pp) THEN 'filter_colour_plot'
   WHEN stream = 'raster' AND w * h > 0 AND EXISTS (SELECT 1 FROM (SELECT pair_id, x - 7.8 AS tx, y - 7.8 AS ty, 55.6 AS tw, 45.6 AS th FROM r WHERE stream = 'text') f WHERE f.pair_id = s2.pair_id AND {_inside("t", "> 0.8")}) THEN 'filter_font_substitution' END AS t3
  FROM s2 WHERE NOT t2),
 i AS (SELECT pair_id, change_id, x, y, w, h, w * h AS px FROM c WHERE stream = 'raster' AND t3 IS NULL),
 m AS (SELECT change_id FROM i AS m WHERE px < 8 OR px < 16 AND NOT EXISTS (SELECT 1 FROM i WHERE i.pair_id = m.pair_id AND i.change_id <> m.change_id AND i.px >= 8
   AND i.x <= m.x + m.w + 1000 / 25.4 AND m.x - 1000 / 25.4 <= i.x + i.w AND i.y <= m.y + m.h + 1000 / 25.4 AND m.y - 1000 / 25.4 <= i.y + i.h)),
 e AS (SELECT *, CASE WHEN t3 IS NOT NULL THEN t3 WHEN stream = 'raster' AND change_id IN (SELECT change_id FROM m) THEN 'filter_speckle' WHEN stream = 'raster' AND w * h >= 6000 THEN 'filter_background_update' END AS t4 FROM c),
 gone AS (SELECT coalesce(t0, t1) AS name FROM a1 WHERE coalesce(t0, t1) IS NOT NULL UNION ALL SELECT 'filter_' || replace(style, ' ', '_') FROM s2 WHERE t2 UNION ALL SELECT t4 FROM e WHERE t4 IS NOT NULL),
 kept AS (SELECT kind FROM e WHERE t4 IS NULL UNION ALL SELECT kind FROM a1 WHERE aside AND coalesce(t0, t1) IS NULL UNION ALL SELECT 'layer_visibility_changed' FROM tg LEFT JOIN rg USING (pair_id) WHERE pair_id % 17 = 3
  UNION ALL SELECT 'style_only' FROM s2 WHERE t2 GROUP BY pair_id, style UNION ALL SELECT 'background_updated' FROM e WHERE t4 = 'filter_background_update' GROUP BY pair_id)
 SELECT 'kept' AS what, kind AS name, count(*) AS n FROM kept GROUP BY ALL UNION ALL SELECT 'suppressed', name, count(*) FROM gone GROUP BY ALL"""
)
def run_filters(spark, d):
    """How many changes all filters keep and suppress, by filter."""
    out = noise.run_filters(_rows(spark, d), residual=spark.range(50).where("id % 17 = 3").select(F.col("id").alias("pair_id")), layers=_layers(spark, d), regions=_content(spark, d), settings=noise.plot_settings(_pixels(spark, d)), unchanged=_plain_texts(spark, d), sheet_area=40_000.0)
    kept = out.kept.groupBy(F.lit("kept").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    return kept.unionByName(out.suppressed.groupBy(F.lit("suppressed").alias("what"), F.col("filter_name").alias("name")).agg(F.count("*").alias("n")))


def _hatched(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select((k % 20).alias("pair_id"), ((k * 37) % 8000).cast("double").alias("x"), ((k * 53) % 5600).cast("double").alias("y"), F.lit(30.0).alias("w"), F.lit(20.0).alias("h"))


@query(
    """WITH s AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM SEGMENTS WHERE path_id % 29 <> 2),
 g AS (SELECT o_orderkey % 20 AS pair_id, o_orderkey * 37 % 8000 - 30 AS gx, o_orderkey * 53 % 5600 - 30 AS gy FROM orders)
 SELECT pair_id, side, count(*) AS n FROM s WHERE NOT (len <= 60 AND EXISTS (SELECT 1 FROM g WHERE g.pair_id = s.pair_id AND mx BETWEEN gx AND gx + 90 AND my BETWEEN gy AND gy + 80)) GROUP BY ALL"""
)
def exclude_hatch(spark, d):
    s = bound(spark, d, "segments")
    return noise.exclude_hatch(s, s.where("path_id % 29 = 2"), _hatched(spark, d), 60.0).groupBy("pair_id", "side").agg(F.count("*").alias("n"))


@query()
def match_hatch_regions(spark, d):
    old = hatched_blocks(spark, d)
    new = old.withColumns({"x": F.col("x") + F.col("region_id") % 5 * 8, "spacing": F.when(F.col("region_id") % 6 == 0, F.col("spacing") + 1).otherwise(F.col("spacing"))}).where("region_id % 9 <> 4")
    return hatch.diff_regions(old, new)


def hatched_blocks(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select((k % 20).alias("pair_id"), k.alias("region_id"), (F.floor(k / 20) % 40 * 110).cast("double").alias("x"), (F.floor(k / 800) * 90).cast("double").alias("y"), F.lit(100.0).alias("w"), F.lit(80.0).alias("h"), (k % 3 * 45).cast("double").alias("angle"), F.lit(6.0).alias("spacing"))


@query()
def compare_pairs(spark, d):
    """The whole comparison of all pairs: reportable changes counted by stream and kind."""
    found = comparison.compare_issues(bound(spark, d, "text_items"), bound(spark, d, "segments"), sheet_area=8000.0 * 5600.0, hatched=True)
    return found.changes.groupBy("stream", "kind", "is_cosmetic").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("pairs"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 10000000 + o_custkey % 97 * 1000 + o_orderkey % 7 AS b FROM orders),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, min(r.component) FROM r JOIN u ON u.a = r.id JOIN recurring.r k ON k.id = u.b WHERE r.component < k.component GROUP BY u.b)
 SELECT id, component FROM r"""
)
def linked_components(spark, d):
    c = F.col("o_custkey")
    return graph.components(table(spark, d, "orders").select(c.alias("src"), (10_000_000 + c % 97 * 1000 + F.col("o_orderkey") % 7).alias("dst"))).distinct()


def _scored(spark, d):
    """A quarter of the changes by number, shifted, as what was planted, and the reportable changes as the report."""
    c = bound(spark, d, "changes")
    planted = c.where("change_id % 40 < 10").select("pair_id", F.col("change_id").alias("truth_id"), (F.col("x") + F.col("change_id") % 9).alias("x"), "y", "w", "h")
    return c.where("not is_cosmetic").select("pair_id", "change_id", "x", "y", "w", "h"), planted


SCORED = """c AS (SELECT * FROM CHANGES), t AS (SELECT pair_id, change_id AS truth_id, x + change_id % 9 AS x, y, w, h FROM c WHERE change_id % 40 < 10), r AS (SELECT * FROM c WHERE NOT is_cosmetic),
 o AS (SELECT t.pair_id, truth_id, change_id, greatest(0, least(t.x + t.w, r.x + r.w) - greatest(t.x, r.x)) * greatest(0, least(t.y + t.h, r.y + r.h) - greatest(t.y, r.y)) AS s, t.w * t.h AS p, r.w * r.h AS q
  FROM t JOIN r ON t.pair_id = r.pair_id AND t.x <= r.x + r.w AND r.x <= t.x + t.w AND t.y <= r.y + r.h AND r.y <= t.y + t.h),
 f AS (SELECT pair_id, truth_id, min(change_id) AS taker FROM o WHERE s >= 0.3 * (p + q - s) OR s >= 0.6 * least(p, q) GROUP BY 1, 2),
 e AS (SELECT pair_id, (SELECT count(*) FROM t WHERE t.pair_id = g.pair_id) AS expected, (SELECT count(*) FROM r WHERE r.pair_id = g.pair_id) AS reported, (SELECT count(DISTINCT taker) FROM f WHERE f.pair_id = g.pair_id) AS matched, (SELECT count(*) FROM f WHERE f.pair_id = g.pair_id) AS covered
  FROM (SELECT DISTINCT pair_id FROM c) g)"""


@query(f"WITH {SCORED} SELECT *, reported - matched AS false_positives, expected - covered AS missed FROM e WHERE expected + reported > 0")
def truth_scores(spark, d):
    return store.score_cases(*_scored(spark, d))


@query(
    f"""WITH {SCORED}, k AS (SELECT *, reported - matched AS fp, expected - covered AS ms FROM e WHERE expected + reported > 0)
 SELECT count(*) AS cases, sum(expected)::BIGINT AS expected, sum(reported)::BIGINT AS reported, sum(matched)::BIGINT AS matched, sum(covered)::BIGINT AS covered, sum(fp)::BIGINT AS false_positives, sum(ms)::BIGINT AS missed, round(avg((fp = 0 AND ms = 0)::INT), 6) AS clean_share,
  round(sum(matched) / sum(reported), 6) AS precision, round(sum(covered) / sum(expected), 6) AS recall FROM k"""
)
def truth_matrix(spark, d):
    return store.score_matrix(store.score_cases(*_scored(spark, d))).withColumns({c: F.round(c, 6) for c in ("clean_share", "precision", "recall")})
