"""Queries on units, boxes, polygons and plane maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillset.functions import geometry as g
from quillset.plans.registry import Registry
from quillset.sources.bindings import bound, table

query = Registry()


def _rounded(**columns) -> list:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


@query(
    """SELECT p_partkey, round(p_size * (200 / 25.4), 6) AS px, round(p_size / (200::DOUBLE / 25.4::DOUBLE), 6) AS mm, CASE WHEN p_partkey % 4 > 0 THEN p_size * (p_partkey % 4) * 50.0 END AS site,
 CASE WHEN p_partkey % 4 > 0 AND p_partkey % 3 > 0 THEN round((p_partkey % 4) / (p_partkey % 3)::DOUBLE * sqrt((100.0 + p_size)::DOUBLE / 100), 6) END AS growth,
 CASE WHEN p_partkey % 4 > 0 THEN round(p_size * 997 * (25.4 / 200) ** 2 * ((p_partkey % 4) * 50) ** 2 / 1e6, 6) END AS m2 FROM part"""
)
def units_convert(spark, d):
    size, k = F.col("p_size").cast("double"), F.col("p_partkey")
    denominator = (k % 4 * 50).cast("double")
    growth = g.expected_content_scale((k % 4).cast("double"), (k % 3).cast("double"), F.lit(100.0), F.lit(100.0) + size)
    return table(spark, d, "part").select("p_partkey", *_rounded(px=g.mm_to_px(size), mm=g.px_to_mm(size), site=g.site_mm(size, denominator), growth=growth, m2=g.area_site_m2(size * 997, denominator)))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN printf('%.2f mm on paper, %.0f mm on site at 1:%d', (p_size + 0.1) / (200 / 25.4), (p_size + 0.1) / (200 / 25.4) * (p_partkey % 4 * 50), p_partkey % 4 * 50)
 ELSE printf('%.2f mm on paper', (p_size + 0.1) / (200 / 25.4)) END AS shown FROM part"""
)
def length_text(spark, d):
    return table(spark, d, "part").select("p_partkey", g.length_text(F.col("p_size") + 0.1, (F.col("p_partkey") % 4 * 50).cast("double")).alias("shown"))


@query(
    """WITH b AS (SELECT change_id, x, y, w, h, x + (change_id % 7) * 4 AS ox, y + (change_id % 5) * 4 AS oy, 30.0 AS ow, 20.0 AS oh FROM CHANGES),
 s AS (SELECT *, greatest(0, least(x + w, ox + ow) - greatest(x, ox)) * greatest(0, least(y + h, oy + oh) - greatest(y, oy)) AS shared FROM b)
 SELECT change_id, ox >= x AND oy >= y AND ox + ow <= x + w AND oy + oh <= y + h AS contains, x <= ox + ow AND ox <= x + w AND y <= oy + oh AND oy <= y + h AS touches, shared,
  round(shared / (w * h + 600 - shared), 6) AS iou, round(shared / (w * h), 6) AS inside, greatest(x + w, ox + ow) - least(x, ox) AS union_w, greatest(y + h, oy + oh) - least(y, oy) AS union_h,
  round(least(greatest((x + w) / 1500, 0), 1) - least(greatest(x / 1500, 0), 1), 6) AS clip_w, x - 3 <= ox + 33 AND ox <= x + w + 3 AS near FROM s"""
)
def box_algebra(spark, d):
    k = F.col("change_id")
    b = g.Box.of()
    o = g.Box(b.x + (k % 7) * 4, b.y + (k % 5) * 4, F.lit(30.0), F.lit(20.0))
    wide, union, clip = b.expanded(3.0), b.union(o), b.scaled(1 / 1500).clipped()
    near = (wide.x <= o.x + o.w + 3) & (o.x <= wide.x + wide.w)
    return bound(spark, d, "changes").select("change_id", b.contains(o).alias("contains"), b.intersects(o).alias("touches"), b.shared(o).alias("shared"), *_rounded(iou=b.iou(o), inside=b.inside(o)), union.w.alias("union_w"), union.h.alias("union_h"), F.round(clip.w, 6).alias("clip_w"), near.alias("near"))


@query(
    """WITH p AS (SELECT p_partkey, (p_partkey * 37 % 100)::DOUBLE AS x, (p_partkey * 53 % 100)::DOUBLE AS y, [[10, 10], [90, 20 + p_partkey % 30], [60, 60], [80, 95], [15, 80]] AS g FROM part),
 e AS (SELECT p_partkey, x, y, g[i][1] AS ax, g[i][2] AS ay, g[i % 5 + 1][1] AS bx, g[i % 5 + 1][2] AS b_y FROM p, generate_series(1, 5) AS s(i))
 SELECT p_partkey, count(*) FILTER (((ay > y) <> (b_y > y)) AND x < ax + (y - ay) * (bx - ax) / nullif(b_y - ay, 0)) % 2 = 1 AS inside FROM e GROUP BY p_partkey"""
)
def polygon_hits(spark, d):
    k = F.col("p_partkey")
    corners = ((F.lit(10), F.lit(10)), (F.lit(90), 20 + k % 30), (F.lit(60), F.lit(60)), (F.lit(80), F.lit(95)), (F.lit(15), F.lit(80)))
    polygon = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners))
    return table(spark, d, "part").select("p_partkey", g.in_polygon((k * 37 % 100).cast("double"), (k * 53 % 100).cast("double"), polygon).alias("inside"))


@query(
    """SELECT p_partkey, round((p_size + 1192) * (200 / 72.0), 6) AS px, round((1684 - (p_partkey % 500 + 842)) * (200 / 72.0), 6) AS py FROM part"""
)
def page_points(spark, d):
    px, py = g.page_to_px(F.col("p_size"), F.col("p_partkey") % 500, F.lit(-1192.0), F.lit(-842.0), F.lit(1684.0))
    return table(spark, d, "part").select("p_partkey", *_rounded(px=px, py=py))


@query(
    """WITH m AS (SELECT *, 0.8 + (change_id % 3) * 0.1 AS a, 0.1 * (change_id % 5) AS s, change_id % 11 - 5.0 AS t FROM CHANGES),
 c AS (SELECT change_id, t, a * i - s * j + 2 * t AS px, s * i + a * j - 2 * t AS py FROM (SELECT change_id, a, s, t, unnest([x, x, x + w, x + w]) AS i, unnest([y, y + h, y, y + h]) AS j FROM m))
 SELECT change_id, round(min(px), 6) AS x, round(min(py), 6) AS y, round(max(px) - min(px), 6) AS w, round(max(py) - min(py), 6) AS h FROM c GROUP BY change_id"""
)
def warp_boxes(spark, d):
    k = F.col("change_id")
    a, s, t = F.lit(0.8) + (k % 3) * 0.1, (k % 5) * 0.1, (k % 11 - 5).cast("double")
    box = g.mapped_box(g.Box.of(), g.at_other_dpi((a, -s, s, a, t, -t), 2.0))
    return bound(spark, d, "changes").select("change_id", *(F.round(c, 6).alias(n) for c, n in zip(box.columns, "xywh", strict=True)))


@query(
    """WITH m AS (SELECT p_partkey, (p_partkey % 7 - 3)::DOUBLE AS a, (p_partkey % 5 - 2)::DOUBLE AS b, (p_partkey % 3 - 1)::DOUBLE AS c, (p_partkey % 11 - 4)::DOUBLE AS d FROM part),
 l AS (SELECT *, a * d - b * c AS det, sqrt(a * a + c * c) AS len FROM m)
 SELECT p_partkey, round(CASE WHEN len = 0 THEN 0 ELSE degrees(atan2(c, a)) END, 6) AS rotation_deg, round(len, 6) AS scale_x, round(CASE WHEN len = 0 THEN sqrt(b * b + d * d) * CASE WHEN det < 0 THEN -1 ELSE 1 END ELSE det / len END, 6) AS scale_y,
  round(CASE WHEN len = 0 THEN 0 ELSE (a * b + c * d) / len END, 6) AS shear, det AS determinant FROM l"""
)
def matrix_decompose(spark, d):
    k = F.col("p_partkey")
    m = tuple((k % n - s).cast("double") for n, s in ((7, 3), (5, 2), (3, 1), (11, 4)))
    parts = table(spark, d, "part").select("p_partkey", g.decomposed((*m, F.lit(0.0), F.lit(0.0))).alias("p"))
    return parts.select("p_partkey", *(F.round(f"p.{c}", 6).alias(c) for c in ("rotation_deg", "scale_x", "scale_y", "shear")), "p.determinant")


@query(
    """WITH s AS (SELECT p_partkey, round_even((200.0 + p_partkey * 37 % 700) / 5, 0) * 5 AS width, round_even((280.0 + p_partkey * 53 % 950) / 5, 0) * 5 AS height, p_partkey * 13 % 3000 AS n FROM part)
 SELECT p_partkey, width, height, CASE WHEN width = height THEN 'square' WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation, (n >= 100)::INT + (n >= 500)::INT + (n >= 2000)::INT AS paths FROM s"""
)
def page_shapes(spark, d):
    k = F.col("p_partkey")
    shape = g.page_shape(F.lit(200.0) + k * 37 % 700, F.lit(280.0) + k * 53 % 950)
    return table(spark, d, "part").select("p_partkey", shape.alias("s"), g.path_class(k * 13 % 3000).alias("paths")).select("p_partkey", "s.width", "s.height", "s.orientation", "paths")
