"""Queries on alignment, its quality gate, rasters, paths, jobs and review grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillset.functions import numbers
from quillset.operators import align, compare, gate, ingest, raster, register
from quillset.plans.registry import Registry
from quillset.sources.bindings import bound, table
from quillset.storage import materialise
from quillset.streaming import progress

query = Registry()


def _points(spark, d):
    return bound(spark, d, "points").withColumn("weight", (F.col("k") % 3 + 1).cast("double"))


@query(
    """WITH p AS (SELECT *, (k % 3 + 1)::DOUBLE AS w FROM POINTS), m AS (SELECT pair_id, sum(w) AS n, sum(w * ox) / sum(w) AS mx, sum(w * oy) / sum(w) AS my, sum(w * nx) / sum(w) AS ux, sum(w * ny) / sum(w) AS uy FROM p GROUP BY 1),
 c AS (SELECT p.pair_id, any_value(mx) AS mx, any_value(my) AS my, any_value(ux) AS ux, any_value(uy) AS uy, sum(w * (ox - mx) * (ox - mx)) AS xx, sum(w * (oy - my) * (oy - my)) AS yy, sum(w * (ox - mx) * (oy - my)) AS xy,
  sum(w * (ox - mx) * (nx - ux)) AS xu, sum(w * (oy - my) * (nx - ux)) AS yu, sum(w * (ox - mx) * (ny - uy)) AS xv, sum(w * (oy - my) * (ny - uy)) AS yv FROM p JOIN m USING (pair_id) GROUP BY 1),
 a AS (SELECT *, xx * yy - xy * xy AS det FROM c)
 SELECT pair_id, round((xu * yy - yu * xy) / det, 6) AS m00, round((yu * xx - xu * xy) / det, 6) AS m01, round((xv * yy - yv * xy) / det, 6) AS m10, round((yv * xx - xv * xy) / det, 6) AS m11 FROM a"""
)
def affine_fit(spark, d):
    return gate.fit(_points(spark, d), "affine").select("pair_id", *(F.round(c, 6).alias(c) for c in ("m00", "m01", "m10", "m11")))


@query(
    """WITH p AS (SELECT *, (k % 3 + 1)::DOUBLE AS w FROM POINTS), m AS (SELECT pair_id, sum(w * ox) / sum(w) AS mx, sum(w * oy) / sum(w) AS my, sum(w * nx) / sum(w) AS ux, sum(w * ny) / sum(w) AS uy FROM p GROUP BY 1),
 c AS (SELECT p.pair_id, sum(w * ((ox - mx) ** 2 + (oy - my) ** 2)) AS s, sum(w * ((ox - mx) * (nx - ux) + (oy - my) * (ny - uy))) AS a, sum(w * ((ox - mx) * (ny - uy) - (oy - my) * (nx - ux))) AS b FROM p JOIN m USING (pair_id) GROUP BY 1)
 SELECT pair_id, round(a / s, 6) AS m00, round(b / s, 6) AS m10 FROM c"""
)
def weighted_similarity(spark, d):
    return gate.fit(_points(spark, d)).select("pair_id", *(F.round(c, 6).alias(c) for c in ("m00", "m10")))


def _fit(name: str, of: str, by: str = "pair_id") -> str:
    """SQL: the similarity fit of the points of a relation, as a named one."""
    return f"""{name} AS (SELECT {by}, (covar_pop(ox, nx) + covar_pop(oy, ny)) / nullif(var_pop(ox) + var_pop(oy), 0) AS a, (covar_pop(ox, ny) - covar_pop(oy, nx)) / nullif(var_pop(ox) + var_pop(oy), 0) AS b, avg(ox) AS mx, avg(oy) AS my, avg(nx) AS ux, avg(ny) AS uy, count(*) AS fitted FROM {of} GROUP BY {by})"""


ERR = "sqrt((a * (ox - mx) - b * (oy - my) + ux - nx) ** 2 + (b * (ox - mx) + a * (oy - my) + uy - ny) ** 2)"


def _trimmed(rounds: int = 3) -> str:
    """SQL: trimmed_fit() with a limit of 3 as relation ft, and the points within 3 of it as used."""
    out = [_fit("f0", "POINTS")]
    for i in range(rounds):
        out.append(f"e{i} AS (SELECT p.*, {ERR} AS err FROM POINTS p JOIN f{i} USING (pair_id)), c{i} AS (SELECT pair_id, greatest(3, 2.5 * median(err)) AS cut FROM e{i} GROUP BY 1), u{i} AS (SELECT e{i}.* FROM e{i} JOIN c{i} USING (pair_id) WHERE err <= cut)")
        out.append(_fit("ft" if i == rounds - 1 else f"f{i + 1}", f"u{i}"))
    return ", ".join([*out, f"used AS (SELECT p.* FROM POINTS p JOIN ft USING (pair_id) WHERE {ERR} <= 3)"])


@query(f"WITH {_trimmed()} SELECT pair_id, fitted AS n, round(a, 6) AS a, round(b, 6) AS b, round(ux - a * mx + b * my, 6) AS tx, round(uy - b * mx - a * my, 6) AS ty FROM ft")
def trimmed_fit(spark, d):
    return align.trimmed_fit(bound(spark, d, "points"), 3.0).select("pair_id", "n", *(F.round(c, 6).alias(c) for c in ("a", "b", "tx", "ty")))


def _holdout(of: str) -> str:
    """SQL: the hold-out error of a relation as relation ho."""
    return f"""dealt AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY md5(label), label, ox, oy) % 5 AS fold, count(*) OVER (PARTITION BY pair_id) AS every FROM {of}),
 others AS (SELECT f.fold AS left_out, d.* FROM dealt d JOIN (SELECT range AS fold FROM range(5)) f ON f.fold <> d.fold), {_fit("fo", "others", "pair_id, left_out")},
 eo AS (SELECT dealt.pair_id, fold, sqrt(avg({ERR} ** 2)) AS rms FROM dealt JOIN fo ON fo.pair_id = dealt.pair_id AND left_out = fold WHERE every >= 5 GROUP BY 1, 2), ho AS (SELECT pair_id, avg(rms) AS holdout FROM eo GROUP BY 1)"""


def _hull(of: str) -> str:
    """SQL: the area of the convex hull of old points as relation hl: sides are the pairs that all others lie to the left of."""
    return f"""at0 AS (SELECT DISTINCT pair_id, round(ox, 4) AS x, round(oy, 4) AS y FROM {of}), at1 AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY x, y) AS i FROM at0),
 sides AS (SELECT p.pair_id, p.x * q.y - q.x * p.y AS twice FROM at1 p JOIN at1 q ON p.pair_id = q.pair_id AND p.i <> q.i JOIN at1 r ON r.pair_id = p.pair_id GROUP BY p.pair_id, p.i, q.i, p.x, p.y, q.x, q.y
  HAVING bool_and((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0 OR (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) <= 0)),
 hl AS (SELECT at1.pair_id, coalesce((SELECT sum(twice) / 2 FROM sides WHERE sides.pair_id = at1.pair_id), 0) AS area FROM at1 GROUP BY 1)"""


def _overlap(fits: str) -> str:
    """SQL: the share of ink that both sides of _ink() have, each grown by a pixel, as relation ov."""
    return f"""ink AS (SELECT DISTINCT l_orderkey % 25 AS pair_id, l_partkey * 7 % 97 AS x, l_orderkey * 13 % 89 AS y FROM lineitem), plus(i, j) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)),
 mapped AS (SELECT pair_id, round_even(a * (x - mx) - b * (y - my) + ux, 0)::BIGINT AS x, round_even(b * (x - mx) + a * (y - my) + uy, 0)::BIGINT AS y FROM ink JOIN {fits} USING (pair_id)),
 issued AS (SELECT pair_id, round_even(0.8 * x - 0.6 * y + 10, 0)::BIGINT AS x, round_even(0.6 * x + 0.8 * y - 5, 0)::BIGINT AS y FROM ink),
 grown AS (SELECT DISTINCT pair_id, x + i AS x, y + j AS y, 0 AS side FROM mapped, plus UNION ALL SELECT DISTINCT pair_id, x + i, y + j, 1 FROM issued, plus),
 seen AS (SELECT pair_id, x, y, count(*) AS n FROM grown GROUP BY 1, 2, 3), ov AS (SELECT pair_id, avg((n = 2)::INT) AS ink_overlap FROM seen GROUP BY 1)"""


@query(f"WITH {_holdout('POINTS')} SELECT pair_id, round(holdout, 6) AS holdout FROM ho")
def holdout_error(spark, d):
    return gate.holdout(bound(spark, d, "points")).withColumn("holdout", F.round("holdout", 6))


@query(f"WITH {_hull('POINTS')} SELECT pair_id, round(area, 4) AS area FROM hl")
def anchor_spread(spark, d):
    return gate.hull_area(bound(spark, d, "points")).withColumn("area", F.round("area", 4))


@query(
    """WITH p AS (SELECT DISTINCT pair_id, ox AS x, oy AS y FROM POINTS), d AS (SELECT a.pair_id, a.x, a.y, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d2 FROM p a JOIN p b ON a.pair_id = b.pair_id AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL)
 SELECT pair_id, round(sqrt(min(d2)), 6) AS least, round(sqrt(max(d2)), 6) AS most FROM d GROUP BY 1"""
)
def anchor_spacing(spark, d):
    return gate.nearest_spacing(bound(spark, d, "points")).select("pair_id", *(F.round(c, 6).alias(c) for c in ("least", "most")))


#: SQL: metrics of all kinds, what of them failed or passed barely, as relation v.
LADDER = """WITH m AS (SELECT p_partkey AS pair_id, 0.5 + p_partkey % 23 / 10.0 AS rms, 0.5 + p_partkey % 7 / 12.0 AS inlier_ratio, 2 + p_partkey % 9 AS anchors, 0.2 + p_partkey % 5 / 20.0 AS spread, p_partkey % 11 <> 3 AS sanity, 0.55 + p_partkey % 13 / 30.0 AS ink_overlap, CASE WHEN p_partkey % 9 >= 3 THEN 0.4 + p_partkey % 31 / 10.0 END AS holdout, 0.9 + p_partkey % 3 / 10.0 AS scale FROM part),
 f AS (SELECT *, list_filter([CASE WHEN NOT rms < 2 THEN 'rms' END, CASE WHEN NOT inlier_ratio >= 0.6 THEN 'inlier_ratio' END, CASE WHEN NOT anchors >= 3 THEN 'anchors' END, CASE WHEN NOT spread >= 0.25 THEN 'spread' END, CASE WHEN NOT sanity THEN 'sanity' END, CASE WHEN NOT ink_overlap >= 0.6 THEN 'ink' END, CASE WHEN NOT coalesce(holdout < 3, false) THEN 'holdout' END], lambda x: x IS NOT NULL) AS failed,
  (rms < 2 AND rms >= 1.8)::INT + (inlier_ratio BETWEEN 0.6 AND 0.66)::INT + (anchors BETWEEN 3 AND 3.3)::INT + (spread BETWEEN 0.25 AND 0.275)::INT + (ink_overlap BETWEEN 0.6 AND 0.66)::INT + coalesce(holdout < 3 AND holdout >= 2.7, false)::INT AS marginal FROM m),
 v AS (SELECT *, failed = ['spread'] AND abs(ln(scale)) > 0.05 AS spread_waived FROM f)
"""
VERDICT = "CASE WHEN len(failed) > 0 AND NOT spread_waived THEN 'failed' WHEN marginal >= 2 THEN 'poor' WHEN anchors >= 8 AND rms < 1 AND marginal = 0 AND ink_overlap >= 0.75 AND NOT spread_waived THEN 'excellent' ELSE 'good' END"


@query(f"""{LADDER} SELECT pair_id, len(failed) AS n_failed, marginal AS n_marginal, spread_waived, {VERDICT} AS verdict FROM v""")
def gate_verdicts(spark, d):
    """The ladder over metrics of all kinds, passing, barely passing and failing."""
    return _assessed(spark, d).select("pair_id", F.size("failed").alias("n_failed"), F.size("marginal").alias("n_marginal"), "spread_waived", "verdict")


def _assessed(spark, d):
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(k.alias("pair_id"), (F.lit(0.5) + k % 23 / 10).alias("rms"), (F.lit(0.5) + k % 7 / 12).alias("inlier_ratio"), (2 + k % 9).alias("anchors"), (F.lit(0.2) + k % 5 / 20).alias("spread"), (k % 11 != 3).alias("sanity"), (F.lit(0.55) + k % 13 / 30).alias("ink_overlap"), F.when(k % 9 >= 3, F.lit(0.4) + k % 31 / 10).alias("holdout"), (F.lit(0.9) + k % 3 / 10).alias("scale"), F.lit("similarity").alias("model"))
    return gate.assess(m)


def _ink(spark, d):
    ink = table(spark, d, "lineitem").select((F.col("l_orderkey") % 25).alias("pair_id"), (F.col("l_partkey") * 7 % 97).alias("x"), (F.col("l_orderkey") * 13 % 89).alias("y")).distinct()
    turned = ink.select("pair_id", F.bround(0.8 * F.col("x") - 0.6 * F.col("y") + 10).cast("long").alias("x"), F.bround(0.6 * F.col("x") + 0.8 * F.col("y") - 5).cast("long").alias("y"))
    return ink, turned


@query(
    f"""WITH {_trimmed()}, {_fit("g", "used")}, {_holdout("used")}, {_hull("used")}, {_overlap("g")},
 er AS (SELECT pair_id, sqrt(avg({ERR} ** 2)) AS rms, avg(({ERR} <= 3)::INT) AS inlier_ratio, count(*) AS anchors, any_value(sqrt(a * a + b * b)) AS scale FROM used JOIN g USING (pair_id) GROUP BY 1),
 m AS (SELECT er.*, area / 540000 AS spread, holdout, ink_overlap FROM er LEFT JOIN hl USING (pair_id) LEFT JOIN ho USING (pair_id) LEFT JOIN ov USING (pair_id)),
 fl AS (SELECT *, list_filter([CASE WHEN NOT rms < 2 THEN 'rms' END, CASE WHEN NOT inlier_ratio >= 0.6 THEN 'inlier_ratio' END, CASE WHEN NOT anchors >= 3 THEN 'anchors' END, CASE WHEN NOT spread >= 0.25 THEN 'spread' END, CASE WHEN NOT scale BETWEEN 0.2 AND 5 THEN 'sanity' END, CASE WHEN NOT coalesce(ink_overlap >= 0.6, false) THEN 'ink' END, CASE WHEN NOT coalesce(holdout < 3, false) THEN 'holdout' END], lambda x: x IS NOT NULL) AS failed,
  (rms < 2 AND rms >= 1.8)::INT + (inlier_ratio BETWEEN 0.6 AND 0.66)::INT + (anchors BETWEEN 3 AND 3.3)::INT + (spread BETWEEN 0.25 AND 0.275)::INT + coalesce(ink_overlap BETWEEN 0.6 AND 0.66, false)::INT + coalesce(holdout < 3 AND holdout >= 2.7, false)::INT AS marginal FROM m),
 v AS (SELECT *, failed = ['spread'] AND abs(ln(scale)) > 0.05 AS waived FROM fl)
 SELECT pair_id, anchors, round(rms, 4) AS rms, round(inlier_ratio, 4) AS inlier_ratio, round(spread, 4) AS spread, round(ink_overlap, 4) AS ink_overlap, round(holdout, 4) AS holdout,
  CASE WHEN len(failed) > 0 AND NOT waived THEN 'failed' WHEN marginal >= 2 THEN 'poor' WHEN anchors >= 8 AND rms < 1 AND marginal = 0 AND ink_overlap >= 0.75 AND NOT waived THEN 'excellent' ELSE 'good' END AS verdict FROM v"""
)
def quality_gate(spark, d):
    """Every pair's points fitted without its outliers and assessed by all seven metrics; scanned sheets may be turned."""
    p = bound(spark, d, "points")
    used = materialise(align.residuals(p, align.trimmed_fit(p, 3.0)).where("err <= 3").select(p.columns), "used-points")
    fits = materialise(gate.fit(used), "fits")
    old, new = _ink(spark, d)
    metrics = gate.measure(used, fits, 900.0 * 600.0, gate.ink_overlap(old, new, fits))
    sane = gate.sanity(fits, scanned=True).select("pair_id", (F.size("problems") == 0).alias("sane"))
    assessed = gate.assess(metrics.join(sane, "pair_id").withColumn("sanity", F.col("sane")))
    return assessed.select("pair_id", "anchors", *(F.round(c, 4).alias(c) for c in ("rms", "inlier_ratio", "spread", "ink_overlap", "holdout")), "verdict")


@query(
    """WITH f AS (SELECT p_partkey, 0.13 + p_partkey % 60 / 10.0 AS s, p_partkey % 91 AS deg, p_partkey % 8 = 0 AS mirrored, CASE WHEN p_partkey % 6 = 0 THEN 0.02 ELSE 0 END AS sh FROM part),
 t AS (SELECT *, abs((deg + 45.0) % 90 - 45) AS off FROM f)
 SELECT p_partkey AS pair_id, round(s, 6) AS scale, len(list_filter([NOT s BETWEEN 0.2 AND 5, mirrored, off > 2, abs(s * sh) > 0.001], lambda x: x)) AS problems FROM t"""
)
def transform_sanity(spark, d):
    k = F.col("p_partkey")
    s, deg = F.lit(0.13) + k % 60 / 10, F.radians((k % 91).cast("double"))
    flip, shear = F.when(k % 8 == 0, -1.0).otherwise(1.0), F.when(k % 6 == 0, 0.02).otherwise(0.0)
    c, n = F.cos(deg), F.sin(deg)
    # a turn after a scale (sx, shear; 0, sy)
    fits = table(spark, d, "part").select(k.alias("pair_id"), (s * c).alias("m00"), (s * shear * c - s * flip * n).alias("m01"), (s * n).alias("m10"), (s * shear * n + s * flip * c).alias("m11"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    return gate.sanity(fits).select("pair_id", F.round("scale", 6).alias("scale"), F.size("problems").alias("problems"))


@query(
    """WITH a AS (SELECT l_orderkey AS pair_id, l_linenumber AS seq, min(CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END) AS v, min(l_suppkey) % 3 > 0 AS has_matrix FROM lineitem GROUP BY 1, 2)
 SELECT pair_id, seq, ['failed', 'poor', 'good', 'excellent'][v + 1] AS verdict FROM a QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY v >= 2 DESC, CASE WHEN v >= 2 THEN seq END NULLS LAST, v DESC, has_matrix DESC, seq) = 1"""
)
def best_attempts(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("seq")).agg(F.min(F.when(F.col("l_partkey") % 5 == 0, 1).when(F.col("l_partkey") % 5 == 1, 2).when(F.col("l_partkey") % 5 == 2, 3).otherwise(0)).alias("v"), (F.min("l_suppkey") % 3 > 0).alias("has_matrix"))
    named = a.withColumn("verdict", F.element_at(F.array(*map(F.lit, gate.VERDICTS)), F.col("v") + 1)).withColumn("method", F.lit("any"))
    return gate.best_attempts(named).select("pair_id", "seq", "verdict")


@query(
    """WITH p AS (SELECT p_partkey AS pair_id, ['failed', 'poor', 'good', 'excellent'][p_partkey % 4 + 1] AS r, ['failed', 'poor', 'good', 'excellent'][p_partkey // 4 % 4 + 1] AS c FROM part)
 SELECT pair_id, CASE WHEN r IN ('failed', 'poor') AND c IN ('good', 'excellent') THEN 'coarse' ELSE 'refined' END AS chosen, CASE WHEN r IN ('failed', 'poor') AND c IN ('good', 'excellent') THEN c ELSE r END AS verdict FROM p"""
)
def refinement_fallback(spark, d):
    k = F.col("p_partkey")
    verdict = lambda n: F.element_at(F.array(*map(F.lit, gate.VERDICTS)), (n + 1).cast("int"))
    part = table(spark, d, "part")
    return gate.choose_refined(part.select(k.alias("pair_id"), verdict(F.floor(k / 4) % 4).alias("verdict")), part.select(k.alias("pair_id"), verdict(k % 4).alias("verdict")))


@query(
    f"""{LADDER} SELECT verdict, verdict = 'failed' AND anchors < 5 AND len(list_filter(failed, lambda x: x NOT IN ('anchors', 'spread', 'holdout'))) = 0 AS waived, count(*) AS n
 FROM (SELECT *, {VERDICT} AS verdict FROM v) GROUP BY ALL"""
)
def manual_waiver(spark, d):
    return gate.manual_waiver(_assessed(spark, d)).groupBy("verdict", "waived").agg(F.count("*").alias("n"))


@query()
def align_cascade(spark, d):
    """Methods in order of trust: few labelled points first, then all; the first that passes wins."""
    p = bound(spark, d, "points")
    good = align.residuals(p, align.trimmed_fit(p, 3.0)).where("err <= 3").select(p.columns)
    old, new = _ink(spark, d)
    return gate.align_pairs([("bubbles", p.where("k % 5 = 0"), 6), ("text", good, 3)], 900.0 * 600.0, lambda fits: gate.ink_overlap(old, new, fits)).select("pair_id", "method", "verdict")


@query("SELECT p_partkey % 4 AS v, count(*) AS n FROM part GROUP BY 1")
def align_verdict_counts(spark, d):
    named = table(spark, d, "part").select((F.col("p_partkey") % 4).alias("verdict"))
    return gate.verdict_counts(named).select(F.col("verdict").alias("v"), "n")


@query(
    """SELECT p_partkey AS pair_id, CASE p_partkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'review' ELSE 'aligned' END AS "group", row_number() OVER (ORDER BY p_partkey % 4, (CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 50 END) DESC NULLS LAST, p_partkey) AS place FROM part WHERE p_partkey % 10 <> 1"""
)
def align_grid(spark, d):
    from pyspark.sql import Window

    k = F.col("p_partkey")
    part = table(spark, d, "part")
    rows = part.select(k.alias("pair_id"), F.element_at(F.array(*map(F.lit, gate.VERDICTS)), (k % 4 + 1).cast("int")).alias("verdict"), F.when(k % 6 > 0, k % 50).alias("rms"))
    shown = gate.review_grid(rows, part.where("p_partkey % 10 = 1").select(k.alias("pair_id")))
    place = F.row_number().over(Window.orderBy(gate.rank(F.col("verdict")), F.desc_nulls_last("rms"), "pair_id"))
    return shown.select("pair_id", "group", place.alias("place"))


# --- rasters and paths ---------------------------------------------------------------------


def _grey(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("sheet"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") % 90).otherwise(160 + F.col("l_suppkey") * 7 % 96).alias("value"))


@query(
    """WITH g AS (SELECT l_orderkey % 40 AS sheet, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 90 ELSE 160 + l_suppkey * 7 % 96 END AS value FROM lineitem), h AS (SELECT sheet, value, count(*)::DOUBLE AS n FROM g GROUP BY ALL),
 s AS (SELECT sheet, value, sum(n) OVER u AS n0, sum(n * value) OVER u AS s0, sum(n) OVER e AS n, sum(n * value) OVER e AS s FROM h WINDOW u AS (PARTITION BY sheet ORDER BY value), e AS (PARTITION BY sheet)),
 b AS (SELECT sheet, value, coalesce(round(n0 * (n - n0) / (n * n) * (s0 / n0 - (s - s0) / nullif(n - n0, 0)) ** 2, 6), 0) AS between_ FROM s)
 SELECT sheet, value AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY between_ DESC, value) = 1"""
)
def otsu_threshold(spark, d):
    return raster.otsu(_grey(spark, d))


def _lit(spark, d):
    """Pixels of ten sheets; the odd ones are lit unevenly from left to right."""
    k = F.col("l_orderkey")
    grey = F.when((F.col("l_linenumber") % 3 == 0) & (F.col("l_partkey") % 4 == 0), F.col("l_partkey") % 90).otherwise(150 + F.col("l_suppkey") * 7 % 12)
    x = F.col("l_partkey") * 7 % 97
    lit = grey + F.when(k % 2 == 1, F.floor(x / 2)).otherwise(0)
    return table(spark, d, "lineitem").groupBy((k % 10).alias("sheet"), x.alias("x"), (k * 13 % 89).alias("y")).agg(F.min(lit).cast("long").alias("value"))


LIT = """px AS (SELECT l_orderkey % 10 AS sheet, l_partkey * 7 % 97 AS x, l_orderkey * 13 % 89 AS y, min(CASE WHEN l_linenumber % 3 = 0 AND l_partkey % 4 = 0 THEN l_partkey % 90 ELSE 150 + l_suppkey * 7 % 12 END + CASE WHEN l_orderkey % 2 = 1 THEN l_partkey * 7 % 97 // 2 ELSE 0 END) AS value FROM lineitem GROUP BY 1, 2, 3),
 lr AS (SELECT *, sum(value) OVER w AS s, count(value) OVER w AS n FROM px WINDOW w AS (PARTITION BY sheet, y ORDER BY x RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
 lt AS (SELECT sheet, x, y, value, sum(s) OVER w / sum(n) OVER w - 10 AS threshold FROM lr WINDOW w AS (PARTITION BY sheet, x ORDER BY y RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING))"""


@query(f"WITH {LIT} SELECT sheet, x, y, round(threshold, 6) AS threshold, value <= threshold AS ink FROM lt")
def adaptive_threshold(spark, d):
    local = raster.local_threshold(_lit(spark, d), side=15)
    return local.select("sheet", "x", "y", F.round("threshold", 6).alias("threshold"), (F.col("value") <= F.col("threshold")).alias("ink"))


@query(
    f"""WITH {LIT}, bk AS (SELECT sheet, median(value) AS m FROM (SELECT *, x * 12 // (max(x) OVER (PARTITION BY sheet) + 1) AS bx, y * 12 // (max(y) OVER (PARTITION BY sheet) + 1) AS bb FROM px) GROUP BY sheet, bx, bb),
 vr AS (SELECT sheet, stddev_pop(m) > 8 AS scanned FROM bk GROUP BY 1), h AS (SELECT sheet, value, count(*)::DOUBLE AS n FROM px GROUP BY ALL),
 su AS (SELECT sheet, value, sum(n) OVER u AS n0, sum(n * value) OVER u AS s0, sum(n) OVER e AS n, sum(n * value) OVER e AS s FROM h WINDOW u AS (PARTITION BY sheet ORDER BY value), e AS (PARTITION BY sheet)),
 b AS (SELECT sheet, value, coalesce(round(n0 * (n - n0) / (n * n) * (s0 / n0 - (s - s0) / nullif(n - n0, 0)) ** 2, 6), 0) AS between_ FROM su),
 o AS (SELECT sheet, value AS cut FROM b QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY between_ DESC, value) = 1)
 SELECT sheet, CASE WHEN scanned THEN 'adaptive' ELSE 'otsu' END AS method, count(*) AS n, count(*) FILTER (CASE WHEN scanned THEN value <= threshold ELSE value <= cut END) AS ink FROM lt JOIN vr USING (sheet) JOIN o USING (sheet) GROUP BY 1, 2"""
)
def binarised_sheets(spark, d):
    return raster.binarise_sheets(_lit(spark, d), side=15).groupBy("sheet", "method").agg(F.count("*").alias("n"), F.count_if("ink").alias("ink"))


@query(
    """WITH g AS (SELECT l_orderkey % 40 AS sheet, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 90 ELSE 160 + l_suppkey * 7 % 96 END AS value FROM lineitem)
 SELECT sheet, round(avg((value < 200)::INT), 6) AS coverage, round(coalesce(count(*) FILTER (value < 200 AND value > 110) / nullif(count(*) FILTER (value < 200), 0), 0), 6) AS pale_share FROM g GROUP BY 1"""
)
def ink_coverage(spark, d):
    return raster.ink_coverage(_grey(spark, d)).select("sheet", *(F.round(c, 6).alias(c) for c in ("coverage", "pale_share")))


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey % 10 AS sheet, l_partkey * 7 % 97 AS x, l_orderkey * 13 % 89 AS y FROM lineitem),
 a AS (SELECT *, x - row_number() OVER (PARTITION BY sheet, y ORDER BY x) AS gx, y - row_number() OVER (PARTITION BY sheet, x ORDER BY y) AS gy FROM i),
 r AS (SELECT sheet, count(*) OVER (PARTITION BY sheet, y, gx) AS rx, count(*) OVER (PARTITION BY sheet, x, gy) AS ry FROM a)
 SELECT sheet, median(least(rx, ry)) AS width FROM r GROUP BY 1"""
)
def stroke_width(spark, d):
    ink = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("sheet"), (F.col("l_partkey") * 7 % 97).alias("x"), (F.col("l_orderkey") * 13 % 89).alias("y")).distinct()
    return raster.stroke_width(ink)


@query(f"""WITH fx AS (SELECT DISTINCT pair_id, 0.8 AS a, 0.6 AS b, 0 AS mx, 0 AS my, 10 + pair_id % 4 AS ux, -5 AS uy FROM POINTS), {_overlap("fx")} SELECT pair_id, round(ink_overlap, 6) AS ink_overlap FROM ov""")
def ink_overlap(spark, d):
    """The fit that made the new ink, off by up to three pixels."""
    old, new = _ink(spark, d)
    pair = F.col("pair_id")
    matrix = (F.lit(0.8), F.lit(-0.6), F.lit(0.6), F.lit(0.8), 10.0 + pair % 4, F.lit(-5.0))
    fits = bound(spark, d, "points").select("pair_id").distinct().select("pair_id", *(v.alias(n) for n, v in zip(gate.MATRIX, matrix, strict=True)))
    return gate.ink_overlap(old, new, fits).withColumn("ink_overlap", F.round("ink_overlap", 6))


def _paths(spark, d):
    """A path of seven points for each order: two straight runs, an outlier in some."""
    k = F.col("o_orderkey")
    at = F.sequence(F.lit(0), F.lit(6))
    p = table(spark, d, "orders").select(k.alias("path_id"), F.posexplode(at).alias("seq", "i"))
    x = F.when(F.col("i") <= 3, F.col("i") * 10).otherwise(30)
    y = F.when(F.col("i") <= 3, 0).otherwise((F.col("i") - 3) * 8) + F.when((F.col("i") == 2) & (F.col("path_id") % 4 == 0), 1).otherwise(0)
    return p.select("path_id", "seq", x.cast("double").alias("x"), y.cast("double").alias("y"), (F.col("path_id") % 3 == 0).alias("closed"))


@query("SELECT o_orderkey AS path_id, CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 3 END AS points FROM orders")
def merge_collinear(spark, d):
    return compare.merge_collinear(_paths(spark, d)).groupBy("path_id").agg(F.count("*").alias("points"))


@query("SELECT 4 AS shapes, count(*) * 2 AS paths FROM orders")
def canonical_paths(spark, d):
    """Paths, and the same paths drawn backwards and, if closed, begun elsewhere, have the same hashes."""
    p = _paths(spark, d)
    n = 7
    back = p.select((-1 - F.col("path_id")).alias("path_id"), F.when(F.col("closed"), F.pmod(n - 1 - F.col("seq") + F.col("path_id"), F.lit(n))).otherwise(n - 1 - F.col("seq")).cast("int").alias("seq"), "x", "y", "closed")
    h = compare.canonical_path(p.unionByName(back))
    return h.agg(F.count_distinct("geometry").alias("shapes"), F.count("*").alias("paths"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 9 <= 2 THEN 'line' WHEN p_partkey % 2 = 1 THEN 'polyline' WHEN p_partkey % 9 IN (4, 5) AND p_partkey % 3 <> 0 THEN 'rectangle' WHEN p_partkey % 9 = 8 THEN 'circle' ELSE 'polygon' END AS kind FROM part"""
)
def path_kinds(spark, d):
    k = F.col("p_partkey")
    n = k % 9
    area = F.when(n == 8, 78.5).when(k % 3 != 0, 100.0).otherwise(60.0)
    return table(spark, d, "part").select("p_partkey", compare.classify_path(n, k % 2 == 0, F.lit(10.0), F.lit(10.0), area).alias("kind"))


# --- files, jobs, register ------------------------------------------------------------------


@query("SELECT l_partkey AS sheet, count(*) AS n, count(*) >= 30 AS usable FROM lineitem GROUP BY 1")
def vector_usable(spark, d):
    return ingest.vector_usable(table(spark, d, "lineitem").select(F.col("l_partkey").alias("sheet")), 30).select("sheet", "n", "usable")


@query(
    """WITH i AS (SELECT l_orderkey AS page_id, max((10 + l_partkey % 90) * (10 + l_suppkey % 90)) AS area FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS page_id, round(coalesce(area / 8000.0, 0), 6) AS coverage, o_custkey % 40 < 20 AND coalesce(area / 8000.0, 0) > 0.6 AS scanned FROM orders LEFT JOIN i ON o_orderkey = page_id"""
)
def scanned_pages(spark, d):
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(100.0).alias("w"), F.lit(80.0).alias("h"), (F.col("o_custkey") % 40).alias("text_chars"))
    images = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (10 + F.col("l_partkey") % 90).alias("w"), (10 + F.col("l_suppkey") % 90).alias("h"))
    return ingest.scanned_pages(pages, images).withColumn("coverage", F.round("coverage", 6))


def _jobs(spark, d):
    n = F.col("l_linenumber")
    log = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    state = F.when(F.col("p") % 4 == 0, "queued").when(F.col("p") % 4 == 1, "running").when(F.col("p") % 4 == 2, "done").otherwise("failed")
    return log.select((F.col("l_orderkey") % 2000).alias("job_id"), (F.col("l_orderkey") % 2000).alias("pair_id"), (F.col("l_orderkey") * 10 + n).alias("seq"), state.alias("state"))


JOBS = "j AS (SELECT l_orderkey % 2000 AS id, max_by(['queued', 'running', 'done', 'failed'][p % 4 + 1], l_orderkey * 10 + l_linenumber) AS state FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {JOBS} SELECT state, count(*) AS n FROM j GROUP BY 1")
def job_counts(spark, d):
    return ingest.job_states(_jobs(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


@query(
    f"""WITH {JOBS}, s AS (SELECT id, CASE WHEN state = 'running' AND id % 3 > 0 THEN 'queued' ELSE state END AS state FROM j)
 SELECT p.id AS pair_id, coalesce(state, 'queued') AS state FROM (SELECT DISTINCT o_orderkey % 2500 AS id FROM orders) p LEFT JOIN s USING (id) WHERE coalesce(state, 'queued') IN ('queued', 'running')"""
)
def job_resume(spark, d):
    pairs = table(spark, d, "orders").select((F.col("o_orderkey") % 2500).alias("pair_id"))
    return ingest.resume(pairs, _jobs(spark, d), spark.range(0, 2000, 3).select(F.col("id").alias("job_id")))


@query(
    """WITH c AS (SELECT doc_id::VARCHAR AS path, n_chars AS size, doc_id % 2 AS kind FROM documents), n AS (SELECT path, size + 1 AS size, kind FROM c WHERE size % 3 = 0)
 SELECT kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT c.kind, coalesce(n.size, c.size) AS size FROM c LEFT JOIN n USING (path, kind)) GROUP BY 1"""
)
def cache_replace(spark, d):
    cache = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), (F.col("doc_id") % 2).alias("kind"))
    fresh = cache.where("size % 3 = 0").withColumn("size", F.col("size") + 1)
    return ingest.cache_put(cache, fresh).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(
    """WITH p AS (SELECT p_partkey, ['A', 'P03', 'C01', 'P09', '02'][p_partkey % 5 + 1] AS o, ['B', 'A', 'P04', 'C02', '02', 'T01'][p_partkey % 6 + 1] AS n FROM part),
 r AS (SELECT *, CASE WHEN o = 'A' AND n IN ('A', 'B') THEN 'alpha' WHEN o[1:1] = n[1:1] AND o[1:1] IN ('P', 'C') THEN o[1:1] WHEN o = '02' AND n = '02' THEN 'numeric' END AS same FROM p)
 SELECT p_partkey, CASE WHEN same IS NULL THEN true ELSE n > o END AS significant FROM r"""
)
def revision_significant(spark, d):
    k = F.col("p_partkey")
    o = F.element_at(F.array(*map(F.lit, ("A", "P03", "C01", "P09", "02"))), (k % 5 + 1).cast("int"))
    n = F.element_at(F.array(*map(F.lit, ("B", "A", "P04", "C02", "02", "T01"))), (k % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", numbers.is_significant(o, n).alias("significant"))


@query()
def revision_sentences(spark, d):
    s = bound(spark, d, "sheets").where("revision is not null").groupBy("k", "side").agg(F.min("revision").alias("r"))
    both = s.groupBy("k").agg(F.max(F.when(F.col("side") == "old", F.col("r"))).alias("o"), F.max(F.when(F.col("side") == "new", F.col("r"))).alias("n"))
    return both.select(numbers.describe_change(F.col("o"), F.col("n")).alias("sentence")).groupBy("sentence").agg(F.count("*").alias("n"))


@query()
def register_sentence(spark, d):
    return register.summary_sentence(register.reconcile(bound(spark, d, "sheets"), "full").groupBy("status").agg(F.count("*").alias("n")))


@query()
def register_search(spark, d):
    found = register.grid(register.reconcile(bound(spark, d, "sheets"), "full"), attention_only=True, search="En-0")
    return found.select("drawing_no", "status", "needs_attention")


@query("SELECT event_id, round(p, 6) AS fraction, round(CASE WHEN p > 0 THEN e * (1 - p) / p END, 4) AS eta FROM (SELECT event_id, (1 + event_id % 20) / 25.0 AS p, 10.0 + event_id % 7 AS e FROM events)")
def progress_eta(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", (1 + k % 20).cast("double").alias("current"), F.lit(25.0).alias("total"), (F.lit(10.0) + k % 7).alias("elapsed"))
    return progress.eta(e).select("event_id", F.round("fraction", 6).alias("fraction"), F.round("eta", 4).alias("eta"))
