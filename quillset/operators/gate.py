"""The quality gate of an alignment: fits in closed form, seven metrics, verdict, waivers, choice among attempts.

points: pair_id, label, ox, oy, nx, ny and, if there is one, weight. A fit is a row of m00, m01, m10,
m11, tx, ty for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillset.functions.geometry import decomposed
from quillset.storage import materialise

# Thresholds of the metrics, and by how much a metric that passes barely is marginal.
RMS_PX, INLIERS, LEAST_ANCHORS, GOOD_ANCHORS, SPREAD, INK, HOLDOUT_PX, MARGIN = 2.0, 0.6, 3, 8, 0.25, 0.6, 3.0, 0.1
INLIER_PX, MOST_SHEAR, AXIS_DEGREES, SCALES, CONTENT_SCALE, SCALE_TOLERANCE = 3.0, 1e-3, 2.0, (0.2, 5.0), 0.05, 0.15
METRICS = ("rms", "inlier_ratio", "anchors", "spread", "sanity", "ink_overlap", "holdout")
VERDICTS = ("failed", "poor", "good", "excellent")
MATRIX = ("m00", "m01", "m10", "m11", "tx", "ty")
SUMS = ("w", "wox", "woy", "wnx", "wny", "woxox", "woyoy", "woxoy", "woxnx", "woynx", "woxny", "woyny")


def weighed(points: DataFrame) -> DataFrame:
    """points with the products whose sums a fit is made of."""
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in points.columns else F.lit(1.0)
    rows = points.withColumn("w", w.cast("double"))
    products = {"wox": "ox", "woy": "oy", "wnx": "nx", "wny": "ny"}
    pairs = {"woxox": ("ox", "ox"), "woyoy": ("oy", "oy"), "woxoy": ("ox", "oy"), "woxnx": ("ox", "nx"), "woynx": ("oy", "nx"), "woxny": ("ox", "ny"), "woyny": ("oy", "ny")}
    return rows.withColumns({n: F.col("w") * F.col(c) for n, c in products.items()} | {n: F.col("w") * F.col(a) * F.col(b) for n, (a, b) in pairs.items()})


def solved(sums: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """The least-squares map from the sums of weighed(): similarity (turn, one scale, shift) or affine. Null where the points don't determine it."""
    c = {n: F.col(n) for n in SUMS}
    mx, my, ux, uy = (c[n] / c["w"] for n in ("wox", "woy", "wnx", "wny"))

    def centred(both: str, a: Column, b: Column) -> Column:
        return c[both] - c["w"] * a * b

    xx, yy, xy = centred("woxox", mx, mx), centred("woyoy", my, my), centred("woxoy", mx, my)
    xu, yu, xv, yv = centred("woxnx", mx, ux), centred("woynx", my, ux), centred("woxny", mx, uy), centred("woyny", my, uy)
    if model == "similarity":
        a, b = F.try_divide(xu + yv, F.nullif(xx + yy, F.lit(0.0))), F.try_divide(xv - yu, F.nullif(xx + yy, F.lit(0.0)))
        m = (a, -b, b, a)
    else:
        det = xx * yy - xy * xy
        det = F.when(F.abs(det) > 1e-9 * F.abs(xx * yy), det)
        m = ((xu * yy - yu * xy) / det, (yu * xx - xu * xy) / det, (xv * yy - yv * xy) / det, (yv * xx - xv * xy) / det)
    linear = sums.withColumns(dict(zip(MATRIX[:4], m, strict=True)))
    return linear.select(*keep, *MATRIX[:4], (ux - F.col("m00") * mx - F.col("m01") * my).alias("tx"), (uy - F.col("m10") * mx - F.col("m11") * my).alias("ty"))


def fit(points: DataFrame, model: str = "similarity") -> DataFrame:
    """pair_id and the map of its points: one aggregation."""
    return solved(weighed(points).groupBy("pair_id").agg(*(F.sum(n).alias(n) for n in SUMS)), model, ["pair_id"])


def errors(points: DataFrame, fits: DataFrame, on: list[str]) -> DataFrame:
    """points with err, the distance of the mapped old point from the new one."""
    x = F.col("m00") * F.col("ox") + F.col("m01") * F.col("oy") + F.col("tx") - F.col("nx")
    y = F.col("m10") * F.col("ox") + F.col("m11") * F.col("oy") + F.col("ty") - F.col("ny")
    return points.join(fits, on).withColumn("err", F.sqrt(x * x + y * y))


def holdout(points: DataFrame, model: str = "similarity", folds: int = 5) -> DataFrame:
    """pair_id, holdout: the mean over ``folds`` of the error of a fifth of the points under the fit of the others; null under 5 points.

    Points are dealt to folds by the hash of their label. The fit without a fold is the sums of all less
    those of the fold, so all folds come out of one aggregation.
    """
    # a pair's points are ordered in 256 ranges of the hash, each behind the points of those before it
    hashed = points.withColumn("md5", F.md5(F.col("label").cast("string").cast("binary"))).withColumn("range", F.substring("md5", 1, 2))
    hashed = materialise(hashed, "hashed-points")
    before = Window.partitionBy("pair_id").orderBy("range")
    starts = hashed.groupBy("pair_id", "range").agg(F.count("*").alias("c")).select("pair_id", "range", (F.sum("c").over(before) - F.col("c")).alias("start"))
    nth = hashed.withColumn("r", F.row_number().over(Window.partitionBy("pair_id", "range").orderBy("md5", "label", "ox", "oy")))
    placed = nth.join(starts, (nth["pair_id"] == starts["pair_id"]) & nth["range"].eqNullSafe(starts["range"])).drop(starts["pair_id"]).drop(starts["range"])
    dealt = weighed(placed.withColumn("fold", (F.col("start") + F.col("r")) % folds).drop("md5", "range", "r", "start"))
    part = dealt.groupBy("pair_id", "fold").agg(*(F.sum(n).alias(n) for n in SUMS), F.count("*").alias("n"))
    every = Window.partitionBy("pair_id")
    rest = part.select("pair_id", "fold", F.sum("n").over(every).alias("all"), *((F.sum(n).over(every) - F.col(n)).alias(n) for n in SUMS))
    fits = solved(rest.where(F.col("all") >= LEAST_ANCHORS + 2), model, ["pair_id", "fold"])
    e = errors(dealt.select("pair_id", "fold", "ox", "oy", "nx", "ny"), fits, ["pair_id", "fold"])
    return e.groupBy("pair_id", "fold").agg(F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rms")).groupBy("pair_id").agg(F.avg("rms").alias("holdout"))


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy
    chains = []
    for part in (xy, xy[::-1]):
        chain: list[np.ndarray] = []
        for p in part:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def hull_area(points: DataFrame, x: str = "ox", y: str = "oy") -> DataFrame:
    """pair_id, area of the points' convex hull. Batches give their own hulls first, so a task gets corners only."""

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pair, part in pdf.groupby("pair_id"):
                h = hull(part[["x", "y"]].to_numpy())
                yield pd.DataFrame({"pair_id": pair, "x": h[:, 0], "y": h[:, 1]})

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy())
        size = abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2 if len(h) > 2 else 0.0
        return pd.DataFrame({"pair_id": [pdf["pair_id"].iloc[0]], "area": [float(size)]})

    at = points.select("pair_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))
    return at.mapInPandas(corners, "pair_id long, x double, y double").groupBy("pair_id").applyInPandas(area, "pair_id long, area double")


def sanity(fits: DataFrame, *, scanned: bool = False, expected_scale: Column | None = None) -> DataFrame:
    """fits with scale, rotation_deg and problems: array of scale, mirrored, turned, sheared, unexpected_scale."""
    d = decomposed(tuple(F.col(c) for c in MATRIX))
    known = fits.withColumn("d", d).withColumns({"scale": F.sqrt(F.abs(F.col("d.determinant"))), "rotation_deg": F.col("d.rotation_deg")})
    off_axis = F.abs(F.pmod(F.col("rotation_deg") + 45.0, F.lit(90.0)) - 45.0)
    cad = F.lit(not scanned)
    tests = {
        "scale": ~F.col("scale").between(*SCALES),
        "mirrored": F.col("d.determinant") <= 0,
        "turned": cad & (off_axis > AXIS_DEGREES),
        "sheared": cad & (F.abs(F.col("d.shear")) > MOST_SHEAR),
    }
    if expected_scale is not None:
        tests["unexpected_scale"] = F.abs(F.col("scale") - expected_scale) > SCALE_TOLERANCE * expected_scale
    return known.withColumn("problems", F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))).drop("d")


def ink_overlap(old: DataFrame, new: DataFrame, fits: DataFrame) -> DataFrame:
    """pair_id, ink_overlap: shared over united ink pixels (pair_id, x, y), the old ones mapped, each grown by one pixel to its four sides."""
    plus = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))

    def grown(rows: DataFrame) -> DataFrame:
        return rows.select("pair_id", "x", "y", F.explode(plus).alias("o")).select("pair_id", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")).distinct()

    x, y = F.col("m00") * F.col("x") + F.col("m01") * F.col("y") + F.col("tx"), F.col("m10") * F.col("x") + F.col("m11") * F.col("y") + F.col("ty")
    moved = old.join(fits.select("pair_id", *MATRIX), "pair_id").select("pair_id", F.bround(x).cast("long").alias("x"), F.bround(y).cast("long").alias("y"))
    both = grown(moved).withColumn("o", F.lit(1)).unionByName(grown(new.select("pair_id", F.col("x").cast("long"), F.col("y").cast("long"))).withColumn("o", F.lit(0)))
    seen = both.groupBy("pair_id", "x", "y").agg(F.count("*").alias("n"))
    return seen.groupBy("pair_id").agg(F.avg((F.col("n") == 2).cast("double")).alias("ink_overlap"))


def assess(metrics: DataFrame) -> DataFrame:
    """metrics with verdict, failed (names), marginal (names), spread_waived.

    metrics: pair_id, the seven METRICS (sanity as a boolean, holdout null where too few points), scale, model.
    All must pass; two or more that pass barely make the verdict poor; excellent takes GOOD_ANCHORS points, an
    error under 1 px, no barely passing metric and ink of 0.75. A failed spread alone is waived for a
    similarity whose scale really changes, and the verdict is then good at most.
    """
    most = 1 + MARGIN
    c = {m: F.col(m) for m in METRICS}
    passes = {"rms": c["rms"] < RMS_PX, "inlier_ratio": c["inlier_ratio"] >= INLIERS, "anchors": c["anchors"] >= LEAST_ANCHORS, "spread": c["spread"] >= SPREAD, "sanity": c["sanity"], "ink_overlap": c["ink_overlap"] >= INK, "holdout": c["holdout"] < HOLDOUT_PX}
    barely = {"rms": c["rms"] >= (1 - MARGIN) * RMS_PX, "inlier_ratio": c["inlier_ratio"] <= min(INLIERS * most, 1.0), "anchors": c["anchors"] <= LEAST_ANCHORS * most, "spread": c["spread"] <= min(SPREAD * most, 1.0), "ink_overlap": c["ink_overlap"] <= min(INK * most, 1.0), "holdout": c["holdout"] >= (1 - MARGIN) * HOLDOUT_PX}
    ok = {m: F.coalesce(p, F.lit(False)) for m, p in passes.items()}
    resized = F.coalesce(F.abs(F.log(F.col("scale"))) > CONTENT_SCALE, F.lit(False)) & (F.col("model") == "similarity")
    failed = F.array_compact(F.array(*(F.when(~ok[m], m) for m in METRICS)))
    close = F.array_compact(F.array(*(F.when(ok[m] & F.coalesce(barely[m], F.lit(False)), m) for m in METRICS if m in barely)))
    judged = metrics.withColumns({"failed": failed, "marginal": close}).withColumn("spread_waived", resized & (F.col("failed") == F.array(F.lit("spread"))))
    all_pass = (F.size("failed") == 0) | F.col("spread_waived")
    best = (c["anchors"] >= GOOD_ANCHORS) & (c["rms"] < 1.0) & (F.size("marginal") == 0) & (c["ink_overlap"] >= 0.75) & ~F.col("spread_waived")
    return judged.withColumn("verdict", F.when(~all_pass, "failed").when(F.size("marginal") >= 2, "poor").when(best, "excellent").otherwise("good"))


def measure(points: DataFrame, fits: DataFrame, page_area: float, ink: DataFrame, model: str = "similarity") -> DataFrame:
    """The seven metrics of each pair, for assess(); ink: pair_id, ink_overlap."""
    points, fits = materialise(points, "fitted-points"), materialise(fits, "fits")
    e = errors(points, fits, ["pair_id"]).groupBy("pair_id").agg(F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rms"), F.avg((F.col("err") <= INLIER_PX).cast("double")).alias("inlier_ratio"), F.count("*").alias("anchors"))
    sane = sanity(fits).select("pair_id", "scale", "rotation_deg", (F.size("problems") == 0).alias("sanity"))
    out = e.join(sane, "pair_id").join(hull_area(points).select("pair_id", (F.col("area") / page_area).alias("spread")), "pair_id", "left").join(holdout(points, model), "pair_id", "left").join(ink, "pair_id", "left")
    return out.withColumn("model", F.lit(model))


def manual_waiver(assessed: DataFrame) -> DataFrame:
    """assessed with waived: a manual fit of too few points to hold any out may pass if only what few points can't show has failed."""
    small = F.col("anchors") < LEAST_ANCHORS + 2
    only = F.size(F.array_except("failed", F.array(*map(F.lit, ("anchors", "spread", "holdout"))))) == 0
    return assessed.withColumn("waived", (F.col("verdict") == "failed") & small & only)


def rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)


def choose_refined(coarse: DataFrame, refined: DataFrame) -> DataFrame:
    """pair_id, chosen, verdict: the refined fit, unless it's refused and the coarse one passes (good or excellent)."""
    both = refined.select("pair_id", F.col("verdict").alias("r")).join(coarse.select("pair_id", F.col("verdict").alias("c")), "pair_id")
    take = ~F.col("r").isin("good", "excellent") & F.col("c").isin("good", "excellent")
    return both.select("pair_id", F.when(take, "coarse").otherwise("refined").alias("chosen"), F.when(take, F.col("c")).otherwise(F.col("r")).alias("verdict"))


def best_attempts(attempts: DataFrame) -> DataFrame:
    """Of each pair's attempts (pair_id, seq, method, verdict, has_matrix): the first that is good or better, else the best by verdict and matrix."""
    passing = F.col("verdict").isin("good", "excellent")
    order = Window.partitionBy("pair_id").orderBy(passing.desc(), F.when(passing, F.col("seq")), rank(F.col("verdict")).desc(), F.col("has_matrix").desc(), "seq")
    return attempts.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def align_pairs(methods: list[tuple[str, DataFrame, int]], page_area: float, ink_of) -> DataFrame:
    """The cascade for all pairs: pair_id, method, verdict and the map of the method that wins.

    methods: (name, points, least points) in order of trust; a pair with fewer points skips a method. Every
    method is fitted and assessed for all pairs that have its points; best_attempts() then chooses.
    ``ink_of(fits)`` gives pair_id, ink_overlap.
    """
    tried = None
    for seq, (name, points, least) in enumerate(methods):
        enough = points.groupBy("pair_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("pair_id")
        used = points.join(enough, "pair_id", "left_semi")
        fits = fit(used)
        verdicts = assess(measure(used, fits, page_area, ink_of(fits))).join(fits, "pair_id")
        rows = verdicts.select("pair_id", F.lit(seq).alias("seq"), F.lit(name).alias("method"), "verdict", F.col("m00").isNotNull().alias("has_matrix"), *MATRIX)
        tried = rows if tried is None else tried.unionByName(rows)
    return best_attempts(tried)


def verdict_counts(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("verdict").agg(F.count("*").alias("n"))


def review_grid(assessed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pairs for review, worst first: pair_id, verdict, group (aligned, review, failed), rms; excluded pairs (pair_id) left out, unknown errors last."""
    group = F.when(F.col("verdict").isin("good", "excellent"), "aligned").when(F.col("verdict") == "poor", "review").otherwise("failed")
    rows = assessed.join(excluded, "pair_id", "left_anti").select("pair_id", "verdict", group.alias("group"), "rms")
    return rows.orderBy(rank(F.col("verdict")), F.desc_nulls_last("rms"), "pair_id")


def nearest_spacing(points: DataFrame, x: str = "ox", y: str = "oy", cell: float = 64.0) -> DataFrame:
    """pair_id, least, most: of each point's distance to its nearest other; points of one place count once, pairs with one point are left out.

    The nearest is looked for in a point's cell and the eight around it; points that find none there, or none
    nearer than a cell, look at all points of their pair.
    """
    at = points.select("pair_id", F.col(x).alias("x"), F.col(y).alias("y")).distinct().withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = at.withColumn("o", F.explode(around)).select("pair_id", F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    d2 = F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)
    close = at.join(near, ["pair_id", "cx", "cy"]).where((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2"))).groupBy("pair_id", "x", "y").agg(F.min(d2).alias("d2")).where(F.col("d2") <= cell * cell)
    lonely = at.join(close, ["pair_id", "x", "y"], "left_anti")
    far = lonely.join(at.select("pair_id", F.col("x").alias("x2"), F.col("y").alias("y2")), "pair_id").where((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2"))).groupBy("pair_id", "x", "y").agg(F.min(d2).alias("d2"))
    return close.unionByName(far).groupBy("pair_id").agg(F.sqrt(F.min("d2")).alias("least"), F.sqrt(F.max("d2")).alias("most"))
