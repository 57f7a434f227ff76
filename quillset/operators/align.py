"""Alignment: anchors by singleton labels, least-squares and robust similarity fits, residuals and their grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillset.storage import materialise


def singletons(items: DataFrame) -> DataFrame:
    """pair_id, label, ox, oy, nx, ny for texts that stand exactly once on each side."""
    def one(side: str, p: str) -> DataFrame:
        return items.where(F.col("side") == side).groupBy("pair_id", "text").agg(F.count("*").alias("n"), F.min("x").alias(f"{p}x"), F.min("y").alias(f"{p}y")).where("n = 1").drop("n")

    return one("old", "o").join(one("new", "n"), ["pair_id", "text"])


def fit_similarity(points: DataFrame, copies: str | None = None) -> DataFrame:
    """pair_id, n, a, b, tx, ty: the least-squares map new = [[a, -b], [b, a]] old + t, from sums only; ``copies`` names a count of the points that a row stands for."""
    k = F.col(copies) if copies else F.lit(1)
    count, mean = (F.sum(k), lambda c: F.sum(k * F.col(c)) / F.sum(k)) if copies else (F.count("*"), F.avg)
    sums = points.groupBy("pair_id").agg(count.alias("n"), *(mean(c).alias(f"m{c}") for c in ("ox", "oy", "nx", "ny")), *(F.sum(k * F.col(p) * F.col(q)).alias(f"{p}{q}") for p, q in (("ox", "nx"), ("oy", "ny"), ("ox", "ny"), ("oy", "nx"), ("ox", "ox"), ("oy", "oy"))))

    def centred(p: str, q: str) -> Column:
        return F.col(f"{p}{q}") - F.col("n") * F.col(f"m{p}") * F.col(f"m{q}")

    norm = centred("ox", "ox") + centred("oy", "oy")
    a, b = F.try_divide(centred("ox", "nx") + centred("oy", "ny"), norm), F.try_divide(centred("ox", "ny") - centred("oy", "nx"), norm)
    return sums.withColumns({"a": a, "b": b}).select("pair_id", "n", "a", "b", (F.col("mnx") - F.col("a") * F.col("mox") + F.col("b") * F.col("moy")).alias("tx"), (F.col("mny") - F.col("b") * F.col("mox") - F.col("a") * F.col("moy")).alias("ty"))


def residuals(points: DataFrame, fit: DataFrame) -> DataFrame:
    """points with err, the distance of the mapped old point from the new one."""
    x = F.col("a") * F.col("ox") - F.col("b") * F.col("oy") + F.col("tx") - F.col("nx")
    y = F.col("b") * F.col("ox") + F.col("a") * F.col("oy") + F.col("ty") - F.col("ny")
    return points.join(fit.drop("n"), "pair_id").withColumn("err", F.sqrt(x * x + y * y))


#: Pairs of fewer points have their median looked for among all of them.
FEW = 10_000


def medians(points: DataFrame, value: str) -> DataFrame:
    """pair_id, median of a column, exactly: its place is counted among the values between two approximate percentiles around it.

    No task holds a pair's values: the percentiles are sketches, off by a ten-thousandth of the ranks, and the
    fiftieth of the values that lies between them is counted by value and ordered.
    """
    shares = F.percentile_approx(value, F.array(F.lit(0.49), F.lit(0.51)), 10_000)
    bounds = points.groupBy("pair_id").agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), shares.alias("s"))
    few = F.col("n") < FEW
    bounds = materialise(bounds.select("pair_id", "n", F.when(few, F.col("least")).otherwise(F.col("s")[0]).alias("lo"), F.when(few, F.col("most")).otherwise(F.col("s")[1]).alias("hi")), "bounds")
    # what lies below the bounds is one row, before all others
    near = points.where(F.col(value).isNotNull()).join(bounds, "pair_id").where(F.col(value) <= F.col("hi"))
    counted = near.groupBy("pair_id", "n", F.when(F.col(value) >= F.col("lo"), F.col(value)).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("pair_id").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("upto", upto)
    middle = [(F.floor((F.col("n") + k) / 2) + 1 - k) for k in (1, 0)]
    # the first value that reaches a rank
    at = [F.min(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank), F.col("v"))) for rank in middle]
    return placed.groupBy("pair_id").agg((at[0] / 2 + at[1] / 2).alias("median"))


def trimmed_fit(points: DataFrame, limit: float, rounds: int = 3) -> DataFrame:
    """fit_similarity on points within a shrinking multiple of each pair's median residual, at least ``limit``."""
    used = points
    for _ in range(rounds):
        measured = materialise(residuals(points, fit_similarity(used)), "residuals")
        cut = medians(measured, "err").select("pair_id", F.greatest(F.lit(limit), 2.5 * F.col("median")).alias("cut"))
        used = measured.join(cut, "pair_id").where("err <= cut").select(points.columns)
    return fit_similarity(used)


#: Odd numbers near 2**32, whose multiples deal out the two points of a hypothesis.
STRIDES = (2654435761, 2246822519)


def ransac_fit(points: DataFrame, limit: float = 3.0, rounds: int = 200) -> DataFrame:
    """pair_id, inliers, a, b, tx, ty: of the similarities through two points the one that most others agree with, refitted on these.

    points: pair_id, ox, oy, nx, ny. Hypotheses are rows: number j takes the points whose places, in the order of
    all four numbers, are the shares (j * STRIDES mod 2**32) / 2**32 of the pair's count. A pair's hypotheses,
    ``rounds`` at most, meet each of its different points once, which votes for all its copies. Of
    equally good ones the first counts. Pairs of fewer than two places have no inliers and no fit; points with a null count for nothing.
    """
    corner = ["ox", "oy", "nx", "ny"]
    known = points.where(" and ".join(f"{c} is not null" for c in ("pair_id", *corner))).select(F.col("pair_id").cast("long"), *(F.col(c).cast("double").alias(c) for c in corner))
    # equal points are one row that takes as many places as it has copies
    known = materialise(known.groupBy("pair_id", *corner).agg(F.count("*").alias("copies")), "points")
    placed = known.withColumn("upto", F.sum("copies").over(Window.partitionBy("pair_id").orderBy(*corner).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = materialise(placed, "placed-points")
    counts = known.groupBy("pair_id").agg(F.sum("copies").alias("n"))
    drawn = counts.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    for k, stride in zip("pq", STRIDES, strict=True):
        drawn = drawn.withColumn(f"{k}_at", F.expr(f"shiftright((j * {stride}L % {1 << 32}L) * n, 32) + 1"))
    spots = drawn.select("pair_id", F.explode(F.array("p_at", "q_at")).alias("at")).distinct()
    # each place takes the first point that reaches it: one running pass over points and places, from the last to the first
    both = placed.select("pair_id", F.col("upto").alias("at"), F.lit(0).alias("asks"), F.struct(*corner).alias("c")).unionByName(spots.select("pair_id", "at", F.lit(1).alias("asks"), F.lit(None).alias("c")))
    back = Window.partitionBy("pair_id").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spots = materialise(both.withColumn("c", F.last("c", ignorenulls=True).over(back)).where("asks = 1").select("pair_id", "at", "c"), "drawn-points")
    for k in "pq":
        drawn = drawn.join(spots.select("pair_id", F.col("at").alias(f"{k}_at"), *(F.col(f"c.{c}").alias(f"{k}_{c}") for c in corner)), ["pair_id", f"{k}_at"])
    dx, dy, ux, uy = (F.col(f"q_{c}") - F.col(f"p_{c}") for c in corner)
    length = dx * dx + dy * dy
    turned = drawn.where(length > 0).withColumns({"a": (dx * ux + dy * uy) / length, "b": (dx * uy - dy * ux) / length})
    maps = turned.select("pair_id", "j", "a", "b", (F.col("p_nx") - F.col("a") * F.col("p_ox") + F.col("b") * F.col("p_oy")).alias("tx"), (F.col("p_ny") - F.col("b") * F.col("p_ox") - F.col("a") * F.col("p_oy")).alias("ty"))
    maps = materialise(maps, "hypotheses")

    def agrees(h: Column) -> Column:
        x = h["a"] * F.col("ox") - h["b"] * F.col("oy") + h["tx"] - F.col("nx")
        y = h["b"] * F.col("ox") + h["a"] * F.col("oy") + h["ty"] - F.col("ny")
        return x * x + y * y <= limit * limit

    every = maps.groupBy("pair_id").agg(F.collect_list(F.struct("j", "a", "b", "tx", "ty")).alias("maps"))
    votes = known.join(every, "pair_id").select("pair_id", "copies", F.explode(F.transform(F.filter("maps", agrees), lambda h: h["j"])).alias("j")).groupBy("pair_id", "j").agg(F.sum("copies").alias("votes"))
    best = votes.groupBy("pair_id").agg(F.max_by("j", F.struct("votes", -F.col("j"))).alias("j"))
    chosen = best.join(maps, ["pair_id", "j"]).select("pair_id", F.struct("a", "b", "tx", "ty").alias("h"))
    fit = fit_similarity(known.join(chosen, "pair_id").where(agrees(F.col("h"))).select("pair_id", *corner, "copies"), "copies")
    return points.select(F.col("pair_id").cast("long")).distinct().join(fit, "pair_id", "left").select("pair_id", F.coalesce("n", F.lit(0)).alias("inliers"), "a", "b", "tx", "ty")
