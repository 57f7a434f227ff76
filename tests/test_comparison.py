"""The whole comparison on sheets with planted changes of all kinds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillset.operators import compare, comparison, noise, store

ITEM = "pair_id long, side string, item_id long, text string, x double, y double, w double, h double"
SEGMENT = "pair_id long, side string, path_id long, x0 double, y0 double, x1 double, y1 double, pen long"
PIXEL = "pair_id long, x long, y long"
ZONE = "pair_id long, zone_id long, kind string, x0 double, y0 double, x1 double, y1 double, enabled boolean, protected boolean, ink_only boolean, words array<string>"
WORDS = "PUMP VALVE STAIR LOBBY KITCHEN STORE OFFICE RAMP TANK DUCT".split()


def sheet(pair: int, rng: random.Random):
    """(items, segments, old ink, new ink, boxes of what was changed): a sheet of 2000 by 1400 pixels; pair 2's old issue is shifted by 7, -4."""
    dx, dy = (7.0, -4.0) if pair == 2 else (0.0, 0.0)
    items, segments, planted = [], [], []
    ink: dict[str, set] = {"old": set(), "new": set()}

    def text(i, x, y, old, new):
        if old:
            items.append((pair, "old", i, old, x + dx, y + dy, 8.0 * len(old), 14.0))
        if new:
            items.append((pair, "new", i, new, x, y, 8.0 * len(new), 14.0))
        if old != new and y < 1200:
            planted.append((x, y, 8.0 * max(len(old or ""), len(new or "")), 14.0))

    def line(i, a, b, sides=("old", "new"), shift=0.0):
        for side in sides:
            d = (dx, dy) if side == "old" else (0.0, shift)
            segments.append((pair, side, i, a[0] + d[0], a[1] + d[1], b[0] + d[0], b[1] + d[1], 10))
        if shift or len(sides) == 1:
            planted.append((min(a[0], b[0]), min(a[1], b[1]), abs(a[0] - b[0]), abs(a[1] - b[1]) + shift))

    for i in range(30):
        same = f"{rng.choice(WORDS)} {i}"
        text(i, 60.0 + i % 6 * 300, 60.0 + i // 6 * 110, same, same)
    text(40, 100.0, 700.0, "3000", "3450")
    text(41, 500.0, 700.0, "FIRE DOOR FD30", None)
    text(42, 900.0, 700.0, None, "NEW COLUMN C7")
    text(43, 1600.0, 1300.0, "REV A", "REV B")  # in the title block
    for i in range(12):
        line(100 + i, (80.0 + i * 150, 760.0), (80.0 + i * 150, 900.0))
    line(120, (300.0, 960.0), (700.0, 960.0), shift=25.0)
    line(121, (900.0, 960.0), (1300.0, 960.0), sides=("new",))
    line(122, (1500.0, 960.0), (1800.0, 960.0), sides=("old",))
    for i in range(30):  # a hatch that only the old issue has
        segments.append((pair, "old", 200 + i, 300.0 + i * 6 + dx, 1050.0 + dy, 300.0 + i * 6 + dx, 1100.0 + dy, 5))
    planted.append((300.0, 1050.0, 174.0, 50.0))
    blob = {(1000 + i, 1080 + j) for i in range(40) for j in range(25)}
    ink["new"] |= blob
    planted.append((1000.0, 1080.0, 40.0, 25.0))
    common = {(50 + i, 1390) for i in range(500)}
    for side in ink:
        ink[side] |= common | ({(1700 + i, 1320) for i in range(30)} if side == "new" else set())
    return items, segments, ink, planted


def test_planted_changes_are_found(spark):
    rng = random.Random(6)
    made = {pair: sheet(pair, rng) for pair in (1, 2)}
    items, segments = (spark.createDataFrame([r for m in made.values() for r in m[k]], schema) for k, schema in ((0, ITEM), (1, SEGMENT)))
    ink = tuple(spark.createDataFrame([(p, *at) for p, m in made.items() for at in m[2][side]], PIXEL) for side in ("old", "new"))
    zones = spark.createDataFrame([(p, 1, "titleblock", 0.7, 0.85, 1.0, 1.0, True, False, False, []) for p in made], ZONE)
    fits = spark.createDataFrame([(2, 1.0, 0.0, 0.0, 1.0, -7.0, 4.0)], "pair_id long, m00 double, m01 double, m10 double, m11 double, tx double, ty double")
    out = comparison.compare_issues(items, segments, sheet_area=2000.0 * 1400, ink=ink, zones=zones, page=(2000.0, 1400.0), fits=fits, hatched=True)
    rows = out.changes.where("not is_cosmetic").collect()
    near = lambda a, b: a[0] - 5 <= b[0] + b[2] and b[0] <= a[0] + a[2] + 5 and a[1] - 5 <= b[1] + b[3] and b[1] <= a[1] + a[3] + 5
    for pair, (_, _, _, planted) in made.items():
        found = [(r.x, r.y, r.w, r.h) for r in rows if r.pair_id == pair]
        right = [f for f in found if any(near(f, p) for p in planted)]
        hit = [p for p in planted if any(near(f, p) for f in found)]
        assert len(right) / len(found) >= 0.90 and len(hit) / len(planted) >= 0.85, (found, planted)
    kinds = {(r.stream, r.kind) for r in rows}
    assert kinds >= {("text", "modified"), ("text", "removed"), ("text", "added"), ("vector", "moved"), ("vector", "added"), ("vector", "removed"), ("hatch", "hatch_removed"), ("raster", "added")}
    assert not [r for r in rows if r.y > 1190]


def test_streams_that_see_the_same(spark):
    """A changed text whose ink changed, too, is one change of two streams."""
    items = spark.createDataFrame([(1, "old", 1, "3000", 100.0, 100.0, 40.0, 14.0), (1, "new", 1, "3500", 100.0, 100.0, 40.0, 14.0)], ITEM)
    blank = spark.createDataFrame([(1, 500, 500)], PIXEL)
    inked = spark.createDataFrame([(1, 500, 500), *((1, 104 + i, 102 + j) for i in range(30) for j in range(10))], PIXEL)
    out = comparison.compare_issues(items, sheet_area=1e6, ink=(blank, inked)).changes.collect()
    assert [(r.stream, r.streams, r.kind) for r in out] == [("text", "raster+text", "modified")]
    assert out[0].confidence > 0.5


def test_comparison_of_nothing(spark):
    out = comparison.compare_issues(spark.createDataFrame([], ITEM), spark.createDataFrame([], SEGMENT), sheet_area=1e6, hatched=True)
    assert out.changes.count() == 0 and out.suppressed.count() == 0 and out.clusters.count() == 0


def test_filters_stay_linear(spark):
    from quillset.operators import noise

    rows = spark.createDataFrame([(p, p * 100 + i, "raster", "added", None, 10.0 * i, 5.0, 4.0, 4.0, 0.5, False, None) for p in range(3) for i in range(20)], "pair_id long, change_id long, stream string, kind string, wording string, x double, y double, w double, h double, confidence double, is_cosmetic boolean, area double")
    nothing = rows.select("pair_id").limit(0)
    text = rows.select("pair_id", F.col("change_id").alias("id"), *"xywh").limit(0)
    out = noise.run_filters(rows, residual=nothing, layers=spark.createDataFrame([], "pair_id long, side string, name string, visible boolean"), regions=text.drop("id"), settings=nothing.withColumn("plot_changed", F.lit(True)), unchanged=text, sheet_area=1e6)
    assert out.kept.count() + out.suppressed.count() == 60
    leaves = out.kept._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves <= 4


def test_saved_changes_are_replaced_by_pair(spark, tmp_path):
    from quillset.operators import store

    path = f"file://{tmp_path}/changes"
    rows = lambda *of: spark.createDataFrame(list(of), "pair_id long, change_id long, kind string")
    held = lambda: sorted((r.pair_id is None, r.pair_id or 0, r.change_id) for r in spark.read.parquet(path).collect())
    store.save_changes(rows((1, 10, "a"), (1, 11, "a"), (2, 20, "b"), (None, 5, "c"), *((p, p * 10, "d") for p in range(3, 40))), path, buckets=4)
    assert len(held()) == 41 and len(list((tmp_path / "changes").glob("bucket=*"))) == 4
    store.save_changes(rows((1, 12, "a")), path, buckets=4)
    assert (False, 1, 12) in held() and len(held()) == 40 and (False, 2, 20) in held()
    store.clear_changes(rows((2, 0, ""), (None, 0, "")), path, buckets=4)
    assert len(held()) == 38 and (False, 2, 20) not in held() and not any(r[0] for r in held())


def test_scores_of_cases(spark):
    from quillset.operators import store

    box = "pair_id long, {} long, x double, y double, w double, h double"
    truth = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 12.0, 0.0, 10.0, 10.0), (1, 3, 500.0, 0.0, 10.0, 10.0), (2, 4, 0.0, 0.0, 5.0, 5.0)], box.format("truth_id"))
    reported = spark.createDataFrame([(1, 1, 0.0, 0.0, 22.0, 10.0), (1, 2, 1.0, 0.0, 10.0, 10.0), (3, 3, 0.0, 0.0, 5.0, 5.0)], box.format("change_id"))
    got = {r.pair_id: tuple(r)[1:] for r in store.score_cases(reported, truth).collect()}
    # the first report covers two planted changes, so the second one gets none
    assert got == {1: (3, 2, 1, 2, 1, 1), 2: (1, 0, 0, 0, 0, 1), 3: (0, 1, 0, 0, 1, 0)}
    row = store.score_matrix(store.score_cases(reported, truth)).first()
    assert (row.cases, row.precision, row.recall, row.clean_share) == (3, 1 / 3, 0.5, 0.0)
    assert store.score_matrix(store.score_cases(reported.limit(0), truth.limit(0))).first().precision == 1.0


def test_overlap_links_count_all_pairs_by_class(spark):
    """Copies are counted and not joined: as many links as pairs of single boxes, from few pairs of classes."""
    rng = random.Random(4)
    rows = [(1, i, *rng.choice([(0.0, 0.0, 10.0, 10.0), (1.0, 1.0, 9.0, 9.0), (50.0, 0.0, 4.0, 4.0), (2.0, 0.0, 10.0, 10.0)])) for i in range(120)] + [(1, 200, None, 0.0, 1.0, 1.0)]
    left, right = (spark.createDataFrame(part, "pair_id long, change_id long, x double, y double, w double, h double") for part in (rows[:60] + rows[-1:], rows[60:120]))
    pairs = [(r.l_id, r.r_id) for r in compare.overlapping(compare.boxes(left, "l", "change_id"), compare.boxes(right, "r", "change_id")).collect()]
    got = [{r.change_id: r for r in side.collect()} for side in compare.overlap_links(left, right)]
    assert sum(r.n_links for r in got[0].values()) == len(pairs) == sum(r.n_links for r in got[1].values())
    for n, side in enumerate(got):
        assert {i: r.n_links for i, r in side.items()} == {i: sum(p[n] == i for p in pairs) for i in side}
        assert len({r.class_id for r in side.values()}) <= 5 and all(r.class_id <= i for i, r in side.items())
    assert len(got[0]) == 61 and got[0][200].n_links == 0


def test_scores_count_copies_without_joining_them(spark, monkeypatch):
    """Planted and reported changes of one box: the first report takes all, and boxes meet once a class."""
    met, overlapping = [], store.overlapping
    monkeypatch.setattr(store, "overlapping", lambda *a: met.append(overlapping(*a)) or met[-1])
    schema = "pair_id long, {0} long, x double, y double, w double, h double"
    truth = spark.createDataFrame([(1, i, 0.0, 0.0, 10.0, 10.0) for i in range(30)] + [(1, 99, 400.0, 0.0, 5.0, 5.0)], schema.format("truth_id"))
    reported = spark.createDataFrame([(1, i, 1.0, 0.0, 10.0, 10.0) for i in range(50)], schema.format("change_id"))
    row = store.score_cases(reported, truth).first()
    assert (row.expected, row.reported, row.matched, row.covered, row.false_positives, row.missed) == (31, 50, 1, 30, 49, 1)
    assert met[0].count() == 1


def test_nearest_moves_join_copies_once(spark, monkeypatch):
    """Copies of a segment: only the smallest ids can be mutual nearest, and only they are joined."""
    met, grid_join = [], compare.grid_join
    monkeypatch.setattr(compare, "grid_join", lambda *a: met.append(grid_join(*a)) or met[-1])
    schema = "pair_id long, path_id long, x0 long, y0 long, x1 long, y1 long"
    old, new = (spark.createDataFrame([(1, n + i, 0, 0, 20, 0) if i % 2 else (1, n + i, 300 + m, 0, 300 + m, 30) for i in range(40)], schema) for n, m in ((0, 0), (100, 7)))
    assert sorted(map(tuple, compare.nearest_moves(old, new, 60.0).collect())) == [(1, 0, 100, 7.0), (1, 1, 101, 0.0)]
    assert met[0].count() == 2


def test_groups_hold_equal_boxes_once():
    """A copy is compared with different boxes, not with all their copies."""
    from collections import namedtuple

    seen = []

    class Counted(float):
        def __le__(self, other):
            seen.append(1)
            return float(self) <= other

    row = namedtuple("Row", "pair_id change_id x y w h")
    rows = [row(1, i, Counted(40.0 * (i % 3)), 0.0, 5.0, 5.0) for i in range(300)]
    assert [r[2] for r in compare.first_groups(128.0, 10.0)((), rows)] == [i % 3 for i in range(300)]
    assert len(seen) < 3 * 300 * 3


def test_font_substitution_joins_equal_boxes_once(spark, monkeypatch):
    met, grid_join = [], noise.grid_join
    monkeypatch.setattr(noise, "grid_join", lambda *a: met.append(grid_join(*a)) or met[-1])
    changes = spark.createDataFrame([(1, i, "raster", 1.0 + i % 2 * 500, 1.0, 5.0, 5.0) for i in range(40)], "pair_id long, change_id long, stream string, x double, y double, w double, h double")
    texts = spark.createDataFrame([(1, i, 0.0, 0.0, 20.0, 10.0) for i in range(30)], "pair_id long, id long, x double, y double, w double, h double")
    gone = noise.font_substitution(texts).marks(changes).collect()
    assert sorted(r.change_id for r in gone) == list(range(0, 40, 2)) and met[0].count() == 1
