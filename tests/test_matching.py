"""Matching, naming, lists, text and region pairing against plain loops and known answers."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillset.functions import measures, numbers
from quillset.functions import names
from quillset.operators import blocks, cascade, compare, comparison, gate, graph, listing, matching, naming, noise, renaming, textdiff


@pytest.mark.parametrize(
    "name,medium,aggressive",
    [
        ("KLM–STR–001_RevD.pdf", "klm-str-001", "klmstr001"), ("klm str 001.pdf", "klm-str-001", "klmstr001"), ("01_KLM-STR-001 Rev D_12-Apr-2026.PDF", "klm-str-001", "klmstr001"),
        ("Copy of A-101 (1).pdf", "copy-of-a-101-1", "a101"), ("A-101_A1_FOR APPROVAL.dwg", "a-101-a1-for-approval", "a101"), ("A-101 (C02).pdf", "a-101", "a101"), ("1234-A-101.pdf", "1234-a-101", "1234a101"), ("", "", ""), (None, "", ""), ("RevD.pdf", "", ""), ("ＫＬＭ‑001.pdf", "klm-001", "klm001"), ("x" * 5_000 + "_D.pdf", "x" * 5_000, "x" * 5_000), ("K-1 (rev B)_2024.1.2", "k-1", "k1"),
    ],
)
def test_normalise_name(spark, name, medium, aggressive):
    row = spark.createDataFrame([(name,)], "name string").select(*(names.normalise_name(F.col("name"), level) for level in ("medium", "aggressive"))).first()
    assert tuple(row) == (medium, aggressive)


def test_ratios():
    assert matching.indel_ratio("abcd", "abed") == 75 and matching.token_sort_ratio("b a", "a b") == 100
    assert cascade.token_set_ratio("plan a", "a plan of all") == 100 and cascade.token_set_ratio("", "a") == 0
    both = cascade.token_set_ratio("fuzzy was a bear", "wuzzy was a bear")
    assert both == 100 - 100 * 2 / 32  # one letter of 16 differs on either side


def test_match_sets(spark):
    rows = [
        ("old", 1, "A.pdf", "A-101", "A"), ("new", 2, "B.pdf", "A-101", "B"), ("old", 3, "C.pdf", "KLM-STR-001", "A"), ("new", 4, "D.pdf", "KLM STR 001", "A"),
        ("old", 5, "KLM-STR-009_RevD.pdf", None, None), ("new", 6, "klm str 009.pdf", None, None), ("old", 7, "ground floor ceiling plan.pdf", None, None), ("new", 8, "ceiling plan ground floor new.pdf", None, None),
        ("old", 9, "Z-1 x.pdf", "Z-1", "A"), ("old", 10, "Z-1 y.pdf", "Z-1", "B"), ("new", 11, "Z-1 z.pdf", "Z-1", "C"), ("old", 12, "qq.pdf", None, None), ("new", 13, "rr.pdf", None, None),
    ]
    sheets = spark.createDataFrame([(s, i, f, f"/{s}/{f}", n, "titleblock", r) for s, i, f, n, r in rows], "side string, sheet_id long, filename string, abs_path string, drawing_no string, source_of_number string, revision string")
    prints = spark.createDataFrame([(12, ["alpha", "beta", "gamma"]), (13, ["alpha", "beta", "gamma"])], "sheet_id long, tokens array<string>").selectExpr("*", "'a' AS size", "'x' AS orientation", "1 AS paths", "array('A') AS grid")
    got = {(r.old_id, r.new_id): (r.tier, r.confidence) for r in cascade.match_sets(sheets, prints).collect()}
    assert got == {(1, 2): (1, 1.0), (3, 4): (2, 0.98), (5, 6): (3, 0.92), (7, 8): (4, 0.839), (10, 11): (1, 1.0), (12, 13): (5, 1.0)}
    assert cascade.match_summary(cascade.match_sets(sheets, prints), sheets).first().asDict() == {"auto": 5, "review": 1, "old_unmatched": 0, "new_unmatched": 0}


def plain_targets(rows, occupied):
    leaving = {s.lower() for s, t in rows if s.lower() != t.lower()}
    held = {p.lower(): p.lower() for p in occupied if p.lower() not in leaving}
    claimed, out = set(), []
    for source, target in rows:
        for n in range(1, 1001):
            name = target if n == 1 else renaming.suffixed(target, n)
            if name.lower() not in claimed and held.get(name.lower(), source.lower()) == source.lower():
                claimed.add(name.lower())
                break
        out.append(name)
    return out


def test_targets_equal_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(f"/in/{i}.pdf", "/out/" + rng.choice(["a.pdf", "A.pdf", "a_2.pdf", "a_2_2.pdf", "b", "b_2", "c.d.pdf", "a_3.PDF"])) for i in range(60)] + [("/out/a_4.pdf", "/out/z.pdf"), ("/out/b_3", "/out/b_3")]
    occupied = ["/out/A_5.pdf", "/out/a_4.pdf", "/out/b_3", "/out/c.d.pdf"]
    plan = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "seq long, source string, target string").repartition(3)
    got = [r.final for r in renaming.resolve_targets(plan, spark.createDataFrame([(p,) for p in occupied], "path string")).orderBy("seq").collect()]
    assert got == plain_targets(rows, occupied) and len({g.lower() for g in got}) == len(got)
    assert [r.final for r in renaming.resolve_targets(spark.createDataFrame([(1, "", "a.pdf"), (2, "", "a.pdf"), (3, "", "a_2.pdf")], "seq long, source string, target string")).orderBy("seq").collect()] == ["a.pdf", "a_2.pdf", "a_2_2.pdf"]


def test_every_claim_gets_a_name(spark):
    plan = spark.range(1_200).select(F.col("id").alias("seq"), F.concat(F.lit("/i/"), F.col("id").cast("string")).alias("source"), F.lit("/o").alias("folder"), F.when(F.col("id") == 700, "Plan_2").otherwise("plan").alias("stem"), F.lit("pdf").alias("extension"))
    got = renaming.build_plan(plan).orderBy("seq").collect()
    assert {r.status for r in got} == {"ok"} and [r.final for r in got if r.seq in (0, 1, 699, 700, 701, 1_199)] == [f"/o/{n}.pdf" for n in ("plan", "plan_2", "plan_700", "Plan_2_2", "plan_701", "plan_1199")]
    assert renaming.grid(renaming.build_plan(plan), "problems").count() == 0


def test_plan_and_order(spark):
    files = [(1, "/i/1.pdf", "/o", "ok", "pdf"), (2, "/i/2.txt", "/o", "x", "txt"), (3, "/i/3.pdf", "/o", " ", "pdf"), (4, "/i/4.pdf", "/o", "NUL", "pdf"), (5, "/i/5.pdf", "/o", "a:b", "pdf"), (6, "/i/6.pdf", "/o", "y" * 300, "pdf"), (7, "/o/same.pdf", "/o", "same", "pdf"), (8, "/i/8.pdf", "/o", "ok", "PDF")]
    plan = renaming.build_plan(spark.createDataFrame(files, "seq long, source string, folder string, stem string, extension string"))
    assert [(r.status, r.final) for r in plan.orderBy("seq").collect()] == [("ok", "/o/ok.pdf"), ("skipped", None), ("missing_tokens", None), ("reserved_name", None), ("invalid_name", None), ("path_too_long", None), ("unchanged", "/o/same.pdf"), ("ok", "/o/ok_2.pdf")]
    assert {r.status for r in renaming.grid(plan, "problems").collect()} == {"skipped", "missing_tokens", "reserved_name", "invalid_name", "path_too_long"}
    moves = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "x", "y"), (5, "y", "x"), (6, "q", "q")], "seq long, source string, final string")
    assert {r.seq: (r.step, r.cyclic) for r in renaming.move_order(moves).collect()} == {1: (2, False), 2: (1, False), 3: (0, False), 4: (None, True), 5: (None, True), 6: (0, False)}


def test_a_cycle_costs_no_rounds(spark, monkeypatch):
    """Chains of up to 20 and a cycle among 2,000 rows: as many rounds as the chains need, not as the rows would allow."""
    written, materialise = [], renaming.materialise
    monkeypatch.setattr(renaming, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    k = F.col("id")
    rows = spark.range(2_000).select(k.alias("seq"), k.cast("string").alias("source"), F.when(k == 1, 0).when(k == 0, 1).when(k % 20 == 19, k + 10_000).otherwise(k + 1).cast("string").alias("final"))
    got = {r.seq: (r.step, r.cyclic) for r in renaming.move_order(rows).collect()}
    assert got == {i: (None, True) if i < 2 else (19 - i % 20, False) for i in range(2_000)}
    assert len(written) <= 7


def test_templates(spark):
    v = spark.range(1).select(naming.render("{a:3}-{b:pad4}", {"a": F.lit("abcdef"), "b": F.lit("7")}).alias("v")).first().v
    assert v == "abc-0007"


def test_compatibility_forms(spark):
    df = spark.createDataFrame([("ＡＢ１２",), ("ﬁre²",), ("a  b",), ("½",), ("plain",), (None,)], "t string")
    assert [r.v for r in df.select(measures.normalise_text(F.col("t")).alias("v")).collect()] == ["AB12", "FIRE2", "A B", "1⁄2", "PLAIN", None]


def plain_text_changes(items, move=3.9, radius=118.11):
    """Whole matrices for every pair, without grid or components."""
    from quillset.operators.matching import assign

    out = []
    for pair in {i[0] for i in items}:
        sides = [[i for i in items if i[0] == pair and i[1] == s] for s in ("old", "new")]
        left = []
        for t in {i[3] for side in sides for i in side}:
            a, b = ([i for i in side if i[3] == t] for side in sides)
            cost = np.array([[np.hypot(o[4] - n[4], o[5] - n[5]) for n in b] for o in a]).reshape(len(a), len(b))
            met = (assign(cost) if len(a) <= len(b) else [(i, j) for j, i in assign(cost.T)]) if len(a) and len(b) else []
            out += [("moved", a[i][2], b[j][2]) for i, j in met if cost[i, j] > move]
            left.append(([o for i, o in enumerate(a) if i not in {m[0] for m in met}], [n for j, n in enumerate(b) if j not in {m[1] for m in met}]))
        olds, news = ([i for part in left for i in part[s]] for s in (0, 1))
        score = np.zeros((len(olds), len(news)))
        for (i, o), (j, n) in itertools.product(enumerate(olds), enumerate(news)):
            d = np.hypot(o[4] - n[4], o[5] - n[5])
            if d <= radius:
                number = all(x[3].isdigit() for x in (o, n))
                score[i, j] = min(1, 0.7 * matching.indel_ratio(o[3], n[3]) / 100 + 0.3 * (1 - d / radius) + 0.1 * number)
                score[i, j] = min(1, score[i, j] + 0.05 * (number or not any(x[3].isdigit() for x in (o, n))))
        cost = np.hstack([np.where(score >= 0.55, 0.55 - score, 0), np.zeros((len(olds), len(olds)))])
        met = [(i, j) for i, j in assign(cost) if j < len(news) and score[i, j] >= 0.55] if len(olds) and len(news) else []
        out += [("modified", olds[i][2], news[j][2]) for i, j in met]
        out += [("removed", o[2], None) for i, o in enumerate(olds) if i not in {m[0] for m in met}] + [("added", None, n[2]) for j, n in enumerate(news) if j not in {m[1] for m in met}]
    return sorted(out, key=repr)


def test_text_changes_equal_whole_matrices(spark):
    rng = random.Random(5)
    items = []
    for pair, side in itertools.product(range(3), ("old", "new")):
        for i in range(25):
            text = rng.choice(["3000", "3200", "3250", "MEETING ROOM", "MEETING AREA", "STORE ROOM WEST", "LOBBY AREA EAST"])
            items.append((pair, side, i, text, float(rng.randrange(400)), float(rng.randrange(300)), 0.0, 0.0))
    df = spark.createDataFrame(items, "pair_id long, side string, item_id long, text string, x double, y double, w double, h double")
    got = textdiff.text_changes(df).collect()
    want = plain_text_changes(items)
    # several assignments may be equally good, so totals are compared, not pairs
    kinds = lambda rows: {k: sum(r[0] == k for r in rows) for k in ("moved", "modified", "removed", "added")}
    assert kinds([(r.kind,) for r in got]) == kinds(want)
    assert textdiff.text_changes(df.limit(0)).count() == 0


def test_clusters_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), i, rng.choice(["O", "F", "text"]), rng.choice(["added", "layer_visibility_changed", "moved"]), rng.random() < 0.4, float(rng.randrange(300)), float(rng.randrange(300)), float(rng.randrange(1, 20)), float(rng.randrange(1, 20))) for i in range(150)]
    reach = 12.0
    groups: list[list] = []
    want = {}
    for r in rows:
        if r[2] == "text" or r[3] == "layer_visibility_changed":
            want[r[1]] = r[1]
            continue
        near = lambda m, r=r: m[0] == r[0] and m[4] == r[4] and m[5] - reach <= r[5] + r[7] and r[5] <= m[5] + m[7] + reach and m[6] - reach <= r[6] + r[8] and r[6] <= m[6] + m[8] + reach
        home = next((g for g in groups if any(near(m) for m in g)), None)
        if home is None:
            groups.append(home := [])
        home.append(r)
        want[r[1]] = home[0][1]
    df = spark.createDataFrame(rows, "pair_id long, change_id long, stream string, kind string, is_cosmetic boolean, x double, y double, w double, h double").repartition(3)
    assert {r.change_id: r.cluster for r in compare.cluster_regions(df, reach).collect()} == want
    merged = compare.merge_clusters(df.withColumn("confidence", F.lit(0.5)), compare.cluster_regions(df, reach)).collect()
    assert sum(r.n for r in merged) == 150 and len(merged) == len(set(want.values()))


def test_components_both_ways(spark, monkeypatch):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "src long, dst long")
    one = sorted(map(tuple, graph.components(df).distinct().collect()))
    monkeypatch.setattr(graph, "SMALL", 0)
    assert one == sorted(map(tuple, graph.components(df).distinct().collect())) and len(one) > 60
    assert graph.components(df.limit(0)).count() == 0


def test_best_pairs_are_optimal(spark):
    rng = random.Random(9)
    pairs = [(a, b, rng.randrange(50, 100) / 100) for a in range(7) for b in range(6) if rng.random() < 0.5]
    score = {(a, b): s for a, b, s in pairs}
    best = max(sum(max(score.get((a, b), 0) - 0.6, 0) for a, b in zip(order, range(6), strict=False)) for order in itertools.permutations(range(7), 6))
    got = matching.best_pairs(spark.createDataFrame(pairs, "left_id long, right_id long, score double"), 0.6).collect()
    assert sum(r.score - 0.6 for r in got) == pytest.approx(best) and len({r.left_id for r in got}) == len({r.right_id for r in got}) == len(got)


def test_token_similarity_equals_all_pairs(spark):
    rng = random.Random(4)
    sets = [(i, "en", sorted({f"t{int(rng.paretovariate(0.8)) % 40}" for _ in range(rng.randrange(1, 25))})) for i in range(80)]
    l, r = sets[:40], sets[40:]
    want = {(a[0], b[0]) for a in l for b in r if round(len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])), 4) >= 0.5}
    frames = [spark.createDataFrame(x, "id long, lang string, tokens array<string>") for x in (l, r)]
    assert {(x.left_id, x.right_id) for x in matching.token_similarity(*frames, ["lang"], 0.5).collect()} == want and want


def test_filters_and_comparison(spark):
    """A moved wall, a changed dimension beside it, one that went stale, a replotted pen, and speckle."""
    items = [(1, s, i, t, x, y, 10.0, 3.0) for s in ("old", "new") for i, t, x, y in ((1, "3000" if s == "old" else "3200", 100.0, 100.0), (2, "1500", 500.0, 500.0), (3, "KITCHEN", 300.0, 300.0))]
    segments = [(1, s, p, *c) for s, p, c in [("old", 1, (100, 110, 160, 110, 10)), ("new", 1, (100, 112, 160, 112, 10)), ("old", 2, (500, 510, 530, 510, 10)), *(("old", p, (900, 10 * p, 950, 10 * p, 10)) for p in (5, 6, 7)), *(("new", p, (900, 10 * p, 950, 10 * p, 15)) for p in (5, 6, 7))]]
    out = comparison.compare_issues(spark.createDataFrame(items, "pair_id long, side string, item_id long, text string, x double, y double, w double, h double"), spark.createDataFrame(segments, "pair_id long, side string, path_id long, x0 long, y0 long, x1 long, y1 long, pen long"), sheet_area=1e6, move_radius=50.0)
    rows = {(r.stream, r.kind, r.flag, r.quantity_mm) for r in out.changes.collect()}
    assert rows == {("text", "modified", "consistent", 200.0), ("vector", "moved", None, None), ("vector", "removed", None, None), ("text", "modified", "geometry_moved_dimension_stale", None), ("vector", "style_only", None, None)}
    assert [(r.filter_name, r.n) for r in out.suppressed.groupBy("filter_name").agg(F.count("*").alias("n")).collect()] == [("filter_line_weight", 3)]
    ink = spark.createDataFrame([(1, 1, "raster", 0.0, 0.0, 2.0, 2.0), (1, 2, "raster", 50.0, 50.0, 3.0, 4.0), (1, 3, "raster", 60.0, 50.0, 9.0, 9.0), (1, 4, "raster", 500.0, 500.0, 3.0, 4.0), (1, 5, "text", 0.0, 0.0, 1.0, 1.0)], "pair_id long, change_id long, stream string, x double, y double, w double, h double").withColumn("area", F.lit(None).cast("double"))
    assert sorted(r.change_id for r in noise.speckle()(ink).kept.collect()) == [2, 3, 5]


def test_lists(spark):
    grid = ["Register|||", "|||", "No|Drawing Title|12.04.26|01.05.26", "A-101|Plan|A|B", "Architectural|||", "A-102|Section|C|", "||x|", "notes|see||"]
    cells = spark.createDataFrame([(1, r, c, t) for r, line in enumerate(grid) for c, t in enumerate(line.split("|"))], "list_id long, row int, col int, text string")
    assert [(r.row_number, r.drawing_no, r.title, r.revision) for r in listing.parse_lists(cells).orderBy("row_number").collect()] == [(4, "A-101", "Plan", "B"), (6, "A-102", "Section", "C")]
    items = spark.createDataFrame([(1, i, t, x, y, 8.0) for i, (t, x, y) in enumerate((("No", 10.0, 100.0), ("Title", 60.0, 100.0), ("A-1", 12.0, 80.0), ("Ground", 61.0, 80.0), ("floor", 75.0, 80.0)))], "list_id long, item_id long, text string, x double, y double, h double")
    assert sorted((r.row, r.col, r.text) for r in listing.page_to_cells(items).collect()) == [(0, 0, "No"), (0, 1, "Title"), (1, 0, "A-1"), (1, 1, "Ground"), (1, 2, "floor")]
    files = spark.createDataFrame([(1, "ceiling_plan-ground floor"), (2, "plan"), (3, "unlike anything else")], "sheet_id long, stem string")
    known = spark.createDataFrame([("A-1", "Ground Floor Ceiling Plan"), ("A-2", "Roof Plan"), ("A-3", None)], "drawing_no string, title string")
    assert [(r.sheet_id, r.drawing_no) for r in listing.fill_by_title(files, known).collect()] == [(1, "A-1")]


def test_revisions_in_text(spark):
    df = spark.createDataFrame([("Rev. C",), ("issue P03",), ("REVISION: 02",), ("rev by",), ("none",)], "t string")
    assert [r.v for r in df.select(blocks.find_revision(F.col("t")).alias("v")).collect()] == ["C", "P03", "02", None, None]
    s = spark.range(1).select(numbers.describe_change(F.lit("C01"), F.lit("P02")).alias("a"), numbers.describe_change(F.lit("A"), F.lit("B")).alias("b")).first()
    assert "back" in s.a and s.b == "Revised from A to B."
    assert blocks.example_pattern("A-101") == r"[A-Z]+\-\d+"


def test_fits_against_numpy(spark):
    rng = np.random.default_rng(6)
    old = rng.uniform(0, 500, (40, 2))
    new = old @ np.array([[0.9, 0.2], [-0.3, 1.1]]).T + [5, -7] + rng.normal(0, 0.1, (40, 2))
    w = rng.uniform(0.5, 2, 40)
    p = spark.createDataFrame([(1, f"p{i}", *map(float, (*old[i], *new[i])), float(w[i])) for i in range(40)] + [(2, "a", 1.0, 1.0, 1.0, 1.0, 1.0)] * 3, "pair_id long, label string, ox double, oy double, nx double, ny double, weight double")
    r = next(r for r in gate.fit(p, "affine").collect() if r.pair_id == 1)
    a = np.c_[old, np.ones(40)] * np.sqrt(w)[:, None]
    want = np.linalg.lstsq(a, new * np.sqrt(w)[:, None], rcond=None)[0]
    assert np.allclose([r.m00, r.m01, r.tx, r.m10, r.m11, r.ty], [*want[:, 0], *want[:, 1]], atol=1e-6)
    assert next(r for r in gate.fit(p).collect() if r.pair_id == 2).m00 is None
    assert 0.05 < gate.holdout(p.where("pair_id = 1"), "affine").first().holdout < 0.3
    square = spark.createDataFrame([(1, x, y) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (2.0, 1.0), (1.0, 1.0))], "pair_id long, ox double, oy double")
    assert gate.hull_area(square).first().area == 12 and gate.hull_area(square.limit(2)).first().area == 0
    assert tuple(gate.nearest_spacing(square).first())[1:] == pytest.approx((1.0, np.sqrt(8)))


def test_robust_fit_of_a_single_place(spark):
    from quillset.operators import align

    p = spark.createDataFrame([(-4, 1.0, 1.0, 2.0, 2.0)] * 5, "pair_id long, ox double, oy double, nx double, ny double")
    assert align.ransac_fit(p).first().inliers == 0
