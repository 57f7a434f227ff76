"""Known answers and invariants of the core operators."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillset.functions import measures, numbers
from quillset.operators import align, compare, ingest, matching, naming, register, store


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "code,scheme,ordinal,shown",
    [("P03", "preliminary", 3, "P03"), ("c1", "construction", 1, "C01"), ("T12", "tender", 12, "T12"), ("Rev A", "alpha", 1, "A"), ("H", "alpha", 8, "H"), ("J", "alpha", 9, "J"), ("I", "unknown", None, "I"), ("AA", "alpha", 25, "AA"), ("A1", "alpha", 101, "A1"), ("01", "numeric", 1, "01"), ("(B)", "alpha", 2, "B"), ("", "unknown", None, ""), (None, "unknown", None, "")],
)
def test_parse_revision(spark, code, scheme, ordinal, shown):
    r = one(spark, numbers.parse_revision(F.lit(code).cast("string")))
    assert (r.scheme, r.ordinal, r.normalised) == (scheme, ordinal, shown)


@pytest.mark.parametrize("old,new,relation", [("C", "D", "newer"), ("D", "C", "older"), ("P03", "C01", "status_change"), ("H", "H", "same"), ("I", "J", "incomparable"), ("A1", "B", "older")])
def test_compare_revisions(spark, old, new, relation):
    assert one(spark, numbers.compare_revisions(numbers.parse_revision(F.lit(old)), numbers.parse_revision(F.lit(new)))) == relation


@pytest.mark.parametrize("text,value,unit,kind", [("3000", 3000, "", "single"), ("3,000", 3000, "", "single"), ("2400mm", 2400, "MM", "single"), ("2.4m", 2.4, "M", "single"), ("+3.600", 3.6, "", "level"), ("3000/2400", 3000, "", "string"), ("3000-3200", 3100, "", "range"), ("3000 to 3200", 3100, "", "range")])
def test_parse_numeric(spark, text, value, unit, kind):
    n = one(spark, measures.parse_numeric(F.lit(text)))
    assert (n.value, n.unit, n.kind) == (pytest.approx(value), unit, kind)


def test_numeric_change(spark):
    d = one(spark, measures.numeric_change(F.lit("3000"), F.lit("3200"), F.lit(False)))
    assert (d.delta_mm, round(d.percent, 1), d.direction) == (200.0, 6.7, "increased")
    d = one(spark, measures.numeric_change(F.lit("FFL +3.600"), F.lit("FFL +3.750"), F.lit(True)))
    assert (round(d.delta_mm, 6), d.direction) == (150.0, "raised")
    assert one(spark, measures.numeric_change(F.lit("1 HOUR"), F.lit("2 HOUR"), F.lit(False))).direction == "unknown"


@pytest.mark.parametrize("text,category", [("1:100", "scale"), ("NTS", "scale"), ("FFL +0.150", "level"), ("CLIENT", "level"), ("D-12", "tag"), ("3000", "dimension"), ("Provide fire rated doors to stair", "spec"), ("See the plan for more rooms", "note"), ("AB", "grid"), ("", "unknown")])
def test_classify(spark, text, category):
    assert one(spark, measures.classify(F.lit(text))).category == category


def test_tolerance(spark):
    t = one(spark, measures.tolerance(F.lit(50.0), F.lit(100.0)))
    assert (t.paper_mm, round(t.px, 1), t.clamped) == (0.5, 3.9, False)
    assert one(spark, measures.tolerance(F.lit(25.0), F.lit(5.0))).paper_mm == 3.0
    assert one(spark, measures.tolerance(F.lit(25.0), F.lit(500.0))).paper_mm == 0.2


def test_filename_number(spark):
    assert one(spark, numbers.number_from_filename(F.lit("KLM-NOR-STR-B02-DR-S-001234-Rev-D.pdf"))) == "KLM-NOR-STR-B02-DR-S-001234"
    assert one(spark, numbers.number_from_filename(F.lit("notes.pdf"))) is None


def sheets(spark, rows):
    return spark.createDataFrame([(s, n, r, h, f"{s}/{n}{h}", True) for s, n, r, h in rows], "side string, drawing_no string, revision string, content_hash string, abs_path string, is_readable boolean")


def test_full_issue_register(spark):
    keep = ["A-001", "A-103", "A-104", "A-105", "A-202", "A-301", "A-302"]
    rows = [("old", n, "C", n) for n in [*keep, "A-101", "A-102", "A-201"]] + [("new", n, "C", n) for n in keep] + [("new", n, "D", n + "x") for n in ("A-101", "A-102", "A-201")] + [("new", "A-303", "A", "q")]
    got = {r.drawing_no: r.status for r in register.reconcile(sheets(spark, rows), "full").collect()}
    assert sum(s == "unchanged" for s in got.values()) == 7 and got["A-303"] == "new" and got["A-201"] == "revised" and len(got) == 11


def test_partial_issue(spark):
    rows = [("old", f"A-{100 + i}", "A", str(i)) for i in range(12)] + [("new", f"A-{100 + i}", "B", f"n{i}") for i in range(3)]
    got = register.reconcile(sheets(spark, rows), "partial").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"revised": 3, "not_reissued": 9}
    assert register.issue_question(sheets(spark, rows)).first().looks_partial


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        cost = rng.random((n, n + 1))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + 1), n))
        assert sum(cost[i, j] for i, j in matching.assign(cost)) == pytest.approx(best)


def test_every_text_item_has_a_state(spark):
    """Texts that stand several times on a side are paired by least total distance; with the singletons, no item is left out."""
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for pair in range(3):
        for text, n in (("a", (3, 3)), ("b", (2, 4)), ("c", (4, 1)), ("d", (0, 3)), ("e", (2, 0)), ("f", (1, 1)), ("g", (1, 0))):
            for side, k in zip(("old", "new"), n, strict=True):
                for _ in range(k):
                    rows.append((pair, side, i, text, *(float(v) for v in rng.integers(0, 4, 2) * 10)))
                    i += 1
    rows += [(0, "old", i, None, 1.0, 1.0), (0, "old", i + 1, None, 1.0, 1.0), (0, "new", i + 2, None, 1.0, 1.0), (0, "old", i + 3, "h", None, 1.0), (0, "old", i + 4, "h", 5.0, 1.0), (0, "new", i + 5, "h", 5.0, 3.0)]
    items = spark.createDataFrame(rows, "pair_id long, side string, item_id long, text string, x double, y double").repartition(3)
    got = compare.text_repeats(items).collect()
    single = {(r.pair_id, r.text) for r in compare.text_singletons(items).collect()}
    place = {r[2]: r for r in rows}
    assert sorted(x for r in got for x in (r.old_id, r.new_id) if x is not None) == sorted(r[2] for r in rows if (r[0], r[3]) not in single)
    for r in got:
        if r.old_id is None or r.new_id is None:
            assert (r.state, r.distance) == ("new_only" if r.old_id is None else "old_only", None)
        else:
            o, n = place[r.old_id], place[r.new_id]
            assert o[:1] + o[3:4] == n[:1] + n[3:4] == (r.pair_id, r.text) and o[1] == "old" and n[1] == "new"
            assert r.distance == pytest.approx(np.hypot(o[4] - n[4], o[5] - n[5]), abs=1e-6) and r.state == ("unchanged" if r.distance <= 3.9 else "moved")
    for pair in range(3):
        for text in "abcde":
            old, new = ([r[4:] for r in rows if r[:2] == (pair, s) and r[3] == text] for s in ("old", "new"))
            few, many = sorted((old, new), key=len)
            best = min(sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(few, p, strict=True)) for p in itertools.permutations(many, len(few)))
            pairs = [r.distance for r in got if (r.pair_id, r.text) == (pair, text) and r.distance is not None]
            assert len(pairs) == len(few) and sum(pairs) == pytest.approx(best, abs=1e-4)


def test_indel_ratio():
    assert matching.indel_ratio("abc", "abc") == 100.0
    assert matching.indel_ratio("abcd", "abxd") == pytest.approx(75.0)
    assert matching.indel_ratio("", "a") == 0.0


def test_swap_turns_added_into_removed(spark):
    rows = spark.createDataFrame([(1, "old", 1, 0, 0, 5, 0, 10), (1, "new", 2, 5, 0, 0, 0, 10), (1, "new", 3, 1, 1, 1, 9, 10)], "pair_id long, side string, path_id long, x0 long, y0 long, x1 long, y1 long, pen long")
    swap = rows.withColumn("side", F.when(F.col("side") == "old", "new").otherwise("old"))
    a, b = ({r.state: r.n for r in compare.vector_bag_diff(x).collect()} for x in (rows, swap))
    assert a == {"same": 1, "added": 1} and b == {"same": 1, "removed": 1}


def test_renumbering(spark):
    rows = spark.createDataFrame([(1, f"D-{i}", f"D-{i + 10}") for i in range(12, 16)] + [(2, "D-1", "D-2"), (2, "D-2", "x"), (2, "D-3", "D-4"), (2, "D-5", "D-6")], "pair_id long, old_text string, new_text string")
    got = {r.pair_id: (r.renumbered, r.offset) for r in compare.renumbering(rows).collect()}
    assert got == {1: (True, 10), 2: (False, None)}


def test_kept_and_suppressed_are_all(spark):
    rows = spark.createDataFrame([(1, i, "a", i % 2 == 0, 0.0, 0.0, 1.0, 1.0) for i in range(7)], "pair_id long, change_id long, kind string, is_cosmetic boolean, x double, y double, w double, h double")
    kept, gone = store.style_collapse(rows)
    assert kept.agg(F.sum("merged")).first()[0] == 7 and gone.count() == 4


def test_robust_fits_ignore_outliers(spark):
    rows = [(1, float(i * 37 % 90), float(i * 53 % 70)) for i in range(40)]
    data = [(p, x, y, 0.8 * x - 0.6 * y + 10 + (60 if k % 10 == 0 else 0), 0.6 * x + 0.8 * y - 5) for k, (p, x, y) in enumerate(rows)]
    points = spark.createDataFrame(data, "pair_id long, ox double, oy double, nx double, ny double")
    for r in (align.ransac_fit(points).first(), align.trimmed_fit(points, 3.0).first()):
        assert (r.a, r.b, r.tx, r.ty) == pytest.approx((0.8, 0.6, 10, -5), abs=1e-6)


def test_render_drops_missing(spark):
    assert one(spark, naming.render("{a:upper}-{b}-{c:pad3}", {"a": F.lit("x"), "b": F.lit(None).cast("string"), "c": F.lit(7)})) == "X-007"


def test_scan_and_list(spark, tmp_path):
    (tmp_path / "archive").mkdir()
    for n in ("a.pdf", "b.dwg", "Thumbs.db", "archive/c.pdf"):
        (tmp_path / n).write_bytes(b"x")
    got = {r.filename: r.disposition for r in ingest.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "drawing", "b.dwg": "other", "Thumbs.db": "skipped", "c.pdf": "skipped"}
    (tmp_path / "list.csv").write_text("No;Name\nA-1;Plan\n")
    assert ingest.read_drawing_list(spark, str(tmp_path / "list.csv"), {"drawing_no": "No", "title": "Name"}, ";").first().drawing_no == "A-1"
