"""Queries on matching, drawing lists, title blocks, masks and renaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillset.functions import names, numbers
from quillset.operators import blocks, cascade, ingest, listing, masks, matching, renaming, store
from quillset.plans.registry import Registry
from quillset.sources.bindings import bound, table

query = Registry()


def _named_sheets(spark, d):
    """Sheets with file names; a third of the new ones have lost their number, some also changed their name."""
    s = bound(spark, d, "sheets")
    k = F.col("k")
    lost = (F.col("side") == "new") & (k % 3 == 0)
    words = F.concat(F.lit("Block "), F.chr(65 + k % 26), F.lit(" room "), k.cast("string"))
    name = F.when(F.col("side") == "old", F.concat(words, F.lit("_RevA.pdf"))).when(k % 6 == 0, F.concat(F.lit("0"), (k % 9).cast("string"), F.lit(" - "), words, F.lit("_RevB 2024-01-02.pdf"))).otherwise(F.concat(F.lit("room "), k.cast("string"), F.lit(" of block "), F.chr(65 + k % 26), F.lit(".pdf")))
    return s.where("is_readable").select("side", F.xxhash64("abs_path").alias("h"), (k * 8 + F.when(F.col("side") == "old", 0).otherwise(4) + F.when(F.col("abs_path").endswith(".dup"), 1).when(F.col("abs_path").endswith(".old"), 2).otherwise(0)).alias("sheet_id"), name.alias("filename"), "abs_path", F.when(lost, F.lit(None)).otherwise(F.col("drawing_no")).alias("drawing_no"), F.when(k % 5 == 0, "filename").otherwise("titleblock").alias("source_of_number"), "revision", "title")


@query()
def match_sets(spark, d):
    """All five tiers, by tier: how many pairs, how many of the same k."""
    sheets = _named_sheets(spark, d)
    prints = sheets.select("sheet_id", matching.tokens(F.col("title")).alias("tokens"), F.lit("a").alias("size"), F.lit("landscape").alias("orientation"), F.lit(1).alias("paths"), F.array().cast("array<string>").alias("grid"))
    pairs = cascade.match_sets(sheets, prints)
    same = F.floor(F.col("old_id") / 8) == F.floor(F.col("new_id") / 8)
    return pairs.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(same).alias("right"), F.count_if("ambiguous").alias("ambiguous"))


@query(
    """WITH s AS (SELECT side, k, abs_path, CASE WHEN side = 'new' AND k % 3 = 0 THEN NULL ELSE drawing_no END AS no, CASE WHEN k % 5 = 0 THEN 0 ELSE 3 END AS src, revision FROM SHEETS WHERE is_readable),
 p AS (SELECT *, coalesce(regexp_replace(upper(no), '[^A-Z0-9]', '', 'g'), '') AS key, upper(regexp_replace(trim(coalesce(revision, '')), '(?i)^rev\\s*', '')) AS r FROM s),
 o AS (SELECT *, CASE WHEN regexp_full_match(r, '[PC]\\d+') THEN substr(r, 2)::INT WHEN regexp_full_match(r, '\\d+') THEN r::INT WHEN r <> '' AND strpos('ABCDEFGHJKLMNPQRSTUVWXYZ', r) > 0 THEN strpos('ABCDEFGHJKLMNPQRSTUVWXYZ', r) ELSE -1 END AS ord FROM p)
 SELECT side, key AS number_key, abs_path, count(*) OVER (PARTITION BY side, key) - 1 AS n_superseded FROM o WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY side, key ORDER BY src DESC, ord DESC, lower(abs_path) DESC) = 1
 UNION ALL SELECT side, key, abs_path, 0 FROM o WHERE key = ''"""
)
def match_representatives(spark, d):
    return cascade.representatives(_named_sheets(spark, d)).select("side", "number_key", "abs_path", "n_superseded")


def _strings(of: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in of) + "]"


NAME_ENDINGS = ("_RevD.pdf", "_12-Apr-2026_P02.PDF", " 2026.04.12 (C).dwg", "_A1.pdf", " revision 03 - Copy.png", "-20260412_FOR APPROVAL.pdf", " (2).tif", "_D.dwg", "(C02)_Rev E.pdf", " Apr 2026.pdf", ".final.v2", "_P01_superseded.pdf",
    " rev.b", "_A1_IFC.pdf", "'s plan, 12/04/26.pdf", "", "—draft_Rev (3)_04.05.2026.dxf", " checked_B_a4.jpeg", "_old-signed off_2026_1_2.bmp")
NAME_STARTS = ("", "07 - ", "Copy of ", "NEW ", " 112_", "issued-for-tender ")


def _replaced(of: str, pattern: str, by: str = "", all_: bool = False) -> str:
    """SQL: a pattern of ``of`` replaced, quotes doubled."""
    return f"regexp_replace({of}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}'" + (", 'g')" if all_ else ")")


def _cut(of: str) -> str:
    """SQL: up to five endings cut off one by one, in RE2, which has no look-around."""
    code = r"(?:[b-z]\d{0,2}|a(?:[5-9]|\d\d)?|[a-z]{2}\d{0,2})"
    for _ in range(5):
        of = _replaced(of, rf"(?:[-_ .]+|([(])|^)(?:{names.REVISION}|{names.DATE})$|[-_ .]*_{code}$|[-_ .]*\({names.CODE}\)$", r"\1")
    return of


def _dash(of: str) -> str:
    return f"trim({_replaced(of, names.SEPARATORS, '-', True)}, '-')"


def _core(of: str) -> str:
    junk = "|".join((*names.JUNK_WORDS, names.SHEET_SIZE))
    return _replaced(of, f"^(?:(?:{junk})-)*(.+?)(?:-(?:{junk}))*$", r"\1")


NAME_SQL = f"""WITH n AS (SELECT p_partkey, {_strings(NAME_STARTS)}[p_partkey % {len(NAME_STARTS)} + 1] || 'KLM–STR_' || lpad((p_partkey % 900)::VARCHAR, 3, '0') || {_strings(NAME_ENDINGS)}[p_partkey // 7 % {len(NAME_ENDINGS)} + 1] AS name FROM part),
 t AS (SELECT p_partkey, lower(trim(translate(name, '–—', '--'))) AS t FROM n),
 s AS (SELECT *, {_cut(_replaced(_replaced("t", "[.](?:" + "|".join(names.EXTENSIONS) + ")$"), "^" + names.SEQUENCE))} AS stem FROM t),
 c AS (SELECT *, {_dash(_replaced(_replaced("stem", "^" + names.COPY_OF), names.COPY_MARK + "$"))} AS bare FROM s),
 w AS (SELECT *, {_cut(_core("bare"))} AS one FROM c), v AS (SELECT *, {_cut(_core("one"))} AS two FROM w)
 SELECT p_partkey, {_dash("t")} AS light, {_dash("stem")} AS medium, {_replaced("two", "[^a-z0-9]", "", True)} AS aggressive FROM v"""


@query(NAME_SQL)
def name_normalise(spark, d):
    k = F.col("p_partkey")
    start, ending = (F.element_at(F.array(*map(F.lit, of)), i.cast("int") + 1) for of, i in ((NAME_STARTS, k % len(NAME_STARTS)), (NAME_ENDINGS, F.floor(k / 7) % len(NAME_ENDINGS))))
    name = F.concat(start, F.lit("KLM–STR_"), F.lpad((k % 900).cast("string"), 3, "0"), ending)
    return table(spark, d, "part").select("p_partkey", *(names.normalise_name(name, level).alias(level) for level in names.LEVELS))


@query(
    """WITH c AS (SELECT p_partkey % 500 AS left_id, p_partkey AS right_id, 0.5 + (p_partkey * 7 % 50) / 100.0 AS score FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS n FROM c WHERE score >= 0.7), b AS (SELECT * FROM r WHERE n = 1)
 SELECT b.left_id, b.right_id, b.score, max(o.score) AS runner_up, coalesce(round_even(b.score - max(o.score), 4) <= 0.05, false) AS ambiguous, count(o.right_id) FILTER (o.n <= 4) AS n_alternatives
 FROM b LEFT JOIN r o ON o.left_id = b.left_id AND o.n > 1 GROUP BY b.left_id, b.right_id, b.score"""
)
def match_alternatives(spark, d):
    k = F.col("p_partkey")
    c = table(spark, d, "part").select((k % 500).alias("left_id"), k.alias("right_id"), (F.lit(0.5) + (k * 7 % 50) / 100).alias("score")).where("score >= 0.7")
    best = c.groupBy("left_id").agg(F.max_by("right_id", F.struct("score", -F.col("right_id"))).alias("right_id"), F.max("score").alias("score"))
    return cascade.with_alternatives(best, c).select("left_id", "right_id", "score", "runner_up", "ambiguous", F.size("alternatives").cast("long").alias("n_alternatives"))


PAIRS = "p AS (SELECT o_orderkey AS old_id, CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 0.7 + (o_orderkey % 30) / 100.0 END AS confidence, o_orderkey % 9 = 2 AS ambiguous FROM orders)"


def _pairs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("old_id"), k.alias("new_id"), F.when(k % 4 == 0, 1.0).otherwise(F.lit(0.7) + (k % 30) / 100).alias("confidence"), (k % 9 == 2).alias("ambiguous"))


@query(
    f"""WITH {PAIRS}, s AS (SELECT side, count(*) AS n FROM (SELECT DISTINCT side, coalesce(regexp_replace(upper(CASE WHEN side = 'new' AND k % 3 = 0 THEN NULL ELSE drawing_no END), '[^A-Z0-9]', '', 'g'), abs_path) FROM SHEETS WHERE is_readable) GROUP BY 1)
 SELECT count(*) FILTER (NOT (confidence < 0.9 OR ambiguous)) AS auto, count(*) FILTER (confidence < 0.9 OR ambiguous) AS review, (SELECT n FROM s WHERE side = 'old') - count(*) AS old_unmatched, (SELECT n FROM s WHERE side = 'new') - count(*) AS new_unmatched FROM p"""
)
def match_summary(spark, d):
    return cascade.match_summary(_pairs(spark, d), _named_sheets(spark, d))


@query(
    f"""WITH {PAIRS}, d AS (SELECT l_orderkey AS old_id, max_by(CASE WHEN l_linenumber % 2 = 0 THEN 'rejected' ELSE 'manual' END, l_linenumber) AS decision FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1),
 t AS (SELECT old_id FROM p WHERE (confidence < 0.9 OR ambiguous) AND confidence >= 0.8)
 SELECT decision, count(*) AS n FROM (SELECT old_id, 'accepted' AS decision FROM t UNION ALL FROM d ANTI JOIN t USING (old_id)) GROUP BY 1"""
)
def bulk_accept(spark, d):
    n = F.col("l_linenumber")
    decided = table(spark, d, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("old_id"), F.when(n % 2 == 0, "rejected").otherwise("manual").alias("decision"), n.alias("seq"))
    return cascade.bulk_accept(_pairs(spark, d), decided, 0.8).groupBy("decision").agg(F.count("*").alias("n"))


# --- drawing lists -----------------------------------------------------------------


def _cells(spark, d):
    """Lists of 40 parts each: a project line, a header, section headings, rows; every third one is a revision matrix."""
    k = F.col("p_partkey")
    at = table(spark, d, "part").select(F.floor(k / 40).alias("list_id"), (k % 40).alias("n"), k.alias("k"), "p_name", "p_brand")
    matrix = F.col("list_id") % 3 == 0

    def cell(row, col, text):
        return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), text.cast("string").alias("text"))

    row = F.col("n") + 4
    rows = F.array(cell(row, 0, F.when(F.col("n") % 13 == 12, F.lit("Structural")).when(F.col("n") % 11 == 7, F.lit("")).otherwise(F.concat(F.lit("A-"), (100 + F.col("k") % 900).cast("string")))), cell(row, 1, F.when(F.col("n") % 13 == 12, F.lit(None)).otherwise(F.col("p_name"))), cell(row, 2, F.when(F.col("n") % 13 != 12, F.when(F.col("n") % 4 == 1, F.lit("nan")).otherwise(F.chr(65 + F.col("n") % 8)))), cell(row, 3, F.when((F.col("n") % 13 != 12) & (F.col("n") % 3 == 0), F.lit("C"))))
    heads = F.array(cell(F.lit(0), 0, F.lit("Project drawing register")), cell(F.lit(2), 0, F.lit("Drawing No.")), cell(F.lit(2), 1, F.lit("Drawing Title")), cell(F.lit(2), 2, F.when(matrix, F.lit("12.04.26")).otherwise(F.lit("Rev."))), cell(F.lit(2), 3, F.when(matrix, F.lit("01.05.26")).otherwise(F.lit("Status"))))
    both = at.withColumn("c", F.explode(F.when(F.col("n") == 0, F.concat(heads, rows)).otherwise(rows)))
    return both.select(F.floor(F.col("list_id") / 2).alias("book"), "list_id", "c.row", "c.col", "c.text").withColumn("has_header", F.lit(True))


@query(
    """WITH p AS (SELECT p_partkey // 40 AS list_id, p_partkey % 40 AS n, p_partkey AS k, p_name FROM part), h AS (SELECT DISTINCT list_id FROM p WHERE n = 0)
 SELECT list_id, n + 5 AS row_number, 'A-' || (100 + k % 900) AS drawing_no, p_name AS title,
  CASE WHEN list_id % 3 = 0 THEN CASE WHEN n % 3 = 0 THEN 'C' WHEN n % 4 <> 1 THEN chr((65 + n % 8)::INT) END WHEN n % 4 <> 1 THEN chr((65 + n % 8)::INT) END AS revision,
  CASE WHEN list_id % 3 <> 0 AND n % 3 = 0 THEN 'C' END AS status, NULL::VARCHAR AS date
 FROM p JOIN h USING (list_id) WHERE n % 13 <> 12 AND n % 11 <> 7"""
)
def parse_lists(spark, d):
    return listing.parse_lists(_cells(spark, d)).withColumn("row_number", F.col("row_number").cast("long"))


@query("""SELECT DISTINCT p_partkey // 40 AS list_id, 2 AS header_row, 3 AS words FROM part WHERE p_partkey % 40 = 0 AND p_partkey // 40 % 3 = 0 UNION ALL SELECT DISTINCT p_partkey // 40, 2, 5 FROM part WHERE p_partkey % 40 = 0 AND p_partkey // 40 % 3 > 0""")
def header_rows(spark, d):
    return listing.header_rows(_cells(spark, d)).select("list_id", "header_row", F.col("words").alias("words")).where("header_row = 2")


@query(
    """WITH h AS (SELECT DISTINCT p_partkey // 40 AS list_id FROM part WHERE p_partkey % 40 = 0)
 SELECT list_id, 'drawing_no' AS field, 0 AS col FROM h UNION ALL SELECT list_id, 'title', 1 FROM h UNION ALL SELECT list_id, 'revision', 2 FROM h WHERE list_id % 3 > 0 UNION ALL SELECT list_id, 'status', 3 FROM h WHERE list_id % 3 > 0"""
)
def list_mapping(spark, d):
    cells = _cells(spark, d)
    return listing.guess_mapping(cells, listing.header_rows(cells).where("header_row = 2"))


@query(
    """WITH p AS (SELECT p_partkey // 40 AS list_id, p_partkey % 40 AS n FROM part), s AS (SELECT list_id, count(*) FILTER (n % 13 <> 12 AND n % 11 <> 7) AS score FROM p GROUP BY 1)
 SELECT list_id // 2 AS book, list_id, score FROM s QUALIFY row_number() OVER (PARTITION BY list_id // 2 ORDER BY score DESC, list_id) = 1"""
)
def best_worksheet(spark, d):
    return listing.best_worksheet(_cells(spark, d))


@query()
def pdf_table_cells(spark, d):
    k = F.col("p_partkey")
    items = table(spark, d, "part").select(F.floor(k / 60).alias("list_id"), k.alias("item_id"), F.col("p_brand").alias("text"), (F.lit(40.0) + k % 3 * 90 + k % 7).alias("x"), (F.lit(700.0) - F.floor(k % 60 / 3) * 12).alias("y"), F.lit(8.0).alias("h"))
    return listing.page_to_cells(items)


@query()
def fill_by_title(spark, d):
    part = table(spark, d, "part")
    files = part.select(F.col("p_partkey").alias("sheet_id"), F.concat_ws("_", F.reverse(F.split("p_name", " "))).alias("stem"))
    return listing.fill_by_title(files, part.select(F.concat(F.lit("A-"), F.col("p_partkey").cast("string")).alias("drawing_no"), F.col("p_name").alias("title")))


@query("SELECT o_custkey AS pair_id, o_orderkey AS run_id, o_orderstatus AS state FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_runs(spark, d):
    """Orders as runs of the comparison of a pair, the customer: the last one of each."""
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("started"))
    return store.latest_runs(runs).select("pair_id", "run_id", "state")


@query(
    """WITH z AS (SELECT p_partkey % 50 AS pair_id, CASE WHEN p_partkey % 5 = 0 THEN 'keep' ELSE 'user' END AS kind, p_size % 10 / 10.0 AS x0, p_size % 7 / 10.0 AS y0, p_partkey % 5 = 0 AS protected FROM part)
 SELECT DISTINCT pair_id, kind, round(x0, 6) AS x0, round(y0, 6) AS y0, protected FROM z"""
)
def merged_masks(spark, d):
    """The zones that the templates and the users of all pairs drew, each once."""
    k, size = F.col("p_partkey"), F.col("p_size")
    zones = table(spark, d, "part").select(k, (k % 50).alias("pair_id"), F.when(k % 5 == 0, "keep").otherwise("user").alias("kind"), (size % 10 / 10).alias("x0"), (size % 7 / 10).alias("y0"), (size % 10 / 10 + 0.1).alias("x1"), (size % 7 / 10 + 0.1).alias("y1"), (k % 5 == 0).alias("protected"))
    parts = [zones.where(F.col("p_partkey") % 3 == n).drop("p_partkey") for n in range(3)]
    return masks.merge_masks(*parts).select("pair_id", "kind", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"), "protected")


# --- title blocks -----------------------------------------------------------------------


def _block_items(spark, d):
    """A label and its value below it, a second line, a note and a stray number on every sheet."""
    k = F.col("p_partkey")
    right = F.lit(0.75) + (k % 5) / 50
    low = F.lit(0.10) + (k % 4) / 100

    def item(n, text, fx, fy, fh=0.01):
        return F.struct(F.lit(n).alias("item_id"), text.alias("text"), fx.alias("fx"), fy.alias("fy"), F.lit(fh).alias("fh"))

    number = F.concat(F.lit("A-"), (100 + k % 900).cast("string"))
    items = F.array(
        item(1, F.when(k % 6 == 0, F.lit("Ref")).otherwise(F.lit("Drawing No.")), right, low), item(2, F.when(k % 7 == 3, F.lit("see list")).otherwise(number), right + 0.01, low - 0.03),
        item(3, F.lit("Drawing Title"), right, low + 0.1), item(4, F.upper("p_name"), right, low + 0.07), item(5, F.lit("LEVEL PLAN"), right + 0.001, low + 0.055), item(6, F.lit("Scale"), right, low + 0.2),
        item(7, F.lit("12mm board, refer to detail."), right, low + 0.06), item(8, F.concat(F.lit("B-"), (200 + k % 700).cast("string")), F.lit(0.3), F.lit(0.6)),
    )
    return table(spark, d, "part").select(k.alias("sheet_id"), F.explode(items).alias("i")).select("sheet_id", "i.*")


@query(
    """SELECT p_partkey AS sheet_id, CASE WHEN p_partkey % 7 = 3 THEN 'B-' || (200 + p_partkey % 700) ELSE 'A-' || (100 + p_partkey % 900) END AS drawing_no, CASE WHEN p_partkey % 7 = 3 THEN 'sheet_text' ELSE 'titleblock' END AS source,
  CASE WHEN p_partkey % 7 = 3 THEN 0.6 WHEN p_partkey % 6 = 0 THEN 0.75 ELSE 0.95 END AS confidence, CASE WHEN p_partkey % 7 = 3 THEN true ELSE p_partkey % 10 = 4 END AS number_mismatch FROM part"""
)
def sheet_numbers(spark, d):
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(k.alias("sheet_id"), F.concat(F.lit("A"), (100 + k % 900 + F.when(k % 10 == 4, 1).otherwise(0)).cast("string")).alias("filename_number"))
    return blocks.sheet_numbers(_block_items(spark, d), files)


@query("SELECT p_partkey AS sheet_id, upper(p_name) || ' LEVEL PLAN' AS title FROM part")
def wrapped_titles(spark, d):
    items = _block_items(spark, d)
    return blocks.wrapped_titles(blocks.values_near(blocks.find_labels(items, blocks.TITLE_LABELS), items, blocks.is_plausible_title(F.col("text"))), items)


@query("SELECT p_partkey AS sheet_id, 4 AS zones FROM part")
def zone_ranks(spark, d):
    ranked = blocks.zone_scores(_block_items(spark, d))
    return ranked.groupBy("sheet_id").agg(F.count("*").alias("zones"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN chr((65 + p_partkey % 7)::INT) WHEN 1 THEN 'P0' || p_partkey % 9 WHEN 2 THEN '0' || p_partkey % 9 END AS revision, p_partkey % 5 <> 3 AS plausible FROM part"""
)
def find_revision(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("Revision: "), F.chr(65 + k % 7), F.lit(" date"))).when(k % 5 == 1, F.concat(F.lit("issued p0"), (k % 9).cast("string"))).when(k % 5 == 2, F.concat(F.lit("rev. 0"), (k % 9).cast("string"))).when(k % 5 == 3, F.lit("rev by")).otherwise(F.lit("A1 plan"))
    shown = F.when(k % 5 == 3, F.lit("NTS")).otherwise(F.lit("p02"))
    return table(spark, d, "part").select("p_partkey", blocks.find_revision(text).alias("revision"), blocks.is_plausible_revision(shown).alias("plausible"))


@query("""SELECT p_partkey AS sheet_id, CASE WHEN p_partkey % 3 = 0 THEN 'B-1' WHEN p_partkey % 3 = 1 THEN 'QX-' || p_partkey END AS drawing_no FROM part""")
def correct_by_example(spark, d):
    k = F.col("p_partkey")
    sheets = table(spark, d, "part").select(k.alias("sheet_id"), F.when(k % 3 == 0, "B-1").alias("drawing_no"), F.when(k % 3 == 1, F.concat(F.lit("plan qx-"), k.cast("string"), F.lit(" new"))).otherwise(F.lit("no number 5")).alias("stem"))
    return blocks.correct_by_example(sheets, "A-101").select("sheet_id", "drawing_no")


@query(
    """WITH e AS (SELECT l_partkey AS sheet_id, max_by('U-' || l_orderkey, l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_orderkey % 50 = 1 GROUP BY 1)
 SELECT p_partkey AS sheet_id, coalesce(n, 'A-' || p_partkey) AS drawing_no, CASE WHEN n IS NULL THEN 'titleblock' ELSE 'user' END AS source, CASE WHEN n IS NULL THEN 0.95 ELSE 1.0 END AS confidence FROM part LEFT JOIN e ON p_partkey = sheet_id"""
)
def manual_numbers(spark, d):
    read = table(spark, d, "part").select(F.col("p_partkey").alias("sheet_id"), F.concat(F.lit("A-"), F.col("p_partkey").cast("string")).alias("drawing_no"), F.lit("titleblock").alias("source"), F.lit(0.95).alias("confidence"))
    entered = table(spark, d, "lineitem").where("l_orderkey % 50 = 1").select(F.col("l_partkey").alias("sheet_id"), F.concat(F.lit("U-"), F.col("l_orderkey").cast("string")).alias("drawing_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return blocks.manual_numbers(read, entered).select("sheet_id", "drawing_no", "source", "confidence")


# --- masks ------------------------------------------------------------------------------


def _zones(spark, d):
    rows = [(p, z, k, x0, y0, x1, y1, e, s, i, w) for p in range(20) for z, (k, x0, y0, x1, y1, e, s, i, w) in enumerate((("titleblock", 0.7, 0.0, 1.0, 0.4, True, False, False, []), ("user", 0.0, 0.5, 0.2, 0.6 + p / 100, p % 3 > 0, False, False, []), ("watermark", 0.3, 0.3, 0.7, 0.7, True, False, True, ["D-7", "1500"]), ("keep", 0.8, 0.1, 0.9, 0.2, True, True, False, [])))]
    return spark.createDataFrame(rows, "pair_id long, zone_id int, kind string, x0 double, y0 double, x1 double, y1 double, enabled boolean, protected boolean, ink_only boolean, words array<string>")


@query(
    """WITH i AS (SELECT pair_id, side, item_id, upper(text) AS t, (x + w / 2) / 900 AS fx, (y + h / 2) / 600 AS fy FROM ITEMS)
 SELECT pair_id, side, count(*) AS n, sum(item_id)::BIGINT AS ids FROM i WHERE (fx BETWEEN 0.8 AND 0.9 AND fy BETWEEN 0.1 AND 0.2)
  OR NOT ((fx BETWEEN 0.7 AND 1 AND fy BETWEEN 0 AND 0.4) OR (pair_id % 3 > 0 AND fx BETWEEN 0 AND 0.2 AND fy BETWEEN 0.5 AND 0.6 + pair_id / 100) OR (fx BETWEEN 0.3 AND 0.7 AND fy BETWEEN 0.3 AND 0.7 AND t IN ('D-7', '1500'))) GROUP BY ALL"""
)
def apply_mask(spark, d):
    items = bound(spark, d, "text_items").withColumn("key", F.concat_ws(":", "side", "item_id"))
    return masks.apply_mask(items, _zones(spark, d), "key", 900.0, 600.0).groupBy("pair_id", "side").agg(F.count("*").alias("n"), F.sum("item_id").alias("ids"))


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey % 10 AS pair_id, l_partkey * 7 % 97 AS x, l_orderkey * 13 % 89 AS y FROM lineitem), f AS (SELECT *, (x + 0.5) / 97 AS fx, (y + 0.5) / 89 AS fy FROM i)
 SELECT pair_id, count(*) AS hidden FROM f WHERE NOT (fx BETWEEN 0.8 AND 0.9 AND fy BETWEEN 0.1 AND 0.2) AND ((fx BETWEEN 0.7 AND 1 AND fy BETWEEN 0 AND 0.4) OR (pair_id % 3 > 0 AND fx BETWEEN 0 AND 0.2 AND fy BETWEEN 0.5 AND 0.6 + pair_id / 100)) GROUP BY 1"""
)
def masked_pixels(spark, d):
    ink = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("pair_id"), (F.col("l_partkey") * 7 % 97).alias("x"), (F.col("l_orderkey") * 13 % 89).alias("y")).distinct()
    return masks.apply_mask_to_pixels(ink, _zones(spark, d), 97, 89, invert=True).groupBy("pair_id").agg(F.count("*").alias("hidden"))


# --- renaming ---------------------------------------------------------------------------


def _plan(spark, d):
    k = F.col("p_partkey")
    stem = F.when(k % 31 == 0, F.lit("con")).when(k % 29 == 0, F.lit("")).when(k % 23 == 0, F.concat(F.lit("a*b"), k.cast("string"))).when(k % 19 == 0, F.repeat(F.lit("x"), 300)).when(k % 7 == 0, F.lit("plan")).when(k % 7 == 1, F.lit("Plan_2")).otherwise(F.concat(F.lit("sheet "), (k % 50).cast("string")))
    return table(spark, d, "part").select(k.alias("seq"), F.concat(F.lit("/in/"), k.cast("string"), F.lit(".pdf")).alias("source"), F.concat(F.lit("/out/"), (k % 4).cast("string")).alias("folder"), stem.alias("stem"), F.when(k % 17 == 0, "txt").otherwise("PDF").alias("extension"))


PLAN = """q AS (SELECT p_partkey AS seq, '/out/' || p_partkey % 4 AS folder, CASE WHEN p_partkey % 31 = 0 THEN 'con' WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN 'a*b' || p_partkey WHEN p_partkey % 19 = 0 THEN repeat('x', 300) WHEN p_partkey % 7 = 0 THEN 'plan' WHEN p_partkey % 7 = 1 THEN 'Plan_2' ELSE 'sheet ' || p_partkey % 50 END AS stem,
  CASE WHEN p_partkey % 17 = 0 THEN 'skipped' WHEN p_partkey % 31 = 0 THEN 'reserved_name' WHEN p_partkey % 29 = 0 THEN 'missing_tokens' WHEN p_partkey % 23 = 0 THEN 'invalid_name' WHEN p_partkey % 19 = 0 THEN 'path_too_long' ELSE 'ok' END AS status FROM part)"""


@query(
    f"""WITH RECURSIVE {PLAN}, c AS (SELECT seq, folder || '/' || stem || '.pdf' AS target, folder || '/' || regexp_replace(lower(stem), '_2$', '') AS g, row_number() OVER (PARTITION BY folder || '/' || regexp_replace(lower(stem), '_2$', '') ORDER BY seq) AS n FROM q WHERE status = 'ok'),
 s(g, n, seq, final, taken) AS (SELECT DISTINCT g, 0, NULL::BIGINT, NULL::VARCHAR, CASE g WHEN '/out/1/plan' THEN ['/out/1/plan_3.pdf'] WHEN '/out/2/plan' THEN ['/out/2/plan.pdf'] ELSE []::VARCHAR[] END FROM c
  UNION ALL SELECT g, n, seq, f, list_append(taken, lower(f)) FROM (SELECT c.g, c.n, c.seq, s.taken, [t FOR t IN list_prepend(c.target, [replace(c.target, '.pdf', '_' || i || '.pdf') FOR i IN range(2, len(s.taken) + 3)]) IF NOT list_contains(s.taken, lower(t))][1] AS f FROM s JOIN c ON c.g = s.g AND c.n = s.n + 1))
 SELECT q.seq, s.final, status, coalesce(s.final <> folder || '/' || stem || '.pdf', false) AS collided FROM q LEFT JOIN s ON s.seq = q.seq"""
)
def rename_plan(spark, d):
    occupied = spark.createDataFrame([("/out/1/plan_3.pdf",), ("/out/2/PLAN.pdf",)], "path string")
    return renaming.build_plan(_plan(spark, d), occupied).select("seq", "final", "status", "collided")


@query(
    """WITH s AS (SELECT CASE WHEN p_partkey % 17 = 0 THEN 'skipped' WHEN p_partkey % 31 = 0 THEN 'reserved_name' WHEN p_partkey % 29 = 0 THEN 'missing_tokens' WHEN p_partkey % 23 = 0 THEN 'invalid_name' WHEN p_partkey % 19 = 0 THEN 'path_too_long' ELSE 'ok' END AS status FROM part),
 n AS (SELECT status, count(*) AS n FROM s GROUP BY 1) SELECT status, n, sum(CASE WHEN status = 'ok' THEN n ELSE 0 END) OVER ()::BIGINT AS to_change, 0 AS unchanged, sum(CASE WHEN status <> 'ok' THEN n ELSE 0 END) OVER ()::BIGINT AS problems FROM n"""
)
def rename_summary(spark, d):
    return renaming.plan_summary(renaming.build_plan(_plan(spark, d)))


@query(f"WITH {PLAN} SELECT seq, status, row_number() OVER (PARTITION BY status ORDER BY seq) AS place FROM q WHERE status <> 'ok'")
def rename_grid(spark, d):
    """The rows that need a hand, numbered within their status."""
    shown = renaming.grid(renaming.build_plan(_plan(spark, d)), "problems")
    return shown.select("seq", "status", F.row_number().over(Window.partitionBy("status").orderBy("seq")).alias("place"))


@query(
    """WITH RECURSIVE m AS (SELECT p_partkey AS seq, 'f' || p_partkey AS s, 'f' || CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 2 WHEN p_partkey % 10 = 6 THEN 100000 + p_partkey ELSE p_partkey + 1 END AS f FROM part),
 w AS (SELECT a.seq, b.seq AS waits FROM m a LEFT JOIN m b ON a.f = b.s), c(seq, step) AS (SELECT seq, 0 FROM w WHERE waits IS NULL UNION ALL SELECT w.seq, step + 1 FROM c JOIN w ON w.waits = c.seq)
 SELECT m.seq, step, step IS NULL AS cyclic FROM m LEFT JOIN c USING (seq)"""
)
def rename_order(spark, d):
    k = F.col("p_partkey")
    target = F.when(k % 10 == 9, k - 2).when(k % 10 == 6, 100000 + k).otherwise(k + 1)
    plan = table(spark, d, "part").select(k.alias("seq"), F.concat(F.lit("f"), k.cast("string")).alias("source"), F.concat(F.lit("f"), target.cast("string")).alias("final"))
    return renaming.move_order(plan).select("seq", "step", "cyclic")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN chr((65 + p_partkey % 9)::INT) END AS revision, CASE WHEN p_partkey % 4 = 1 THEN '2024-01-0' || p_partkey % 9 END AS date, CASE WHEN p_partkey % 4 = 2 THEN 'TEN' END AS status, p_partkey % 4 = 3 AS reserved FROM part"""
)
def name_parts(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("plan rev-"), F.chr(65 + k % 9))).when(k % 4 == 1, F.concat(F.lit("plan 2024/01/0"), (k % 9).cast("string"))).when(k % 4 == 2, F.lit("For Tender x")).otherwise(F.lit("nul.pdf"))
    return table(spark, d, "part").select("p_partkey", renaming.revision_in_name(name).alias("revision"), renaming.date_in_name(name).alias("date"), renaming.status_in_name(name).alias("status"), renaming.is_reserved(name).alias("reserved"))


@query("WITH c AS (SELECT side, revision, count(*) AS n FROM SHEETS WHERE revision IS NOT NULL GROUP BY ALL) FROM c QUALIFY row_number() OVER (PARTITION BY side ORDER BY n DESC, revision) = 1")
def common_revision(spark, d):
    return renaming.common_revision(bound(spark, d, "sheets"))


@query("SELECT p_name AS final, min(p_partkey) AS seq FROM part GROUP BY 1 ORDER BY seq LIMIT 3")
def rename_preview(spark, d):
    return renaming.preview(table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("final")))


# --- files ------------------------------------------------------------------------------


@query(
    "SELECT doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1"
)
def quick_hash_copies(spark, d):
    return ingest.copies(table(spark, d, "documents").select(F.col("doc_id"), F.col("text").cast("binary").alias("content")), "doc_id", "content").select("doc_id")


@query("SELECT p_partkey, p_partkey % 3 = 1 AS equivalent FROM part")
def scales_equivalent(spark, d):
    k = F.col("p_partkey")
    other = F.when(k % 3 == 0, F.lit("1:50")).when(k % 3 == 1, F.lit("Scale 1 / 100")).otherwise(F.lit("NTS"))
    return table(spark, d, "part").select("p_partkey", numbers.scales_equivalent(F.lit("1:100"), other).alias("equivalent"))
