"""Deterministic bindings of the star-schema tables to the library's input schemas.

Each is one SQL text that Spark and DuckDB both run, so the two engines start from the
same rows; everything after it is computed independently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BASE = """SELECT doc_id AS k, doc_id % 8 AS ri, doc_id % 5 AS bp, doc_id % 101 = 7 AS unread,
 (doc_id % 37 = 5 OR doc_id % 101 = 7) AS noid, lang, source, md5(text) AS h, substr(text, 1, 40) AS title, n_chars FROM {documents}"""

OLD_REV = "CASE ri WHEN 0 THEN 'A' WHEN 1 THEN 'H' WHEN 2 THEN 'P03' WHEN 3 THEN 'C01' WHEN 4 THEN '01' WHEN 5 THEN 'Rev B' WHEN 6 THEN 'I' ELSE NULL END"
NEXT_REV = "CASE ri WHEN 0 THEN 'B' WHEN 1 THEN 'J' WHEN 2 THEN 'P04' WHEN 3 THEN 'C02' WHEN 4 THEN '02' WHEN 5 THEN 'Rev C' WHEN 6 THEN 'O' ELSE NULL END"
OTHER_REV = "CASE ri WHEN 0 THEN 'P01' WHEN 1 THEN 'G' WHEN 2 THEN 'C01' WHEN 3 THEN 'P02' ELSE 'A' END"

SHEETS = f"""
WITH b AS ({BASE}),
one AS (
 SELECT 'old' AS side, k, 'old/' || source || '/' || cast(k AS STRING) || '.pdf' AS abs_path,
  CASE WHEN noid THEN NULL ELSE upper(lang) || '-' || lpad(cast(k AS STRING), 5, '0') END AS drawing_no,
  {OLD_REV} AS revision, h AS content_hash, NOT unread AS is_readable, title, n_chars AS size, noid
 FROM b WHERE k % 10 <> 9
 UNION ALL
 SELECT 'new' AS side, k, 'new/' || source || '/' || cast(k AS STRING) || '.pdf' AS abs_path,
  CASE WHEN noid THEN NULL ELSE upper(lang) || CASE WHEN k % 4 = 0 THEN ' ' ELSE '-' END || lpad(cast(k AS STRING), 5, '0') END AS drawing_no,
  CASE WHEN bp IN (0, 1) THEN {OLD_REV} WHEN bp IN (2, 3) THEN {NEXT_REV} ELSE {OTHER_REV} END AS revision,
  CASE WHEN k % 3 <> 0 THEN md5(h || '#new') ELSE h END AS content_hash, NOT unread AS is_readable, title, n_chars AS size, noid
 FROM b WHERE k % 10 <> 0)
SELECT side, k, abs_path, drawing_no, revision, content_hash, is_readable, title, size FROM one
UNION ALL SELECT side, k, abs_path || '.dup', drawing_no, revision, content_hash, is_readable, title, size FROM one WHERE k % 25 = 1
UNION ALL SELECT side, k, abs_path || '.old', drawing_no, 'A', md5(content_hash || '#sup'), is_readable, title, size FROM one WHERE k % 25 = 2
"""

LIST = """
SELECT upper(lang) || '-' || lpad(cast(doc_id AS STRING), 5, '0') AS drawing_no, substr(text, 1, 40) AS title, doc_id AS row_number FROM {documents}
WHERE doc_id % 10 <> 9 AND NOT (doc_id % 37 = 5 OR doc_id % 101 = 7) AND doc_id % 7 <> 3
UNION ALL SELECT 'ZZ-' || lpad(cast(item_id AS STRING), 5, '0'), substr(text, 1, 40), 1000000 + item_id FROM {benchmark}
"""

ITEMS = """
WITH p AS (SELECT p_partkey AS k, p_partkey % 20 AS pair_id, cast((p_partkey * 37) % 800 AS DOUBLE) AS x, cast((p_partkey * 53) % 560 AS DOUBLE) AS y, p_size AS s, p_name AS n FROM {part}),
t AS (SELECT *,
 CASE k % 6 WHEN 0 THEN cast(1000 + 50 * s AS STRING) WHEN 1 THEN 'D-' || cast(s AS STRING) WHEN 2 THEN 'FFL +' || cast(s % 10 AS STRING) || '.600' WHEN 3 THEN upper(n)
  WHEN 4 THEN cast(2 + s % 7 AS STRING) || '.4m' ELSE 'Provide ' || cast(100 + s AS STRING) || 'mm blockwork to ' || n || ' walls' END AS old_text,
 CASE k % 6 WHEN 0 THEN cast(1200 + 50 * s AS STRING) WHEN 1 THEN 'D-' || cast(s + 10 AS STRING) WHEN 2 THEN 'FFL +' || cast(s % 10 AS STRING) || '.750' END AS changed FROM p)
SELECT pair_id, 'old' AS side, k AS item_id, old_text AS text, x, y, 2.0 * length(old_text) AS w, cast(3 AS DOUBLE) AS h FROM t WHERE k % 17 <> 0
UNION ALL
SELECT pair_id, 'new', k, CASE WHEN k % 11 = 0 AND changed IS NOT NULL THEN changed ELSE old_text END, CASE WHEN k % 9 = 0 THEN x + 30 ELSE x END, y,
 2.0 * length(CASE WHEN k % 11 = 0 AND changed IS NOT NULL THEN changed ELSE old_text END), cast(3 AS DOUBLE) FROM t WHERE k % 13 <> 0
"""

SEGMENTS = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 20 AS pair_id, (o_orderkey * 31) % 8000 AS x0, (o_orderkey * 57) % 5600 AS y0, 10 + o_custkey % 90 AS len, 10 + 5 * (o_custkey % 3) AS pen FROM {orders}),
s AS (SELECT *, x0 + CASE WHEN k % 2 = 0 THEN len ELSE 0 END AS x1, y0 + CASE WHEN k % 2 = 1 THEN len ELSE 0 END AS y1 FROM o)
SELECT pair_id, 'old' AS side, k AS path_id, x0, y0, x1, y1, pen FROM s WHERE k % 19 <> 0
UNION ALL
SELECT pair_id, 'new', k, (CASE WHEN k % 4 = 1 THEN x1 ELSE x0 END) + (CASE WHEN k % 7 = 0 THEN 40 ELSE 0 END), CASE WHEN k % 4 = 1 THEN y1 ELSE y0 END,
 (CASE WHEN k % 4 = 1 THEN x0 ELSE x1 END) + (CASE WHEN k % 7 = 0 THEN 40 ELSE 0 END), CASE WHEN k % 4 = 1 THEN y0 ELSE y1 END, pen + CASE WHEN k % 10 = 3 THEN 5 ELSE 0 END FROM s WHERE k % 23 <> 0
"""

POINTS = """
SELECT pair_id, label, ox, oy, 0.8 * ox - 0.6 * oy + 10 + CASE WHEN k % 10 = 0 THEN 50 ELSE 0 END AS nx, 0.6 * ox + 0.8 * oy - 5 - CASE WHEN k % 10 = 0 THEN 40 ELSE 0 END AS ny, k
FROM (SELECT cast(c_nationkey AS BIGINT) AS pair_id, c_name AS label, cast((73 * c_custkey) % 900 AS DOUBLE) AS ox, cast((91 * c_custkey) % 600 AS DOUBLE) AS oy, c_custkey AS k FROM {customer})
"""

CHANGES = """
SELECT l_orderkey % 50 AS pair_id, l_orderkey * 10 + l_linenumber AS change_id, min(l_returnflag) AS kind, min(l_linestatus) AS stream, min(l_discount) AS confidence,
 min(l_tax) < 0.02 AS is_cosmetic, CASE WHEN min(l_quantity) < 10 THEN 'small' WHEN min(l_quantity) < 30 THEN 'medium' ELSE 'large' END AS category,
 cast((l_orderkey * 13) % 3000 AS DOUBLE) AS x, cast((l_orderkey * 29) % 2000 AS DOUBLE) AS y, cast(5 + l_orderkey % 60 AS DOUBLE) AS w, cast(5 + l_linenumber * 9 AS DOUBLE) AS h
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

PAGE_ITEMS = """
SELECT d.doc_id AS sheet_id, d.doc_id * 40 + v.n AS item_id,
 CASE WHEN v.t = '#' THEN upper(d.lang) || '-' || cast(d.doc_id AS STRING) WHEN v.t = '%' THEN 'P0' || cast(1 + d.doc_id % 4 AS STRING) ELSE v.t END AS text,
 v.x + (d.doc_id % 11) / 1000.0E0 AS x, v.y + (d.doc_id % 7) / 1000.0E0 AS y, v.w + 0.0E0 AS w, CASE WHEN v.t = 'N' THEN 0.01E0 + (d.doc_id % 4) / 100.0E0 ELSE v.h + 0.0E0 END AS h
FROM {documents} d JOIN (
 SELECT * FROM (VALUES
 (0, 0, 'Drawing No.', 0.80, 0.93, 0.07, 0.010), (0, 1, '#', 0.80, 0.95, 0.06, 0.010), (0, 2, 'SCALE  1:50', 0.90, 0.93, 0.05, 0.010), (0, 3, 'Drawn', 0.80, 0.90, 0.03, 0.010),
 (0, 4, 'Checked by', 0.86, 0.90, 0.05, 0.010), (0, 5, 'Date', 0.92, 0.90, 0.03, 0.010), (0, 6, 'Rev.', 0.95, 0.93, 0.02, 0.010), (0, 7, 'Description', 0.84, 0.70, 0.06, 0.010),
 (0, 8, 'Rev', 0.78, 0.70, 0.02, 0.010), (0, 9, 'Date', 0.93, 0.70, 0.03, 0.010), (0, 10, '%', 0.78, 0.72, 0.02, 0.010), (0, 11, 'Stair moved', 0.84, 0.72, 0.08, 0.010),
 (0, 12, '12.04.26', 0.93, 0.721, 0.04, 0.010), (0, 13, 'A', 0.78, 0.74, 0.02, 0.010), (0, 14, 'First issue', 0.84, 0.74, 0.08, 0.010), (0, 15, '3 Mar 2026', 0.93, 0.74, 0.04, 0.010),
 (0, 16, 'GENERAL NOTES', 0.70, 0.10, 0.10, 0.012), (0, 17, '1. Do not scale.', 0.70, 0.13, 0.12, 0.010), (0, 18, '2. All sizes in mm.', 0.70, 0.15, 0.12, 0.010), (0, 19, 'far below', 0.70, 0.30, 0.12, 0.010),
 (0, 20, 'N', 0.05, 0.10, 0.02, 0.010), (0, 21, 'Scale bar', 0.60, 0.88, 0.06, 0.010), (0, 22, 'Key plan', 0.55, 0.60, 0.06, 0.010),
 (1, 0, 'CLIENT', 0.10, 0.88, 0.05, 0.010), (1, 1, 'PROJECT', 0.30, 0.88, 0.05, 0.010), (1, 2, 'TITLE', 0.50, 0.88, 0.05, 0.010), (1, 3, 'SHEET NO', 0.71, 0.88, 0.05, 0.010), (1, 4, 'Date', 0.20, 0.20, 0.05, 0.010),
 (1, 5, 'Scale', 0.30, 0.20, 0.05, 0.010), (1, 6, 'Amendments', 0.30, 0.80, 0.05, 0.010), (1, 7, '02', 0.22, 0.82, 0.02, 0.010), (1, 8, 'Door D-7 widened', 0.30, 0.82, 0.10, 0.010), (1, 9, '2026-01-09', 0.45, 0.82, 0.05, 0.010),
 (1, 10, 'B', 0.43, 0.82, 0.01, 0.010), (1, 11, 'NOTES:', 0.05, 0.50, 0.05, 0.010), (1, 12, 'True north', 0.90, 0.50, 0.05, 0.010), (1, 13, 'TRUE NORTH', 0.20, 0.40, 0.05, 0.010),
 (2, 0, 'Scale', 0.40, 0.40, 0.05, 0.010), (2, 1, 'Door schedule', 0.40, 0.45, 0.10, 0.010), (2, 2, 'Notes to the door schedule that go on and on', 0.40, 0.50, 0.30, 0.010), (2, 3, 'Issue', 0.80, 0.50, 0.04, 0.010),
 (2, 4, 'C01', 0.80, 0.52, 0.02, 0.010), (2, 5, 'metres', 0.50, 0.90, 0.04, 0.010)
 ) AS a(g, n, t, x, y, w, h)) v ON v.g = d.doc_id % 3
"""

PAGE_LINES = """
SELECT d.doc_id AS sheet_id, v.x0 + (d.doc_id % 5) / 2000.0E0 AS x0, v.y0 + 0.0E0 AS y0, v.x1 + (d.doc_id % 5) / 2000.0E0 AS x1, v.y1 + 0.0E0 AS y1
FROM {documents} d JOIN (
 SELECT * FROM (VALUES (0, 0.02, 0.02, 0.98, 0.02), (0, 0.02, 0.98, 0.98, 0.98), (0, 0.02, 0.02, 0.02, 0.98), (0, 0.97, 0.02, 0.97, 0.98), (0, 0.973, 0.02, 0.973, 0.98), (0, 0.77, 0.50, 0.77, 0.98), (0, 0.70, 0.87, 0.98, 0.87), (0, 0.60, 0.86, 0.98, 0.861),
  (1, 0.02, 0.86, 0.99, 0.86), (1, 0.02, 0.10, 0.30, 0.40), (3, 0.05, 0.05, 0.95, 0.05)) AS a(g, x0, y0, x1, y1)) v ON v.g = d.doc_id % 4
"""

SQL = {"page_items": PAGE_ITEMS, "page_lines": PAGE_LINES, "sheets": SHEETS, "drawing_list": LIST, "text_items": ITEMS, "segments": SEGMENTS, "points": POINTS, "changes": CHANGES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every table and binding as a temporary view, for plain Spark SQL."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name in SQL:
        bound(spark, sf_dir, name).createOrReplaceTempView(name)


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def as_oracle(name: str) -> str:
    """The binding's text for DuckDB, as a subquery."""
    text = SQL[name]
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return f"({text})"


#: How SQL twins name the bindings.
NAMES = {"PAGE_ITEMS": "page_items", "PAGE_LINES": "page_lines", "SHEETS": "sheets", "DRAWING_LIST": "drawing_list", "ITEMS": "text_items", "SEGMENTS": "segments", "POINTS": "points", "CHANGES": "changes"}


def with_bindings(sql: str) -> str:
    """DuckDB SQL with the bindings' names, written in capitals after FROM or JOIN, replaced by their text."""
    return re.sub(r"\b(FROM|JOIN) (" + "|".join(NAMES) + r")\b", lambda m: f"{m[1]} {duckdb_text(NAMES[m[2]])}", sql)


def duckdb_text(name: str) -> str:
    return as_oracle(name).replace("AS STRING", "AS VARCHAR")
