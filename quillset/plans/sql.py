"""SQL twins of the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

from quillset.sources.bindings import as_oracle

NO = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ"

#: A macro-like text: parse of a revision column r into scheme, ordinal and shown.
CLEAN = r"upper(regexp_replace(regexp_replace(trim(coalesce({0}, '')), '(?i)^(rev|issue)?[\s.:_-]*', ''), '[\s)\]]+$', ''))"
REV = f"""
(SELECT raw, t,
  CASE WHEN regexp_full_match(t, '[PCT]\\d{{1,3}}') THEN CASE left(t, 1) WHEN 'P' THEN 'preliminary' WHEN 'C' THEN 'construction' ELSE 'tender' END
   WHEN regexp_full_match(t, '\\d{{1,3}}') THEN 'numeric' WHEN regexp_full_match(t, '[{ALPHABET}]') THEN 'alpha' ELSE 'unknown' END AS scheme,
  CASE WHEN regexp_full_match(t, '[PCT]\\d{{1,3}}') THEN substr(t, 2)::BIGINT WHEN regexp_full_match(t, '\\d{{1,3}}') THEN t::BIGINT
   WHEN regexp_full_match(t, '[{ALPHABET}]') THEN strpos('{ALPHABET}', t) END AS ordinal,
  CASE WHEN regexp_full_match(t, '[PCT]\\d{{1,3}}') THEN left(t, 1) || lpad(substr(t, 2)::BIGINT::VARCHAR, 2, '0') WHEN regexp_full_match(t, '\\d{{1,3}}') THEN lpad(t::BIGINT::VARCHAR, 2, '0') ELSE t END AS shown
 FROM (SELECT DISTINCT revision AS raw, {CLEAN.format("revision")} AS t FROM sheets))
"""
SHEETS = f"sheets AS {as_oracle('sheets')}, rev AS {REV}"
LATEST = f"""{SHEETS},
known AS (SELECT s.*, {NO.format('drawing_no')} AS number_key, rev.scheme, rev.ordinal, row_number() OVER (PARTITION BY side, {NO.format('drawing_no')}, content_hash ORDER BY abs_path) > 1 AS copy
 FROM sheets s JOIN rev ON s.revision IS NOT DISTINCT FROM rev.raw WHERE drawing_no IS NOT NULL AND is_readable),
latest AS (SELECT *, count(*) FILTER (copy) OVER (PARTITION BY side, number_key) AS n_duplicates, count(*) FILTER (NOT copy) OVER (PARTITION BY side, number_key) - 1 AS n_superseded
 FROM known QUALIFY row_number() OVER (PARTITION BY side, number_key ORDER BY copy, coalesce(ordinal, -1) DESC, abs_path DESC) = 1)"""


def register(gone: str) -> str:
    return f"""{LATEST},
rows AS (SELECT coalesce(o.number_key, n.number_key) AS number_key, coalesce(n.drawing_no, o.drawing_no) AS drawing_no,
 CASE WHEN o.side IS NULL THEN 'new' WHEN n.side IS NULL THEN '{gone}'
  WHEN o.ordinal IS NOT NULL AND n.ordinal IS NOT NULL AND o.scheme <> n.scheme THEN 'status_change'
  WHEN o.ordinal IS NOT NULL AND n.ordinal IS NOT NULL AND o.ordinal <> n.ordinal THEN 'revised'
  WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'same_rev_different_file' END AS status,
 o.revision AS old_revision, n.revision AS new_revision, o.abs_path AS old_path, n.abs_path AS new_path,
 coalesce(o.scheme = n.scheme AND n.ordinal < o.ordinal, false) AS is_older
 FROM (FROM latest WHERE side = 'old') o FULL JOIN (FROM latest WHERE side = 'new') n ON o.number_key = n.number_key),
loose AS (SELECT NULL AS number_key, NULL AS drawing_no, CASE WHEN is_readable THEN 'unidentified' ELSE 'unreadable' END AS status,
 CASE WHEN side = 'old' THEN revision END AS old_revision, CASE WHEN side = 'new' THEN revision END AS new_revision,
 CASE WHEN side = 'old' THEN abs_path END AS old_path, CASE WHEN side = 'new' THEN abs_path END AS new_path, false AS is_older
 FROM sheets WHERE drawing_no IS NULL OR NOT is_readable),
reg AS (SELECT *, status IN ('unidentified', 'unreadable', 'same_rev_different_file', 'removed') AS needs_attention FROM (FROM rows UNION ALL FROM loose))"""


LISTED = f"list AS {as_oracle('drawing_list')}, wanted AS (SELECT {NO.format('drawing_no')} AS number_key, arg_min(drawing_no, row_number) AS drawing_no FROM list GROUP BY 1)"
ITEMS = f"items AS {as_oracle('text_items')}"
EDITS = f"{ITEMS}, edits AS (SELECT pair_id, item_id, max(text) FILTER (side = 'old') AS o, max(text) FILTER (side = 'new') AS n FROM items GROUP BY ALL HAVING o <> n)"
SEGMENTS = f"""seg AS (SELECT *, md5(CASE WHEN x0 < x1 OR (x0 = x1 AND y0 <= y1) THEN x0 || ',' || y0 || ',' || x1 || ',' || y1 ELSE x1 || ',' || y1 || ',' || x0 || ',' || y0 END) AS geometry FROM {as_oracle('segments')})"""
CHANGES = f"changes AS {as_oracle('changes')}"
POINTS = f"points AS {as_oracle('points')}"
EVENTS = "ev AS (SELECT event_id, ts, user_id AS run_id, event_type AS stage, value, event_type = 'purchase' AS terminal FROM events)"
SIDES = f"{LATEST}, old AS (SELECT k AS id, drawing_no AS number, number_key FROM latest WHERE side = 'old'), new AS (SELECT k AS id, drawing_no AS number, number_key FROM latest WHERE side = 'new')"
PRINTS = "prints AS (SELECT doc_id AS id, lang, doc_id % 2 AS m, list_distinct(regexp_extract_all(lower(regexp_replace(text, '[^ -~]', ' ', 'g')), '[a-z0-9]{2,}')) AS tokens FROM documents)"
NUM = r"[-+±]?\d{1,3}(?:[ ,]\d{3})*(?:\.\d+)?|[-+±]?\d+(?:\.\d+)?"

NOTES = r"""(SELECT p_partkey, p_partkey % 20 AS pair_id, upper(regexp_replace(trim((['For  Tender', 'digitally signed by', 'Status B', 'draft copy', 'Reviewed', 'grid'])[p_partkey % 6 + 1] || ' ' || substr(p_name, 1, 8)), '\s+', ' ', 'g')) AS t,
  (p_partkey * 37) % 800 AS x, (p_partkey * 53) % 560 AS y, CASE WHEN p_partkey % 7 = 3 THEN 40.0 ELSE 3.0 END AS h, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 9 END * CASE WHEN p_partkey % 7 = 3 THEN 40.0 ELSE 3.0 END AS w, p_partkey % 11 = 2 AS pale FROM part)"""

INK_DIFF = """WITH i AS (SELECT DISTINCT l_orderkey % 10 AS pair_id, l_partkey * 7 % 97 AS x, l_orderkey * 13 % 89 AS y, l_linenumber % 2 = 0 AS o FROM lineitem),
 a AS (SELECT pair_id, x, y FROM i WHERE o AND (x + y) % 5 <> 0), b AS (SELECT pair_id, x, y FROM i WHERE NOT o AND (x * y) % 7 <> 0),
 d(i, j) AS (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))
 SELECT pair_id, x, y, 'removed' AS state FROM a ANTI JOIN (SELECT pair_id, x + i AS x, y + j AS y FROM b, d) USING (pair_id, x, y)
 UNION ALL SELECT pair_id, x, y, 'added' FROM b ANTI JOIN (SELECT pair_id, x + i AS x, y + j AS y FROM a, d) USING (pair_id, x, y)"""
ORACLES = {
    "register_reconcile": f"WITH {register('removed')} SELECT number_key, drawing_no, status, old_revision, new_revision, old_path, new_path, is_older, needs_attention FROM reg",
    "register_partial": f"""WITH {register('not_reissued')}, {LISTED},
 marked AS (SELECT r.number_key, r.drawing_no, CASE WHEN status = 'new' AND w.number_key IS NULL THEN 'in_folder_not_in_list' ELSE status END AS status, w.number_key IS NOT NULL AS in_list FROM rows r LEFT JOIN wanted w USING (number_key)
  UNION ALL SELECT number_key, drawing_no, 'in_list_not_in_folder', true FROM wanted WHERE number_key NOT IN (SELECT number_key FROM known)
  UNION ALL SELECT NULL, NULL, status, NULL FROM loose)
 SELECT *, status IN ('unidentified', 'unreadable', 'same_rev_different_file', 'removed', 'in_list_not_in_folder') AS needs_attention FROM marked""",
    "register_summary": f"WITH {register('removed')} SELECT status, count(*) AS n FROM reg GROUP BY 1 UNION ALL SELECT '(attention)', count(*) FROM reg WHERE needs_attention UNION ALL SELECT '(comparable)', count(*) FROM reg WHERE status IN ('revised', 'same_rev_different_file', 'status_change')",
    "register_attention": f"WITH {register('removed')} SELECT status, count(*) AS n, min(drawing_no) AS first_no FROM reg WHERE needs_attention GROUP BY 1",
    "register_issue_question": f"WITH {SHEETS} SELECT count(*) FILTER (side = 'old') AS old_count, count(*) FILTER (side = 'new') AS new_count, count(*) FILTER (side = 'old') > 0 AND count(*) FILTER (side = 'new') < 0.6 * count(*) FILTER (side = 'old') AS looks_partial FROM sheets",
    "list_missing_from_folders": f"WITH {LATEST}, {LISTED} SELECT number_key, drawing_no FROM wanted WHERE number_key NOT IN (SELECT number_key FROM known)",
    "latest_per_number": f"WITH {LATEST} SELECT side, number_key, abs_path, revision, n_duplicates, n_superseded FROM latest",
    "dominant_scheme": f"WITH {SHEETS}, c AS (SELECT side, scheme, count(*) AS n FROM sheets s JOIN rev ON s.revision IS NOT DISTINCT FROM rev.raw WHERE scheme <> 'unknown' GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY side ORDER BY n DESC, scheme) = 1",
    "revision_parse": f"WITH {SHEETS} SELECT raw AS revision, scheme, ordinal, shown AS normalised FROM rev",
    "revision_compare": f"""WITH {SHEETS}, codes AS (SELECT k, side, min(revision) AS r FROM sheets WHERE revision IS NOT NULL GROUP BY ALL),
 p AS (SELECT k, max(r) FILTER (side = 'old') AS o, max(r) FILTER (side = 'new') AS n FROM codes GROUP BY k)
 SELECT p.o, p.n, CASE WHEN a.ordinal IS NULL OR b.ordinal IS NULL THEN 'incomparable' WHEN a.scheme <> b.scheme THEN 'status_change' WHEN b.ordinal > a.ordinal THEN 'newer' WHEN b.ordinal < a.ordinal THEN 'older' ELSE 'same' END AS relation, count(*) AS pairs
 FROM p LEFT JOIN rev a ON p.o = a.raw LEFT JOIN rev b ON p.n = b.raw GROUP BY ALL""",
    "ext_counts": r"WITH e AS (SELECT regexp_extract(url, '\.([a-z]{2,4})(?:/|$)', 1) AS extension FROM pages) SELECT extension, count(*) AS n FROM e WHERE extension <> '' GROUP BY 1",
    "sheet_size": """WITH p AS (SELECT p_partkey, least(200.0 + p_partkey * 37 % 700, 280.0 + p_partkey * 53 % 950) AS s, greatest(200.0 + p_partkey * 37 % 700, 280.0 + p_partkey * 53 % 950) AS l FROM part),
 z(i, name, a, b) AS (VALUES (0, 'A0', 841, 1189), (1, 'A1', 594, 841), (2, 'A2', 420, 594), (3, 'A3', 297, 420), (4, 'A4', 210, 297)),
 e AS (SELECT p_partkey, name, greatest(abs(s - a), abs(l - b)) AS err, i FROM p, z QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY err, i) = 1)
 SELECT p_partkey, CASE WHEN err < 25 THEN name ELSE 'Custom' END AS size_name FROM e""",
    "duplicate_groups": "SELECT md5(text) AS hash, count(*) AS n, min(source || '/' || doc_id) AS first_path FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "cache_hit_miss": "SELECT doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS hit, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1",
    "quarantine_by_reason": "WITH q AS (SELECT CASE WHEN doc_id % 41 = 3 THEN 'password' WHEN doc_id % 29 = 1 OR n_chars = 0 THEN 'empty' WHEN doc_id % 23 = 5 THEN 'damaged' END AS reason FROM documents) SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY 1",
    "multisheet_collapse": """WITH p AS (SELECT 'f' || (doc_id // 4) AS abs_path, doc_id % 4 AS page_index, CASE WHEN doc_id % 11 <> 0 THEN 'A-' || ((doc_id // 4) % 50 + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END) END AS drawing_no FROM documents),
 f AS (SELECT abs_path, count(*) = count(drawing_no) AND count(DISTINCT drawing_no) = 1 AS one, count(*) AS n, min(page_index) AS p0 FROM p GROUP BY 1)
 SELECT p.abs_path, page_index, drawing_no, CASE WHEN one THEN n ELSE 1 END AS sheets_in_drawing FROM p JOIN f USING (abs_path) WHERE NOT one OR page_index = p0""",
    "page_facts": """WITH p AS (SELECT 'f' || (doc_id // 4) AS abs_path, CASE WHEN doc_id % 5 = 0 THEN doc_id % 30 ELSE n_chars END AS c, doc_id % 3 AS i FROM documents)
 SELECT abs_path, bool_or(c >= 20) AS any_text, bool_and(c < 20 AND i > 0) AS all_scanned, count(*) AS pages FROM p GROUP BY 1""",
    "find_numbers": r"""WITH t AS (SELECT doc_id, 'SEE ' || upper(lang) || '-' || lpad(doc_id::VARCHAR, 4, '0') || ' AND A' || lpad(doc_id::VARCHAR, 3, '0') || ' AT 1:50, KLM-NOR-STR-B02-DR-S-0' || doc_id || ' REV' AS s FROM documents),
 a AS (SELECT doc_id, regexp_extract_all(s, '\b[A-Z]{2,5}(?:-[A-Z0-9]{1,6}){3,7}\b') || regexp_extract_all(s, '\b[A-Z]{1,3}-\d{2,5}[A-Z]?\b') || regexp_extract_all(s, '\b[A-Z]{1,3}\d{3,5}[A-Z]?\b') || regexp_extract_all(s, '\b\d{3,6}-[A-Z]{1,3}-\d{2,4}\b') AS l FROM t),
 u AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM a), d AS (SELECT doc_id, v, min(i) AS i FROM u WHERE length(v) BETWEEN 3 AND 60 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') GROUP BY ALL)
 SELECT documents.doc_id, coalesce(string_agg(v, '|' ORDER BY i), '') AS found FROM documents LEFT JOIN d USING (doc_id) GROUP BY 1""",
    "scale_read": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1:' || p_size WHEN 1 THEN '1:100' WHEN 2 THEN 'NTS' WHEN 3 THEN '1:50' WHEN 4 THEN 'As shown' END AS text,
 CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN 100 WHEN 3 THEN 50 END::BIGINT AS ratio, CASE p_partkey % 6 WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.6 WHEN 4 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM part""",
    "match_tier1": f"WITH {SIDES} SELECT min(o.id) AS old_id, min(n.id) AS new_id, 1.0::DOUBLE AS confidence, 1 AS tier FROM old o JOIN new n USING (number) GROUP BY number HAVING count(*) = 1",
    "match_tier2": f"WITH {SIDES}, one AS (SELECT o.id AS a, n.id AS b FROM old o JOIN new n USING (number)) SELECT min(o.id) AS old_id, min(n.id) AS new_id, 0.98::DOUBLE AS confidence, 2 AS tier FROM old o JOIN new n USING (number_key) WHERE o.id NOT IN (SELECT a FROM one) AND n.id NOT IN (SELECT b FROM one) GROUP BY number_key HAVING count(*) = 1",
    "list_fill_contains": f"""WITH {LISTED}, f AS (SELECT doc_id AS id, 'X' || upper(lang) || lpad(doc_id::VARCHAR, 5, '0') || 'REVB' AS stem FROM documents)
 SELECT id, number_key AS key FROM f JOIN wanted ON contains(stem, number_key) WHERE length(number_key) >= 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(number_key) DESC, number_key) = 1""",
    "fingerprint_similarity": f"""WITH {PRINTS}, g AS (SELECT *, min(id) OVER c AS class_id, count(*) OVER c AS copies FROM prints WHERE len(tokens) > 0 WINDOW c AS (PARTITION BY lang, m, list_sort(tokens))),
 p AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.tokens, b.tokens)) AS s, len(a.tokens) AS x, len(b.tokens) AS y, a.copies AS left_copies, b.copies AS right_copies FROM g a JOIN g b ON a.lang = b.lang AND a.m = 0 AND b.m = 1 AND a.id = a.class_id AND b.id = b.class_id)
 SELECT 'link' AS kind, left_id, right_id, round_even(s / (x + y - s), 4) AS score, left_copies, right_copies FROM p WHERE s > 0 AND round_even(s / (x + y - s), 4) >= 0.7
 UNION ALL SELECT 'member', class_id, id, NULL, NULL, NULL FROM g WHERE id <> class_id""",
    "match_ambiguity": """WITH c AS (SELECT l_orderkey % 700 AS left_id, l_partkey % 40 AS right_id, 0.5 + (sum(l_linenumber)::BIGINT * 7 % 50) / 100 AS score FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, lead(score) OVER w AS runner_up, row_number() OVER w AS r FROM c WINDOW w AS (PARTITION BY left_id ORDER BY score DESC, right_id))
 SELECT left_id, right_id, score, runner_up, coalesce(runner_up >= 0.7 AND round_even(score - runner_up, 4) <= 0.05, false) AS ambiguous FROM r WHERE r = 1""",
    "iso_number_parse": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN 'NOR' END AS originator, CASE WHEN p_partkey % 4 <> 0 THEN 'L' || (p_partkey % 9) END AS level, CASE WHEN p_partkey % 4 <> 0 THEN lpad(p_partkey::VARCHAR, 5, '0') END AS number FROM part",
    "render_template": r"""WITH n AS (SELECT p_partkey, upper(p_brand) || '-' || lpad((p_partkey % 977)::VARCHAR, 4, '0') || '_' || coalesce(CASE WHEN p_partkey % 3 <> 0 THEN lower(p_name) END, '') || '_' || CASE WHEN p_partkey % 4 <> 1 THEN 'A' ELSE '' END AS s FROM part)
 SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(s, '([-_ ])[-_ ]+', '\1', 'g'), '[<>:"/\\|?*]', '', 'g'), '^[-_ ]+|[-_ .]+$', '', 'g') AS name FROM n""",
    "undo_prefix": """WITH l AS (SELECT o_orderkey % 300 AS batch, o_orderkey AS seq, o_orderkey * 7 % 31 <> 5 AS ok FROM orders), f AS (SELECT batch, coalesce(max(seq) FILTER (NOT ok), -1) AS stop FROM l GROUP BY 1)
 SELECT batch, count(*) FILTER (seq > stop) AS undone, count(*) AS n FROM l JOIN f USING (batch) GROUP BY 1""",
    "classify_text": f"""WITH {ITEMS}, t AS (SELECT *, upper(text) AS u FROM items)
 SELECT pair_id, side, item_id,
  CASE WHEN starts_with(u, 'FFL') THEN 'level' WHEN regexp_full_match(u, 'D-?\\d+') THEN 'tag' WHEN regexp_full_match(u, '\\d+|\\d+\\.\\dM') THEN 'dimension' WHEN len(string_split(u, ' ')) > 4 THEN CASE WHEN len(list_intersect(regexp_extract_all(u, '[A-Z0-9\\-]+'), ['FIRE', 'RATED', 'HR', 'HOUR', 'WATERPROOF', 'TANKING', 'ACOUSTIC', 'MIN', 'MAX', 'THK', 'THICK', 'GRADE', 'CLASS', 'GALV', 'INSULATION', 'U-VALUE', 'DPC', 'DPM'])) > 0 THEN 'spec' ELSE 'note' END ELSE 'unknown' END AS category,
  CASE WHEN starts_with(u, 'FFL') THEN 0.95 WHEN regexp_full_match(u, 'D-?\\d+') THEN 0.92 WHEN regexp_full_match(u, '\\d+|\\d+\\.\\dM') THEN 0.7 WHEN len(string_split(u, ' ')) > 4 THEN CASE WHEN len(list_intersect(regexp_extract_all(u, '[A-Z0-9\\-]+'), ['FIRE', 'RATED', 'HR', 'HOUR', 'WATERPROOF', 'TANKING', 'ACOUSTIC', 'MIN', 'MAX', 'THK', 'THICK', 'GRADE', 'CLASS', 'GALV', 'INSULATION', 'U-VALUE', 'DPC', 'DPM'])) > 0 THEN 0.85 ELSE 0.9 END ELSE 0.3 END::DOUBLE AS confidence FROM t""",
    "dimension_delta": f"""WITH {EDITS}, v AS (SELECT *, try_cast(regexp_extract(o, '([0-9.]+)m?$', 1) AS DOUBLE) * CASE WHEN starts_with(o, 'FFL') OR ends_with(o, 'm') THEN 1000 ELSE 1 END AS x, try_cast(regexp_extract(n, '([0-9.]+)m?$', 1) AS DOUBLE) * CASE WHEN starts_with(n, 'FFL') OR ends_with(n, 'm') THEN 1000 ELSE 1 END AS y, starts_with(o, 'D-') AS tag FROM edits),
 w AS (SELECT pair_id, item_id, CASE WHEN NOT tag THEN y - x END AS dm, CASE WHEN NOT tag THEN (y - x) * 100 / x END AS pc, starts_with(o, 'FFL') AS lv FROM v)
 SELECT pair_id, item_id, round(dm, 6) AS delta_mm, round(pc, 6) AS percent, CASE WHEN dm IS NULL THEN 'unknown' WHEN dm > 0 THEN CASE WHEN lv THEN 'raised' ELSE 'increased' END WHEN dm < 0 THEN CASE WHEN lv THEN 'lowered' ELSE 'decreased' END ELSE 'unchanged' END AS direction FROM w""",
    "text_unchanged_moved": f"""WITH {ITEMS}, g AS (SELECT pair_id, text, count(*) FILTER (side = 'old') AS a, count(*) FILTER (side = 'new') AS b, max(x) FILTER (side = 'old') AS ox, max(y) FILTER (side = 'old') AS oy, max(x) FILTER (side = 'new') AS nx, max(y) FILTER (side = 'new') AS ny FROM items GROUP BY ALL),
 d AS (SELECT *, sqrt((nx - ox) ** 2 + (ny - oy) ** 2) AS dist FROM g WHERE a <= 1 AND b <= 1)
 SELECT pair_id, text, CASE WHEN a = 0 THEN 'new_only' WHEN b = 0 THEN 'old_only' WHEN dist <= 3.9 THEN 'unchanged' ELSE 'moved' END AS state, round(dist, 6) AS distance FROM d""",
    "renumbering_detect": rf"""WITH {EDITS}, p AS (SELECT pair_id, o, n, regexp_extract(o, '^([A-Z]+[-/ ]?)(\d+)$', 1) AS op, try_cast(regexp_extract(o, '^([A-Z]+[-/ ]?)(\d+)$', 2) AS INT) AS a, regexp_extract(n, '^([A-Z]+[-/ ]?)(\d+)$', 1) AS np, try_cast(regexp_extract(n, '^([A-Z]+[-/ ]?)(\d+)$', 2) AS INT) AS b FROM edits WHERE regexp_full_match(upper(n), 'D-?\d+')),
 g AS (SELECT pair_id, count(*) AS n, count(*) >= 2 AND count(a + b) = count(*) AND count(DISTINCT b - a) = 1 AND count(DISTINCT op || '|' || np) = 1 AND count(DISTINCT o) = count(DISTINCT p.n) AS renumbered, min(b - a)::BIGINT AS d FROM p GROUP BY 1)
 SELECT pair_id, n, renumbered, CASE WHEN renumbered THEN d END AS "offset" FROM g""",
    "tolerance_resolve": """WITH p AS (SELECT p_partkey, p_size * 2.0 AS site, CASE p_partkey % 5 WHEN 1 THEN 100 WHEN 2 THEN 5 WHEN 3 THEN 500 WHEN 4 THEN 50 END::DOUBLE AS den FROM part), w AS (SELECT *, coalesce(site / den, 0.5) AS want FROM p), c AS (SELECT *, greatest(least(want, 3.0), 0.2) AS paper FROM w)
 SELECT p_partkey, round(paper, 6)::DOUBLE AS paper_mm, round(paper * (200 / 25.4), 6)::DOUBLE AS px, round(paper * den, 6)::DOUBLE AS site_mm, abs(paper - want) > 1e-9 AS clamped FROM c""",
    "segment_canonical_hash": f"WITH {SEGMENTS} SELECT pair_id, side, count(*) AS n, count(DISTINCT geometry) AS shapes, min(geometry) AS least FROM seg GROUP BY ALL",
    "vector_bag_diff": f"""WITH {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, geometry ORDER BY pen, path_id) AS rn FROM seg),
 j AS (SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, CASE WHEN o.pen IS NULL THEN 'added' WHEN n.pen IS NULL THEN 'removed' WHEN o.pen = n.pen THEN 'same' ELSE 'style' END AS state FROM (FROM r WHERE side = 'old') o FULL JOIN (FROM r WHERE side = 'new') n ON o.pair_id = n.pair_id AND o.geometry = n.geometry AND o.rn = n.rn)
 SELECT pair_id, state, count(*) AS n FROM j GROUP BY ALL""",
    "vector_removed_added": f"""WITH {SEGMENTS}, c AS (SELECT pair_id, geometry, count(*) FILTER (side = 'old') - count(*) FILTER (side = 'new') AS d FROM seg GROUP BY ALL)
 SELECT pair_id, CASE WHEN d > 0 THEN 'removed' ELSE 'added' END AS state, sum(abs(d))::BIGINT AS n FROM c WHERE d <> 0 GROUP BY ALL""",
    "moves_mutual_nearest": f"""WITH {SEGMENTS}, m AS (SELECT pair_id, side, path_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, abs(x1 - x0) AS w, abs(y1 - y0) AS h FROM seg),
 p AS (SELECT o.pair_id, o.path_id AS old_id, n.path_id AS new_id, (o.cx - n.cx) ** 2 + (o.cy - n.cy) ** 2 AS d2 FROM m o JOIN m n ON o.pair_id = n.pair_id AND o.side = 'old' AND n.side = 'new' AND abs(o.len - n.len) <= 0.08 * greatest(o.len, n.len) AND abs(o.w - n.w) <= 0.1 * greatest(o.w, n.w) AND abs(o.h - n.h) <= 0.1 * greatest(o.h, n.h) WHERE (o.cx - n.cx) ** 2 + (o.cy - n.cy) ** 2 <= 3600)
 SELECT pair_id, old_id, new_id, round(sqrt(d2), 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY pair_id, old_id ORDER BY d2, new_id) = 1 AND row_number() OVER (PARTITION BY pair_id, new_id ORDER BY d2, old_id) = 1""",
    "hatch_spacing": f"""WITH {SEGMENTS}, l AS (SELECT DISTINCT pair_id, CASE WHEN x0 = x1 THEN 90 ELSE 0 END AS angle, CASE WHEN x0 = x1 THEN x0 ELSE y0 END::DOUBLE AS v FROM seg),
 g AS (SELECT pair_id, angle, v - lag(v) OVER (PARTITION BY pair_id, angle ORDER BY v) AS gap FROM l), m AS (SELECT pair_id, angle, count(gap) AS n, median(gap) AS mid FROM g WHERE gap IS NOT NULL GROUP BY ALL)
 SELECT pair_id, angle, n, any_value(mid) AS gap, median(abs(g.gap - mid)) <= 0.45 * any_value(mid) AS regular FROM g JOIN m USING (pair_id, angle) WHERE g.gap IS NOT NULL GROUP BY pair_id, angle, n""",
    "merge_streams": f"""WITH RECURSIVE {CHANGES},
 c AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY CASE stream WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, -w * h, change_id) AS n,
  {{'id': change_id, 's': stream, 'x0': x, 'y0': y, 'x1': x + w, 'y1': y + h, 'c': confidence::DOUBLE, 'cos': is_cosmetic, 'alone': category = 'large', 'many': 1::BIGINT, 'o': stream = 'O', 'f': stream = 'F'}} AS c FROM changes),
 s(pair_id, n, kept) AS (
  SELECT pair_id, 1::BIGINT, [c] FROM c WHERE n = 1
  UNION ALL
  SELECT pair_id, n, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(kept, c) ELSE list_transform(kept, lambda k, i: CASE WHEN i <> hit THEN k ELSE
    {{'id': k.id, 's': k.s, 'x0': least(k.x0, c.x0), 'y0': least(k.y0, c.y0), 'x1': greatest(k.x1, c.x1), 'y1': greatest(k.y1, c.y1), 'c': least(0.99, k.c + 0.1), 'cos': k.cos AND c.cos, 'alone': k.alone, 'many': k.many + 1, 'o': k.o OR c.o, 'f': k.f OR c.f}} END) END
  FROM (SELECT s.pair_id, c.n, c.c, kept, list_position([NOT c.c.alone AND NOT k.alone AND k.s <> c.c.s AND (least(k.x1, c.c.x1) > greatest(k.x0, c.c.x0)) AND (least(k.y1, c.c.y1) > greatest(k.y0, c.c.y0)) AND (
     (least(k.x1, c.c.x1) - greatest(k.x0, c.c.x0)) * (least(k.y1, c.c.y1) - greatest(k.y0, c.c.y0)) >= 0.8 * least((k.x1 - k.x0) * (k.y1 - k.y0), (c.c.x1 - c.c.x0) * (c.c.y1 - c.c.y0))
     OR 1.4 * (least(k.x1, c.c.x1) - greatest(k.x0, c.c.x0)) * (least(k.y1, c.c.y1) - greatest(k.y0, c.c.y0)) >= 0.4 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (c.c.x1 - c.c.x0) * (c.c.y1 - c.c.y0))) FOR k IN kept], true) AS hit
   FROM s JOIN c ON c.pair_id = s.pair_id AND c.n = s.n + 1)),
 f AS (SELECT pair_id, unnest(kept) AS k FROM s QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC) = 1)
 SELECT pair_id, k.id AS change_id, CASE WHEN k.o AND k.f THEN 'F+O' ELSE k.s END AS streams, k.many AS n, k.x0 AS x, k.y0 AS y, k.x1 - k.x0 AS w, k.y1 - k.y0 AS h, round(k.c, 6) AS confidence, k.cos AS is_cosmetic FROM f""",
    "ransac_fit": f"""WITH {POINTS}, p AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ox, oy, nx, ny) AS at1 FROM points), n AS (SELECT pair_id, count(*) AS n FROM points GROUP BY 1),
 d AS (SELECT pair_id, j, (((j * 2654435761 % 4294967296) * n) >> 32) + 1 AS pa, (((j * 2246822519 % 4294967296) * n) >> 32) + 1 AS qa FROM n, (SELECT range AS j FROM range(1, 201))),
 h AS (SELECT d.pair_id, j, p.ox, p.oy, p.nx, p.ny, q.ox - p.ox AS dx, q.oy - p.oy AS dy, q.nx - p.nx AS ux, q.ny - p.ny AS uy FROM d JOIN p ON p.pair_id = d.pair_id AND p.at1 = pa JOIN p q ON q.pair_id = d.pair_id AND q.at1 = qa),
 m AS (SELECT pair_id, j, ox, oy, nx, ny, (dx * ux + dy * uy) / (dx * dx + dy * dy) AS a, (dx * uy - dy * ux) / (dx * dx + dy * dy) AS b FROM h WHERE dx * dx + dy * dy > 0),
 t AS (SELECT pair_id, j, a, b, nx - a * ox + b * oy AS tx, ny - b * ox - a * oy AS ty FROM m),
 v AS (SELECT t.pair_id, j, count(*) AS votes FROM t JOIN points p ON p.pair_id = t.pair_id AND (a * ox - b * oy + tx - nx) ** 2 + (b * ox + a * oy + ty - ny) ** 2 <= 9 GROUP BY 1, 2),
 c AS (SELECT t.* FROM t JOIN v USING (pair_id, j) QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY votes DESC, j) = 1),
 i AS (SELECT p.* FROM points p JOIN c ON p.pair_id = c.pair_id AND (a * ox - b * oy + tx - nx) ** 2 + (b * ox + a * oy + ty - ny) ** 2 <= 9),
 f AS (SELECT pair_id, count(*) AS n, (covar_pop(ox, nx) + covar_pop(oy, ny)) / (var_pop(ox) + var_pop(oy)) AS a, (covar_pop(ox, ny) - covar_pop(oy, nx)) / (var_pop(ox) + var_pop(oy)) AS b, avg(ox) AS mx, avg(oy) AS my, avg(nx) AS ux, avg(ny) AS uy FROM i GROUP BY 1)
 SELECT pair_id, coalesce(n, 0) AS inliers, round(a, 6) AS a, round(b, 6) AS b, round(ux - a * mx + b * my, 6) AS tx, round(uy - b * mx - a * my, 6) AS ty FROM (SELECT DISTINCT pair_id FROM points) LEFT JOIN f USING (pair_id)""",
    "ink_regions": f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY pair_id, y, x) AS id FROM ({INK_DIFF})),
 e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.pair_id = b.pair_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
 r(id, root) USING KEY (id) AS (SELECT id, id FROM c UNION SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.id JOIN recurring.r k ON k.id = e.b WHERE r.root < k.root GROUP BY e.b),
 g AS (SELECT pair_id, root, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM c JOIN r USING (id) GROUP BY 1, 2 HAVING count(*) >= 2),
 s AS (SELECT g.pair_id, root, area, x0, y0, x1, y1, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'added') AS added FROM g JOIN c ON c.pair_id = g.pair_id AND c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1 GROUP BY ALL)
 SELECT pair_id, x0 AS x, y0 AS y, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, area, removed, added, CASE WHEN removed > 0.2 * added AND added > 0.2 * removed THEN 'modified' WHEN added > 0.2 * removed THEN 'added' ELSE 'removed' END AS kind FROM s""",
    "rename_collisions": """WITH RECURSIVE c AS (SELECT p_partkey AS seq, lower(p_brand) AS g, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END || CASE WHEN p_partkey % 5 = 0 THEN '_2' ELSE '' END || '.pdf' AS target, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS n FROM part),
 s(g, n, seq, final, taken) AS (SELECT g, n, seq, target, [lower(target)] FROM c WHERE n = 1
  UNION ALL SELECT g, n, seq, f, list_append(taken, lower(f)) FROM (SELECT c.g, c.n, c.seq, s.taken, [t FOR t IN list_prepend(c.target, [replace(c.target, '.pdf', '_' || i || '.pdf') FOR i IN range(2, len(s.taken) + 3)]) IF NOT list_contains(s.taken, lower(t))][1] AS f FROM s JOIN c ON c.g = s.g AND c.n = s.n + 1))
 SELECT seq, final FROM s""",
    "bbox_iou_join": f"""WITH {CHANGES}, k AS (SELECT pair_id, stream, x, y, w, h, min(change_id) AS class_id, count(*) AS n FROM changes WHERE stream IN ('O', 'F') GROUP BY ALL),
 p AS (SELECT a.class_id AS o, b.class_id AS f, a.n AS o_n, b.n AS f_n, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS s, a.w * a.h AS p, b.w * b.h AS q
  FROM k a JOIN k b ON a.pair_id = b.pair_id AND a.stream = 'O' AND b.stream = 'F' AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h),
 m AS (SELECT *, s / (p + q - s) AS iou FROM p WHERE s / (p + q - s) >= 0.4 OR s / least(p, q) >= 0.8),
 n AS (SELECT o AS class_id, sum(f_n) AS n_links, max(iou) AS best FROM m GROUP BY 1 UNION ALL SELECT f, sum(o_n), max(iou) FROM m GROUP BY 1)
 SELECT pair_id, stream, change_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, round(best, 6) AS best_iou FROM changes JOIN k USING (pair_id, stream, x, y, w, h) LEFT JOIN n USING (class_id)""",
    "ink_tolerant_diff": INK_DIFF,
    "style_collapse": f"""WITH {CHANGES}, n AS (SELECT *, count(*) FILTER (is_cosmetic) OVER (PARTITION BY pair_id, kind) AS c FROM changes)
 SELECT pair_id, kind, change_id, x, y, w, h, 1::BIGINT AS merged FROM n WHERE NOT is_cosmetic OR c < 2
 UNION ALL SELECT pair_id, kind, min(change_id), min(x), min(y), max(x + w) - min(x), max(y + h) - min(y), count(*) FROM n WHERE is_cosmetic AND c >= 2 GROUP BY pair_id, kind""",
    "filtered_by_reason": f"""WITH {CHANGES}, f AS (SELECT pair_id, 'style_collapse' AS filter_name FROM changes WHERE is_cosmetic QUALIFY count(*) OVER (PARTITION BY pair_id, kind) >= 2 UNION ALL SELECT pair_id, 'speckle' FROM changes WHERE w * h < 200)
 SELECT filter_name, count(*) AS n, count(DISTINCT pair_id) AS pairs FROM f GROUP BY 1""",
    "background_collapse": f"WITH {CHANGES} SELECT pair_id, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM changes WHERE w * h >= 3000 GROUP BY 1",
    "change_query": f"WITH {CHANGES} SELECT pair_id, change_id, category, confidence FROM changes WHERE NOT is_cosmetic AND stream = 'O' AND kind = 'N'",
    "change_stats": f"WITH {CHANGES} SELECT 'total' AS facet, 'all' AS value, count(*) AS n FROM changes UNION ALL SELECT 'kind', kind, count(*) FROM changes GROUP BY kind UNION ALL SELECT 'category', category, count(*) FROM changes GROUP BY category UNION ALL SELECT 'stream', stream, count(*) FROM changes GROUP BY stream UNION ALL SELECT 'is_cosmetic', is_cosmetic::VARCHAR, count(*) FROM changes GROUP BY is_cosmetic",
    "triage": f"WITH {CHANGES} SELECT coalesce(CASE WHEN o_custkey % 2 = 0 THEN 'confirmed' WHEN o_custkey IS NOT NULL THEN 'dismissed' END, 'open') AS user_status, count(*) AS n FROM changes LEFT JOIN orders ON change_id = o_orderkey * 10 + 1 GROUP BY 1",
    "layer_toggle": """WITH g AS (SELECT o_orderkey % 20 AS pair_id, o_orderpriority AS name, bool_or(o_orderstatus = 'O') FILTER (o_orderkey % 2 = 0) AS old_visible, bool_and(o_orderstatus = 'O') FILTER (o_orderkey % 2 <> 0) AS new_visible FROM orders GROUP BY ALL)
 SELECT *, old_visible IS DISTINCT FROM new_visible AS toggled FROM g""",
    "precision_recall": "WITH c AS (SELECT count(*) FILTER (quality = 0) AS expected, count(*) FILTER (toxic = 1) AS reported, count(*) FILTER (quality = 0 AND toxic = 1) AS hits FROM labels) SELECT *, coalesce(hits / nullif(reported, 0), 1.0) AS precision, coalesce(hits / nullif(expected, 0), 1.0) AS recall FROM c",
    "benchmark_summary": "SELECT l_returnflag AS method, count(*) AS n, round(avg(l_discount), 6) AS mean, round(quantile_cont(l_quantity, 0.95), 6) AS p95, round(avg((l_tax < 0.05)::INT), 6) AS success FROM lineitem GROUP BY 1",
    "anchor_singletons": f"WITH {ITEMS}, g AS (SELECT pair_id, text, count(*) FILTER (side = 'old') AS a, count(*) FILTER (side = 'new') AS b, max(x) FILTER (side = 'old') AS ox, max(y) FILTER (side = 'old') AS oy, max(x) FILTER (side = 'new') AS nx, max(y) FILTER (side = 'new') AS ny FROM items GROUP BY ALL) SELECT pair_id, text, ox, oy, nx, ny FROM g WHERE a = 1 AND b = 1",
    "similarity_fit_ls": f"""WITH {POINTS}, f AS (SELECT pair_id, count(*) AS n, (covar_pop(ox, nx) + covar_pop(oy, ny)) / (var_pop(ox) + var_pop(oy)) AS a, (covar_pop(ox, ny) - covar_pop(oy, nx)) / (var_pop(ox) + var_pop(oy)) AS b, avg(ox) AS mx, avg(oy) AS my, avg(nx) AS ux, avg(ny) AS uy FROM points GROUP BY 1)
 SELECT pair_id, n, round(a, 6) AS a, round(b, 6) AS b, round(ux - a * mx + b * my, 6) AS tx, round(uy - b * mx - a * my, 6) AS ty FROM f""",
    "residual_rms": f"""WITH {POINTS}, f AS (SELECT pair_id, (covar_pop(ox, nx) + covar_pop(oy, ny)) / (var_pop(ox) + var_pop(oy)) AS a, (covar_pop(ox, ny) - covar_pop(oy, nx)) / (var_pop(ox) + var_pop(oy)) AS b, avg(ox) AS mx, avg(oy) AS my, avg(nx) AS ux, avg(ny) AS uy FROM points GROUP BY 1),
 e AS (SELECT pair_id, sqrt((a * (ox - mx) - b * (oy - my) + ux - nx) ** 2 + (b * (ox - mx) + a * (oy - my) + uy - ny) ** 2) AS err FROM points JOIN f USING (pair_id))
 SELECT pair_id, round(sqrt(avg(err ** 2)), 6) AS rms, round(max(err), 6) AS worst FROM e GROUP BY 1""",
    "progress_coalesce": f"WITH {EVENTS} SELECT run_id, stage, event_id, value FROM ev WHERE terminal UNION ALL SELECT run_id, stage, event_id, value FROM (FROM ev WHERE NOT terminal QUALIFY row_number() OVER (PARTITION BY run_id, stage, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1)",
    "progress_latest": f"WITH {EVENTS} SELECT run_id, event_id, stage FROM ev QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1",
    "event_windows": f"WITH {EVENTS} SELECT date_trunc('hour', ts) AS start, stage, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1, 2",
    "event_sessions": f"""WITH {EVENTS}, g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY run_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS fresh FROM ev), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY run_id ORDER BY ts) AS s FROM g)
 SELECT run_id, min(ts) AS start, count(*) AS n FROM s GROUP BY run_id, s""",
    "change_rank_top3": f"WITH {CHANGES} SELECT pair_id, change_id, row_number() OVER (PARTITION BY pair_id ORDER BY confidence DESC, change_id) AS rank FROM changes QUALIFY rank <= 3",
    "merge_runs": """WITH RECURSIVE r AS (SELECT l_orderkey AS page, l_linenumber AS id, min(l_returnflag || l_linestatus) AS text, (l_linenumber * 5)::DOUBLE AS x, (l_linenumber % 2 * 10)::DOUBLE AS y, (9 + l_linenumber * l_orderkey % 3)::DOUBLE AS w, (2 + l_orderkey % 2)::DOUBLE AS h FROM lineitem GROUP BY l_orderkey, l_linenumber),
 o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y DESC, x, id) AS rn FROM r),
 f(page, rn, first_id, n, text, x, y, h, rgt) AS (
  SELECT page, rn, id, 1, text, x, y, h, x + w FROM o WHERE rn = 1
  UNION ALL
  SELECT o.page, o.rn, CASE WHEN j THEN first_id ELSE id END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN ftext || CASE WHEN o.x > rgt THEN ' ' ELSE '' END || o.text ELSE o.text END,
   CASE WHEN j THEN fx ELSE o.x END, CASE WHEN j THEN least(fy, o.y) ELSE o.y END, CASE WHEN j THEN greatest(fh, o.h) ELSE o.h END, CASE WHEN j THEN greatest(rgt, o.x + w) ELSE o.x + w END
  FROM (SELECT f.page AS fpage, f.rn AS frn, first_id, n, f.text AS ftext, f.x AS fx, f.y AS fy, f.h AS fh, rgt, o.*,
    least(f.h, o.h) >= 0.5 * greatest(f.h, o.h) AND abs(f.y - o.y) <= 0.3 * greatest(f.h, o.h) AND o.x - rgt BETWEEN -0.2 * greatest(f.h, o.h) AND 0.6 * greatest(f.h, o.h) AS j
   FROM f JOIN o ON o.page = f.page AND o.rn = f.rn + 1) o)
 SELECT page, first_id, n, text, x, y, rgt - x AS w, h FROM f QUALIFY row_number() OVER (PARTITION BY page, first_id ORDER BY rn DESC) = 1""",
    "watermark_text": """WITH n AS (SELECT *, median(h) OVER (PARTITION BY pair_id) AS mid, length(replace(t, ' ', '')) AS c FROM NOTES),
 s AS (SELECT *, CASE WHEN contains(t, 'DRAFT') THEN 'DRAFT' WHEN contains(t, 'FOR TENDER') THEN 'FOR TENDER' WHEN contains(t, 'COPY') THEN 'COPY' END AS phrase,
  c >= 4 AND 0.55 * c > 1.2 AND ln(w / h) BETWEEN -0.6 * ln(0.55 * c) AND 0.6 * ln(0.55 * c) AS turned FROM n),
 k AS (SELECT *, turned::INT + (h > 3 * mid)::INT + (w > 320 OR h > 224)::INT + pale::INT + (phrase IS NOT NULL)::INT AS signals FROM s)
 SELECT p_partkey, phrase, signals, round(least(0.98, 0.45 + 0.18 * signals + CASE WHEN phrase IS NULL THEN 0 ELSE 0.15 END), 6) AS confidence FROM k WHERE signals >= 2 AND (turned OR pale OR phrase IS NOT NULL)""",
    "control_stamps": """WITH n AS (SELECT *, 2 * greatest(abs((x + w / 2) / 800 - 0.5), abs((y + h / 2) / 560 - 0.5)) AS corner FROM NOTES)
 SELECT p_partkey, 'signature_block' AS stamp, 'DIGITALLY SIGNED' AS phrase, round(least(0.95, 0.7 + 0.2 * corner), 6) AS confidence FROM n WHERE contains(t, 'DIGITALLY SIGNED')
 UNION ALL SELECT p_partkey, 'control_stamp', CASE WHEN contains(t, 'REVIEWED') THEN 'REVIEWED' ELSE 'STATUS B' END, round(least(0.95, 0.6 + 0.2 * corner), 6) FROM n WHERE contains(t, 'REVIEWED') OR contains(t, 'STATUS B')""",
    "flatten_curves": """WITH RECURSIVE c AS (SELECT p_partkey AS id, (p_partkey * 37 % 97)::DOUBLE AS ax, (p_partkey * 53 % 97)::DOUBLE AS ay, (p_partkey * 37 % 97 + 40)::DOUBLE AS bx, (p_partkey * 71 % 97 + 90)::DOUBLE AS ey, (p_partkey * 41 % 97 + 120)::DOUBLE AS cx, (p_partkey * 29 % 97 + 60)::DOUBLE AS cy, (p_partkey * 23 % 97 + 160)::DOUBLE AS dx, (p_partkey * 53 % 97 + 30)::DOUBLE AS dy FROM part),
 p(id, t, n, ax, ay, bx, ey, cx, cy, dx, dy, flat) AS (
  SELECT id, 0.0::DOUBLE, 0, ax, ay, bx, ey, cx, cy, dx, dy, greatest(abs((dx - ax) * (ey - ay) - (dy - ay) * (bx - ax)), abs((dx - ax) * (cy - ay) - (dy - ay) * (cx - ax))) <= 0.79 * sqrt((dx - ax) ** 2 + (dy - ay) ** 2) FROM c
  UNION ALL
  SELECT id, t, n, ax, ay, bx, ey, cx, cy, dx, dy, n = 10 OR greatest(abs((dx - ax) * (ey - ay) - (dy - ay) * (bx - ax)), abs((dx - ax) * (cy - ay) - (dy - ay) * (cx - ax))) <= 0.79 * sqrt((dx - ax) ** 2 + (dy - ay) ** 2) FROM (
   SELECT id, t, n + 1 AS n, ax, ay, (ax + bx) / 2 AS bx, (ay + ey) / 2 AS ey, (ax + 2 * bx + cx) / 4 AS cx, (ay + 2 * ey + cy) / 4 AS cy, (ax + 3 * bx + 3 * cx + dx) / 8 AS dx, (ay + 3 * ey + 3 * cy + dy) / 8 AS dy FROM p WHERE NOT flat
   UNION ALL
   SELECT id, t + 0.5 ** (n + 1), n + 1, (ax + 3 * bx + 3 * cx + dx) / 8, (ay + 3 * ey + 3 * cy + dy) / 8, (bx + 2 * cx + dx) / 4, (ey + 2 * cy + dy) / 4, (cx + dx) / 2, (cy + dy) / 2, dx, dy FROM p WHERE NOT flat))
 SELECT id AS curve_id, t + 0.5 ** n AS t, round(dx, 6) AS x, round(dy, 6) AS y FROM p WHERE flat""",
}

ORACLES = ORACLES | {k: ORACLES[k].replace("NOTES", NOTES) for k in ("watermark_text", "control_stamps")}
