"""The registered query of each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillset.llm import decontaminate, embed_dedup, hard_negatives, line_dedup, minhash_forest, mixing, period_runs, sharding, suffix_dedup, token_count, toxicity, url_filter, warc_revisit

#: (action, host, path)
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def url_block_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules with a block list drawn from the pages: the host and the start of the path of one URL in eight, by hash."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.url_parts(F.col("url"))
    listed = pages.where(F.md5(F.col("url").cast("binary")) < "2").select(host.alias("host"), F.substring(path, 1, 5).alias("path"))
    return url_filter.filter_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), temperature=0.7, epochs=1.0)
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "copy", F.round("rate", 9).alias("rate"), "mix_key")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def warc_records(pages: DataFrame) -> DataFrame:
    """A crawl log made of pages, validators being hashes of their html.

    Every page has a full response and, 20 days later, a not-modified one under another
    spelling of its URL. One page in four had a full response of other content in between, one
    in nine sends no etag but a date, and one in seven is not modified against an etag that nobody sent.
    """
    k = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    dated = F.concat(F.lit("day "), (k % 50).cast("string"))
    spelt = F.concat(F.upper(F.regexp_extract("url", "^(https?)://", 1)), F.regexp_replace(F.regexp_extract("url", "(?s)^https?(://.*)$", 1), "(#.*)?$", "#part"))

    def record(n: int, kind: str, url: Column, days: int, etag: Column) -> Column:
        etag = F.when(k % 9 != 0, etag)
        headers = F.create_map(F.lit("content-type"), F.lit("text/html" if kind == "response" else "none"), F.lit("date"), F.concat(k.cast("string"), F.lit(f"+{days}")), F.lit("etag"), F.coalesce(etag, F.lit("")))
        return F.struct((k * 4 + n).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), (k * 3600 + days * 86400).alias("fetched"), etag.alias("etag"), F.when(k % 9 == 0, dated).alias("last_modified"), headers.alias("headers"))

    first = record(0, "response", F.col("url"), 0, tag)
    between = record(1, "response", F.col("url"), 10, F.concat(F.lit('"other '), F.octet_length("url").cast("string"), F.lit('"')))
    again = record(2, "revisit", spelt, 20, F.when(k % 7 == 0, F.lit('"unknown"')).otherwise(F.concat(F.lit("W/"), tag)))
    captures = F.when(k % 4 == 0, F.array(first, between, again)).otherwise(F.array(first, again))
    return pages.select(F.explode(captures).alias("r")).select("r.*")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisit.resolve_revisits(warc_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("record_id", "canonical", "base_id", "status", F.element_at("headers", "content-type").alias("content_type"), F.element_at("headers", "date").alias("date"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, tokenizer_path(), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, percent=80)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32(doc_id) is divisible by 10, the words from a on repeat the p words there."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size("words")
    g = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10).cast("long")
    a = F.when(n > 0, g % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), 1, n - F.col("a"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    known = docs.select("doc_id", "text", F.when(chosen, words).alias("words")).withColumn("g", g).withColumn("a", a).withColumn("p", p)
    planted = F.array_join(F.concat(F.slice("words", 1, F.col("a")), tail), " ")
    return known.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")), min_length=12)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    # the longest run, then the first one, then that of the shortest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_url_filter, url_block_list, op2_mix_sources, op3_embedding_dedup, op4_decontaminate, op5_suffix_dedup, op6_warc_revisits, op7_minhash_dedup, op8_token_count, op9_line_dedup, op10_toxicity, op11_sharding, op12_hard_negatives, op13_period_runs, pipeline)
    return {f.__name__: f for f in named}


OP1 = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, host, path, action, rhost || rpath AS rule
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""

URL_BLOCK_LIST = OP1.replace("""m AS (""", """b AS (SELECT DISTINCT host AS bhost, substr(path, 1, 5) AS bpath FROM p JOIN pages USING (page_id) WHERE md5(url) < '2'),
m AS (""").replace("""SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict""", """SELECT page_id, host, path, rule, coalesce(action, CASE WHEN EXISTS (SELECT 1 FROM b WHERE (host = bhost OR ends_with(host, '.' || bhost)) AND starts_with(path, bpath)) THEN 'block' ELSE 'allow' END) AS verdict""")

OP2 = r"""
WITH RECURSIVE mass AS (SELECT source, sum(greatest(strlen(text), 1))::DOUBLE AS mass FROM documents GROUP BY source),
weighed AS (SELECT source, mass, pow(mass, 0.7) AS weight FROM mass),
total AS (SELECT sum(mass) AS all_mass, sum(weight) AS all_weight FROM weighed),
rates AS (SELECT source, weight / all_weight * 1.0 * all_mass / mass AS rate FROM weighed, total),
cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < 71),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('20240901|' || doc_id || '|1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d),
counted AS (
  SELECT doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(drawn.source) AS source, any_value(n_chars) AS n_chars, any_value(rate) AS rate, count(*) AS times
  FROM drawn JOIN cdf ON drawn.source = cdf.source AND c <= u GROUP BY doc_id),
copies AS (SELECT *, unnest(generate_series(1, times))::INTEGER AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy, round(rate, 9) AS rate, md5('20240901:order|' || doc_id || '|' || copy) AS mix_key FROM copies
"""

OP6 = r"""
WITH p AS (
  SELECT page_id AS k, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '(?s)^([a-z]+://[^/?]*)([^?]*?)/*([?].*)?$', '\1\2\3') AS bare, '"' || md5(coalesce(html, '')) || '"' AS tag, '"other ' || strlen(url) || '"' AS other
  FROM pages),
u AS (SELECT *, regexp_replace(bare, '^([a-z]+://[^/?]*)($|[?].*$)', '\1/\2') AS canonical FROM p),
r AS (
  SELECT k * 4 AS id, k, canonical, k * 3600 AS fetched, CASE WHEN k % 9 <> 0 THEN tag END AS tag, '+0' AS days FROM u
  UNION ALL
  SELECT k * 4 + 1, k, canonical, k * 3600 + 864000, CASE WHEN k % 9 <> 0 THEN other END, '+10' FROM u WHERE k % 4 = 0),
v AS (SELECT k * 4 + 2 AS id, k, canonical, k * 3600 + 1728000 AS fetched, CASE WHEN k % 9 <> 0 THEN CASE WHEN k % 7 = 0 THEN '"unknown"' ELSE tag END END AS tag FROM u),
j AS (
  SELECT v.*, r.id AS base_id, r.k AS base_k, r.tag AS base_tag, r.days,
    row_number() OVER (PARTITION BY v.id ORDER BY r.fetched DESC, r.id DESC) AS n
  FROM v JOIN r ON v.canonical = r.canonical AND (v.fetched, v.id) > (r.fetched, r.id)),
s AS (
  SELECT *, CASE WHEN tag IS NOT NULL AND base_tag IS NOT NULL THEN CASE WHEN tag = base_tag THEN 'resolved' ELSE 'stale' END
    WHEN k % 9 = 0 AND base_k % 9 = 0 THEN CASE WHEN k % 50 = base_k % 50 THEN 'resolved' ELSE 'stale' END ELSE 'unverified' END AS status
  FROM j WHERE n = 1)
SELECT id AS record_id, canonical, base_id, status,
  CASE WHEN status = 'stale' THEN 'none' ELSE 'text/html' END AS content_type, k || '+20' AS date
FROM s
"""

OP9 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS lost FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP12 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "url_block_list": URL_BLOCK_LIST, "op2_mix_sources": OP2, "op6_warc_revisits": OP6, "op9_line_dedup": OP9, "op12_hard_negatives": OP12}
