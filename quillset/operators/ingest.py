"""Files and pages: extensions, duplicates, cache, quarantine, collapse of multi-page files, scan sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a scan passes over.
SKIP_NAMES = ("thumbs.db", "desktop.ini", ".ds_store", "ehthumbs.db", "icon\r")
#: Folders below the root that a scan goes into, at most.
MAX_DEPTH = 32
SKIP_PREFIXES = ("~$", ".~")
SKIP_FOLDERS = ("_archive", "archive", "superseded", "old", "obsolete", "backup", "$recycle.bin")
NOTABLE = ("dwg", "dxf", "dwf", "rvt", "ifc", "xlsx", "xls", "csv", "docx", "doc")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing without content: path, filename, extension, size, modified, disposition."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    listed = found.withColumns({"filename": name, "extension": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))})
    skipped = F.lower("filename").isin(*SKIP_NAMES)
    for p in SKIP_PREFIXES:
        skipped = skipped | F.col("filename").startswith(p)
    depth = F.size(F.split(F.replace(F.col("path"), F.lit(root.rstrip("/")), F.lit("")), "/")) - 2
    skipped = skipped | (depth > MAX_DEPTH) | F.arrays_overlap(F.slice(F.split(F.lower("path"), "/"), 1, F.size(F.split("path", "/")) - 1), F.array(*map(F.lit, SKIP_FOLDERS)))
    return listed.withColumn("disposition", F.when(skipped, "skipped").when(F.col("extension") == "pdf", "drawing").otherwise("other"))


def read_drawing_list(spark: SparkSession, path: str, mapping: dict[str, str], separator: str = ",") -> DataFrame:
    """A delimited drawing list by an explicit column mapping (our name -> heading)."""
    raw = spark.read.option("header", "true").option("sep", separator).csv(path)
    return raw.select(*(F.col(f"`{heading}`").alias(ours) for ours, heading in mapping.items()))


def write_register(register: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The register partitioned by status, so that a status filter reads its own files only."""
    register.write.mode("overwrite").partitionBy("status").format(fmt).save(path)


def extension_counts(files: DataFrame, notable: tuple[str, ...] | None = None) -> DataFrame:
    """Files by extension; of the ``notable`` ones only, if given (NOTABLE is what a drawing folder is told about)."""
    known = files.where("extension <> ''")
    return (known.where(F.col("extension").isin(*notable)) if notable else known).groupBy("extension").agg(F.count("*").alias("n"))


EDGE_BYTES = 64 * 1024


def copies(files: DataFrame, key: str, content: str) -> DataFrame:
    """Files (key, binary content) of which there are several, with hash: first by size and both ends, then by the whole content."""
    c = F.col(content)
    size = F.octet_length(c)
    ends = F.md5(F.concat(F.substring(c, 1, EDGE_BYTES), F.when(size > EDGE_BYTES, F.substring(c, -EDGE_BYTES, EDGE_BYTES)).otherwise(F.lit(b""))))
    quick = files.where(c.isNotNull()).select(key, size.alias("size"), ends.alias("ends"), F.md5(c).alias("hash"))
    return quick.withColumn("n", F.count("*").over(Window.partitionBy("size", "ends", "hash"))).where("n > 1").select(key, "hash", "n")


def vector_usable(paths: DataFrame, least: int = 50) -> DataFrame:
    """sheet, n, usable, skip_reason: a sheet's vector stream is compared from ``least`` paths on."""
    n = paths.groupBy("sheet").agg(F.count("*").alias("n"))
    return n.withColumns({"usable": F.col("n") >= least, "skip_reason": F.when(F.col("n") < least, "too few paths")})


def scanned_pages(pages: DataFrame, images: DataFrame, text_limit: int = 20, share: float = 0.6) -> DataFrame:
    """page_id, coverage, scanned: little text, and one image (page_id, w, h) over ``share`` of the page (page_id, w, h, text_chars)."""
    largest = images.groupBy("page_id").agg(F.max(F.col("w") * F.col("h")).alias("area"))
    cover = F.coalesce(F.try_divide("area", F.col("w") * F.col("h")), F.lit(0.0))
    return pages.join(largest, "page_id", "left").select("page_id", cover.alias("coverage"), ((F.col("text_chars") < text_limit) & (cover > share)).alias("scanned"))


def cache_put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with ``rows`` (path, size, mtime, kind and more) in place of those of the same path and kind."""
    return cache.join(rows.select("path", "kind"), ["path", "kind"], "left_anti").unionByName(rows)


def cache_counts(cache: DataFrame) -> DataFrame:
    return cache.groupBy("kind").agg(F.count("*").alias("n"))


#: States of a job.
OPEN_STATES = ("queued", "running")


def job_states(log: DataFrame) -> DataFrame:
    """job_id, pair_id, state of each job's latest entry in the log (job_id, pair_id, seq, state)."""
    return log.groupBy("job_id").agg(F.max_by("pair_id", "seq").alias("pair_id"), F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def resume(pairs: DataFrame, log: DataFrame, alive: DataFrame) -> DataFrame:
    """Work to do after a restart: pair_id, state. Pairs done are left out, jobs that ran under no living worker are queued again, new pairs are queued."""
    last = job_states(log).join(alive.select("job_id", F.lit(True).alias("alive")), "job_id", "left")
    state = F.when((F.col("state") == "running") & F.col("alive").isNull(), "queued").otherwise(F.col("state"))
    known = last.groupBy("pair_id").agg(F.max_by(state, "seq").alias("state"))
    return pairs.select("pair_id").distinct().join(known, "pair_id", "left").select("pair_id", F.coalesce("state", F.lit("queued")).alias("state")).where(F.col("state").isin(*OPEN_STATES))


def duplicate_groups(files: DataFrame, content: str, path: str) -> DataFrame:
    """Paths of equal content, for contents that several files share; hash and paths in order."""
    hashed = files.where(F.col(content).isNotNull()).select(F.md5(content).alias("hash"), F.col(path).alias("path"))
    return hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def cache_lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files with hit: whether the cache has this path at this size and time."""
    known = cache.select("path", "size", "mtime", F.lit(True).alias("hit")).dropDuplicates(["path", "size", "mtime"])
    return files.join(known, ["path", "size", "mtime"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_prune(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows whose path is gone."""
    return cache.join(files.select("path"), "path", "left_anti")


def quarantine(files: DataFrame) -> DataFrame:
    """Unusable files with one reason: password before empty before damaged."""
    reason = F.when(F.col("encrypted"), "password").when(F.col("size") == 0, "empty").when(F.col("damaged"), "damaged")
    return files.withColumn("reason", reason).where("reason is not null")


def collapse_pages(pages: DataFrame) -> DataFrame:
    """Files whose pages all name the same drawing become one sheet (its first page) with sheets_in_drawing."""
    file = Window.partitionBy("abs_path")
    facts = pages.withColumns({"n": F.count("*").over(file), "named": F.count("drawing_no").over(file), "lo": F.min("drawing_no").over(file), "hi": F.max("drawing_no").over(file), "page0": F.min("page_index").over(file)})
    one = (F.col("named") == F.col("n")) & (F.col("lo") == F.col("hi"))
    return facts.where(~one | (F.col("page_index") == F.col("page0"))).select("abs_path", "page_index", "drawing_no", F.when(one, F.col("n")).otherwise(1).cast("long").alias("sheets_in_drawing"))


def page_facts(pages: DataFrame) -> DataFrame:
    """has_text from 20 characters on; scanned if there are images and no text; any and all by file."""
    own = pages.withColumns({"has_text": F.col("text_chars") >= 20}).withColumn("scanned", ~F.col("has_text") & (F.col("image_count") > 0))
    return own.groupBy("abs_path").agg(F.bool_or("has_text").alias("any_text"), F.bool_and("scanned").alias("all_scanned"), F.count("*").alias("pages"))
