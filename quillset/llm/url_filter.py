"""URL filter on a sorted digest array.

Entries (host suffix + path prefix) are keyed by 64-bit xxhash and kept, sorted, in one
file that every executor memory-maps: keys, offsets and the full strings. A URL's few
candidate strings (last labels of its host x prefixes of its path, at the lengths that
entries have) are built and hashed by Spark, probed with a vectorised binary search,
and all hits are compared with the stored strings at once, so colliding keys do no harm.

The file's size is bounded. A longer list isn't handed out: the digests of the distinct
(host, path) then meet those of the list in a join, with the same confirmation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillset.llm.textkernel import flat

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEADER = 16
#: Bytes of entries, with 40 for each entry's numbers, that are handed to every executor at most.
MAX_BYTES = 64 << 20
ENTRY = "entry string, host_len int, rank int, action string"
_open: dict[str, tuple] = {}


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL string; both empty for null or where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def write_digest_array(entries: DataFrame) -> str:
    """Write entries (see ENTRY) as one file, hand it to all executors, return its name.

    Entries are ordered by key, then from the weakest to the strongest: rank (1 for rules, 0
    for listed ones), length, host length. Only a checked size may be given.
    """
    spark = entries.sparkSession
    table = entries.select(F.xxhash64("entry").alias("key"), "entry", F.char_length("entry").cast("long").alias("chars"), F.col("host_len").cast("long"), (2 * F.col("rank") + (F.col("action") == "block").cast("int")).cast("long").alias("code")).toArrow().combine_chunks()
    key, chars, host_len, code = (table[c].to_numpy() for c in ("key", "chars", "host_len", "code"))
    order = np.lexsort((host_len, chars, code // 2, key))
    data, offsets = flat(table["entry"].take(pa.array(order)))
    name = f"digests-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="quillset-")
    # executors fetch the driver's file when their first task needs it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with open(f"{folder}/{name}", "wb") as out:
        for part in (np.array([len(order), len(data)], np.int64), key[order], offsets, code[order], chars[order], host_len[order], data):
            out.write(part.tobytes())
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def open_digest_array(name: str) -> tuple:
    """(keys, offsets, codes, lengths, host lengths, bytes), memory-mapped once per worker."""
    if name not in _open:
        path = SparkFiles.get(name)
        n, size = (int(x) for x in np.fromfile(path, np.int64, 2))
        at = HEADER
        parts = []
        for length in (n, n + 1, n, n, n):
            parts.append(np.memmap(path, np.int64, "r", at, (length,)))
            at += 8 * length
        _open[name] = (*parts, np.memmap(path, np.uint8, "r", at, (size,)) if size else np.zeros(0, np.uint8))
    return _open[name]


def probe(name: str, keys: pa.Array, candidates: pa.Array) -> np.ndarray:
    """For each row: the index of its strongest entry whose string equals a candidate, or -1."""
    mapped, offsets, codes, chars, host_len, blob = open_digest_array(name)
    row = np.repeat(np.arange(len(keys)), np.diff(np.asarray(keys.offsets)))
    flat_keys = keys.flatten()
    valid = ~np.asarray(flat_keys.is_null().to_numpy(zero_copy_only=False))
    wanted = flat_keys.fill_null(0).to_numpy(zero_copy_only=False)
    data, ends = flat(candidates.flatten())
    left, right = np.searchsorted(mapped, wanted), np.searchsorted(mapped, wanted, side="right")
    many = np.where(valid, right - left, 0)
    asked = np.repeat(np.arange(len(wanted)), many)
    entry = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    size = ends[asked + 1] - ends[asked]
    alike = offsets[entry + 1] - offsets[entry] == size
    asked, entry, size = asked[alike], entry[alike], size[alike]
    # the bytes of all hits, end to end, beside those that are stored
    start = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(start, size)
    differs = data[np.repeat(ends[asked], size) + step] != blob[np.repeat(offsets[entry], size) + step]
    wrong = np.concatenate([[0], np.cumsum(differs)])
    same = wrong[start + size] == wrong[start]
    asked, entry = asked[same], entry[same]
    order = np.lexsort((host_len[entry], chars[entry], codes[entry] // 2, row[asked]))
    best = np.full(len(keys), -1)
    # of repeated places the last is stored, which is the strongest
    best[row[asked][order]] = entry[order]
    return best


def judge_column(name: str):
    """A column function: candidates and their keys to struct<rule, verdict>."""

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judge(keys: pa.Array, candidates: pa.Array) -> pa.Array:
        best = probe(name, keys, candidates)
        _, offsets, codes, _, _, blob = open_digest_array(name)
        stored = pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(blob))
        rule = best.copy()
        rule[(best >= 0) & (codes[np.maximum(best, 0)] < 2)] = -1
        verdict = pa.array(["allow", "block"]).take(pa.array(np.where(best >= 0, codes[np.maximum(best, 0)] % 2, 0)))
        return pa.StructArray.from_arrays([stored.take(pa.array(rule, mask=rule < 0)).cast(pa.string()), verdict], ["rule", "verdict"])

    return judge


def candidates_of(labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes of so many labels, each with path prefixes of so many characters; null where the path is shorter."""
    n = F.char_length("path")
    return F.flatten(F.array(*(F.array(*(F.when(n >= size, F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, size))) for size in lengths)) for k in labels)))


def listed_entries(spark: SparkSession, rules: Iterable[tuple[str, str, str]], blocked: DataFrame | None) -> DataFrame:
    entries = spark.createDataFrame([(h + p, len(h), 1, a) for a, h, p in rules], ENTRY)
    if blocked is None:
        return entries
    known = blocked.where("host is not null and path is not null").select(F.concat("host", "path").alias("entry"), F.char_length("host").alias("host_len"), F.lit(0).alias("rank"), F.lit("block").alias("action"))
    return entries.unionByName(known.distinct())


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], blocked: DataFrame | None = None, *, url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    rules: (``allow`` or ``block``, host, path). A rule fits its host and all subdomains
    if the URL's path starts with the rule's; the longest wins, of equally long ones that
    with the longer host. ``blocked`` lists further (host, path) entries, which fit alike: a URL that no
    rule fits is blocked if it is listed, else allowed; rule is null for these.

    Null URLs and those without ``://`` have an empty host and path and fit no rule;
    URLs of any length are read whole; repeated rows are judged alike and repeated entries count
    once; other columns pass through, but columns named host, path, rule or verdict are
    replaced. Empty tables give empty tables. A list of over ``max_bytes`` isn't handed to
    executors but joined, with the same result.
    """
    host, path = url_parts(F.col(f"`{url}`"))
    out = pages.withColumns({"host": host, "path": path})
    entries = listed_entries(pages.sparkSession, rules, blocked)
    dots = F.size(F.split(F.substring("entry", F.lit(1), F.col("host_len")), r"\.", -1))
    shape = entries.agg(F.sum(F.octet_length("entry") + 40).alias("bytes"), F.sort_array(F.collect_set(dots)).alias("labels"), F.sort_array(F.collect_set(F.char_length("entry") - F.col("host_len"))).alias("lengths")).first()
    if not shape.bytes:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    strings = candidates_of(shape.labels, shape.lengths)
    if shape.bytes <= max_bytes:
        judge = judge_column(write_digest_array(entries))
        keys = F.transform(strings, lambda s: F.when(s.isNotNull(), F.xxhash64(s)))
        found = out.withColumn("__found", judge(keys, strings))
        return found.withColumns({"rule": F.col("__found.rule"), "verdict": F.col("__found.verdict")}).drop("__found")
    asked = out.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(F.array_compact(strings))).alias("entry"))
    hits = asked.withColumn("digest", F.xxhash64("entry")).join(entries.withColumn("digest", F.xxhash64("entry")), ["digest", "entry"])
    strength = F.struct("rank", F.char_length("entry").alias("chars"), "host_len", "entry", "action")
    best = hits.groupBy("host", "path").agg(F.max(strength).alias("__found")).withColumnsRenamed({"host": "__host", "path": "__path"})
    met = out.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    verdict = F.coalesce(F.col("__found.action"), F.lit("allow"))
    return met.withColumns({"rule": F.when(F.col("__found.rank") == 1, F.col("__found.entry")), "verdict": verdict}).drop("__host", "__path", "__found")
