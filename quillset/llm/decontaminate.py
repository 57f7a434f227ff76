"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Items are word sequences (letter or digit runs, A-Z lower-cased). Their n-grams are seeds, however
many documents hold them. A seed in a document opens the window in which that item could lie.
Common seeds open many windows, so a window is first given the most that its words could
score; those that can't reach the limit are left, which loses nothing. The local alignment of item
and window (match 2, mismatch and gap -1) scores the others: copies with substituted, dropped or
inserted words.

Items are handed to executors in chunks of a checked size; more items mean more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillset.llm.groups import bounds
from quillset.llm.textkernel import ALNUM, U64, Poly, flat, shingles, slices, words

SEED = 3
#: Item words that one pass hands to every executor: 8 bytes each, and as much for seeds.
MAX_WORDS = 2_000_000
#: Hits that are expanded to their items at a time, and cells of a batch of windows.
MAX_HITS, MAX_CELLS = 1_000_000, 4_000_000
#: Matching words that an alignment needs, or all of a shorter item.
LEAST_MATCHES = 8


@dataclass
class Items:
    """Word hashes of items, end to end, and their seeds sorted by hash."""

    ids: np.ndarray
    first: np.ndarray
    word: np.ndarray
    seed: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray

    def table(self) -> np.ndarray:
        """A first test of hashes by their low 16 bits."""
        out = np.zeros(1 << 16, dtype=bool)
        out[(self.seed & U64(0xFFFF)).astype(np.int64)] = True
        return out


def pack(ids: list[int], texts: list[str]) -> Items:
    data, offsets = flat(pa.array(texts, pa.string()))
    doc, _, _, word = words(data, offsets, Poly(31), ALNUM)
    first = np.searchsorted(doc, np.arange(len(ids) + 1))
    item, seed = shingles(doc, word, SEED, False, len(ids))
    at = np.arange(len(seed)) - np.searchsorted(item, item)
    order = np.argsort(seed, kind="stable")
    return Items(np.array(ids, np.int64), first, word, seed[order], item[order].astype(np.int64), at[order])


def seed_hits(value: np.ndarray, seeds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in value, first place in seeds) of each hash that is a seed."""
    maybe = np.flatnonzero(table[(value & U64(0xFFFF)).astype(np.int64)])
    at = np.searchsorted(seeds, value[maybe])
    at[at == len(seeds)] = 0
    hit = seeds[at] == value[maybe]
    return maybe[hit], at[hit]


def align(item: np.ndarray, item_len: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of item (padded by 0) with its row of text (padded by 1).

    Row by row over the items; a gap in the text's direction is a running maximum, so each
    step is a few operations on whole arrays.
    """
    k, n = text.shape
    slope = np.arange(n + 1, dtype=np.int32)
    before = np.zeros((k, n + 1), np.int32)
    best = np.zeros(k, np.int32)
    for i in range(item.shape[1]):
        now = np.zeros((k, n + 1), np.int32)
        now[:, 1:] = before[:, :-1] + np.where(text == item[:, i, None], 2, -1)
        now = np.maximum(np.maximum(now, before - 1), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        best = np.maximum(best, np.where(i < item_len, now.max(axis=1), 0))
        before = now
    return best


def padded(items: Items, item: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Word hashes of each item in a row of their own, padded by 0."""
    a = np.arange(int(length.max()))
    return np.where(a < length[:, None], items.word[np.minimum(items.first[item, None] + a, len(items.word) - 1)], U64(0))


def ceilings(left: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray, values: np.ndarray, spots: np.ndarray, n: int) -> np.ndarray:
    """The most that align() can give for each row of left (see padded()) in words lo to hi of a text of ``n`` words.

    A word of the item that stands in the window can match (2), another one costs 1 if the
    alignment passes it: the best run of such a sum is never under the alignment's score.
    values are the text's distinct words and spots their rank * n + place, both sorted.
    """
    rank = np.minimum(np.searchsorted(values, left), len(values) - 1)
    at = np.searchsorted(spots, rank * n + lo[:, None])
    there = (values[rank] == left) & (spots[np.minimum(at, len(spots) - 1)] < rank * n + hi[:, None]) & (at < len(spots))
    there &= np.arange(left.shape[1]) < length[:, None]
    now = np.zeros(len(left), np.int64)
    best = now
    for i in range(left.shape[1]):
        now = np.maximum(now + np.where(there[:, i], 2, -1), 0)
        best = np.maximum(best, now)
    return best


def windows(items: Items, doc: np.ndarray, value_doc: np.ndarray, place: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text index, item index, first word, end) of the distinct windows that seed hits open, a bounded number of hits at a time."""
    # a hash may be the seed of several items
    many = np.searchsorted(items.seed, items.seed[at], side="right") - at
    part = np.cumsum(many) // MAX_HITS
    cut = bounds(part)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        m = many[a:b]
        here = np.repeat(place[a:b], m)
        seed = np.repeat(at[a:b], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
        row, item = value_doc[here], items.seed_item[seed]
        length = np.diff(items.first)[item]
        bucket = (here - np.searchsorted(value_doc, row) - items.seed_at[seed]) // length
        row, item, bucket = np.unique(np.stack([row, item, bucket], axis=1), axis=0).T
        begin, end = np.searchsorted(doc, row), np.searchsorted(doc, row, side="right")
        length = np.diff(items.first)[item]
        slack = length // 4 + 5
        yield row, item, np.maximum(begin + bucket * length - slack, begin), np.minimum(begin + (bucket + 2) * length + slack, end)


def alignments(items: Items, need: np.ndarray, doc: np.ndarray, word: np.ndarray, value_doc: np.ndarray, value: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text index, item index, best score) for all texts of a slice that hold seeds, where the score reaches the item's ``need``."""
    place, at = seed_hits(value, items.seed, table)
    found = [(np.zeros(0, np.int64),) * 3]
    if len(at):
        values, rank = np.unique(word, return_inverse=True)
        spots = np.sort(rank * len(word) + np.arange(len(word)))
    for row, item, lo, hi in windows(items, doc, value_doc, place, at):
        length = np.diff(items.first)[item]
        order = np.argsort(length, kind="stable")
        most = max(1, MAX_CELLS // int(3 * length.max() + 10))
        for i in range(0, len(order), most):
            j = order[i : i + most]
            left = padded(items, item[j], length[j])
            able = ceilings(left, length[j], lo[j], hi[j], values, spots, len(word)) >= need[item[j]]
            j, left = j[able], left[able]
            if not len(j):
                continue
            b = np.arange(int((hi - lo)[j].max()))
            right = np.where(b < (hi - lo)[j, None], word[np.minimum(lo[j, None] + b, len(word) - 1)], U64(1))
            score = align(left, length[j], right).astype(np.int64)
            good = score >= need[item[j]]
            found.append((row[j][good], item[j][good], score[good]))
    row, item, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-score, item, row))
    row, item, score = row[order], item[order], score[order]
    first = bounds(row, item)[:-1]
    return row[first], item[first], score[first]


def matcher(items: Items, least: float, spark):
    """A column function: text to its leaked items, array<struct<item_id, score>>."""
    shared = spark.sparkContext.broadcast(items)

    @F.arrow_udf("array<struct<item_id: long, score: double>>")
    def leaks(texts: pa.Array) -> pa.Array:
        known, poly = shared.value, Poly(31)
        table = known.table()
        data, offsets = flat(texts)
        size = np.diff(known.first)
        need = np.maximum(2 * least * size, 2 * np.minimum(size, LEAST_MATCHES))
        count = np.zeros(len(texts), np.int64)
        ids, scores = [], []
        for a, b in slices(offsets):
            if not len(known.seed):
                break
            doc, _, _, word = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], poly, ALNUM)
            value_doc, value = shingles(doc, word, SEED, False, b - a)
            row, item, score = alignments(known, need, doc, word, value_doc, value, table)
            count[a:b] = np.bincount(row, minlength=b - a)
            ids.append(known.ids[item])
            scores.append(score / (2 * size[item]))
        ids, scores = (np.concatenate(x) if x else np.zeros(0) for x in (ids, scores))
        pairs = pa.StructArray.from_arrays([pa.array(ids.astype(np.int64)), pa.array(scores.astype(np.float64))], ["item_id", "score"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pairs)

    return leaks


def with_leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` plus leaks: array<struct<item_id, score>> of benchmark items found in the text.

    score is the alignment's share of a full match, 0 to 1; an item counts from ``least`` on, if at
    least LEAST_MATCHES words match (all, if it has fewer). Items of under SEED words, null
    items and items without id find nothing; null and empty texts have no leaks. Rows are judged one by one,
    so repeated rows are judged alike. A column named leaks is replaced.
    """
    spark = docs.sparkSession
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = F.array().cast("array<struct<item_id: long, score: double>>")
    chunks = -(-total // (2 * max_words)) or 1
    for c in range(chunks):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c).orderBy("item_id", "text").collect()
        items = pack([r.item_id for r in rows], [r.text for r in rows])
        if not len(items.seed):
            continue
        found = F.concat(found, matcher(items, least, spark)(F.coalesce(F.col("text").cast("string"), F.lit("")))) if chunks > 1 else matcher(items, least, spark)(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("leaks", found)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, score) for every document and benchmark item that leaked into it."""
    return with_leaks(docs.select("doc_id", "text"), benchmark, **options).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.score")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    return with_leaks(docs, benchmark, **options).where(F.size("leaks") == 0).select(docs.columns)
