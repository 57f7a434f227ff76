"""Removal of repeated byte strings by a hash-compared suffix sort, dealt out by content.

A byte goes if a window of ``WINDOW`` bytes that covers it also starts earlier (smaller
doc_id, or the same document further left). Windows that are equal choose the same
anchor, the k-gram of the smallest hash among those inside (rightmost if tied), so they
meet under the anchor's hash wherever they stand:

1. Scan: the run of windows that choose one anchor is a row: anchor hash, two hashes of all the
   bytes the run covers, document, place. Equal runs met in one batch are compared byte for
   byte; they're known to repeat and leave as merged ranges, so only the first of each kind
   in a batch travels with its hashes. An anchor that very many documents share thereby has
   at most as many rows as there are batches, for each kind of run.
2. By anchor: a run equal to an earlier one repeats as a whole (128 bits of cover hash and the
   anchor agree). Where an anchor has different runs, the first of each kind asks for its bytes.
3. Those bytes, fetched by a join, are grouped by anchor and their windows sorted as
   suffixes: a mergesort whose comparisons find the common extension by binary search on
   prefix hashes. Neighbours that agree for a whole window are equal, which is confirmed
   on the bytes; all but the earliest repeat. Should hashes collide, that part is sorted by its
   bytes instead. Anchors with very many kinds of runs are dealt out by the windows' own hashes.
4. Repeated windows are gathered by document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillset.llm.groups import bounds, gathered, sorted_groups
from quillset.storage import materialise
from quillset.llm.textkernel import U64, Poly, flat, mix, slices

WINDOW, GRAM = 100, 28
SPAN = WINDOW - GRAM + 1
#: Kinds of runs of one anchor that a single task sorts; beyond, windows are dealt out by hash, about so many a deal.
HOT_KINDS = 2_000
LOW = U64(0xFFFFFFFF)


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (width - size)], key[width - size :]) if width > size else key


def anchored_runs(data: np.ndarray, offsets: np.ndarray, gram: Poly, cover: Poly, second: Poly) -> tuple[np.ndarray, ...]:
    """(text index, anchor hash, cover hash, second cover hash, first window, windows, anchor place) of each run; places are within the slice."""
    n = len(data)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= WINDOW)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none.astype(U64), none.astype(U64), none.astype(U64), none, none, none
    prefix = gram.prefix(data)
    gram.reserve(n + 1)
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * gram.inverses[: n - GRAM + 1])
    key = (grams & ~LOW) | (LOW - np.arange(len(grams), dtype=U64))
    place = (LOW - (sliding_min(key, SPAN) & LOW)).astype(np.int64)
    edge = np.zeros(n + 2, np.int8)
    edge[offsets[long]] = 1
    np.add.at(edge, offsets[long + 1] - WINDOW + 1, -1)
    start = np.flatnonzero(np.cumsum(edge[:n], dtype=np.int8))
    chosen = place[start]
    cut = bounds(chosen)
    lo, count, at = start[cut[:-1]], np.diff(cut), chosen[cut[:-1]]
    doc = np.searchsorted(offsets, lo, side="right") - 1
    shape = ((at - lo).astype(U64) << U64(32)) ^ count.astype(U64)
    whole, other = (mix(p.ranges(p.prefix(data), lo, lo + count - 1 + WINDOW) ^ mix(shape)) for p in (cover, second))
    return doc, grams[at], whole, other, lo, count, at


def first_of_kind(anchor: np.ndarray, cover: np.ndarray, second: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether the row is the first of its anchor and cover), by (anchor, covers, doc, lo)."""
    order = np.lexsort((lo, doc, second, cover, anchor))
    first = np.ones(len(order), dtype=bool)
    first[1:] = False
    for x in (anchor[order], cover[order], second[order]):
        first[1:] |= x[1:] != x[:-1]
    return order, first


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` bytes at a and b are equal, a bounded number of bytes at a time."""
    out = np.zeros(len(a), dtype=bool)
    total = np.concatenate([[0], np.cumsum(size)])
    for i, j in slices(total):
        step = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], size[i:j])
        differs = data[np.repeat(a[i:j], size[i:j]) + step] != data[np.repeat(b[i:j], size[i:j]) + step]
        wrong = np.concatenate([[0], np.cumsum(differs)])
        out[i:j] = wrong[total[i + 1 : j + 1] - total[i]] == wrong[total[i:j] - total[i]]
    return out


RUN_SCHEMA = "key long, cover long, second long, doc_id long, lo int, n int, off int, known boolean"


def scan(docs: DataFrame) -> DataFrame:
    """The first run of each kind in a batch, and merged ranges of windows known to repeat one of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, cover, second = Poly(41), Poly(42), Poly(45)
        names = ["key", "cover", "second", "doc_id", "lo", "n", "off", "known"]
        for batch in batches:
            data, offsets = flat(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(offsets, 1 << 24):
                got = []
                for a, b in slices(offsets[part[0] : part[1] + 1] - offsets[part[0]]):
                    a, b = a + part[0], b + part[0]
                    base = offsets[a : b + 1] - offsets[a]
                    doc, anchor, whole, other, lo, count, at = anchored_runs(data[offsets[a] : offsets[b]], base, gram, cover, second)
                    got.append((anchor, whole, other, a + doc, lo - base[doc], count, at - lo))
                anchor, whole, other, row, lo, count, off = (np.concatenate(x) for x in zip(*got, strict=True))
                order, first = first_of_kind(anchor, whole, other, ids[row], lo)
                head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
                # later runs in order of place; neighbours that repeat neighbours are one range
                later, head = order[~first], head[~first]
                by = np.lexsort((lo[later], row[later]))
                later, head = later[by], head[by]
                place = offsets[row] + lo
                merged = np.ones(len(later), dtype=bool)
                merged[1:] = (row[later[1:]] != row[later[:-1]]) | (row[head[1:]] != row[head[:-1]])
                for x in (later, head):
                    merged[1:] |= place[x[1:]] != place[x[:-1]] + count[x[:-1]]
                cut = np.flatnonzero(merged)
                n = np.add.reduceat(count[later], cut) if len(cut) else np.zeros(0, np.int64)
                start = later[cut]
                equal = same_bytes(data, place[start], place[head[cut]], n - 1 + WINDOW)
                if not equal.all():
                    # hashes that collide: these runs travel, under a hash of another family
                    odd = later[np.repeat(~equal, np.diff(np.concatenate([cut, [len(later)]])))]
                    for i in odd:
                        whole[i] = np.frombuffer(hashlib.sha256(data[place[i] : place[i] + count[i] - 1 + WINDOW].tobytes()).digest()[:8], U64)[0]
                    order, first = np.concatenate([order[first], odd]), np.ones(first.sum() + len(odd), dtype=bool)
                    start, n = start[equal], n[equal]
                mine = order[first]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[mine].view(np.int64), whole[mine].view(np.int64), other[mine].view(np.int64), ids[row[mine]], lo[mine].astype(np.int32), count[mine].astype(np.int32), off[mine].astype(np.int32), np.zeros(len(mine), bool))], names)
                # known ranges need no company: their key is spread by place
                key = mix(ids[row[start]].astype(U64) * U64(0x9E3779B97F4A7C15) + lo[start].astype(U64)).view(np.int64)
                none = np.zeros(len(start), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, none, none, ids[row[start]], lo[start].astype(np.int32), n.astype(np.int32), none.astype(np.int32), np.ones(len(start), bool))], names)

    return docs.mapInArrow(run, RUN_SCHEMA)


def meet_by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs (split null), and the first of each kind where an anchor has several (split: how many ways to deal it)."""
    for table in gathered(sorted_groups(batches, ["key"])):
        known = table.filter(table["known"])
        yield from known.select(["key", "doc_id", "lo", "n", "off"]).append_column("split", pa.nulls(known.num_rows, pa.int32())).to_batches()
        table = table.filter(pc.invert(table["known"]))
        anchor, cover, second, doc, lo, n = (table[c].to_numpy() for c in ("key", "cover", "second", "doc_id", "lo", "n"))
        order, first = first_of_kind(anchor, cover, second, doc, lo)
        cut = bounds(anchor[order])
        kinds, windows = (np.repeat(np.add.reduceat(x, cut[:-1]) if len(order) else x, np.diff(cut)) for x in (first.astype(np.int64), np.where(first, n[order], 0).astype(np.int64)))
        keep = ~first | (kinds > 1)
        deals = np.where(kinds > HOT_KINDS, -(-windows // HOT_KINDS), 1)
        split = pa.array(deals[keep].astype(np.int32), mask=~first[keep])
        yield from table.select(["key", "doc_id", "lo", "n", "off"]).take(pa.array(order[keep])).append_column("split", split).to_batches()


def repeats_here(data: np.ndarray, key: np.ndarray, h: np.ndarray, doc: np.ndarray, lo: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows (hash h, starting at ``at`` in data) equal an earlier one of their anchor, byte for byte."""
    order = np.lexsort((lo, doc, h, key))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    out = np.zeros(len(order), dtype=bool)
    span = np.arange(WINDOW)
    later = np.flatnonzero(~first)
    for i in range(0, len(later), 20_000):
        j = later[i : i + 20_000]
        out[order[j]] = (data[at[order[j], None] + span] == data[at[head[j], None] + span]).all(axis=1)
    return out


def fetch_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc_id, asks) to (key, salt, doc_id, lo, n, off, bytes); runs of split anchors become single windows.

    Of equal single windows in a batch only the first is sent with bytes; the others,
    compared with it here, are known to repeat (salt -1, spread by place).
    """
    names = ["key", "salt", "doc_id", "lo", "n", "off", "bytes"]
    poly = Poly(43)
    for batch in batches:
        data, offsets = flat(batch.column(0))
        asks = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asks.offsets)))
        flat_asks = asks.flatten()
        key, lo, n, off, split = (flat_asks.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        doc = batch.column(1).to_numpy(zero_copy_only=False)[row]
        inside = lo + n - 1 + WINDOW <= np.diff(offsets)[row]
        row, key, lo, n, off, split, doc = (x[inside] for x in (row, key, lo, n, off, split, doc))
        salt = np.zeros(len(row), np.int64)
        hot = np.flatnonzero(split > 1)
        if len(hot):
            step = np.arange(n[hot].sum()) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            many = np.repeat(hot, n[hot])
            h = np.empty(len(many), U64)
            for a, b in slices(offsets):
                here = (row[many] >= a) & (row[many] < b)
                if here.any():
                    s = lo[many[here]] + step[here] + offsets[row[many[here]]] - offsets[a]
                    h[here] = poly.ranges(poly.prefix(data[offsets[a] : offsets[b]]), s, s + WINDOW)
            cold = np.flatnonzero(split <= 1)
            own = repeats_here(data, key[many], h, doc[many], lo[many] + step, offsets[row[many]] + lo[many] + step)
            place = mix(doc[many].astype(U64) * U64(0x9E3779B97F4A7C15) + (lo[many] + step).astype(U64)).view(np.int64)
            salt = np.concatenate([salt[cold], np.where(own, -1, 1 + (h % split[many].astype(U64)).astype(np.int64))])
            key = np.concatenate([key[cold], np.where(own, place, key[many])])
            row, doc = (np.concatenate([x[cold], x[many]]) for x in (row, doc))
            off = np.concatenate([off[cold], off[many] - step])
            lo, n = np.concatenate([lo[cold], lo[many] + step]), np.concatenate([n[cold], np.ones(len(many), np.int64)])
        most = 40_000
        for i in range(0, len(row), most):
            j = slice(i, i + most)
            size = np.where(salt[j] < 0, 0, n[j] - 1 + WINDOW)
            ends = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(offsets[row[j]] + lo[j] - ends[:-1], size) + np.arange(ends[-1])
            picked = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])])
            yield pa.RecordBatch.from_arrays([pa.array(key[j]), pa.array(salt[j].astype(np.int32)), pa.array(doc[j]), pa.array(lo[j].astype(np.int32)), pa.array(n[j].astype(np.int32)), pa.array(off[j].astype(np.int32)), picked], names)


class Suffixes:
    """Comparison of suffixes of one byte array, up to WINDOW bytes, by prefix hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.poly = data, Poly(44)
        self.prefix = self.poly.prefix(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of starts a and b: a binary search on hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), WINDOW)
        for _ in range(WINDOW.bit_length()):
            mid = (low + high + 1) // 2
            same = (self.prefix[a + mid] - self.prefix[a]) * self.poly.inverses[a] == (self.prefix[b + mid] - self.prefix[b]) * self.poly.inverses[b]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the window at a sorts before that at b; equal ones don't."""
        n = self.common(a, b)
        at = np.minimum(n, WINDOW - 1)
        return (n < WINDOW) & (self.data[a + at] < self.data[b + at])

    def sort(self, start: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Stable order of the windows, each bucket cut[i]..cut[i+1] sorted on its own.

        Bottom-up mergesort, all buckets in step: the place of an element is its rank in
        its own run plus its rank in the other, found by binary search.
        """
        order, sizes, width = np.arange(len(start)), np.diff(cut), 1
        while True:
            open_ = np.flatnonzero(sizes > width)
            if not len(open_):
                return order
            lengths = sizes[open_]
            first = np.repeat(cut[:-1][open_], lengths)
            inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            end = np.repeat(lengths, lengths)
            pair = inner // (2 * width) * (2 * width)
            is_left = inner - pair < width
            other = np.where(is_left, pair + width, pair)
            low, high = np.minimum(other, end), np.minimum(other + width, end)
            base = low.copy()
            me = start[order[first + inner]]
            while len(busy := np.flatnonzero(low < high)):
                mid = (low[busy] + high[busy]) // 2
                it = start[order[first[busy] + mid]]
                # equal elements of the left run come first
                left = is_left[busy]
                x, y = np.where(left, it, me[busy]), np.where(left, me[busy], it)
                smaller = self.less(x, y)
                after = np.where(left, smaller, ~smaller)
                low[busy], high[busy] = np.where(after, mid + 1, low[busy]), np.where(after, high[busy], mid)
            rank = np.where(is_left, inner - pair, inner - pair - width)
            target = first + pair + rank + (low - base)
            moved = order.copy()
            moved[target] = order[first + inner]
            order, width = moved, width * 2


def by_bytes(data: np.ndarray, start: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """What Suffixes.sort() gives, found by comparing whole windows."""
    text = data[start[:, None] + np.arange(WINDOW)]
    return np.lexsort((*text.T[::-1], np.repeat(np.arange(len(cut) - 1), np.diff(cut))))


def equal_neighbours(data: np.ndarray, start: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the windows within their buckets, whether each but the first equals the one before)."""
    suffixes = Suffixes(data)
    order = suffixes.sort(start, cut)
    inside = np.ones(max(len(start) - 1, 0), dtype=bool)
    inside[cut[1:-1] - 1] = False
    a, b = start[order[:-1]], start[order[1:]]
    same = inside.copy()
    same[inside] = suffixes.common(a[inside], b[inside]) == WINDOW
    at = np.flatnonzero(same)
    if not same_bytes(data, a[at], b[at], np.full(len(at), WINDOW)).all():
        order = by_bytes(data, start, cut)
        a, b = start[order[:-1]], start[order[1:]]
        same = inside.copy()
        same[inside] = same_bytes(data, a[inside], b[inside], np.full(int(inside.sum()), WINDOW))
    return order, same


def sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that equal an earlier one of their anchor, as (doc_id, lo, n)."""
    for table in gathered(sorted_groups(batches, ["key", "salt"])):
        known = pc.less(table["salt"], 0)
        yield from table.filter(known).select(["doc_id", "lo", "n"]).to_batches()
        table = table.filter(pc.invert(known)).combine_chunks()
        if not table.num_rows:
            continue
        key, salt, doc, lo, n, off = (table[c].to_numpy().astype(np.int64) for c in ("key", "salt", "doc_id", "lo", "n", "off"))
        order = np.lexsort((lo, doc, salt, key))
        groups = bounds(key[order], salt[order])
        data, ends = flat(table["bytes"])
        group_bytes = np.concatenate([[0], np.cumsum((n[order] + WINDOW)[: groups[-1]])])[groups]
        for ga, gb in slices(group_bytes, 1 << 22):
            rows = order[groups[ga] : groups[gb]]
            size = ends[rows + 1] - ends[rows]
            begin = np.cumsum(size) - size
            part = data[np.repeat(ends[rows] - begin, size) + np.arange(size.sum())]
            step = np.arange(n[rows].sum()) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            row = np.repeat(np.arange(len(rows)), n[rows])
            group = np.repeat(np.arange(gb - ga), np.diff(groups[ga : gb + 1]))
            # the distance from window to anchor is the same for equal windows
            away = off[rows][row] - step
            by = np.lexsort((lo[rows][row] + step, doc[rows][row], away, group[row]))
            row, step, away = row[by], step[by], away[by]
            sorted_, same = equal_neighbours(part, begin[row] + step, bounds(group[row], away))
            # stable by place: the first of equal windows is the earliest
            repeated = np.zeros(len(row), dtype=bool)
            repeated[sorted_[1:][same]] = True
            d, s = doc[rows][row][repeated], (lo[rows][row] + step)[repeated]
            again = np.lexsort((s, d))
            d, s = d[again], s[again]
            run = bounds(d, s - np.arange(len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(d[run[:-1]]), pa.array(s[run[:-1]].astype(np.int32)), pa.array(np.diff(run).astype(np.int32))], ["doc_id", "lo", "n"])


def cut_out(data: bytes, lo: np.ndarray, n: np.ndarray) -> tuple[int, int, list[bytes]]:
    """(bytes removed, maximal removed runs, what is left) for windows lo .. lo + n - 1."""
    order = np.argsort(lo, kind="stable")
    a, b = lo[order], np.minimum((lo + n - 1 + WINDOW)[order], len(data))
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    begin, end = a[first], reach[np.concatenate([first[1:] - 1, [len(a) - 1]])]
    kept = [data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)]
    return int((end - begin).sum()), len(first), kept


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, kept (binary: the bytes left), n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty, texts under WINDOW bytes lose nothing, and matches don't cross
    documents. What is left may not be valid UTF-8, so it is binary. Rows that share
    doc_id and text are one document and are cut alike; doc_id is expected to name one
    text (of different texts under one id, ranges that repeat are cut from each). Rows
    without doc_id are neither compared nor cut. Texts of any length are read whole. Further columns,
    whatever their names, are ignored. An empty table gives an empty table.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    runs = scan(texts.where("doc_id is not null")).repartition("key").sortWithinPartitions("key")
    met = materialise(runs.mapInArrow(meet_by_anchor, "key long, doc_id long, lo int, n int, off int, split int"), "runs")
    asks = met.where("split is not null").groupBy("doc_id").agg(F.collect_list(F.struct("key", "lo", "n", "off", "split")).alias("asks"))
    asked = texts.join(asks, "doc_id").select("text", "doc_id", "asks")
    pieces = asked.mapInArrow(fetch_bytes, "key long, salt int, doc_id long, lo int, n int, off int, bytes binary").repartition("key", "salt").sortWithinPartitions("key", "salt")
    partial = pieces.mapInArrow(sort_windows, "doc_id long, lo int, n int")
    marks = met.where("split is null").select("doc_id", "lo", "n").unionAll(partial).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))

    @F.arrow_udf("struct<kept: binary, n_removed: long, n_spans: long, kept_sha256: string>")
    def cut(texts: pa.Array, marks: pa.Array) -> pa.Array:
        kept, removed, spans, digest = [], [], [], []
        for text, mark in zip(texts, marks, strict=True):
            data, r, s = text.as_py(), 0, 0
            left = [data]
            if mark.is_valid and len(mark.values):
                values = mark.values
                r, s, left = cut_out(data, values.field(0).to_numpy().astype(np.int64), values.field(1).to_numpy().astype(np.int64))
            kept.append(b"".join(left))
            removed.append(r)
            spans.append(s)
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["kept", "n_removed", "n_spans", "kept_sha256"])

    out = texts.join(marks, "doc_id", "left").withColumn("cut", cut("text", "marks"))
    return out.select("doc_id", "cut.kept", F.length("text").cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans", "cut.kept_sha256")
