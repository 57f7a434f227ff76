"""Periodic runs of words: a suffix automaton's end positions seed squares, which are extended to runs.

A run is a stretch of consecutive words with smallest period q, of at least two periods
and ``min_length`` words, that no neighbouring word extends. Its words but the first q
from the left and its words but the last q agree in at least min_length / 2 words, so it
lies where such grams of words occur again. Stretches without repeated grams are left out
by hashes of the grams, which is exact as equal grams have equal hashes; what's left is
cut into segments, each with an automaton of its own.

In a segment every state of the automaton stands for substrings that end at the same
positions. States are visited from long to short, and each one's ordered end positions
are merged into its link's, the smaller set into the larger one. Two positions that
become neighbours in a state of length L and are at most L apart end two equal substrings
that touch: a square. The state where the two ends of a run (a period apart) first meet
is at least a period long, and nothing lies between them there, so every run is seeded.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: End positions in a block of an ordered set.
BLOCK = 1_024
RUNS_SCHEMA = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class Ends:
    """An ordered set of end positions, in blocks, so that an insertion moves few of them."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Insert ``x``, which isn't in the set; its neighbours, -1 where there is none."""
        k = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else (self.blocks[k - 1][-1] if k else -1)
        after = block[i] if i < len(block) else (self.heads[k + 1] if k + 1 < len(self.heads) else -1)
        block.insert(i, x)
        self.size += 1
        if not i:
            self.heads[k] = x
        if len(block) > 2 * BLOCK:
            self.blocks.insert(k + 1, block[BLOCK:])
            self.heads.insert(k + 1, block[BLOCK])
            del block[BLOCK:]
        return before, after


def automaton(word: list[int]) -> tuple[array, array, array]:
    """(length, link, end) of the states of the suffix automaton; end is -1 for those that aren't a prefix's.

    A state's first transition is kept in two arrays and only further ones in a dictionary,
    as most states have one.
    """
    length, link, end, letter, to = (array("q", [v]) for v in (0, -1, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(word):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        letter.append(-1)
        to.append(-1)
        p = last
        found = -1
        while p >= 0:
            if letter[p] == c:
                found = to[p]
                break
            if letter[p] < 0:
                letter[p], to[p] = c, new
            else:
                others = more.setdefault(p, {})
                if c in others:
                    found = others[c]
                    break
                others[c] = new
            p = link[p]
        if found >= 0:
            if length[found] == length[p] + 1:
                link[new] = found
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[found])
                end.append(-1)
                letter.append(letter[found])
                to.append(to[found])
                if found in more:
                    more[copy] = dict(more[found])
                while p >= 0:
                    if letter[p] == c:
                        if to[p] != found:
                            break
                        to[p] = copy
                    else:
                        others = more.get(p, {})
                        if others.get(c) != found:
                            break
                        others[c] = copy
                    p = link[p]
                link[found] = link[new] = copy
        last = new
    return length, link, end


def squares(word: list[int]) -> Iterator[tuple[int, int]]:
    """(d, i): neighbouring ends i and i + d of equal substrings that are at least d words long."""
    length, link, end = automaton(word)
    ends: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    for state in np.argsort(-np.frombuffer(length, np.int64), kind="stable").tolist():
        up = link[state]
        small, ends[state] = ends[state], None
        if up <= 0:
            continue  # the empty substring seeds nothing
        large, most = ends[up], length[up]
        if large is None:
            ends[up] = small
            continue
        if large.size < small.size:
            small, large = large, small
        for x in small:
            before, after = large.add(x)
            if before >= 0 and x - before <= most:
                yield x - before, before
            if after >= 0 and after - x <= most:
                yield after - x, x
        ends[up] = large


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of ``a`` and ``b`` agree; looks on in doubling steps."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        same = a[at : min(at + step, n)] == b[at : min(at + step, n)]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + len(same), step * 2
    return n


def segments(hashes: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Stretches outside of which no gram of ``gram`` words occurs twice in one stretch."""
    open_, done = [(0, len(hashes))], []
    powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(gram)], np.uint64)
    while open_:
        s, e = open_.pop()
        n = e - s - gram + 1
        if n < 2:
            continue
        x = hashes[s:e] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
        x ^= x >> np.uint64(29)
        h = x[:n] * powers[0]
        for k in range(1, gram):
            h += x[k : k + n] * powers[k]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if not same.any():
            continue
        again = np.zeros(n, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        step = np.zeros(e - s + 1, np.int64)
        np.add.at(step, np.flatnonzero(again), 1)
        np.add.at(step, np.flatnonzero(again) + gram, -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]]).astype(np.int8)))
        parts = [(s + int(a), s + int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        if parts == [(s, e)]:
            done.append((s, e))
        else:
            open_ += parts
    return sorted(done)


def runs_of(words: list, min_length: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start, then period."""
    least: dict[tuple[int, int], int] = {}
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for s, e in segments(hashes, max((min_length + 1) // 2, 1)):
        number: dict = {}
        part = np.array([number.setdefault(w, len(number)) for w in words[s:e]], np.int64)
        known: dict[int, tuple[list[int], list[int]]] = {}
        for d, i in squares(part.tolist()):
            starts, stops = known.setdefault(d, ([], []))
            k = bisect_right(starts, i)
            if k and i < stops[k - 1]:
                continue
            left = i - reach(part[i::-1], part[i + d : (d - 1 if d else None) : -1]) + 1
            right = i + reach(part[i:], part[i + d :])
            starts.insert(k, left)
            stops.insert(k, right)
            n = right - left + d
            if n >= max(min_length, 2 * d):
                key = (s + left, n)
                least[key] = min(d, least.get(key, d))
    return sorted((start, n, d) for (start, n), d in least.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for the words that some run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step)[:n] == 0


def runs_in(text: Column, min_length: int = 12) -> Column:
    """RUNS_SCHEMA of a text column."""

    @F.arrow_udf(RUNS_SCHEMA)
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            # bytes are split at space and 0x09 to 0x0D, strings would be at more
            words = text.as_py().encode().split() if text.is_valid else []
            n, runs = len(words), runs_of(words, min_length)
            if runs:
                words = list(compress(words, kept_words(n, runs).tolist()))
            out.append((n, runs, b" ".join(words)))
        n, runs, collapsed = zip(*out, strict=True) if out else ((), (), ())
        flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
        each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(rs) for rs in runs])]).astype(np.int32))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, each), pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return find(text)


def find_runs(docs: DataFrame, *, text: str = "text", min_length: int = 12) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period, in words) and collapsed (the text without repeats of periods).

    Words are what stands between spaces and the bytes 0x09 to 0x0D; collapsed joins the
    words that are left by one space. A null, empty or blank text has no words, no runs and an
    empty collapsed text. Texts of any length are searched whole; a task holds one text's words
    and automaton at a time. Equal rows have equal runs; columns named as the three new ones are
    replaced; an empty table gives an empty table.
    """
    if min_length < 2:
        raise ValueError("a run has two words at least")
    others = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    found = docs.withColumn("_found", runs_in(F.col(text).cast("string"), min_length))
    return found.select(*others, "_found.n_words", "_found.runs", "_found.collapsed")
