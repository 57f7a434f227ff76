"""K-d shards, hard negatives and periodic runs against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillset.llm import hard_negatives, period_runs, queries, sharding
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(words, least):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and j > i and not any(all(words[t] == words[t + r] for t in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(1_500):
        words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            if len(words) > 2:
                a, p = rng.randrange(len(words)), rng.randint(1, 9)
                for i in range(a + p, min(len(words), a + rng.randint(p, 45))):
                    words[i] = words[i - p]
        least = rng.choice([2, 3, 5, 12, 12])
        assert period_runs.runs_of(words, least) == brute_runs(words, least), (words, least)


def test_runs_of_long_sequences():
    assert period_runs.runs_of(["a"] * 50_000) == [(0, 50_000, 1)]
    assert period_runs.runs_of([i % 9_000 for i in range(30_000)]) == [(0, 30_000, 9_000)]
    fibonacci, after = [0], [0, 1]
    while len(after) < 400:
        fibonacci, after = after, after + fibonacci
    assert period_runs.runs_of(after) == brute_runs(after, 12)


def test_ordered_ends():
    rng = random.Random(2)
    values = rng.sample(range(100_000), 9_000)
    ends, known = period_runs.Ends(values[0]), [values[0]]
    for x in values[1:]:
        i = int(np.searchsorted(known, x)) if len(known) < 200 else None
        got = ends.add(x)
        if i is not None:
            assert got == (known[i - 1] if i else -1, known[i] if i < len(known) else -1)
            known.insert(i, x)
    assert list(ends) == sorted(values) and len(ends.blocks) > 3


def test_find_runs_of_odd_rows(spark):
    texts = [None, "", " \n", "one two", "x " * 14, "x\x0by\tz " * 4 + "tail", "a b a b", "é 世 " * 7, ("w%d " * 400) % tuple(range(400)) * 30, "x " * 14]
    rows = spark.createDataFrame([(i % 9, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, runs int").repartition(2)
    found = period_runs.find_runs(rows)
    assert found.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    for r in found.collect():
        words = (r.text or "").encode().split()
        want = brute_runs(words, 12) if len(words) < 5_000 else [(0, 12_000, 400)]
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words)
        lost = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in lost)
    assert period_runs.find_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        period_runs.find_runs(rows, min_length=1)


def test_op13_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.queries()["op13_period_runs"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for doc_id, text in texts.items():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words, 12) if n < 1_200 else period_runs.runs_of(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lost = {i for s, m, q in runs for i in range(s + q, s + m)}
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (top[1] and 1_000 * top[1] // top[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in lost)).hexdigest()
    assert planted > 5


def brute_negatives(rows, is_anchor):
    rows = [(i, g, [math.floor(256 * float(x)) for x in v]) for i, v, g in rows if None not in (i, v, g) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({r[0] for r in rows if is_anchor(r[0])}):
        _, label, v = min((r for r in rows if r[0] == a), key=lambda r: (str(r[1]), r[2]))
        clip = lambda s: max(min(s, 2**63 - 1), -(2**63))
        scored = [(clip(sum(x * y for x, y in zip(v, w, strict=True))), i, g) for i, g, w in rows if i != a and len(w) == len(v)]
        for p, pid, _ in sorted((r for r in scored if r[2] == label), key=lambda r: (-r[0], r[1]))[:5]:
            fit = sorted((r for r in scored if r[2] != label and 80 * p <= 100 * r[0] <= 100 * p), key=lambda r: (-r[0], r[1]))[:5]
            out += [(a, pid, k + 1, i, p, s) for k, (s, i, _) in enumerate(fit)]
    return sorted(out)


def negatives(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("x")).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 6))
    rows = [(i, (middle[i % 12] + rng.normal(size=6) * rng.choice([0.05, 0.3, 1])).tolist(), int(rng.integers(3))) for i in range(600)]
    rows += [(700 + i, rows[3][1], i % 3) for i in range(120)]  # a crowd of equal vectors: ties
    rows += [(10, [0.1] * 6, 0), (20, rows[20][1], rows[20][2])]  # repeated ids
    rows += [(900, None, 1), (910, [1.0, None], 1), (920, [float("nan")] * 6, 1), (930, [0.0] * 6, None), (None, [1.0] * 6, 1), (940, [0.0] * 6, 1), (950, [], 1), (951, [], 1), (952, [], 2), (960, [float("inf")] * 6, 2)]
    rows += [(970 + i, [1e20 + i, -1.0], i % 2) for i in range(8)] + [(980 + i, [3.0 + i, 2.0], i % 2) for i in range(11)]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert negatives(spark, rows, cell_rows=25, block=40) == want
    assert negatives(spark, rows[:40], cell_rows=10_000) == brute_negatives(rows[:40], lambda i: i % 10 == 0)


def test_hard_negatives_of_few_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(df, F.lit(True)).collect() == []
    assert negatives(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 2), (13, [0.1], 2)]) == [(10, 11, 1, 12, 65536, 58880)]


def test_op12_equals_sql(spark):
    assert compare(queries.queries()["op12_hard_negatives"](spark, SF), queries.oracle_sql()["op12_hard_negatives"], connect(SF)) == ""


def checked(got, texts, shards):
    rows = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in texts)
    known = {}
    for i, t in texts:
        known.setdefault(i, set()).add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    by = {}
    for r in rows:
        assert (r.size, r.text_crc32) in known[r.doc_id] and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return {s: sum(r.size for r in part) for s, part in by.items()}, rows


def plain_tree(points, leaves, slack):
    """doc rows (coordinates, tail, size) -> leaf, by sorting every node."""
    if leaves == 1 or not points:
        return [0] * len(points)
    spans = [max(p[0][d] for p in points) - min(p[0][d] for p in points) for d in range(len(points[0][0]))]
    d = spans.index(max(spans))
    key = [(p[0][d] << sharding.TAIL) + p[1] for p in points]
    total = sum(p[2] for p in points)
    ideal = total * (leaves // 2) / leaves
    prefix, below, cut = 0, 0, 0
    for shift in range(sharding.TAIL, -1, -sharding.DIGIT):
        bins = {}
        for k, p in zip(key, points, strict=True):
            if shift == sharding.TAIL or k >> (shift + sharding.DIGIT) == prefix:
                bins[k >> shift] = bins.get(k >> shift, 0) + p[2]
        for b in sorted(bins):
            if below + bins[b] >= ideal:
                break
            below += bins[b]
        if shift == 0 or bins[b] <= slack:
            cut = (b + (ideal - below > below + bins[b] - ideal)) << shift
            break
        prefix = b
    left = [k < cut for k in key]
    inner = iter(plain_tree([p for p, at in zip(points, left, strict=True) if at], leaves // 2, slack))
    outer = iter(plain_tree([p for p, at in zip(points, left, strict=True) if not at], leaves - leaves // 2, slack))
    return [next(inner) if at else leaves // 2 + next(outer) for at in left]


@pytest.mark.parametrize("leaves", [8, 5])
def test_shards_equal_plain_tree(spark, leaves):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dims = ["lang", "source", "n_chars"]
    points = sharding.points(docs, dims, "text", "doc_id").orderBy("doc_id").collect()
    want = plain_tree([((r.c0, r.c1, r.c2), r.tail, r["size"]) for r in points], leaves, 0.01 * sum(r["size"] for r in points) / leaves)
    bytes_, rows = checked(sharding.shard_documents(docs, shards=leaves), [(r.doc_id, r.text) for r in docs.collect()], leaves)
    assert {r.doc_id: r.shard for r in rows} == {r.doc_id: leaf for r, leaf in zip(points, want, strict=True)}
    assert max(bytes_.values()) - min(bytes_.values()) <= 2 * max(r["size"] for r in rows)


def test_shards_of_odd_rows(spark):
    texts = [None, "", "é世", "x" * 200_000, *["copy of a text"] * 400, *(f"text number {i}" for i in range(300))]
    rows = [(None if i == 5 else 7 if i in (8, 9) else i, t, None if i % 11 == 0 else "en", f"s{i % 4}", None if i % 13 == 0 else len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("size", F.lit(1)).repartition(4)
    bytes_, got = checked(sharding.shard_documents(docs, shards=4, dims=("lang", "n_chars")), [(r[0], r[1]) for r in rows], 4)
    assert set(bytes_) <= {0, 1, 2, 3} and max(bytes_.values()) >= 200_001
    small = docs.where(F.length("text") < 1_000)
    bytes_, got = checked(sharding.shard_documents(small, shards=8), [(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) < 1_000], 8)
    # 400 copies hold over half of the bytes: split over shards, which stay even
    assert len(bytes_) == 8 and max(bytes_.values()) <= 1.15 * min(bytes_.values())
    assert {r.shard for r in sharding.shard_documents(small, target_bytes=10**9).collect()} == {0}
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    assert sharding.shard_documents(docs.limit(1), shards=8).count() == 1


def test_shards_keep_equal_texts_together(spark):
    rows = [(i, f"text {i // 3} " + "word " * (i // 3 % 50), "en", f"s{i % 5}", 7) for i in range(3_000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), slack=0.02).collect()  # more than the bytes of any three copies
    shards = {}
    for r in got:
        shards.setdefault(r.doc_id // 3, set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_block_list_equals_sql(spark):
    assert compare(queries.queries()["url_block_list"](spark, SF), queries.oracle_sql()["url_block_list"], connect(SF)) == ""
