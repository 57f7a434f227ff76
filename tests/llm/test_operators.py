"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillset.llm import decontaminate, embed_dedup, line_dedup, minhash_forest, mixing, queries, suffix_dedup, token_count, toxicity, url_filter, warc_revisit
from quillset.operators.graph import components

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def corpus(seed=1, n=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(n)]
    for k in range(0, n, 3):
        w = texts[rng.randrange(n)].split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        texts[k] = rng.choice(["", "  ", "\t"]) + " ".join(w).upper() if k % 2 else " ".join(w)
    return [*texts, None, "", " \n", "one", "One", "x" * 300, ("long word " * 30_000)]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(300, 200 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*links, (None, 1), (5, 5)], "src long, dst long")).collect()}
    want = roots(400, links)
    assert got == {i: want[i] for i in {x for e in links if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(spark, size):
    texts = corpus()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r for r in minhash_forest.near_duplicates(make(spark, texts), shingle=size).collect()}
    assert [got[i].component_id for i in range(len(texts))] == roots(len(texts), links)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values()) and links


def test_minhash_blocks(spark, monkeypatch):
    """Candidate groups of several blocks."""
    monkeypatch.setattr(minhash_forest, "BLOCK", 4)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(40)]
    got = minhash_forest.near_duplicates(make(spark, texts), shingle=2).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_minhash_null_and_repeated_ids(spark):
    got = minhash_forest.near_duplicates(make(spark, ["a b c d", "a b c d", "a b c d", "q"], [None, 7, 7, 9]), shingle=2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (7, 7, True), (7, 7, True), (9, 9, True)]


def brute_cut(texts):
    seen, out = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2_000, 2])
def test_suffix(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_KINDS", hot)
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdé ") for _ in range(150))
    texts = [t and t[:3000] for t in corpus(7, 40)] + [f"{i}".zfill(20) + shared + f"{i * 7}".zfill(30) for i in range(12)] + ["ab" * 400, shared[:99], shared[:100], "y" * 250]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(make(spark, texts)).collect()}
    assert got == brute_cut(enumerate(texts))


def test_suffix_sort_equals_bytes():
    rng = np.random.default_rng(2)
    data = np.tile(rng.integers(0, 3, 400).astype(np.uint8), 3)
    start = rng.permutation(len(data) - 100)[:300]
    cut = np.array([0, 1, 50, 300])
    order = suffix_dedup.Suffixes(data).sort(start, cut)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        windows = [data[start[i] : start[i] + 100].tobytes() for i in order[a:b]]
        assert windows == sorted(windows)


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = [*corpus(2, 20), "it's <|endoftext|> we'll\n\n  x\u00a0y 12３4", "\u0558 \ua7ce tail", "日本語 한국 🙂!!", "a" * 600_000, " \n" * 3000 + "z", "<|endoftext|>" * 3]
    got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_count.count_tokens(make(spark, texts), queries.tokenizer_path()).collect()}
    assert got == {i: (len(t.encode(x or "", add_special_tokens=False).ids), len((x or "").encode())) for i, x in enumerate(texts)}


def test_safe_characters_agree():
    """Both pattern engines cut alike around every character of SAFE."""
    import regex
    from tokenizers import Tokenizer

    cut, pattern = Tokenizer.from_file(queries.tokenizer_path()).pre_tokenizer, regex.compile(token_count.PATTERN)
    for a, b in token_count.SAFE:
        for c in map(chr, range(a, b + 1)):
            s = f"a{c}b1{c}2!{c}? {c} x"
            assert [x[1] for x in cut.pre_tokenize_str(s)] == [m.span() for m in pattern.finditer(s)], hex(ord(c))


def test_lines(spark):
    long, other = "  The same Long Line of words \t", "the same long line of words"
    texts = [f"{long}\na", f"b\n{other}\n{long}", f"{other}\n{other}\nc", "short\nshort", None, "", "x\n" * 5000, long]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(make(spark, texts)).collect()}
    assert [got[i].text for i in range(4)] == ["a", "b", "c", "short\nshort"] and got[7].text == long
    assert got[4].text is None and [got[i].n_lines for i in (4, 5, 6)] == [1, 1, 5001] and got[2].n_dropped == 2


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    for k in range(0, 600, 4):
        x[k + 1] = x[k] * 3 + rng.normal(size=16) * rng.uniform(0, 0.5)
    x[5] = x[404]
    rows = [(i, [float(v) for v in r], i // 4 % 2) for i, r in enumerate(x.astype(np.float32))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, rows[0][1], None), (905, [], 0), (906, [1.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embed_dedup.embedding_duplicates(df, cell_rows=60, sample=500).collect()}
    assert len(got) == 708 and all(got[i].n_links == 0 and got[i].kept for i in (*range(900, 907), None))
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T >= 0.93) & (np.arange(700)[:, None] // 4 % 2 == np.arange(700) // 4 % 2)
    np.fill_diagonal(linked, False)
    assert all(got[i].n_links <= linked[i].sum() for i in range(700))
    assert sum(got[i].n_links for i in range(700)) >= 0.9 * linked.sum() > 50


def test_decontaminate(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    items = [[word() for _ in range(rng.randint(20, 40))] for _ in range(12)]
    clean = [" ".join(word() for _ in range(rng.randint(5, 300))) for _ in range(60)]
    edited = [[w if k % 7 else word() for k, w in enumerate(it)] for it in items]
    docs = clean + [f"{clean[i]} {' '.join(it).upper()}, {clean[i + 1]}" for i, it in enumerate(edited)] + [None, "", "the the"] + [" ".join(items[0])] * 5
    bench = spark.createDataFrame([(i, " ".join(it)) for i, it in enumerate(items)] + [(90, None), (91, ""), (92, "two words"), (None, clean[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(make(spark, docs), bench).collect()}
    assert set(got) == {(60 + i, i) for i in range(12)} | {(75 + i, 0) for i in range(5)}
    assert all(got[75 + i, 0] == 1.0 for i in range(5))
    assert decontaminate.decontaminate(make(spark, docs), bench).count() == 63
    assert decontaminate.decontaminate(make(spark, docs), bench.limit(0)).count() == len(docs)
    chunked = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(make(spark, docs), bench, max_words=200).collect()}
    assert chunked == got


def test_decontaminate_keeps_seeds_of_repeated_partial_copies(spark):
    """An edited copy and a bit over half of an item, each in many documents: no seed may be given up for its count."""
    docs, expected = [], set()
    items = {}
    for i, copies in enumerate((4, 50, 1000)):
        for part in range(2):
            item = [f"w{i}x{part}x{k}" for k in range(24)]
            items[2 * i + part] = " ".join(item)
            text = " ".join(item[:13] if part else [w if k not in (8, 16) else f"other{k}" for k, w in enumerate(item)])
            expected |= {(len(docs) + c, 2 * i + part) for c in range(copies)}
            docs += [f"before {text} after"] * copies
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(make(spark, docs), bench).collect()} == expected


def test_decontaminate_ceilings_are_never_under_the_alignment():
    rng = np.random.default_rng(4)
    for _ in range(200):
        m, n = rng.integers(1, 9), rng.integers(1, 15)
        item, text = rng.integers(2, 9, m).astype(np.uint64), rng.integers(2, 9, n).astype(np.uint64)
        lo, hi = np.sort(rng.integers(0, n + 1, 2))
        values, rank = np.unique(text, return_inverse=True)
        most = decontaminate.ceilings(item[None], np.array([m]), np.array([lo]), np.array([hi]), values, np.sort(rank * n + np.arange(n)), n)[0]
        assert most >= (decontaminate.align(item[None], np.array([m]), text[None, lo:hi])[0] if hi > lo else 0)
        assert most == 0 or np.isin(item, text[lo:hi]).any()


def test_align_equals_plain_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(2, 6, rng.integers(1, 9)).astype(np.uint64), rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a[None], np.array([len(a)]), b[None])[0] == h.max()


def test_mixing(spark):
    docs = make(spark, [f"t{i}" * (1 + i % 7) for i in range(3000)] + [None, ""]).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise("small"))
    out = mixing.mix_sources(docs, {"big": 3, "small": 1}).cache()
    mass = {r.source: r.m for r in out.groupBy("source").agg(F.sum(F.octet_length("text")).alias("m")).collect()}
    assert mass["big"] / sum(mass.values()) == pytest.approx(0.75, abs=0.03)
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert sorted(out.select("mix_key").toPandas().mix_key) == sorted(mixing.mix_sources(docs.repartition(7), {"big": 3, "small": 1}).toPandas().mix_key)
    heavy = mixing.mix_sources(docs.limit(20), epochs=200.0)
    assert heavy.count() == pytest.approx(4000, rel=0.2)
    assert mixing.mix_sources(docs, {"none": 1.0}).count() == 0 and mixing.mix_sources(docs.limit(0)).count() == 0


def pair_texts(rule, n=1600):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(50)]
    texts, labels = [], []
    for _ in range(n):
        w = rng.sample(plain, 12)
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["dreadful"] * insult + ["martians"] * group
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(rule(insult, group)))
    return texts, labels


@pytest.mark.parametrize("rule", [lambda a, b: a and b, lambda a, b: a != b])
def test_toxicity_learns_pairs(spark, rule):
    """Two terms together: as a conjunction, and as exclusive or, where neither says anything alone and no linear model does better than chance."""
    texts, labels = pair_texts(rule)
    lab = spark.createDataFrame([(i, x) for i, x in enumerate(labels)] + [(None, 1), (5000, 2)], "doc_id long, toxic int")
    got = toxicity.toxicity(make(spark, [*texts, None, "", "x " * 200_000]), lab).collect()
    held = [r for r in got if r.held_out and r.doc_id < len(labels)]
    assert len(held) > 400 and sum((r.score >= 0.5) == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    alone = toxicity.toxicity(make(spark, ["a", None]), lab.limit(0)).collect()
    assert len(alone) == 2 and all(r.predicted == 0 for r in alone)


def test_machine_equals_plain_sums():
    """The machine's sums against a loop over pairs, and its scores' slope against differences."""
    rng = np.random.default_rng(8)
    m = toxicity.Machine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    rows = [np.sort(rng.choice(9, k, replace=False)) for k in (0, 1, 4, 9)]
    got = m.raw(np.repeat(np.arange(4), [len(r) for r in rows]), np.concatenate(rows), 4)
    for r, x in zip(rows, got, strict=True):
        assert x == pytest.approx(0.3 + m.weight[r].sum() + sum(m.factor[i] @ m.factor[j] for i, j in itertools.combinations(r, 2)))


def test_toxicity_scores_equal_a_plain_machine(spark):
    """The operator's scores are those of the fitted machine, worked out word by word."""
    from quillset.llm.textkernel import Poly

    texts, labels = pair_texts(lambda a, b: a and b, 400)
    docs, lab = make(spark, [*texts, "", None]), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    machine = toxicity.train(docs, lab.where(~held))
    place = {int(b): k for k, b in enumerate(machine.buckets)}

    def bucket(word):
        import pyarrow as pa

        return next(toxicity.term_rows(pa.array([word]), Poly(23)))[3]

    known = {w: [place[int(b)] for b in bucket(w) if int(b) in place] for t in texts for w in t.split()}
    for r in toxicity.toxicity(docs, lab).collect():
        terms = sorted({k for w in (r.text or "").split() for k in known[w]})
        raw = machine.bias + sum(machine.weight[k] for k in terms) + sum(machine.factor[i] @ machine.factor[j] for i, j in itertools.combinations(terms, 2))
        assert r.score == pytest.approx(1 / (1 + np.exp(-raw)))


def test_urls(spark):
    urls = ["http://A.Example.org/es/x?y", "https://example.org/en/12", "http://notexample.org/en/1", "ftp://com/de/", "x.com/de/", None, "http://org", "http://b.com/fr/é#z", "http://org/" + "p" * 100_000, "http://a.org:80/x", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [(r.host[:20], r.path[:8], r.rule, r.verdict) for r in url_filter.filter_urls(df, queries.URL_RULES).orderBy("page_id").collect()]
    assert got[:8] == [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/en/1", "org/", "allow"), ("com", "/de/", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "", None, "allow"), ("b.com", "/fr/é", "com/fr/", "allow")]
    assert got[8][2] == "org/" and got[9] == ("a.org:80", "/x", None, "allow") and got[10][:2] == ("b:", "//c/d")
    listed = spark.createDataFrame([("b.com", "/"), ("org", "/x"), (None, "/")], "host string, path string")
    assert [r.verdict for r in url_filter.filter_urls(df, (), listed).orderBy("page_id").collect()][7] == "block"


def test_url_collisions_are_confirmed(spark):
    """Keys that collide don't match: here the stored string of the only key is another one."""
    name = url_filter.write_digest_array(url_filter.listed_entries(spark, [("block", "bad.com", "/")], None))
    keys = url_filter.open_digest_array(name)[0]
    import pyarrow as pa

    for text, found in (("evil.com/", -1), ("evl.com/", -1), ("bad.com/", 0)):
        assert url_filter.probe(name, pa.array([[int(keys[0])]], pa.list_(pa.int64())), pa.array([[text]]))[0] == found


def test_urls_of_a_long_list(spark):
    """150,000 entries: mapped and joined alike, and as a plain search says."""
    n = 150_000
    listed = spark.range(n).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("host"), F.when(F.col("id") % 3 == 0, "/").otherwise(F.concat(F.lit("/p"), F.col("id") % 7)).alias("path"))
    urls = [f"http://{'www.' * (k % 2)}h{k * 37}.COM/p{k % 9}/x" for k in range(9000)] + [None, "", "http://h3.com", "http://org/" + "p" * 50_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumns({"rule": F.lit(1), "verdict": F.lit(2), "entry": F.lit(3)})
    rules = [("allow", "h37.com", "/p1"), ("block", "com", "/p8/")]
    mapped, joined = (sorted((r.page_id, r.rule or "", r.verdict, r.entry) for r in url_filter.filter_urls(pages, rules, listed, max_bytes=m).collect()) for m in (1 << 26, 1000))

    def plain(k):
        h, p = k * 37, f"/p{k % 9}/x"
        if h == 37:
            return "h37.com/p1", "allow"
        if p.startswith("/p8/"):
            return "com/p8/", "block"
        return "", "block" if h < n and (h % 3 == 0 or p.startswith(f"/p{h % 7}")) else "allow"

    assert mapped == joined and len(mapped) == len(urls) + 1
    assert {i: (r, v) for i, r, v, _ in mapped if i < 9000} == {k: plain(k) for k in range(9000)}
    assert [v for i, _, v, _ in mapped if i >= 9000] == ["allow"] * 4
    assert url_filter.filter_urls(pages.limit(0), rules, listed).count() == 0 and url_filter.filter_urls(pages, (), listed.limit(0)).where("verdict = 'allow'").count() == len(urls) + 1


def test_warc(spark):
    h = {"content-type": "t", "date": "1"}
    rows = [(1, "response", "http://A.com:80/x/", 10, '"1"', None, h), (2, "revisit", "http://a.com/x#f", 20, 'W/"1"', None, {"date": "2", "content-type": "no"}), (3, "response", "http://a.com/x", 10_000_000, '"2"', None, h), (4, "revisit", "http://a.com/x", 20_000_000, '"1"', None, None), (5, "revisit", "http://a.com/x", 5, '"1"', None, None), (6, "revisit", None, 9, None, None, None), (7, "revisit", "http://a.com/x", 20_000_001, None, None, {}), (8, "revisit", "http://a.com/x", None, None, None, None), (9, "other", "http://a.com/x", 1, None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, fetched long, etag string, last_modified string, headers map<string,string>")
    got = {r.record_id: (r.base_id, r.status) for r in warc_revisit.resolve_revisits(df).collect()}
    assert got == {2: (1, "resolved"), 4: (3, "stale"), 5: (None, "orphan"), 6: (None, "orphan"), 7: (3, "unverified"), 8: (None, "orphan")}
    merged = next(r for r in warc_revisit.resolve_revisits(df).collect() if r.record_id == 2).headers
    assert merged == {"content-type": "t", "date": "2"}


def test_empty_tables(spark):
    docs = make(spark, [])
    empty = [minhash_forest.near_duplicates(docs), suffix_dedup.remove_repeats(docs), line_dedup.drop_repeated_lines(docs), token_count.count_tokens(docs, queries.tokenizer_path()), embed_dedup.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))]
    assert [df.count() for df in empty] == [0] * 5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    from tests.oracle import compare, connect

    sf = "/root/testdata/sf0.001"
    assert compare(queries.queries()[name](spark, sf), queries.oracle_sql()[name], connect(sf)) == ""


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.toArrow())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} <= {r.doc_id for r in docs.collect()}


def plain_lines(docs):
    strip = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    holders: dict = {}
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            holders.setdefault(strip(line), set()).add(i)
    lost = lambda i, line: len(k := strip(line)) >= 20 and len(holders[k]) >= 3 and i != max(holders[k])
    return {i: t if t is None else "\n".join(line for line in t.split("\n") if not lost(i, line)) for i, t in docs.items()}


def plain_near(docs, size, percent):
    ids = sorted(docs)
    sets = []
    for i in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", (docs[i] or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {ids[k] for k, r in enumerate(roots(len(ids), links)) if r == k}


def plain_leaks(docs, items):
    """Documents in which an item aligns over the whole text, without any seeds."""
    split = lambda t: [abs(hash(w)) + 2 for w in re.findall(r"[^\W_]+", (t or "").translate(LOWER))]
    out = set()
    for i, t in docs.items():
        text = np.array([split(t)], np.uint64)
        for item in items:
            a = np.array([split(item)], np.uint64)
            n = a.shape[1]
            if n >= decontaminate.SEED and text.shape[1] and decontaminate.align(a, np.array([n]), text)[0] >= max(n, 2 * min(n, decontaminate.LEAST_MATCHES)):
                out.add(i)
                break
    return out


def plain_mix(docs, source):
    mass: dict = {}
    for i, t in docs.items():
        mass[source[i]] = mass.get(source[i], 0) + max(len((t or "").encode()), 1)
    total, weight = sum(mass.values()), sum(m**0.7 for m in mass.values())
    out = []
    for i, t in docs.items():
        rate = mass[source[i]] ** 0.7 / weight * total / mass[source[i]]
        assert rate <= mixing.MAX_PIECE
        u = int(hashlib.md5(f"20240901|{i}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, np.exp(-rate)
        c = p
        while c <= u:
            k, p = k + 1, p * rate / (k + 1)
            c += p
        out += [(i, t, copy) for copy in range(1, k + 1)]
    return out


def test_pipeline_equals_brute_force(spark):
    """run() against plain loops; only the learned verdict on toxicity is taken from the model."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r.doc_id: r.source for r in table.collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(table, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    docs = plain_lines({r.doc_id: r.text for r in table.collect() if r.doc_id not in toxic})
    kept = plain_near(docs, 5, 80)
    docs = {i: t for i, t in docs.items() if i in kept}
    leaked = plain_leaks(docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    expected = plain_mix({i: t for i, t in docs.items() if i not in leaked}, source)
    assert sorted((r.doc_id, r.text, r["copy"]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(expected)
    assert leaked and len(kept) < len(source) - len(toxic)
