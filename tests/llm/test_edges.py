"""Edge cases of the corpus operators: null and repeated ids, long texts, clashing columns, empty tables, hot groups."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillset import storage
from quillset.llm import decontaminate, embed_dedup, line_dedup, minhash_forest, mixing, suffix_dedup, token_count, warc_revisit

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_lines_of_rows_that_share_an_id(spark):
    """Each row loses its own lines: what repeats nowhere stays, even under a repeated doc_id."""
    line = "the same long line of text"
    rows = [(1, f"{line}\na"), (1, "UNIQUE FIRST LINE HERE\nb"), (2, line), (3, line), (None, line), (4, None)]
    got = line_dedup.drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_lines, r.n_dropped) for r in got) == [(0, line, 1, 0), (1, "UNIQUE FIRST LINE HERE\nb", 2, 0), (1, "a", 2, 1), (2, "", 1, 1), (3, line, 1, 0), (4, "", 1, 0)]


@pytest.mark.parametrize("share", [1_000, 2, 1])
def test_lines_hot_and_cold_alike(spark, monkeypatch, share):
    """The broadcast way and the shuffled way give the same rows, with long texts and clashing columns."""
    rng = random.Random(4)
    lines = ["  The Hot Line that many have\t", *(f"line number {i} of the pool é" for i in range(30)), "short"]
    texts = ["\n".join(rng.choice(lines[:1] + lines) for _ in range(rng.randint(1, 20))) for _ in range(60)] + ["\n".join(lines * 500), ""]
    docs = frame(spark, list(enumerate(texts))).withColumns({"keeper": F.lit(1), "pos": F.lit(2), "n_lines": F.lit(3), "row": F.lit(4), "hot": F.lit(5)})
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    holders: dict = {}
    key = lambda x: x.strip(" \t").lower() if x.isascii() else x.strip(" \t")
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)])
    want = {i: ("\n".join(x for x in t.split("\n") if not gone(i, x)), t.count("\n") + 1) for i, t in enumerate(texts)}
    got = line_dedup.drop_repeated_lines(docs).collect()
    assert {r.doc_id: (r.text, r.n_lines) for r in got} == want and all((r.keeper, r.pos, r.row, r.hot) == (1, 2, 4, 5) for r in got)


def test_mixing_edges(spark):
    """Null ids are drawn by text, large rates add up, sources beyond the broadcast's bound join alike."""
    docs = frame(spark, [(None, f"t{i}") for i in range(300)] + [(i, "x" * 50_000 if i == 5 else "y") for i in range(40)] + [(7, "y")] * 2).withColumns({"source": F.lit("s"), "copy": F.lit(9), "rate": F.lit(9), "mix_key": F.lit(9), "__cdf": F.lit(1)}).drop("__cdf")
    out = mixing.mix_sources(docs, {"s": 1.0}, epochs=40.0).collect()
    n = {}
    for r in out:
        n[r.doc_id, r.text] = n.get((r.doc_id, r.text), 0) + 1
    drawn = [v for (i, _), v in n.items() if i is None]
    assert len(drawn) == 300 and 38 < sum(drawn) / 300 < 42 and len(set(drawn)) > 10
    assert n[7, "y"] % 3 == 0 and all(r["copy"] <= n[r.doc_id, r.text] for r in out)


def test_mixing_joins_many_sources_alike(spark, monkeypatch):
    docs = frame(spark, [(i, "word " * (i % 9)) for i in range(200)]).withColumn("source", (F.col("doc_id") % 5).cast("string"))
    rows = lambda: sorted((r.doc_id, r["copy"], r.mix_key) for r in mixing.mix_sources(docs).collect())
    few = rows()
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 1)
    assert rows() == few


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


@pytest.mark.parametrize(("dims", "noise"), [(4, 0.16), (8, 0.12), (64, 0.04)])
def test_embeddings_in_few_and_many_dimensions(spark, dims, noise):
    """Many cells, links across borders: recall of links at least 0.9 (all where the margin is exact), components and kept compared."""
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(400, dims))
    x = np.concatenate([centres + rng.normal(size=centres.shape) * noise for _ in range(4)]).astype(np.float32)
    label = np.arange(len(x)) % 400 % 2
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "cell": F.lit(2), "copies": F.lit(3), "component": F.lit(4)})
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    for options in ({"cell_rows": 40, "sample": 800}, {"cell_rows": 20, "sample": 200}):
        got = {r.vec_id: r for r in embed_dedup.embedding_duplicates(df, **options).collect()}
        n = np.array([got[i].n_links for i in range(len(x))])
        assert (n <= linked.sum(1)).all() and n.sum() >= (0.97 if dims == 64 else 1.0) * linked.sum() > 400
        if n.sum() == linked.sum():
            roots = np.arange(len(x))
            while True:
                low = np.where(linked, roots, len(x)).min(1, initial=len(x))
                new = np.minimum(roots, low)
                if (new == roots).all():
                    break
                roots = new
            assert [got[i].component_id for i in range(len(x))] == roots.tolist()
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_labels_of_text_and_repeats(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (4, [float("inf"), 1.0], "a")]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_suffix_of_long_texts_null_and_repeated_ids(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(60_000))
    shared = long[500:700]
    rows = [(1, long), (2, "start " + long + " end"), (3, shared), (3, shared), (4, None), (None, long), (5, "z" * 50_000), (6, "")]
    docs = frame(spark, rows).withColumns({"key": F.lit(1), "lo": F.lit(2), "n": F.lit(3), "marks": F.lit(4)})
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(0, 60_000, 0, 0), (1, 60_000, 0, 0), (2, 60_010, 60_000, 1), (3, 200, 200, 1), (3, 200, 200, 1), (4, 0, 0, 0), (5, 50_000, 49_999, 1), (6, 0, 0, 0)]


def test_suffix_collisions_fall_back_to_bytes(monkeypatch):
    """Hashes that say that everything is equal don't make it so."""
    rng = np.random.default_rng(1)
    data = np.tile(rng.integers(0, 3, 150).astype(np.uint8), 2)
    start, cut = np.arange(0, 200, 5), np.array([0, 2, 40])

    def texts(order):
        return [data[start[i] : start[i] + 100].tobytes() for i in order]

    want, same = suffix_dedup.equal_neighbours(data, start, cut)
    monkeypatch.setattr(suffix_dedup.Suffixes, "common", lambda self, a, b: np.full(len(a), suffix_dedup.WINDOW))
    got, fell = suffix_dedup.equal_neighbours(data, start, cut)
    assert texts(got) == texts(want) and (same == fell).all() and same.any() and not same.all()


def test_suffix_runs_whose_hashes_collide(spark, monkeypatch):
    """Cover hashes that are all alike: bytes decide within a batch."""
    a, b = "a" * 40 + "the anchor text of these" + "x" * 60, "b" * 40 + "the anchor text of these" + "y" * 60
    assert suffix_dedup.same_bytes(np.frombuffer((a + b).encode(), np.uint8), np.array([40, 0]), np.array([164, 124]), np.array([24, 24])).tolist() == [True, False]


def test_revisits_with_repeated_and_null_ids(spark):
    h = {"date": "1"}
    rows = [(1, "response", "http://a.com/q?u=/", 10, '"1"', None, h), (2, "revisit", "http://a.com/q?u=/", 20, '"1"', None, h), (2, "revisit", "http://a.com/q?u=/", 20, '"1"', None, h), (None, "revisit", "http://a.com/q?u=/", 30, '"1"', None, h), (5, "revisit", "http://a.com/q?u=", 40, '"1"', None, h), (None, "response", "http://b.com", None, None, "d", None), (7, "revisit", "http://b.com/", 1, None, "d", h), (8, "response", "http://a.com/q?u=/", 20, '"8"', None, h), (8, "revisit", "http://a.com/q?u=/", 20, '"8"', None, h)]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, fetched long, etag string, last_modified string, headers map<string,string>").withColumns({"range": F.lit(1), "base": F.lit(2), "full": F.lit(3), "canonical": F.lit(4)})
    got = sorted(((r.record_id or 0), r.base_id, r.status) for r in warc_revisit.resolve_revisits(df).collect())
    assert got == [(0, 8, "stale"), (2, 1, "resolved"), (2, 1, "resolved"), (5, None, "orphan"), (7, None, "resolved"), (8, 1, "stale")]
    assert warc_revisit.resolve_revisits(df.limit(0)).count() == 0


def test_forest_finds_links_in_a_crowd(spark):
    """1,200 texts that share most of their words, so that regions hold hundreds; pairs at 0.8 and a little over among them."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(70)]
    texts = []
    for i in range(600):
        own = [f"o{i}x{k}" for k in range(60)]
        text = common + own
        texts.append(" ".join(text))
        changed = list(text)
        for k in rng.sample(range(75, 129), 6):
            changed[k] = f"n{i}x{k}"
        texts.append(" ".join(changed))
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(frame(spark, list(enumerate(texts))), shingle=2).collect()}
    sets = [{tuple(p) for p in zip(t.split(), t.split()[1:], strict=False)} for t in texts]
    linked = [i for i in range(0, 1200, 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])]
    assert len(linked) > 300 and all(got[i + 1] == got[i] == i for i in linked)
    assert sum(got[i + 1] != got[i] for i in range(0, 1200, 2)) == 600 - len(linked)


def test_forest_of_another_similarity(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:45] + [f"x{i}" for i in range(12)]), " ".join(f"y{i}" for i in range(50))]
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(frame(spark, list(enumerate(texts))).withColumns({"bits": F.lit(1), "fp": F.lit(2), "id": F.lit(3), "cluster": F.lit(4)}), shingle=2, percent=50).collect()}
    assert got == {0: 0, 1: 0, 2: 2} and minhash_forest.least_depth(50) == 1 and minhash_forest.least_depth(80) == 3


def test_tokens_of_another_shape_go_to_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some Words HERE", "", None, "a  b\n", "x" * 3000]
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(frame(spark, list(enumerate(texts))).withColumns({"n_tokens": F.lit(1), "over_limit": F.lit(2)}), path).collect()}
    t = Tokenizer.from_file(path)
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_decontamination_edges(spark):
    """Long texts and items, repeated items and documents, empty tables, a clashing column."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(1500)]
    filler = [word() for _ in range(30_000)]
    rows = [(1, " ".join(filler[:9000] + item + filler[9000:])), (1, " ".join(item[:30])), (2, " ".join(filler)), (3, None), (None, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, " ".join(item[:20]))], "item_id long, text string")
    docs = frame(spark, rows).withColumn("leaks", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 7), (1, 8), (None, 7), (None, 8)}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_bear_odd_rows(spark, stage):
    """Null ids, texts and sources, empty and very long texts, repeated rows, an empty table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    line = "this line stands in many documents"
    rows = [(1, None, None, None, None), (None, "text " * 30, "en", "a", 150), (None, None, None, "a", 0), (2, "", "en", None, 0), (3, "word " * 50_000, "en", "a", 250_000), (4, "word " * 50_000, "en", "a", 250_000), (5, "a b c\n" + line, "en", "b", 40), (5, "a b c\n" + line, "en", "b", 40), (6, line, "de", "b", 34), (7, line, "de", "b", 34), (8, line, None, "b", 34)]
    docs = spark.createDataFrame(rows, schema)
    name, step = corpus_pipeline.STAGES[stage]
    out = step(spark, docs, sf)
    assert out.columns[:5] == docs.columns and (stage == 4 or len(out.columns) == 5)
    got = [r.doc_id for r in out.collect()]
    if name != "mixing":
        assert {None, 1, 2, 3} <= set(got) and (name != "line_dedup" or len(got) == len(rows)) and (name != "minhash_near_dedup" or 4 not in got)
    assert step(spark, docs.limit(0), sf).count() == 0


def test_pipeline_drops_a_toxic_document(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.STAGES[0][1](spark, docs, sf).select("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    gone = docs.select("doc_id").join(left, "doc_id", "left_anti").join(labels, "doc_id").groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in gone}
    assert n[1] > 300 and n.get(0, 0) < 0.01 * labels.where("toxic = 0").count()
