"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words (letter or digit runs, A-Z lower-cased) and the first
five bytes of longer ones, hashed to 2**20 buckets. The machine adds to linear weights
the products of learned factors for every pair of terms, so that two terms can mean more
together than apart. It's fitted by Adam on a bounded, hash-ordered sample of labelled
rows; scoring reads every text whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillset.llm.groups import bounds
from quillset.storage import materialise
from quillset.llm.textkernel import ALNUM, LOWER, U64, Poly, distinct, flat, mix, slices, words

BITS = 20
PREFIX = 5
#: Labelled rows of each class that the machine is fitted on, at most.
SAMPLE_PER_CLASS = 6_000
#: Distinct terms of all sampled rows of a class, at most (and one text's more): 4 bytes each on the driver.
TERMS_PER_CLASS = 4_000_000


def term_rows(column: pa.Array, poly: Poly, keep: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, text index, distinct bucket) for slices; ``keep`` renumbers buckets, -1 drops."""
    data, offsets = flat(column)
    for a, b in slices(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        doc, start, end, word = words(part, offsets[a : b + 1] - offsets[a], poly, ALNUM)
        long = np.flatnonzero(end - start > PREFIX)
        head = mix(poly.ranges(poly.prefix(part), start[long], start[long] + PREFIX) ^ U64(0x5851F42D4C957F2D))
        doc = np.concatenate([doc, doc[long]])
        bucket = (np.concatenate([word, head]) >> U64(64 - BITS)).astype(np.int64)
        if keep is not None:
            bucket = keep[bucket]
            doc, bucket = doc[bucket >= 0], bucket[bucket >= 0]
        yield a, b, *distinct(doc, bucket)


@dataclass
class Machine:
    """bias + sum w_i + sum_{i<j} <v_i, v_j> over a text's terms."""

    buckets: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(row):
            cut = bounds(row)
            at, rows = cut[:-1], row[cut[:-1]]
            v = self.factor[term]
            total = np.add.reduceat(v, at, axis=0)
            out[rows] += np.add.reduceat(self.weight[term], at) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), at))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(doc: np.ndarray, term: np.ndarray, label: np.ndarray, *, least_docs: int, least_z: float, pair_terms: int, least_pair_z: float) -> np.ndarray:
    """Buckets that the machine is given: those that tell something alone or together with another.

    Alone: the rate among ones differs from the mean by ``least_z`` standard errors. Together: of
    the ``pair_terms`` commonest buckets, a pair's rate among ones differs from what the two terms' log
    odds add up to by ``least_pair_z`` standard errors; there the terms alone may say nothing.
    """
    seen = np.bincount(term, minlength=1 << BITS)
    ones = np.bincount(term, weights=label[doc], minlength=1 << BITS)
    mean = label.mean()
    z = (ones - seen * mean) / np.sqrt(np.maximum(seen * mean * (1 - mean), 1e-9))
    alone = (seen >= least_docs) & (np.abs(z) >= least_z)
    common = np.argsort(-seen, kind="stable")[:pair_terms]
    common = common[seen[common] >= 4 * least_docs]
    place = np.full(1 << BITS, -1)
    place[common] = np.arange(len(common))
    row, column = doc[place[term] >= 0], place[term[place[term] >= 0]]
    both, both_ones = (np.zeros((len(common), len(common)), np.float32) for _ in range(2))
    for r in range(0, len(label), 1_000):
        a, b = np.searchsorted(row, [r, r + 1_000])
        x = np.zeros((min(1_000, len(label) - r), len(common)), np.float32)
        x[row[a:b] - r, column[a:b]] = 1
        both += x.T @ x
        x = x[label[r : r + 1_000] == 1]
        both_ones += x.T @ x

    def odds(one: np.ndarray, all_: np.ndarray) -> np.ndarray:
        return np.log((one + 0.5) / (all_ - one + 0.5))

    single = odds(ones[common], seen[common]).astype(np.float32)
    for i in range(0, len(common), 100):
        n, expected = both[i : i + 100], sigmoid(single[i : i + 100, None] + single - np.float32(odds(label.sum(), len(label))))
        told = (np.abs(both_ones[i : i + 100] - n * expected) >= least_pair_z * np.sqrt(n * expected * (1 - expected) + 0.5)) & (n >= 4 * least_docs)
        told[np.arange(len(told)), np.arange(i, i + len(told))] = False
        alone[common[i : i + 100][told.any(axis=1)]] = True
    return np.flatnonzero(alone)


def fit(first: np.ndarray, term: np.ndarray, label: np.ndarray, *, prior: float, factors: int = 4, epochs: int = 30, rate: float = 0.05, decay: float = 1e-4, factor_decay: float = 1e-3, dropout: float = 0.3, least_docs: int = 4, least_z: float = 4.0, pair_terms: int = 1_000, least_pair_z: float = 6.0, seed: int = 5) -> Machine:
    """Fit on texts' term lists (term[first[i] : first[i + 1]]) and 0/1 labels; ``prior`` is the share of ones where the rows were sampled from.

    Each step hears a term with probability 1 - ``dropout``, so that one strong term is
    enough where most texts hold several, and factors decay faster than weights, so that
    pairs only say what single terms don't. Terms that telling() leaves out aren't used. Where
    ones are rarer or commoner than in the sample, the bias is moved by the difference of the
    log odds. With one class only, the machine is its bias.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    none = Machine(np.zeros(0, np.int64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, factors)))
    if not len(label) or label.min() == label.max():
        return none
    doc = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(first))
    buckets = telling(doc, term, label, least_docs=least_docs, least_z=least_z, pair_terms=pair_terms, least_pair_z=least_pair_z)
    if not len(buckets):
        return none
    place = np.full(1 << BITS, -1)
    place[buckets] = np.arange(len(buckets))
    used = place[term] >= 0
    doc, term = doc[used], place[term[used]]
    first = np.searchsorted(doc, np.arange(len(label) + 1))
    rng = np.random.default_rng(seed)
    machine = Machine(buckets, 0.0, np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), factors)))
    parameters = np.zeros((len(buckets), factors + 1))
    parameters[:, 1:] = machine.factor
    moment, square, bias, bias_m, bias_s, step = np.zeros_like(parameters), np.zeros_like(parameters), 0.0, 0.0, 0.0, 0
    for epoch in range(epochs):
        slower = rate * (1 - epoch / epochs)
        order = rng.permutation(len(label))
        for chunk in np.array_split(order, max(1, len(label) // 256)):
            chunk = np.sort(chunk)
            lengths = first[chunk + 1] - first[chunk]
            t = term[np.repeat(first[chunk] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]
            r = np.repeat(np.arange(len(chunk)), lengths)
            heard = rng.random(len(t)) >= dropout
            t, r = t[heard], r[heard]
            machine.bias, machine.weight, machine.factor = bias, parameters[:, 0], parameters[:, 1:]
            error = sigmoid(machine.raw(r, t, len(chunk))) - label[chunk]
            gradient = parameters * np.r_[decay, np.full(factors, factor_decay)]
            v = machine.factor[t]
            total = np.stack([np.bincount(r, weights=v[:, f], minlength=len(chunk)) for f in range(factors)], axis=1)
            e = error[r] / len(chunk)
            gradient[:, 0] += np.bincount(t, weights=e, minlength=len(buckets))
            inner = e[:, None] * (total[r] - v)
            for f in range(factors):
                gradient[:, f + 1] += np.bincount(t, weights=inner[:, f], minlength=len(buckets))
            step += 1
            moment = 0.9 * moment + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            g = float(error.mean())
            bias_m, bias_s = 0.9 * bias_m + 0.1 * g, 0.999 * bias_s + 0.001 * g * g
            parameters -= slower * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            bias -= slower * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_s / (1 - 0.999**step)) + 1e-8)
    mean = float(label.mean())
    shift = float(np.log(prior / (1 - prior)) - np.log(mean / (1 - mean)))
    return Machine(buckets, bias + shift, parameters[:, 0].copy(), parameters[:, 1:].copy())


def train(docs: DataFrame, labels: DataFrame, *, target: str = "toxic", per_class: int = SAMPLE_PER_CLASS, terms_per_class: int = TERMS_PER_CLASS, **options) -> Machine:
    """Fit on the first labelled documents of each class in hash order: at most ``per_class``, until they have ``terms_per_class`` distinct terms in all.

    ``labels``: doc_id and ``target`` (0 or 1; others are ignored). The sampled ids are
    broadcast, being bounded, and meet the texts without a shuffle of texts.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(target).cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(31))
    sample = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionAll(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Poly(23)
        for batch in batches:
            for a, b, doc, bucket in term_rows(batch.column(0), poly):
                cut = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), lists], ["doc_id", "label", "terms"])

    joined = docs.select(F.col("text").cast("string"), "doc_id").join(F.broadcast(sample), "doc_id").select("text", F.col("doc_id").cast("long"), "label")
    listed = materialise(joined.mapInArrow(run, "doc_id long, label int, terms array<int>"), "sample-terms")
    so_far = Window.partitionBy("label").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    held = listed.withColumn("before", F.coalesce(F.sum(F.size("terms")).over(so_far), F.lit(0))).where(F.col("before") < terms_per_class)
    got = held.select("doc_id", "label", "terms").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    label = got["label"].to_numpy().astype(float)
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(got["terms"]).to_numpy())]).astype(np.int64)
    term = pc.list_flatten(got["terms"]).to_numpy()
    del got
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit(first, term, label, prior=share, **options)


def scorer(machine: Machine):
    """A column function: text to a score in [0, 1]; null and empty texts get the bias alone."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        poly = Poly(23)
        keep = np.full(1 << BITS, -1)
        keep[machine.buckets] = np.arange(len(machine.buckets))
        out = np.empty(len(texts))
        for a, b, row, term in term_rows(texts, poly, keep):
            out[a:b] = sigmoid(machine.raw(row, term, b - a))
        return pa.array(out)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (1 if score >= ``threshold``, else 0).

    Labels are learned only from ids whose crc32 (of the id as text) modulo 3 isn't 1;
    held_out marks the others. Scores depend on the text alone. A null doc_id is neither
    learned from nor held out. Columns named score, predicted or held_out are replaced.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    machine = train(docs, labels.where(~held), **options)
    score = scorer(machine)
    out = docs.withColumns({"held_out": F.coalesce(held, F.lit(False)), "score": score(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
