"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each document of source s is repeated Poisson(rate_s) times, rate_s = weight_s *
budget / mass_s, where mass is UTF-8 bytes. The draw inverts the Poisson distribution
at a uniform number hashed from (seed, doc_id), so it's the same on every run and for
every partitioning. Rates over MAX_PIECE are a sum of equally small Poisson draws, each
with its own hash, which has the same distribution and never underflows; that is one draw
for some MAX_PIECE copies, so drawing never costs more than the copies do.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillset.functions import let
from quillset.storage import materialise

MAX_PIECE = 16.0
#: Terms of the distribution kept for a piece: beyond them the tail is under 2**-53 for rates up to MAX_PIECE.
TERMS = 72
#: Rates of at most so many sources are broadcast; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, with 52 bits."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """Array of P(X <= k), k = 0 .. TERMS - 1, for a Poisson variable of a rate up to MAX_PIECE."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["c"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """(source, rate): mean repetitions of a document of each source.

    With ``weights`` (any positive scale; sources without one get 0) a source's share of the
    mix is its weight. Without, its share is its share of bytes to the power
    ``temperature``, which lifts small sources. The mix has about ``epochs`` times the
    input's bytes.
    """
    mass = docs.groupBy("source").agg(F.sum(F.greatest(F.octet_length("text"), F.lit(1))).cast("double").alias("mass"))
    if weights is None:
        weight = F.pow(F.col("mass"), F.lit(float(temperature)))
    elif weights:
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))), F.col("source")), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    weighed = mass.withColumn("weight", weight)
    total = weighed.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return weighed.crossJoin(F.broadcast(total)).select("source", (share * F.lit(float(epochs)) * F.col("all_mass") / F.col("mass")).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, *, temperature: float = 0.7, epochs: float = 1.0, seed: int = 20240901) -> DataFrame:
    """Documents repeated to the target mix and shuffled globally.

    Returns the columns of ``docs`` plus ``copy`` (int, from 1), ``rate`` (double) and
    ``mix_key`` (string, hexadecimal): rows are in random order, which is the order of
    ``mix_key`` in each of the hash partitions they are dealt to. A null source is a
    source of its own (weight 0 where weights are given); a null or empty text has a
    mass of one byte. Rows with equal doc_id are drawn alike; a row without doc_id
    is drawn by its text. Texts of any length pass through unread but for their bytes. An empty
    table gives an empty table. Columns named as the three new ones are replaced.
    """
    docs = docs.drop("copy", "rate", "mix_key")
    rates = materialise(source_rates(docs, weights, temperature, epochs), "rates")
    pieces = F.greatest(F.ceil(F.col("rate") / MAX_PIECE), F.lit(1)).cast("int")
    known = rates.select(F.col("source").alias("__source"), "rate", pieces.alias("__pieces")).withColumn("__cdf", cumulative(F.col("rate") / F.col("__pieces")))
    if rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        known = F.broadcast(known)
    joined = docs.join(known, F.col("source").eqNullSafe(F.col("__source")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))

    def draw(j: Column) -> Column:
        # the number is worked out once and not for each term that it's compared with
        return let(uniform(F.lit(seed), name, j), lambda u: F.size(F.filter(F.col("__cdf"), lambda c: c <= u)))

    more = F.when(F.col("__pieces") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(F.col("__pieces"), F.lit(2))), F.lit(0), lambda acc, j: acc + draw(j))).otherwise(0)
    repeated = joined.withColumn("__times", draw(F.lit(1)) + more)
    # the outer form keeps Catalyst from drawing again in a filter below the explode
    copies = repeated.withColumn("copy", F.explode_outer(F.when(F.col("__times") > 0, F.sequence(F.lit(1), F.col("__times"))))).where("copy is not null")
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), name, F.col("copy").cast("string")))
    out = copies.withColumn("mix_key", key).select(*docs.columns, "copy", "rate", "mix_key")
    return out.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
