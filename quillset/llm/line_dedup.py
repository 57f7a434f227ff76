"""Line deduplication: explode normalised lines, hash, count distinct documents, drop, reassemble.

Lines are cut and hashed once, into a table of (row, position, hash) in the shared folder.
Distinct documents are counted by partial aggregation. Hashes that hold over one in
HOT_SHARE of all lines are under HOT_SHARE in number, so they are broadcast and their lines
met without a shuffle; all other hashes have few lines each and meet them in a join.
Texts move once, unsorted, past the positions that their row loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillset.functions import let
from quillset.storage import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
#: A hash is hot if it has more than one in so many of all lines: fewer hashes than this can.
HOT_SHARE = 1_000


def stripped(line: Column) -> Column:
    """The line without whitespace (0x20, 0x09-0x0D) at both ends."""
    spaces = list(SPACES)
    loose = F.substring(line, 1, 1).isin(spaces) | F.substring(line, -1, 1).isin(spaces)
    return F.when(loose, F.btrim(line, F.lit(SPACES))).otherwise(line)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(stripped(line))


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with repeated lines dropped from the text, plus n_lines and n_dropped (long).

    A key of at least ``min_chars`` code points found in at least ``min_docs`` different
    doc_ids loses all its lines but those of the largest doc_id that holds it; there all
    of them stay. Rows that share a doc_id count as one document, but each loses its own lines
    by its own positions. A null text is one empty line and stays null; a row without doc_id
    isn't counted and keeps its lines. Texts are read whole, whatever their length. Keys are told
    apart by 128 bits of hash. Columns named n_lines or n_dropped are replaced; others pass
    through. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_dropped")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = F.xxhash64(whole, F.lit("row"))
    long_enough = docs.where(F.col("doc_id").isNotNull() & (F.char_length(whole) >= min_chars))
    exploded = long_enough.select("doc_id", row.alias("row"), F.posexplode(F.split(whole, "\n", -1)).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    keyed = exploded.select("doc_id", "row", "pos", stripped(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    low = lower_ascii(F.col("line"))
    hashed = materialise(keyed.select("doc_id", "row", "pos", F.xxhash64(low).alias("h1"), F.xxhash64(F.lit("second"), low).alias("h2")), "lines")
    limit = max(1, hashed.count() // HOT_SHARE)
    counted = hashed.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("lines")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"), F.sum("lines").alias("lines"))
    repeated = F.col("n") >= min_docs
    spread = materialise(counted.where(repeated | (F.col("lines") > limit)).select("h1", "h2", F.when(repeated, F.col("keeper")).alias("keeper"), (F.col("lines") > limit).alias("hot")), "repeated-lines")
    hot = spread.where("hot").select("h1", "h2", F.col("keeper").alias("hot_keeper"), "hot")
    marked = hashed.join(F.broadcast(hot), ["h1", "h2"], "left")
    met = marked.where("hot is null").drop("hot_keeper", "hot").join(spread.where("not hot").select("h1", "h2", "keeper"), ["h1", "h2"])
    lost = met.where("doc_id <> keeper").select("doc_id", "row", "pos").unionAll(marked.where("doc_id <> hot_keeper").select("doc_id", "row", "pos"))
    positions = lost.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("__lost")).withColumnsRenamed({"doc_id": "__doc", "row": "__row"})
    joined = docs.join(positions.hint("shuffle_hash"), (F.col("doc_id") == F.col("__doc")) & (row == F.col("__row")), "left").drop("__doc", "__row")
    touched = F.col("__lost").isNotNull()
    breaks = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))

    def remaining(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lost"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return joined.withColumns(
        {
            "n_lines": (breaks + 1).cast("long"),
            "n_dropped": F.when(touched, F.size("__lost")).otherwise(0).cast("long"),
            text: F.when(touched, let(F.split(whole, "\n", -1), remaining)).otherwise(F.col(text)),
        }
    ).drop("__lost")
