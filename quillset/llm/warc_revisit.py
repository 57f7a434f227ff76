"""WARC revisits: an as-of join of "not modified" records to the latest earlier full response.

Records are dealt out in the order of (canonical URL, time, id), so a URL that holds a large
part of all records lies in many ranges. Within each (URL, range) a window finds the latest
response so far; the last response of a range is carried into the later ones of its URL over
a table with one row for each (URL, range). Header fields travel with their record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillset.storage import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Header fields that a not-modified response may update (RFC 9111 forbids the content's own).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port, fragment and the path's trailing slashes dropped, ``/`` for an empty path."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.translate(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1), UPPER, LOWER)
    tail = F.substring(bare, F.char_length(head) + 1, F.char_length(bare))
    path, asked = F.regexp_extract(tail, r"(?s)^([^?]*)(.*)$", 1), F.regexp_extract(tail, r"(?s)^([^?]*)(.*)$", 2)
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^/?]*):80$", "$1"), r"^(https://[^/?]*):443$", "$1")
    path = F.regexp_replace(path, r"/+$", "")
    return F.concat(head, F.when(path == "", F.lit("/")).otherwise(path), asked)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit record: what it resolves to and the merged headers.

    records: record_id, kind (``response`` or ``revisit``; others are ignored), url, fetched (long,
    epoch seconds), etag, last_modified (strings), headers (map<string,string>, names in lower
    case); further columns are ignored. A revisit meets the latest response of its canonical
    URL with a smaller (fetched, record_id). Returned: record_id, canonical, base_id (null if
    there is none or it has no id), status (``resolved``; ``unverified`` if neither validator is on
    both; ``stale`` if one that is on both differs; ``orphan`` without a base) and headers: the
    base's, overlaid with the revisit's PERMITTED ones, for resolved and unverified; else the
    revisit's own. A strong etag decides alone; a leading ``W/`` is ignored. Null URLs match
    nothing; a null time or id counts as the smallest; of responses equal in both, the one with
    the larger (etag, last_modified) counts. Repeated revisits, with or without an id, give a row each. URLs of
    any length are read whole. An empty table gives an empty table.
    """
    is_response = F.col("kind") == "response"
    known = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical"), F.coalesce(F.col("fetched").cast("long"), F.lit(-(1 << 62))).alias("t"), is_response.alias("full"), "etag", "last_modified", "headers")
    order = ["canonical", "t", "record_id", "full", "etag", "last_modified"]
    ranged = known.where("canonical is not null").repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = materialise(ranged, "records").withColumn("base", F.when(F.col("full"), F.struct(F.col("record_id").alias("id"), "etag", "last_modified", "headers")))
    within = Window.partitionBy("canonical", "range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumn("near", F.last("base", ignorenulls=True).over(within))
    last = dealt.groupBy("canonical", "range").agg(F.max_by("base", F.when(F.col("full"), F.struct(*order[1:]))).alias("ending"))
    before = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("ending", ignorenulls=True).over(before)).where("carried is not null").select("canonical", "range", "carried")
    met = here.where("not full").join(carried, ["canonical", "range"], "left").withColumn("base", F.coalesce("near", "carried"))
    columns = ["record_id", "canonical", "etag", "last_modified", "headers", "base"]
    alone = known.where("canonical is null and not full").withColumn("base", F.lit(None).cast(dealt.schema["base"].dataType))
    found = met.select(columns).unionByName(alone.select(columns))

    def tag(c: Column) -> Column:
        return F.regexp_replace(c, "^W/", "")

    tags, dates = tag(F.col("etag")) == tag(F.col("base.etag")), F.col("last_modified") == F.col("base.last_modified")
    status = F.when(F.col("base").isNull(), "orphan").when(F.coalesce(tags, dates).isNull(), "unverified").when(F.coalesce(tags, dates), "resolved").otherwise("stale")
    judged = found.withColumn("status", status)
    none = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce("headers", none), F.coalesce("base.headers", none)
    allowed = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    headers = F.when(F.col("status").isin("resolved", "unverified"), F.map_concat(kept, allowed)).otherwise(mine)
    return judged.select("record_id", "canonical", F.col("base.id").alias("base_id"), "status", headers.alias("headers"))
