"""Renaming: templates, collisions and undo."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISO = r"(?i)^(?:([A-Z0-9]{2,6})-)?([A-Z0-9]{2,6})-([A-Z0-9]{2,6})-([A-Z0-9]{1,4})-([A-Z]{2,3})-([A-Z])-(\d{3,6})$"
ISO_FIELDS = ("project", "originator", "volume", "level", "type", "role", "number")


def parse_iso_number(number: Column) -> Column:
    """struct of the seven fields of a structured number; null where it has another shape."""
    return F.when(number.rlike(ISO), F.struct(*(F.regexp_extract(number, ISO, i + 1).alias(f) for i, f in enumerate(ISO_FIELDS))))


def render(template: str, fields: dict[str, Column]) -> Column:
    """A file name from ``{token}`` or ``{token:modifier}`` (upper, lower, padN, N: the first N characters); missing ones vanish with a separator."""
    parts = []
    for text, token, modifier in re.findall(r"([^{]*)(?:\{(\w+)(?::(\w+))?\})?", template):
        if text:
            parts.append(F.lit(text))
        if token:
            value = fields[token].cast("string")
            if modifier == "upper":
                value = F.upper(value)
            elif modifier == "lower":
                value = F.lower(value)
            elif modifier.isdigit():
                value = F.substring(value, 1, int(modifier))
            elif modifier.startswith("pad"):
                width = int(modifier[3:])
                value = F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)
            parts.append(F.coalesce(value, F.lit("")))
    joined = F.regexp_replace(F.concat(*parts), r"([-_ ])[-_ ]+", "$1")
    return F.regexp_replace(F.regexp_replace(joined, r'[<>:"/\\|?*]', ""), r"^[-_ ]+|[-_ .]+$", "")


def undo_prefix(log: DataFrame) -> DataFrame:
    """log (batch, seq, ok) with undone: in reverse order, up to the first entry that isn't ok."""
    w = Window.partitionBy("batch").orderBy(F.desc("seq"))
    return log.withColumn("undone", F.min(F.col("ok").cast("int")).over(w) == 1)
