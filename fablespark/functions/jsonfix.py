"""Reading JSON that a model has written: strict first, repaired only where that fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired(c: Column) -> Column:
    """Cut to the outermost braces, without // comments, with the commas put in that are missing between strings."""
    cut = F.regexp_extract(c, "(?s)\\{.*\\}", 0)
    plain = F.regexp_replace(cut, "(?m)(?<!:)//[^\n\"]*$", "")
    return F.regexp_replace(plain, "\"([ \t\r\n]+)\"", "\",$1\"")


def parse_lenient(c: Column, schema: str) -> Column:
    """The record of a response: as it stands, or repaired, or null."""
    strict = F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema, {"mode": "PERMISSIVE"}))
    fixed = repaired(c)
    return F.coalesce(strict, F.when(F.try_parse_json(fixed).isNotNull(), F.from_json(fixed, schema, {"mode": "PERMISSIVE"})))


def as_list(c: Column) -> Column:
    """A response that is one object, or objects in a row, as a JSON list."""
    text = F.btrim(c)
    return F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), F.regexp_replace(text, "\\}\\s*\\{", "},{"), F.lit("]")))
