"""Records of whois output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whois_fields(output: Column) -> Column:
    """map key -> value of the lines with a colon, cut at the first one and trimmed; the last of repeated keys counts."""
    lines = F.filter(F.split(output, "\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    # the map keeps the last value of each key
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def registrant(output: Column) -> Column:
    """struct(org, country), ``#`` where missing."""
    own = whois_fields(output)
    return F.struct(F.coalesce(own["Registrant Organization"], F.lit("#")).alias("org"), F.coalesce(own["Registrant Country"], F.lit("#")).alias("country"))
