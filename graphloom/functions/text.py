"""Text columns: normal forms, name forms, n-grams and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_text(c: Column | str) -> Column:
    """Lower case; whatever is no letter or digit is one space; no spaces at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def without_parenthetical(c: Column | str) -> Column:
    return F.regexp_replace(c, "\\s*\\([^)]*\\)\\s*$", "")


def ngrams(words: Column, most: int) -> Column:
    """Array of all runs of 1 to `most` words, joined by a space."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))))


def id_digest(ids: Column) -> Column:
    """SHA-256 of sorted ids joined by commas."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(ids)), lambda x: x.cast("string")), ","), 256)


def hop_of(c: Column | str) -> Column:
    """The number of steps that an identifier `<digit>hop<digits>__<components>` names; another form is an error when read."""
    c = F.col(c) if isinstance(c, str) else c
    digit = F.regexp_extract(c, r"^(\d)hop\d*__", 1)
    return F.when(digit != "", digit.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no hop count in "), F.coalesce(c, F.lit("null")))).cast("int"))


def id_parts(c: Column | str) -> Column:
    """The components of such an identifier."""
    return F.split(F.regexp_extract(c, r"^\dhop\d*__(.*)$", 1), "_")
