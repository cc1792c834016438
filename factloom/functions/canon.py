"""Canonical text, content ids, seeded order and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in alphabetical order, no spaces and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_id(prefix: str, **fields: Column) -> Column:
    """``prefix:`` and the first 24 hex digits of the canonical JSON's SHA-256."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(canonical_json(**fields), 256), 1, 24))


def seeded_hash(seed: int, id_column: Column, separator: str = "\x00") -> Column:
    """The key of a deterministic order: SHA-256 of seed, separator and id."""
    return F.sha2(F.concat(F.lit(f"{seed}{separator}"), id_column.cast("string")), 256)


def digest_byte(digest: Column, first: bool = True) -> Column:
    """The first or last byte of a hex digest as a number."""
    return F.conv(F.substring(digest, 1 if first else -2, 2), 16, 10).cast("bigint")


def slug(value: Column, default: str = "unnamed") -> Column:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends."""
    out = F.btrim(F.regexp_replace(F.lower(F.btrim(value)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.coalesce(out, F.lit("")) == "", default).otherwise(out)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)
