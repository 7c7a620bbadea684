"""Canonical forms and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(*columns: str) -> Column:
    """Keys sorted, no blanks, nulls kept, characters as they are."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def spaced_json(**texts: Column) -> Column:
    """Keys sorted, ``", "`` and ``": "`` between: the form of another fingerprint. Values are JSON texts."""
    parts = [F.concat(F.lit(f'"{k}": '), texts[k]) for k in sorted(texts)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def unit_interval(uuid: Column) -> Column:
    """0 to 1 by the first 8 bytes of the SHA-256 of an identifier's 16 bytes: the same draw in each run."""
    digest = F.sha2(F.unhex(F.replace(uuid, F.lit("-"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))
