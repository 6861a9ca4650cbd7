"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintagebook.functions import fixed as V

ID_SPACE = 10**8


def measure_id(name: Column, edition: Column, salt: Column | int = 0, space: int = ID_SPACE) -> Column:
    """An 8-digit id from a hash of name, edition and salt, the same in every rebuild."""
    salt_text = (F.lit(salt) if isinstance(salt, int) else salt).cast("string")
    digest = F.sha2(F.concat_ws(V.KEY_SEPARATOR, name, edition, salt_text), 256)
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    return F.lpad((number % space).cast("string"), 8, "0")
