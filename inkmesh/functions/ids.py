"""Ids for new notes, named by what they come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_uuid(*parts: Column | str) -> Column:
    """A version 5 UUID of the parts' names: the same rows get the same ids whenever a batch is run again.

    The name is the JSON array of the parts as text (a null part is a null in
    it), so parts cannot run into each other.  The 122 free bits are those of
    its SHA-1; whether an id is taken is checked where notes are inserted.
    """
    name = F.to_json(F.array(*[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    h = F.sha1(name)
    at = lambda start, n: F.substring(h, start, n)
    variant = F.lower(F.hex(F.conv(at(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))
