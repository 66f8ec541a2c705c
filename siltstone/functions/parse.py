"""A model's JSON as typed columns, and ids that depend on a name alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def model_json(reply: Column, schema: str) -> Column:
    """What a model's reply holds between its outermost braces, without its thoughts; null where that isn't JSON."""
    said = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)<think>.*?</think>", "")
    return F.from_json(F.regexp_extract(said, r"(?s)(\{.*\})", 1), schema)


def named_id(space: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name in a name space."""
    hashed = F.sha1(F.concat(F.lit(bytearray(space.bytes)), F.encode(name, "UTF-8")))

    def digits(start: int, length: int) -> Column:
        return F.substring(hashed, start, length)

    variant = F.element_at(F.array(*(F.lit(d) for d in "89ab")), (F.conv(digits(17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", digits(1, 8), digits(9, 4), F.concat(F.lit("5"), digits(14, 3)), F.concat(variant, digits(18, 3)), digits(21, 12))
