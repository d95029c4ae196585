"""Canonical JSON as column expressions: digests that don't depend on the order of keys or rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters whose escape has hexadecimal digits; JSON writers differ in the case of those.
_CONTROL = "[\\x00-\\x07\\x0B\\x0E-\\x1F]"


def _plain(text: Column) -> Column:
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


def quoted(text: Column) -> Column:
    """A text as a JSON string, code points beyond ASCII as they are, escapes in lower case; null as ``null``."""
    one = lambda c: F.substring(_plain(c), F.lit(2), F.length(_plain(c)) - 2)
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(_CONTROL), F.lower(one(c))).otherwise(one(c)))
    return F.when(text.rlike(_CONTROL), F.concat(F.lit('"'), F.array_join(each, ""), F.lit('"'))).otherwise(_plain(text))


def width(character: Column) -> Column:
    """Places that a character takes within a JSON string."""
    return F.when(character.isin(*'"\\\b\f\n\r\t'), 2).when(character.rlike(_CONTROL), 6).otherwise(1)


def array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def record(fields: dict[str, Column], *, spaced: bool = False) -> Column:
    """An object of values that are JSON already, keys sorted; ``spaced`` leaves a blank after commas and colons."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    parts = [F.concat(F.lit(f'"{k}"{colon}'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))


def digest(json: Column) -> Column:
    return F.sha2(F.encode(json, "UTF-8"), 256)
