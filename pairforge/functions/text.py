"""Column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript's trim() and \s take it.
WHITE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


#: The same characters in a row.
_WHITE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE_CHARS))


def normalise(c: Column) -> Column:
    """Lower case, runs of anything but a-z, 0-9 and _ as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_]+", " "))


def trigrams(normal: Column) -> Column:
    """Distinct character trigrams; a shorter text is its own gram, an empty one has none."""
    n = F.length(normal)
    every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: normal.substr(i, F.lit(3))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(normal)).otherwise(every)


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)
