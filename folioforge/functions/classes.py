"""Classification numbers: parsing, ranges and bins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import strip_ws

# Bins of class digits, inclusive, in order.
BINS = [
    ("PS1-499", 1, 499), ("PS501-689", 501, 689), ("PS700-893", 700, 893), ("PS991-3390", 991, 3390),
    ("PS3500-3549", 3500, 3549), ("PS3550-3576", 3550, 3576), ("PS3600-3626", 3600, 3626),
]
# The digits of PS that belong to another national literature.
EXCLUDED = ("PS", 8001, 8599)


def prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^([A-Z]+)(\d+)?", 1), F.lit(""))


def digits(c: Column) -> Column:
    return F.regexp_extract(c, r"^([A-Z]+)(\d+)?", 2).try_cast("bigint")


@dataclass(frozen=True)
class ClassRange:
    """A class prefix with optional inclusive bounds of its digits."""

    prefix: str
    low: int | None = None
    high: int | None = None

    @classmethod
    def parse(cls, text: str) -> ClassRange:
        """``PS``, ``PR9000``, ``PR9000-9999`` or ``PR9000-PR9999``; else ValueError."""
        m = re.fullmatch(r"([A-Z]+)(\d+)?(?:-([A-Z]+)?(\d+))?", text.strip().upper())
        if not m or m[3] and m[3] != m[1] or m[4] and not m[2]:
            raise ValueError(f"not a class range: {text!r}")
        return cls(m[1], m[2] and int(m[2]), m[4] and int(m[4]))

    def matches(self, c: Column) -> Column:
        """Whether a number lies in the range; a one-letter prefix takes all its subclasses.  Null is false."""
        p, d = prefix(c), digits(c)
        found = p.startswith(self.prefix) if len(self.prefix) == 1 else p == self.prefix
        found = found & ~F.coalesce((p == EXCLUDED[0]) & d.between(*EXCLUDED[1:]), F.lit(False))
        if self.low is not None:
            found = found & F.coalesce(d >= self.low, F.lit(False))
        if self.high is not None:
            found = found & F.coalesce(d <= self.high, F.lit(False))
        return F.coalesce(found, F.lit(False))

    def any(self, classes: Column) -> Column:
        return F.exists(F.coalesce(classes, F.array().cast("array<string>")), lambda c: self.matches(strip_ws(c)))

    def all_of(self, classes: Column) -> Column:
        """The numbers of an array in the range, stripped."""
        stripped = F.transform(F.coalesce(classes, F.array().cast("array<string>")), strip_ws)
        return F.filter(stripped, self.matches)

    def digits_in(self, c: Column) -> Column:
        return F.when(self.matches(c), digits(c))


def in_scope(classes: Column, local: Column) -> Column:
    """Whether a number begins with PS and digits; local numbers count only where the others are empty."""
    empty = F.array().cast("array<string>")
    test = lambda c: F.coalesce(strip_ws(c).rlike(r"^PS\s*\d"), F.lit(False))
    classes, local = F.coalesce(classes, empty), F.coalesce(local, empty)
    return F.when(F.size(classes) > 0, F.exists(classes, test)).otherwise(F.exists(local, test))


def is_target(classes: Column) -> Column:
    """Whether the first number of class PS has digits under 8000 or none; false without one."""
    first = F.get(F.filter(F.coalesce(classes, F.array().cast("array<string>")), lambda c: prefix(c) == "PS"), F.lit(0))
    return F.when(first.isNull(), F.lit(False)).otherwise(F.coalesce(digits(first) < 8000, F.lit(True)))


def class_prefixes(classes: Column, length: int | None = None) -> Column:
    """Distinct sorted prefixes of an array, or their first ``length`` letters."""
    found = F.filter(F.transform(F.coalesce(classes, F.array().cast("array<string>")), prefix), lambda p: p.isNotNull())
    if length:
        found = F.transform(found, lambda p: F.substring(p, 1, length))
    return F.array_sort(F.array_distinct(found))


def assign_bin(d: Column, bins=BINS) -> Column:
    """The bin of a number of class digits; null outside every bin."""
    found = F.lit(None).cast("string")
    for name, low, high in reversed(bins):
        found = F.when(d.between(low, high), name).otherwise(found)
    return found
