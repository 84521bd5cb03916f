"""Times that file names carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exif_time import once, time_struct
from .text import stem

_DAY, _CLOCK = r"(\d{4})(\d{2})(\d{2})", r"(\d{2})(\d{2})(\d{2})"
_DASHED = r"(\d{4})-(\d{2})-(\d{2})"
_MOMENTS = (_DAY + _CLOCK, f"{_DAY}_{_CLOCK}", rf"{_DASHED}[-_](\d{{2}})-(\d{{2}})-(\d{{2}})")
_DAYS = (_DAY, _DASHED)


def _first(name: Column, pattern: str, shown: str) -> Column:
    """The first match, bounded by non-digits, as a time; null if there is no such time.

    A year of zeros is none, and does not let a later match in."""
    found = F.regexp_extract(name, rf"(?<!\d){pattern}(?!\d)", 0)
    return F.regexp_replace(F.regexp_replace(found, "^0000.*", ""), pattern, shown).try_cast("timestamp_ntz")


def second_of(bare: Column) -> Column:
    """The date and time that a stem carries, or null; an impossible value lets the next pattern try."""
    found = F.coalesce(*[_first(bare, p, "$1-$2-$3 $4:$5:$6") for p in _MOMENTS])
    return F.when(F.length(bare) >= 14, found)


def noon_of(bare: Column) -> Column:
    """Noon of the date that a stem carries, or null."""
    found = F.coalesce(*[_first(bare, p, "$1-$2-$3 12:00:00") for p in _DAYS])
    return F.when(F.length(bare) >= 8, found)


def parse(name: Column) -> Column:
    """struct(time, precision): ``second`` with a time, ``date`` for a date alone."""
    parts = once(stem(name), lambda b: F.struct(second_of(b).alias("second"), noon_of(b).alias("noon")))

    def made(p: Column) -> Column:
        both = F.struct(time_struct(F.coalesce(p["second"], p["noon"]), F.lit(0)).alias("time"), F.when(p["second"].isNotNull(), "second").otherwise("date").alias("precision"))
        return F.when(p["second"].isNotNull() | p["noon"].isNotNull(), both)

    return once(parts, made)
