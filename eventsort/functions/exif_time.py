"""Capture times: parsing with an offset, and ISO text that keeps it.

A time is a struct of ``local`` (timestamp without zone), ``offset_s`` and
``epoch`` (seconds of the instant), so nothing depends on the session's zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Year, separator, month, day, hour, minute, second, then sign, hours, minutes and seconds of an offset.
_SHAPE = r"^(?!0000)(\d{4})([:-])(\d{1,2})\2 ?(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})(?:Z|([+-])(\d{2}):?([0-5]\d)(?::?([0-5]\d))?)?\z"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def epoch(local: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), local)


def local_of(value: Column) -> Column:
    """The local time that a text in a camera's format says, or null."""
    plain = F.regexp_replace(value, _SHAPE, r"$1-$3-$4 $5:$6:$7")
    return F.when(value.rlike(_SHAPE), plain.try_cast("timestamp_ntz"))


def offset_of(value: Column) -> Column:
    """Seconds of the text's offset; 0 without one."""
    number = lambda k: F.coalesce(F.regexp_extract(value, _SHAPE, k).try_cast("int"), F.lit(0))
    seconds = number(9) * 3600 + number(10) * 60 + number(11)
    signed = F.when(F.regexp_extract(value, _SHAPE, 8) == "-", -seconds).otherwise(seconds)
    clock = F.substring(value, 9, 100)  # past the date's own dashes
    return F.when((F.instr(clock, "+") > 0) | (F.instr(clock, "-") > 0), signed).otherwise(F.lit(0))


def time_struct(local: Column, offset_s: Column) -> Column:
    """The time; null without a local time or with an offset of a day or more."""
    made = F.struct(local.alias("local"), offset_s.cast("int").alias("offset_s"), (epoch(local) - offset_s).alias("epoch"))
    return F.when(local.isNotNull() & (F.abs(offset_s) < 86400), made)


def parse(value: Column) -> Column:
    """A capture time as cameras write it, with or without offset; naive is UTC."""
    parts = F.struct(local_of(value).alias("local"), offset_of(value).alias("offset"))
    return once(parts, lambda p: time_struct(p["local"], p["offset"]))


def iso(time: Column) -> Column:
    """ISO text with the time's own offset, or null."""
    off = F.abs(time["offset_s"])
    seconds = F.when(off % 60 == 0, F.lit("")).otherwise(F.format_string(":%02d", off % 60))
    sign = F.when(time["offset_s"] < 0, "-").otherwise("+")
    text = F.concat(F.date_format(time["local"], "yyyy-MM-dd'T'HH:mm:ss"), sign, F.format_string("%02d:%02d", F.floor(off / 3600), F.floor(off % 3600 / 60)), seconds)
    return F.when(time.isNotNull(), text)
