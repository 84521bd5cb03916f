"""Destinations that no other row has, case-insensitively, given in plan order.

A name that is taken gets ``__dup02``, ``__dup03`` and so on, the first that is
free, also of names given before and literal ones. Only names of one *family* in
one folder can meet: names that are equal once ``__dupNN`` endings are taken off.
A family with a single literal name is numbered by its rows' turns; only families
with several run the allocation itself, family by family.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem, suffix
from .positions import turns


def split_name(name: str) -> tuple[str, str]:
    """A name before its last dot, and from there; as ``stem`` and ``suffix``."""
    found = re.fullmatch(r"(?s)(.+)(\.[^.]+)", name)
    return (found[1], found[2]) if found else (name, "")


def allocate(names: Iterable[str]) -> list[str]:
    """Names for ``names`` in order, each free when its turn comes.

    What is taken stays taken, so a name's search goes on where it last stopped."""
    taken: set[str] = set()
    reached: dict[str, int] = {}
    out = []
    for name in names:
        low = name.lower()
        if low not in taken:
            taken.add(low)
            out.append(name)
            continue
        bare, end = split_name(name)
        variants = (f"{bare}__dup{n:02d}{end}" for n in count(reached.get(low, 2)))
        chosen = next(v for v in variants if v.lower() not in taken)
        reached[low] = int(chosen[len(bare) + 5 : len(chosen) - len(end)]) + 1
        taken.add(chosen.lower())
        out.append(chosen)
    return out


def _allocate_family(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("__at")
    rows["__given"] = allocate(rows["__name"])
    return rows[["__at", "__key", "__given"]]


def name_destinations(plan: DataFrame, order: str, folder: str = "proposed_folder", name: str = "file_name", out: str = "proposed_destination") -> DataFrame:
    """Adds ``out``: folder/name. ``order``: a column of distinct numbers, the plan order.
    ``plan`` is read more than once, so it should be a written table."""
    n = F.col(name)
    family = F.concat(F.regexp_replace(F.lower(stem(n)), "(__dup[0-9]+)+$", ""), F.lower(suffix(n)))
    rows = plan.withColumns({"__at": F.col(order), "__key": F.lower(folder), "__name": n, "__low": F.lower(n), "__family": family})
    kinds = rows.groupBy("__key", "__family").agg((F.min("__low") != F.max("__low")).alias("__crowded"))
    rows = turns(rows, ["__key", "__low"], ["__at"], "__turn").join(kinds, ["__key", "__family"])
    turn = F.col("__turn")
    numbered = F.concat(stem(n), F.format_string("__dup%02d", turn), suffix(n))
    fast = rows.where("not __crowded").withColumn("__given", F.when(turn == 1, n).otherwise(numbered))
    slow = rows.where("__crowded")
    kind = plan.schema[order].dataType.simpleString()
    given = slow.select("__at", "__key", "__family", "__name").groupBy("__key", "__family").applyInPandas(_allocate_family, f"__at {kind}, __key string, __given string")
    slow = slow.join(given, ["__at", "__key"]).select(*fast.columns)
    both = fast.unionByName(slow).withColumn(out, F.concat_ws("/", folder, "__given"))
    return both.drop("__at", "__key", "__name", "__low", "__family", "__turn", "__crowded", "__given")
