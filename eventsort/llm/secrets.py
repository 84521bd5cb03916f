"""Secret scans, in DataFrame expressions only.

Base kinds are patterns; the method adds spans: maximal runs of key characters
are candidates, and a window of ``window`` characters slides over each, keeping
the count of every character of its class and the sum of c*log2(c). One step adds
the entering character and takes away the leaving one; the window's Shannon
entropy is log2(window) - sum/window. A candidate is a secret if a window reaches
its class's threshold, unless an allow-list pattern matches it or a base span
overlaps it. The same holds for each of its parts between separators that is as
long as a window, so that nothing beside a key hides it; the span is the whole run.

A text is one row of one task: nothing is shuffled, exploded or collected.

Cases: a null text counts as empty (no spans, digest of the empty string); null
ids and repeated rows stay; an empty table gives an empty table; columns other
than the named id and text are kept out, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

# The base kinds' patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # greedy: as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # greedy: as [0-9a-f]+ of 24 characters or more


@dataclass(frozen=True)
class CharacterClass:
    """Candidates made of ``alphabet`` alone that match all of ``needs``."""

    name: str
    alphabet: str
    threshold: float
    needs: tuple[str, ...]


#: In this order; a candidate belongs to the first class that takes it.
CLASSES = (
    CharacterClass("hex", "0123456789ABCDEFabcdef", 2.9, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("key", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.6, ("[0-9]", "[A-Z]", "[a-z]")),
    # digits and one letter case, as in base36 and base32: digits in two places at least, which words with a number lack
    CharacterClass("lower", "0123456789abcdefghijklmnopqrstuvwxyz", 3.5, ("[0-9]+[a-z]+[0-9]",)),
    CharacterClass("upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.5, ("[0-9]+[A-Z]+[0-9]",)),
)
#: Candidates that match one of these are no secrets. Groups repeat possessively: others
#: take a stack frame a round, which a very long candidate has too many of.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",  # identifiers in the usual form
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"(?i)0123456789|abcdefghij|(.)\1{7}",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([-_/][A-Za-z]+)*+([-_/T]?[0-9]{1,6})?$",  # dates, with words or a time
    r"^[A-Za-z]+[0-9]{0,4}([-_/][A-Za-z]+)*+[-_/][0-9]{1,4}$",  # slugs with a number
)
WINDOW = 20
#: What parts of a candidate stand between.
SEPARATOR = "[+/_=-]"
#: Matches that are added up at a time.
BLOCK = 256

_SPANS = "array<struct<start:int,end:int>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _none() -> Column:
    return F.array().cast(_SPANS)


def match_spans(text: Column, head: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Code-point spans of the leftmost non-overlapping matches of ``pattern``
    whose ``group`` has ``least`` characters; looked for only where ``head`` holds.

    The text between matches and the matches, laid end to end, give the places.
    They are added up in blocks, so that a text with very many matches is not
    copied once for each."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.zip_with(matches, values, lambda m, v: F.struct(F.char_length(m).alias("long"), F.char_length(v).alias("value")))
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, f: F.struct(F.char_length(gap).alias("gap"), f["long"].alias("long"), f["value"].alias("value")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["long"], F.lit(0))
        more = F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["value"] >= least, more).otherwise(state["out"]).alias("out"))

    def within(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), _none().alias("out")), step, lambda s: s["out"])

    def in_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["long"], F.lit(0))))
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, nothing, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, starts, within))

    def cut(all_steps: Column) -> Column:
        last = F.floor((F.size(all_steps) - 1) / BLOCK).cast("int")
        return _once(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_steps, b * BLOCK + 1, F.lit(BLOCK))), in_blocks)

    return F.when(head, _once(steps, cut)).otherwise(_none())


def _clogc(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def peak_entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of a window over ``candidate``."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c))
    # each step needs the character that leaves: the same codes, ``window`` later
    leaving = F.concat(F.array_repeat(F.lit(0), window), codes)
    pairs = F.slice(F.arrays_zip(codes.alias("new"), leaving.alias("old")), 1, F.char_length(candidate))

    def step(s: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        had = F.element_at(s["counts"], new)
        total = s["sum"] + _clogc(had + 1) - _clogc(had)
        of_old = F.element_at(s["counts"], F.greatest(old, F.lit(1))) + F.when(old == new, 1).otherwise(0)
        total = F.when(old > 0, total + _clogc(of_old - 1) - _clogc(of_old)).otherwise(total)
        counts = F.transform(s["counts"], lambda c, i: c + F.when(i + 1 == new, 1).otherwise(0) - F.when(i + 1 == old, 1).otherwise(0))
        seen = s["seen"] + 1
        entropy = F.when(seen >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("sum"), seen.alias("seen"), F.greatest(s["best"], entropy).alias("best"))

    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(0.0).alias("best"))
    return F.aggregate(pairs, zero, step, lambda s: s["best"])


def _suspicious(candidate: Column, classes: Sequence[CharacterClass], allowed: Sequence[str], window: int) -> Column:
    out = F.lit(False)
    for c in reversed(classes):
        of_class = candidate.rlike("^[" + c.alphabet.replace("-", "\\-") + "]+$")
        for need in c.needs:
            of_class &= candidate.rlike(need)
        out = F.when(of_class, peak_entropy(candidate, c.alphabet, window) >= c.threshold).otherwise(out)
    for pattern in allowed:
        out = F.when(candidate.rlike(pattern), F.lit(False)).otherwise(out)
    return out


def entropy_spans(text: Column, classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED, window: int = WINDOW) -> Column:
    pattern = f"[A-Za-z0-9+/_=-]{{{window},}}"
    # runs with a digit, each looked at from its beginning only
    head = f"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{{window},}}"
    part = f"[A-Za-z0-9]{{{window},}}"
    spans = match_spans(text, F.lit(True), pattern)
    texts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bad_part = lambda t: F.exists(F.regexp_extract_all(t, F.lit(part), F.lit(0)), lambda p: _suspicious(p, classes, allowed, window))
    is_bad = lambda t: _suspicious(t, classes, allowed, window) | (t.rlike(SEPARATOR) & bad_part(t))
    judged = F.zip_with(spans, texts, lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), is_bad(t).alias("bad")))
    bad = F.transform(F.filter(judged, lambda x: x["bad"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(head), bad).otherwise(_none())


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED, window: int = WINDOW, carry: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, text, assign, access, hex, entropy, *carry): each row's spans by kind,
    as arrays of (start, end) in code points, end exclusive, in order."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), *carry)
    names = rows.columns[2:]
    t = F.col("text")
    found = rows.select(
        "doc_id",
        "text",
        match_spans(t, t.rlike(ASSIGN_HEAD), ASSIGN, 2, 6).alias("assign"),
        match_spans(t, t.contains("AKIA"), ACCESS).alias("access"),
        match_spans(t, t.rlike(HEX), HEX).alias("hex"),
        entropy_spans(t, classes, allowed, window).alias("found"),
        *names,
    )
    base = F.concat("assign", "access", "hex")
    clear = F.filter("found", lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.select("doc_id", "text", "assign", "access", "hex", F.when(F.size("found") > 0, clear).otherwise(F.col("found")).alias("entropy"), *names)


def joined(kinds: Sequence[str]) -> Column:
    """kind:start:end of all spans of ``kinds`` by start, then kind, comma-joined."""
    def tagged(kind: str) -> Column:
        number = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), number, s["end"].alias("end")))

    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*map(tagged, kinds))), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """What ``scan`` returned without the spans; each run of overlapping spans is replaced by ``mask``.

    The characters of a text with spans become an array once, and each gap between
    spans is a slice of it, so a text is not copied once for each span."""
    spans = F.array_sort(F.concat(*KINDS[:4]))

    def step(s: Column, x: Column) -> Column:
        gap = F.array(F.struct(s["at"].alias("start"), x["start"].alias("end")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["gaps"], gap)).otherwise(s["gaps"]).alias("gaps"))

    def kept(chars: Column) -> Column:
        last = lambda s: F.concat(s["gaps"], F.array(F.struct(s["at"].alias("start"), F.size(chars).alias("end"))))
        gaps = F.aggregate(spans, F.struct(F.lit(0).alias("at"), _none().alias("gaps")), step, last)
        return F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(chars, g["start"] + 1, g["end"] - g["start"]), "")), mask)

    text = F.when(F.size(spans) > 0, _once(F.split("text", ""), kept)).otherwise(F.col("text"))
    return scanned.select("doc_id", text.alias("text"), *scanned.columns[6:])
