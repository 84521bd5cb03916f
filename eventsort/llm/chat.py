"""Chat formatting: transcripts are parsed by a hidden Markov model, then rendered.

A conversation is the sequence of the lines of its rows. A line's features are
its speaker marker (the row's given speaker on its first line, or a prefix such
as "User:" in the text), its length and whether it asks. Hidden states are the
roles; a change of role is likely where a row or a marker begins and unlikely
elsewhere. Viterbi finds the likeliest roles; lines without a marker, or with one
that says nothing, get theirs from their surroundings. Consecutive lines of one
role and row are a turn, rendered as ``<|role|>``, its text, ``<|end|>``.

A marker is taken out of the text only where the path agrees with it and a turn
begins there, that is on a row's first line or where the role changes; anywhere
else it is text, so nothing else of a text is lost. Words that are common in
ordinary text are markers only in rows without a known speaker, letters never are.

Conversations may be of any length: rows are dealt by ranges of (conversation,
turn), so that a long one spans tasks, and the number of ranges follows the bytes.
The best way through a run of lines from each state to each is a small matrix; the
driver chains the matrices of the first and last conversation of every range (two
of nine numbers at most) and tells each range the states at its borders.

Cases: null text is one empty line; unknown, empty or null speakers are no
marker; a null conversation is one of its own; rows with equal turns are ordered
by speaker and a hash of the text; repeated rows are repeated turns, and may span
tasks too; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path, type_of, write_table

ROLES = ("system", "user", "assistant")

# What given speakers are called.
NAMES = {
    "system": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "prompter": "user", "question": "user", "q": "user",
    "assistant": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant",
}
# Names that mark a speaker within a text, and those that do so only in rows without a known speaker.
MARKERS, LOOSE = ("system", "user", "human", "assistant"), ("customer", "prompter", "bot", "ai", "agent")
_MARKER = re.compile(r"[\s\[<(*#|]*(" + "|".join(MARKERS + LOOSE) + r")[\s\])>*|]*:[ \t]*", re.IGNORECASE)
#: Bytes of text, and rows, that a range of rows holds, about.
RANGE_BYTES, RANGE_ROWS = 32 << 20, 200_000

#: The model: probabilities by role in the order of ROLES.
START = np.log([0.30, 0.65, 0.05])
TURN = np.log([[0.02, 0.88, 0.10], [0.02, 0.13, 0.85], [0.02, 0.90, 0.08]])
STAY = np.log(np.full((3, 3), 0.01) + np.eye(3) * 0.97)
MARKED, OTHER = np.log(0.96), np.log(0.02)
LONG = np.log([[0.45, 0.35, 0.20], [0.45, 0.40, 0.15], [0.25, 0.35, 0.40]])  # under 60, under 300, longer
ASKS = np.log([[0.98, 0.02], [0.80, 0.20], [0.95, 0.05]])


def _nudge(turn: int | None, line: int) -> np.ndarray:
    """A tiny preference among roles, fixed by place: equally likely paths are told
    apart in the same way however the rows are dealt to tasks."""
    return np.array([zlib.crc32(f"{turn}:{line}:{k}".encode()) for k in range(len(ROLES))]) * (1e-6 / 2**32)


class Line(NamedTuple):
    """A line: whether a turn may begin, emission by role, its text, its marker's role and the text after the marker."""

    begins: bool
    score: np.ndarray
    text: str
    marked: int | None
    rest: str


def _lines(text: str | None, speaker: str | None, turn: int | None = None) -> list[Line]:
    """The lines of a row."""
    out = []
    given = NAMES.get((speaker or "").strip().lower())
    for k, line in enumerate((text or "").split("\n")):
        found = _MARKER.match(line)
        if found and given and found[1].lower() in LOOSE:
            found = None
        rest = line[found.end() :] if found else line
        marked = NAMES[found[1].lower()] if found else None
        n = len(rest)
        score = LONG[:, 0 if n < 60 else 1 if n < 300 else 2] + ASKS[:, int(rest.rstrip().endswith("?"))] + _nudge(turn, k)
        for name in (marked, None if k else given):
            if name:
                score = score + np.where(np.array(ROLES) == name, MARKED, OTHER)
        out.append(Line(not k or marked is not None, score, line, ROLES.index(marked) if marked else None, rest))
    return out


def _turns(lines: list[Line], states: list[int]) -> list[tuple[int, list[str]]]:
    """(role, lines) of the turns of a row. A marker goes where a turn of its role begins."""
    out: list[tuple[int, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        new = not out or out[-1][0] != state
        if new:
            out.append((state, []))
        out[-1][1].append(line.rest if new and line.marked == state else line.text)
    return out


def _chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best sums over the middle state."""
    return (a[:, :, None] + b[None]).max(1)


def _through(lines: list, first: bool) -> np.ndarray:
    """(state before, state at the end): best score of the way through ``lines``.

    ``first``: the conversation begins here, so the state before says nothing."""
    out = None
    for begins, score, *_ in lines:
        if out is None:
            step = (np.broadcast_to(START, (3, 3)) if first else TURN if begins else STAY) + score
            out = step
        else:
            out = _chain(out, (TURN if begins else STAY) + score)
    return out


def _viterbi(lines: list, before: int | None, last: int | None) -> list[int]:
    """States of ``lines`` given the state before them and, if known, the last state."""
    best, back = None, []
    for begins, score, *_ in lines:
        if best is None:
            best = (START if before is None else (TURN if begins else STAY)[before]) + score
            continue
        ways = best[:, None] + (TURN if begins else STAY)
        back.append(ways.argmax(0))
        best = ways.max(0) + score
    states = [int(best.argmax()) if last is None else last]
    for pointer in reversed(back):
        states.append(int(pointer[states[-1]]))
    return states[::-1]


def _conversations(rows: pa.Table) -> list[tuple[int, int]]:
    """Row ranges of the conversations of a sorted table."""
    key = rows.column("conv_id").to_pylist()
    cuts = [k for k in range(len(key)) if not k or key[k] != key[k - 1]]
    return list(zip(cuts, [*cuts[1:], len(key)], strict=True))


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("number", "ascending")])


def _borders(rows: pa.Table) -> pa.Table:
    """Matrices of a range's first and last conversation, both as at its beginning and not."""
    rows = _sorted(rows)
    ranges = _conversations(rows)
    texts, speakers, turns = (rows.column(c).to_pylist() for c in ("text", "role", "turn"))
    out = []
    for at in sorted({0, len(ranges) - 1}):
        a, b = ranges[at]
        lines = [x for k in range(a, b) for x in _lines(texts[k], speakers[k], turns[k])]
        conv = rows.column("conv_id")[a].as_py()
        out.append((rows.column("pid")[0].as_py(), at, len(ranges), None if conv is None else str(conv), _through(lines, True).ravel().tolist(), _through(lines, False).ravel().tolist()))
    names = ("pid", "at", "n", "conv", "first", "next")
    types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out, strict=True), types, strict=True)})


def _border_states(found: list) -> dict[int, tuple[int | None, int | None]]:
    """For each range, the state before its first line and that of its last line,
    where a conversation crosses the border."""
    found = sorted(found, key=lambda r: (r["pid"], r["at"]))
    runs: list[list] = []
    for r in found:
        last = runs[-1][-1] if runs else None
        joins = last is not None and last["conv"] == r["conv"] and last["pid"] != r["pid"] and last["at"] == last["n"] - 1 and r["at"] == 0
        if joins:
            runs[-1].append(r)
        else:
            runs.append([r])
    before: dict[int, int] = {}
    after: dict[int, int] = {}
    for run in runs:
        if len(run) < 2:
            continue
        matrices = [np.reshape(r["first"] if not k else r["next"], (3, 3)) for k, r in enumerate(run)]
        scores = [matrices[0][0]]
        for m in matrices[1:]:
            scores.append((scores[-1][:, None] + m).max(0))
        state = int(scores[-1].argmax())
        for k in range(len(run) - 1, -1, -1):
            if run[k]["at"] == run[k]["n"] - 1:  # else another conversation ends the range
                after[run[k]["pid"]] = state
            if k:
                state = int((scores[k - 1] + matrices[k][:, state]).argmax())
                before[run[k]["pid"]] = state
    return {pid: (before.get(pid), after.get(pid)) for pid in {*before, *after}}


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}<|end|>\n"


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, part, given_role, role, n_lines, rendered) of every turn found in
    rows (conv_id, turn, role, text). ``part`` counts the turns within a row."""
    spark = rows.sparkSession
    picked = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    size = picked.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    ranges = max((size["bytes"] or 0) // RANGE_BYTES, size["rows"] // RANGE_ROWS)
    more = [ranges] if ranges > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    # rows that are equal in all columns are told apart, so that they too can span ranges; which is which doesn't show
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "copy"]
    dealt = picked.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*more, *order).sortWithinPartitions(*order).drop("copy")
    table = write_table(dealt.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("number")), new_path(spark, "turns"))
    found = table.groupBy("pid").applyInArrow(_borders, "pid int, at int, n int, conv string, first array<double>, next array<double>").collect()
    states = _border_states([r.asDict() for r in found])

    def parse(part: pa.Table) -> pa.Table:
        part = _sorted(part)
        ranges = _conversations(part)
        before, after = states.get(part.column("pid")[0].as_py(), (None, None))
        texts, speakers, numbers = (part.column(c).to_pylist() for c in ("text", "role", "turn"))
        at, index, roles, counts, rendered = [], [], [], [], []
        for k, (a, b) in enumerate(ranges):
            lines = [_lines(texts[i], speakers[i], numbers[i]) for i in range(a, b)]
            path = iter(_viterbi([x for row in lines for x in row], before if not k else None, after if k == len(ranges) - 1 else None))
            for i, row in zip(range(a, b), lines, strict=True):
                for j, (state, kept) in enumerate(_turns(row, [next(path) for _ in row])):
                    at.append(i)
                    index.append(j)
                    roles.append(ROLES[state])
                    counts.append(len(kept))
                    rendered.append(render(ROLES[state], "\n".join(kept)))
        take = pa.array(at, pa.int64())
        return pa.table({"conv_id": part.column("conv_id").take(take), "turn": part.column("turn").take(take), "part": pa.array(index, pa.int32()), "given_role": part.column("role").take(take), "role": pa.array(roles, pa.string()), "n_lines": pa.array(counts, pa.int64()), "rendered": pa.array(rendered, pa.string())})

    return table.groupBy("pid").applyInArrow(parse, f"conv_id {type_of(picked, 'conv_id')}, turn long, part int, given_role string, role string, n_lines long, rendered string")
