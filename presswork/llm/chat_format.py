r"""Conversations as one text, proved by reparsing it.

A turn is written <|turn|>role, a line end, the text, <|end|>, a line end. A deterministic parser reads the text back;
where its turns aren't those that went in, the text and role in conflict are escaped, until they are: each "<" that
backslashes and a bar follow gets one backslash more, which the parser takes off. <|null|> stands for a null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import has

TURN, END, NULL = "<|turn|>", "<|end|>", "<|null|>"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

Turn = tuple[str | None, str | None]


class Malformed(ValueError):
    """A text that isn't the rendering of any turns."""


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str | None, level: int) -> str:
    if role is None:
        return NULL
    return escape(role).replace("%", "%25").replace("\n", "%0A") if level else role


def render_turn(turn: Turn, level: int) -> str:
    role, text = turn
    return f"{TURN}{_role(role, level)}\n{NULL if text is None else escape(text) if level else text}{END}\n"


def parse(rendered: str) -> list[Turn]:
    """The turns of a rendered text; Malformed where it isn't one."""
    out: list[Turn] = []
    here = 0
    while here < len(rendered):
        if not rendered.startswith(TURN, here):
            raise Malformed(f"no turn at {here}")
        line = rendered.find("\n", here)
        end = rendered.find(END, here)
        if line < 0 or end < line or not rendered.startswith("\n", end + len(END)):
            raise Malformed(f"no end of the turn at {here}")
        role, text = rendered[here + len(TURN) : line], rendered[line + 1 : end]
        if TURN in text or TURN in role:
            raise Malformed(f"a turn within the turn at {here}")
        out.append((None if role == NULL else unescape(role).replace("%0A", "\n").replace("%25", "%"), None if text == NULL else unescape(text)))
        here = end + len(END) + 1
    return out


def render(turns: list[Turn]) -> tuple[str, int]:
    """(text, turns that had to be escaped). parse(text) is turns."""
    parts, escaped = [], 0
    for turn in turns:
        for level in (0, 1):
            part = render_turn(turn, level)
            try:
                if parse(part) == [turn]:
                    break
            except Malformed:
                pass
        else:
            raise AssertionError(f"no rendering of {turn!r} can be read back")
        parts.append(part)
        escaped += level
    text = "".join(parts)
    if parse(text) != list(turns):
        raise AssertionError("the conversation can't be read back")
    return text, escaped


def chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_escaped, rendered) for each conversation, its turns by turn, then role, then text, nulls first.

    Every rendering has been parsed and found to be its turns. A null role or text is <|null|>, an empty one empty. Rows with a null conv_id are one
    conversation; repeated rows, and turns of one number, are turns each; a very long text, or conversation, is rendered whole in one row; an empty table
    gives an empty result; other columns, whatever their names, are ignored.
    """
    few = has(conversations, "conv_id", "turn", "role", "text")
    turns = few.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # whole conversations, from the flat columns
            lists = batch.column("turns")
            offsets = lists.offsets.to_pylist()
            base, flat = offsets[0] if offsets else 0, lists.flatten()
            pairs = list(zip(flat.field("role").to_pylist(), flat.field("text").to_pylist()))
            done = [render(pairs[a - base : b - base]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(pa.int64()), pa.array([b - a for a, b in zip(offsets, offsets[1:])], pa.int32()), pa.array([e for _, e in done], pa.int32()), pa.array([t for t, _ in done], pa.string())], ["conv_id", "n_turns", "n_escaped", "rendered"])

    return turns.mapInArrow(run, "conv_id long, n_turns int, n_escaped int, rendered string")


#: The same in DuckDB. A turn is escaped where a mark stands in it, or what the parser would take for an escape or a null.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text,
    coalesce(contains(text, '<|turn|>') OR contains(text, '<|end|>') OR text = '<|null|>' OR regexp_matches(text, '<\\+\|'), false)
    OR coalesce(contains(role, '<|turn|>') OR contains(role, '<|end|>') OR role = '<|null|>' OR regexp_matches(role, '<\\+\|')
      OR contains(role, chr(10)) OR contains(role, '%0A') OR contains(role, '%25'), false) AS bad
  FROM conversations
)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (bad) AS INTEGER) AS n_escaped,
  string_agg('<|turn|>' || CASE WHEN role IS NULL THEN '<|null|>' WHEN bad THEN
      replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '%', '%25'), chr(10), '%0A') ELSE role END || chr(10)
    || CASE WHEN text IS NULL THEN '<|null|>' WHEN bad THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END || '<|end|>' || chr(10),
    '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM t GROUP BY conv_id
"""
