"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: text </turn>`` and a line end.  A deterministic parser reads it
back; where what it recovers isn't the source turn, the conflicting content is escaped one step
further and the turn rendered and parsed anew, until they are identical.

The grammar: a turn starts with a header, ``### `` + name + ``: ``.  The text runs to the first
close mark without a backslash before it.  A mark in the text (a close mark, or a header up to its
colon) has one backslash more before it than in the source, which the parser takes away.  Marks have no
blank at either end, so none lies across the border of a text.  A role other than the usual ones is
spelled with percent codes, after ``=``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import bound_batches

NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ROLES = {name: role for role, name in NAMES.items()}
CLOSE = " </turn>\n"
MARK = re.compile(r"(\\*)(### (?:System|User|Assistant|Tool|=[^\s:]*):|</turn>)")
HEADER = re.compile(r"### (System|User|Assistant|Tool|=[^\s:]*): ")
LOSS_ROLE = "assistant"


class GrammarError(ValueError):
    """Rendered text that the grammar doesn't have."""


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of rendered text."""
    turns, at = [], 0
    while at < len(rendered):
        head = HEADER.match(rendered, at)
        if not head:
            raise GrammarError(f"no header at {at}")
        name, text, start = head[1], [], head.end()
        at = -1
        for m in MARK.finditer(rendered, start):
            if m[1]:
                text += [rendered[start : m.start()], m[1][1:], m[2]]
                start = m.end()
            elif m[2] != "</turn>":
                raise GrammarError(f"a header inside a turn at {m.start()}")
            else:
                at = m.start() - 1
                break
        if at < start or rendered[at : at + len(CLOSE)] != CLOSE:
            raise GrammarError("a turn that isn't closed")
        turns.append((unquote(name[1:]) if name[0] == "=" else ROLES[name], "".join([*text, rendered[start:at]])))
        at += len(CLOSE)
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, where its text starts in it, and the steps of escaping that it took."""
    name = NAMES.get(role, f"={quote(role, safe='', errors='replace')}")
    header, body = f"### {name}: ", text
    for step in range(2):
        rendered = f"{header}{body}{CLOSE}"
        try:
            if parse(rendered) == [(role, text)]:
                return rendered, len(header), step
        except GrammarError:
            pass
        body = MARK.sub(r"\\\g<0>", text)
    raise GrammarError(f"the turn doesn't survive its own escape: {role!r}")


def format_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn: conv, turn, role, rendered, loss_start, loss_stop, escapes.

    A conversation is its rows' ``rendered`` in order of turn (ties by role, then rendered; null
    turns first).  loss_start and loss_stop bound the text of a turn that is learned from in code
    points of ``rendered``, null for others.  Null roles and texts are empty ones; a null conv is a
    conversation of its own; repeated rows are repeated turns, texts are kept whole whatever their
    length, an empty table gives an empty one, and other columns, whatever their names, aren't looked at.
    """
    bound_batches(conversations.sparkSession)

    @F.pandas_udf("rendered string, loss_start long, loss_stop long, escapes int")
    def run(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for r, t in zip(roles, texts):
            r, t = r or "", t or ""
            rendered, start, step = render(r, t)
            loss = r == LOSS_ROLE
            rows.append((rendered, start if loss else None, len(rendered) - len(CLOSE) if loss else None, step))
        return pd.DataFrame(rows, columns=["rendered", "loss_start", "loss_stop", "escapes"]).astype({"loss_start": "Int64", "loss_stop": "Int64"})

    own = conversations.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.col(f"`{text}`").alias("text"))
    return own.select("conv", "turn", "role", run("role", "text").alias("r")).select("conv", "turn", "role", "r.*")


FIELDS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
DIGEST = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations whose turns come one after the other; memory holds one batch."""
    now, rows, begun = None, [], False

    def new(conv):
        return [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def done():
        return [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]]

    for batch in batches:
        for conv, rendered, start, stop in zip(batch["conv"], batch["rendered"], batch["loss_start"], batch["loss_stop"]):
            conv = None if pd.isna(conv) else conv
            if not begun or now[0] != conv:
                if begun:
                    rows.append(done())
                now, begun = new(conv), True
            for role, text in parse(rendered):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            now[5] += len(rendered)
            if not pd.isna(start):  # the mask bounds the text as rendered; unescaped it is the turn's text again
                loss = MARK.sub(lambda m: m[0][1:] if m[1] else m[0], rendered[int(start) : int(stop)])
                now[3] += len(loss)
                now[4].update(loss.encode("utf-8", "replace"))
        yield pd.DataFrame(rows, columns=["conv", *FIELDS])
        rows = []
    if begun:
        yield pd.DataFrame([done()], columns=["conv", *FIELDS])


def read_back(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of each conversation, read back from ``format_turns``'s output by the parser.

    Columns: ``conv`` (of the type that it has in the source; a null one is a conversation), n_turns,
    turns_sha256, loss_chars, loss_sha256 and formatted_chars; an empty table gives none.  A digest runs
    over a conversation in order, so its turns meet in one task; they stream through it, and memory
    doesn't grow with them.
    """
    kind = turns.schema["conv"].dataType
    own = turns.select(F.col("conv").cast("string").alias("conv"), "turn", "role", "rendered", "loss_start", "loss_stop")
    ordered = own.repartition("conv").sortWithinPartitions("conv", "turn", "role", "rendered")
    return ordered.mapInPandas(_digests, DIGEST).select(F.col("conv").cast(kind).alias(conv), *FIELDS)
