"""Chat formatting by a declarative template and a finite-state machine over roles, in SQL functions alone.

A template states for each role the marks around its text and whether the text is learned, and the moves of the machine. Every
turn becomes segments of text with a loss flag each; a conversation is its segments in the order of its turns, and the machine
runs over its roles and tells where it ends and which turn it refuses first. Nothing is dropped: conversations that the machine
refuses are formatted as well and marked.

Inside texts and role names a backslash is doubled, and each control string gets a backslash behind its first character, so no
control string is left there and ``unescaped`` gives the text back. ``turns_of`` reads a formatted conversation back.

Rows are shuffled once, by conversation; a group is as large as the conversation that is returned. ``turn_segments`` gives the
segments of each turn without any shuffle, for turns that are too many for one value.

Defined results: a null text or role is an empty one. Turns are in the order of ``turn``, null last; ties by role, then text,
and repeated rows are turns of their own. Roles outside the template have marks that name them. Rows without a conversation
id do not belong together: each is a conversation of one turn. An empty table gives no rows. Other columns are never looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Turn:
    """What stands around a role's text, and whether the text counts in the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``turns`` by role; ``other`` for any role else, with ``named`` between its name and text. ``moves`` by state and role;
    a missing move refuses the turn. ``controls``: strings that no text may hold."""

    turns: dict[str, Turn]
    other: Turn
    named: str
    moves: dict[str, dict[str, str]]
    start: str
    ends: tuple[str, ...]
    controls: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for mark in (self.named, *(m for t in (*self.turns.values(), self.other) for m in (t.before, t.after))):
            if not any(c in mark for c in self.controls):
                raise ValueError(f"the mark {mark!r} holds no control string")
        befores = [t.before for t in (*self.turns.values(), self.other)]
        if any(a is not b and a.startswith(b) for a in befores for b in befores):
            raise ValueError("a mark begins with another one")
        if any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")


TEMPLATE = Template(
    turns={
        "system": Turn("<<SYS>> ", " <</SYS>>\n"),
        "user": Turn("[INST] ", " [/INST]\n"),
        "assistant": Turn("<s> ", " </s>\n", loss=True),
    },
    other=Turn("[ROLE] ", " [/ROLE]\n"),
    named=" [TEXT] ",
    moves={
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    start="start",
    ends=("asked", "answered"),
    controls=("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]"),
)


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    """Text without control strings. The lookahead sees each occurrence, also one that begins within another."""
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(template.controls))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({starts})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segment(text: Column, loss: bool | Column = False) -> Column:
    return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))


def turn_segments(role: Column, text: Column, template: Template = TEMPLATE) -> Column:
    """The segments of a turn: array<struct<text, loss>>."""
    role, body = F.coalesce(role, F.lit("")), escaped(F.coalesce(text, F.lit("")), template)
    known = {name: (F.lit(t.before), t.loss, t.after) for name, t in template.turns.items()}
    named = F.concat(F.lit(template.other.before), escaped(role, template), F.lit(template.named))
    before, after, loss = named, F.lit(template.other.after), F.lit(template.other.loss)
    for name, (b, learned, a) in known.items():
        here = role == name
        before, after, loss = F.when(here, b).otherwise(before), F.when(here, F.lit(a)).otherwise(after), F.when(here, F.lit(learned)).otherwise(loss)
    return F.array(_segment(before), _segment(body, loss), _segment(after))


def machine(roles: Column, template: Template = TEMPLATE) -> Column:
    """Runs the moves over an array of roles: struct<state, refused>, the state reached and the place of the first turn that
    has no move, from 0; null if all have one."""
    moves = [F.lit(x) for state, by_role in template.moves.items() for role, then in by_role.items() for x in (f"{state}\n{role}", then)]
    table_, start = F.create_map(*moves), F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("long").alias("refused"), F.lit(0).cast("long").alias("at"))

    def step(now: Column, role: Column) -> Column:
        then = F.try_element_at(table_, F.concat_ws("\n", now["state"], role))
        stop = F.when(now["refused"].isNotNull(), now["refused"]).when(then.isNull(), now["at"])
        return F.struct(F.coalesce(then, now["state"]).alias("state"), stop.alias("refused"), (now["at"] + 1).alias("at"))

    return F.aggregate(roles, start, step, lambda end: F.struct(end["state"].alias("state"), end["refused"].alias("refused")))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, state, refused (the first turn against the order) and valid."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    # null ids are told apart by a number of the row
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    own = turns.select("conv_id", alone.alias("alone"), F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text").alias("t"))
    whole = own.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.select("conv_id", F.flatten(F.transform("turns", lambda t: turn_segments(t["role"], t["text"], template))).alias("segments"), machine(F.transform("turns", lambda t: t["role"]), template).alias("m"))
    valid = F.col("m.refused").isNull() & F.col("m.state").isin(*template.ends)
    return whole.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "m.state", "m.refused", valid.alias("valid"))


def turns_of(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>>: a formatted conversation read back by its marks."""
    befores = [t.before for t in (*template.turns.values(), template.other)]
    pieces = F.split(formatted, f"(?={'|'.join(map(re.escape, befores))})", -1)

    def inner(piece: Column, turn: Turn) -> Column:
        return F.substring(piece, F.lit(len(turn.before) + 1), F.length(piece) - len(turn.before) - len(turn.after))

    def read(piece: Column) -> Column:
        body = inner(piece, template.other)
        name = F.substring_index(body, template.named, 1)
        role, text = name, F.substring(body, F.length(name) + len(template.named) + 1, F.length(body))
        for known, turn in template.turns.items():
            here = F.startswith(piece, F.lit(turn.before))
            role, text = F.when(here, F.lit(known)).otherwise(role), F.when(here, inner(piece, turn)).otherwise(text)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, read)


def digest(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What can be read back of formatted conversations: turns from the text, learned text from the flags."""
    read = chats.select("conv_id", "formatted", "valid", turns_of(F.col("formatted"), template).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op11_chat(spark, sf_dir):
    """All conversations, and one whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -7 AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'")
    odd = odd.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    return digest(format_conversations(rows.unionByName(odd)))


def _oracle(template: Template = TEMPLATE) -> str:
    body = r"replace(text, '\', '\\')"
    for c in template.controls:
        body = f"replace({body}, '{c}', '{c[0]}\\{c[1:]}')"
    sizes = " ".join(f"WHEN '{name}' THEN {len(t.before) + len(t.after)}" for name, t in template.turns.items())
    learned = ", ".join(f"'{name}'" for name, t in template.turns.items() if t.loss)
    moves = ", ".join(f"('{state}', '{role}', '{then}')" for state, by_role in template.moves.items() for role, then in by_role.items())
    ends = ", ".join(f"'{e}'" for e in template.ends)
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, {body} AS body FROM t),
moves(state, role, next) AS (VALUES {moves}),
walk AS (SELECT DISTINCT conv_id, 0 AS k, '{template.start}' AS state FROM n
  UNION ALL SELECT walk.conv_id, n.k, moves.next FROM walk JOIN n ON n.conv_id = walk.conv_id AND n.k = walk.k + 1 JOIN moves ON moves.state = walk.state AND moves.role = n.role),
reached AS (SELECT conv_id, max(k) AS k, arg_max(state, k) AS state FROM walk GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
      coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({learned})), '') AS learned, sum(length(body) + CASE role {sizes} END) AS formatted_chars FROM n GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, r.k = n_turns AND r.state IN ({ends}) AS valid
FROM g JOIN reached r USING (conv_id)
"""


OP11_SQL = _oracle()
