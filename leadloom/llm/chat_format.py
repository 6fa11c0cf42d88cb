"""Conversations of any layout as canonical turns, and turns as training strings.

Records differ in layout: one row per turn, a list of messages, an instruction with
its output, a prompt with its completion.  A layout is a set of nested field paths
and a declarative mapping of them onto turns.  Hashing the paths that a table (by
its schema) or a JSON record (by its keys) has selects the mapping, so one job
converts records of all layouts.  Everything is a native column expression.

A formatted conversation is a sequence of pieces of at most ``PIECE_TURNS`` turn
numbers, so a conversation of any length is spread over tasks.  Texts are escaped:
a backslash goes before every backslash and after the first character of every
control string, so a control string in the output is always the template's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Turn numbers that one piece of a formatted conversation spans.
PIECE_TURNS = 64

TURN = "array<struct<role:string,text:string>>"


# -- layouts -----------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and how they become turns.

    ``messages`` is ``(list field, role field, text field)``; ``parts`` are ``(role, fields)``
    in turn order, filled fields of a part joined by an empty line.  ``row`` is ``(turn, role,
    text)`` where every row is a turn already.  ``roles`` renames roles.
    """

    name: str
    messages: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str, str] | None = None
    roles: Mapping[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> tuple[str, ...]:
        if self.messages:
            items, role, text = self.messages
            return (items, f"{items}[].{role}", f"{items}[].{text}")
        return self.row or tuple(f for _, fields in self.parts for f in fields)

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)

    @property
    def ddl(self) -> str:
        if self.messages:
            items, role, text = self.messages
            return f"`{items}` array<struct<`{role}`:string,`{text}`:string>>"
        return ", ".join(f"`{p}` string" for p in self.paths)


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Tried in this order; the first whose paths are all there is taken.
LAYOUTS = (
    Layout("messages", messages=("messages", "role", "content")),
    Layout("conversations", messages=("conversations", "from", "value"), roles=_SPEAKERS),
    Layout("system_instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_input", parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("rows", row=("turn", "role", "text")),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def schema_paths(schema: T.StructType, above: str = "") -> list[str]:
    """Nested field paths of a schema; ``[]`` stands for the elements of a list."""
    found = []
    for f in schema.fields:
        path, kind = above + f.name, f.dataType
        found.append(path)
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        if isinstance(kind, T.StructType):
            found += schema_paths(kind, path + ".")
    return found


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def layout_of(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> Layout:
    """The layout whose fingerprint the table's paths have; other columns do not count."""
    paths = set(schema_paths(df.schema))
    for layout in layouts:
        if fingerprint(paths & set(layout.paths)) == layout.fingerprint:
            return layout
    raise ValueError(f"no layout has these fields: {', '.join(sorted(paths))}")


def json_layout(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Name of the layout of a JSON record, null if it has none of them."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    lists = sorted({x.messages[0] for x in layouts if x.messages})

    def below(name: str) -> Column:
        inner = F.json_object_keys(F.get_json_object(record, f"$.{name}[0]"))
        return F.transform(
            F.coalesce(inner, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{name}[]."), k)
        )

    paths = F.concat(keys, *map(below, lists))
    named = [
        F.when(
            F.sha2(
                F.array_join(
                    F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, layout.paths)))), "\n"
                ),
                256,
            )
            == layout.fingerprint,
            layout.name,
        )
        for layout in layouts
        if layout.row is None
    ]
    return F.coalesce(*named)


def _renamed(role: Column, roles: Mapping[str, str]) -> Column:
    for old, new in roles.items():
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def _turns(layout: Layout, get) -> Column:
    """Turns of one record; ``get`` gives the column of a top-level field."""
    if layout.messages:
        items, role, text = layout.messages
        return F.transform(
            get(items),
            lambda m: F.struct(
                _renamed(m[role].cast("string"), layout.roles).alias("role"), m[text].cast("string").alias("text")
            ),
        )
    made = [
        F.struct(
            F.lit(role).alias("role"),
            F.when(
                F.coalesce(*(get(f) for f in fields)).isNotNull(),
                F.concat_ws("\n\n", *(F.nullif(get(f).cast("string"), F.lit("")) for f in fields)),
            ).alias("text"),
        )
        for role, fields in layout.parts
    ]
    # A part none of whose fields is there is no turn.
    return F.filter(F.array(*made), lambda t: t["text"].isNotNull())


def canonical_turns(df: DataFrame, id_column: str = "conv_id", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``(conv_id, turn, role, text)`` of a table, by the layout its schema's fingerprint selects.

    Null roles and texts are empty.  Columns that the layout does not name are not read,
    whatever they are called.  A null list has no turns; an empty table gives an empty one.
    """
    layout = layout_of(df, layouts)
    if layout.row:
        turn, role, text = map(_quoted, layout.row)
        turns = df.select(_quoted(id_column).alias("conv_id"), turn.cast("bigint").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    else:
        turns = df.select(_quoted(id_column).alias("conv_id"), F.posexplode(_turns(layout, _quoted)).alias("turn", "t")).select(
            "conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text"
        )
    return turns.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})


def canonical_turns_json(
    df: DataFrame, record: str, id_column: str = "conv_id", layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """``(conv_id, layout, turn, role, text)`` of JSON records, each by its own fingerprint.

    A record that is null, no JSON object or of no known layout is one row with a null layout
    and no turn, so it is not lost.
    """
    body, name = _quoted(record), F.col("layout")
    rows = df.select(_quoted(id_column).alias("conv_id"), body.alias("record"), json_layout(body, layouts).alias("layout"))
    turns = F.lit(None).cast(TURN)
    for layout in layouts:
        if layout.row is None:
            parsed = F.from_json("record", layout.ddl)
            turns = F.when(name == layout.name, _turns(layout, lambda f, p=parsed: p[f])).otherwise(turns)
    found = rows.select("conv_id", "layout", F.posexplode_outer(turns).alias("turn", "t"))
    return found.select(
        "conv_id", "layout", F.col("turn").cast("bigint").alias("turn"),
        *(F.when(F.col("turn").isNotNull(), F.coalesce(f"t.{c}", F.lit(""))).alias(c) for c in ("role", "text")),
    )


# -- template ------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """A turn is ``begin role middle text end``.  ``others`` are further control strings to escape."""

    begin: str = "<s>[ROLE]"
    middle: str = "[/ROLE]"
    end: str = "</s>"
    others: tuple[str, ...] = ("<s>", "[ROLE]", "[INST]", "[/INST]")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.middle, self.end, *self.others)))

    def __post_init__(self):
        for c in self.controls:
            # Two of them can then neither overlap nor arise at the border of a text.
            if len(c) < 2 or "\\" in c or any(x[0] in c[1:] for x in self.controls):
                raise ValueError(f"no control string: {c!r}")


def _java(literal: str) -> str:
    return re.sub(r"([^0-9A-Za-z\x80-\U0010ffff])", r"\\\1", literal)


def escape(text: Column, template: Template = Template()) -> Column:
    """``text`` without any control string; ``unescape`` turns it back."""
    any_control = "|".join(map(_java, template.controls))
    return F.regexp_replace(
        F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?s)(?={any_control})(.)", "$1\\\\"
    )


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(
    turns: DataFrame, template: Template = Template(), loss_roles: Sequence[str] = ("assistant",)
) -> DataFrame:
    """Pieces ``(conv_id, piece, formatted, loss)`` of every conversation.

    The pieces of a conversation, in order and put together, are its training string.
    ``loss`` holds ``(start, length)`` in code points of the piece: the escaped texts of
    ``loss_roles``.  Turns are ordered by number, a missing number first, then by role and
    text; repeated rows are turns each.  A null id is a conversation of its own.
    """
    role, text = escape(F.col("role"), template), escape(F.col("text"), template)
    head = F.concat(F.lit(template.begin), role, F.lit(template.middle))
    rendered = turns.select(
        "conv_id", "turn", "role", "text",
        F.floor(F.col("turn") / PIECE_TURNS).alias("piece"),
        head.alias("head"), text.alias("body"),
        F.col("role").isin(*loss_roles).alias("loss"),
    )
    entry = F.struct("turn", "role", "text", "head", "body", "loss")
    grouped = rendered.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(entry)).alias("turns"))

    def add(done: Column, t: Column) -> Column:
        start = done["at"] + F.char_length(t["head"])
        size = F.char_length(t["body"]).cast("bigint")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (start + size + len(template.end)).alias("at"),
            F.when(t["loss"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    nothing = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
    )
    return grouped.select(
        "conv_id", "piece",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(template.end))), "").alias("formatted"),
        F.aggregate("turns", nothing, add, lambda done: done["spans"]).alias("loss"),
    )


def read_pieces(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` pieces with their ``turns`` and the unescaped ``learned`` texts under the loss mask."""
    marked = F.split("formatted", _java(template.end))
    shown = F.slice(marked, 1, F.size(marked) - 1)

    def turn(t: Column) -> Column:
        halves = F.split(F.substr(t, F.lit(len(template.begin) + 1)), _java(template.middle), 2)
        return F.struct(
            unescape(F.get(halves, F.lit(0))).alias("role"), unescape(F.get(halves, F.lit(1))).alias("text")
        )

    return formatted.select(
        "*",
        F.transform(shown, turn).alias("turns"),
        F.transform(
            "loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))
        ).alias("learned"),
    )


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation of ``read_pieces``: counts and digests.

    A digest runs over a whole conversation, so its pieces meet in one row here and nowhere else.
    """
    each = pieces.select(
        "conv_id",
        F.struct(
            "piece",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("learned", "").alias("learned"),
        ).alias("part"),
        F.size("turns").cast("bigint").alias("n"),
        F.char_length("formatted").cast("bigint").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    learned = F.array_join("parts.learned", "")
    return whole.select(
        "conv_id", "n_turns",
        F.sha2(F.array_join("parts.turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
