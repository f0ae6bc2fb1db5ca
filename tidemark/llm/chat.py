"""Chat formatting: layouts told by a fingerprint of their nested field paths, canonical turns, one template.

A layout is a set of field paths, such as ``messages.role``. The hash of its sorted paths selects a
declarative mapping to canonical turns (conversation, position, role, text): for a table
the hash of its schema's paths, for JSON records row by row that of their own. Everything is built from DataFrame functions.

The template writes a turn as ``### <role>: <text></turn>\\n``. Inside roles and texts
the characters ``\\``, ``<``, ``#`` and ``:`` (in roles) become ``\\b``, ``\\l``, ``\\h`` and ``\\c``,
so no control string can occur there, and four replacements read them back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, BETWEEN, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
TRAINED = "assistant"


#: Between the paths of a fingerprint; no field name holds it.
BETWEEN_PATHS = "\x1f"


def fingerprint_of(paths: Iterable[str]) -> str:
    """SHA-256 of sorted field paths."""
    return hashlib.sha256(BETWEEN_PATHS.join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """paths: the fields that make the layout; turns: (role, path) or (role path, text path) pairs by kind."""

    name: str
    paths: tuple[str, ...]
    kind: str  # rows | fields | list
    turns: tuple[tuple[str, str], ...]

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), "rows", (("role", "text"),)),
    Layout("messages", ("messages", "messages.role", "messages.content"), "list", (("messages.role", "messages.content"),)),
    Layout("from_value", ("conversations", "conversations.from", "conversations.value"), "list", (("conversations.from", "conversations.value"),)),
    Layout("instruction_input", ("instruction", "input", "output"), "fields", (("user", "instruction+input"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), "fields", (("user", "instruction"), ("assistant", "output"))),
    Layout("system_prompt", ("system", "prompt", "response"), "fields", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_response", ("prompt", "response"), "fields", (("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), "fields", (("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", ("question", "answer"), "fields", (("user", "question"), ("assistant", "answer"))),
)
#: Names of the same role in layouts that hold lists; rows by turn name their roles themselves.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURN = "array<struct<role:string,text:string>>"


def fingerprint(paths: Column) -> Column:
    """The same of a column of arrays of field paths."""
    return F.sha2(F.array_join(F.array_sort(paths), BETWEEN_PATHS).cast("binary"), 256)


def schema_paths(schema: T.StructType) -> set[str]:
    """Field paths of a schema, through structs and arrays."""
    out: set[str] = set()

    def walk(kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.ArrayType):
            walk(kind.elementType, at)
        elif isinstance(kind, T.StructType):
            for field in kind.fields:
                path = f"{at}.{field.name}" if at else field.name
                out.add(path)
                walk(field.dataType, path)

    walk(schema, "")
    return out


def layout_of(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout with the most paths whose fingerprint is that of the schema's paths which it knows; further fields don't matter."""
    have = schema_paths(schema)
    by_print = {x.fingerprint: x for x in layouts}
    prints = {fingerprint_of(have & set(x.paths)) for x in layouts}
    fits = [by_print[x] for x in prints & by_print.keys()]
    if not fits:
        raise ValueError(f"no layout for the fields {sorted(have)}")
    return max(fits, key=lambda x: len(x.paths))


def _role(role: Column) -> Column:
    return reduce(lambda out, pair: F.when(role == pair[0], pair[1]).otherwise(out), ROLES.items(), F.coalesce(role, F.lit("")))


def _field(get, path: str) -> Column:
    """The text of a path; a+b joins two by an empty line if the second has any."""
    first, _, second = path.partition("+")
    out = F.coalesce(get(first).cast("string"), F.lit(""))
    if not second:
        return out
    more = F.coalesce(get(second).cast("string"), F.lit(""))
    return F.when(more == "", out).otherwise(F.concat(out, F.lit("\n\n"), more))


def record_turns(layout: Layout, get) -> Column:
    """Canonical turns, as an array of (role, text), of a record whose fields ``get(path)`` gives."""
    if layout.kind == "list":
        role_path, text_path = layout.turns[0]
        items = get(role_path.split(".")[0])
        role, text = role_path.split(".")[1], text_path.split(".")[1]
        turns = F.transform(items, lambda x: F.struct(_role(x[role].cast("string")).alias("role"), F.coalesce(x[text].cast("string"), F.lit("")).alias("text")))
        return F.coalesce(turns, F.array().cast(TURN))
    turns = F.array(*[F.struct(F.lit(role).alias("role"), _field(get, path).alias("text")) for role, path in layout.turns])
    # An empty system text is no turn.
    return F.filter(turns, lambda x: (x["role"] != "system") | (x["text"] != ""))


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text rows of a table in any known layout, which its schema's fingerprint selects.

    Null roles and texts are empty. A record without turns has no rows.
    """
    layout = layout_of(df.schema, layouts)
    key = F.col(id_col).cast("long").alias("conv_id")
    if layout.kind == "rows":
        role, text = layout.turns[0]
        return df.select(key, F.col("turn").cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    turns = df.select(key, F.posexplode(record_turns(layout, lambda p: F.col(f"`{p}`"))).alias("turn", "at"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "at.role", "at.text")


def _keys_under(record: Column, name: str) -> Column:
    """Paths of the fields of the first element of a JSON record's list."""
    keys = F.coalesce(F.json_object_keys(F.get_json_object(record, f"$.{name}[0]")), F.array().cast("array<string>"))
    return F.transform(keys, lambda k: F.concat(F.lit(f"{name}."), k))


def json_turns(df: DataFrame, record_col: str = "record", id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text rows of JSON records of mixed layouts; each record's own fingerprint selects its mapping.

    Records of no known layout, null and broken ones give no rows.
    """
    record = F.col(record_col).cast("string")
    known = sorted({p for x in layouts if x.kind != "rows" for p in x.paths})
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    nested = [_keys_under(record, p) for p in ("messages", "conversations")]
    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), record.alias("record"), F.array_distinct(F.concat(top, *nested)).alias("paths"))
    rows = rows.withColumn("paths", F.array_intersect("paths", F.array(*[F.lit(p) for p in known])))
    rows = rows.withColumn("print", fingerprint(F.col("paths")))
    turns = F.lit(None).cast(TURN)
    for layout in layouts:
        if layout.kind == "rows":
            continue
        if layout.kind == "list":
            top_name = layout.paths[0]
            role, text = (p.split(".")[1] for p in layout.turns[0])
            got = F.from_json("record", f"`{top_name}` array<struct<`{role}`:string,`{text}`:string>>")
        else:
            got = F.from_json("record", ", ".join(f"`{p}` string" for p in layout.paths))
        own = record_turns(layout, lambda p, got=got: got[p])
        turns = F.when(F.col("print") == layout.fingerprint, own).otherwise(turns)
    out = rows.select("conv_id", F.posexplode(turns).alias("turn", "at"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "at.role", "at.text")


def escape(text: Column, role: bool = False) -> Column:
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), ESCAPES if role else ESCAPES[:3], text)


def unescape(text: Column) -> Column:
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES), text)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 1 and length, in code points).

    Turns stand in order of turn; equal ones in order of role and text. Rows without a
    conv_id are one conversation with a null id. The loss mask covers the texts of the
    assistant, as they are written. One shuffle: window and aggregation share it.
    """
    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(BETWEEN))
    rows = turns.select("conv_id", "turn", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("length", F.length("head") + F.length("body") + len(TAIL))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", unescape(F.col("body")))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("end", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.col("length") + F.length("head") + 1
    span = F.when(F.col("role") == TRAINED, F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    piece = F.struct("at", F.concat("head", "body", F.lit(TAIL)).alias("piece"), span.alias("span"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    spans = F.filter(F.transform("pieces", lambda x: x["span"]), lambda x: x.isNotNull())
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text): the inverse of the template."""
    pieces = F.filter(F.split(formatted, TAIL), lambda x: x != "")

    def turn(piece: Column) -> Column:
        at = F.lit(len(HEAD) + 1)
        colon = F.instr(piece, BETWEEN)
        role = F.substr(piece, at, colon - at)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, colon + len(BETWEEN))).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
