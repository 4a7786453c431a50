"""Chat formatting: schema fingerprints pick declarative mappings to canonical turns.

A record's layout is the sorted set of its nested field paths, and its fingerprint the xxhash64 of
that. LAYOUTS declares, for each known layout, how to read turns; a record column that is typed has one
layout for the table, a JSON column has a fingerprint for each row. The turns then go into a template whose
control strings cannot occur in a text, because those in texts are escaped reversibly.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<turn>", "</turn>"
#: Other datasets' role names and ours.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths. many: the path of an array of turns with fields role and text,
    or single: (role, path) of each turn in order, left out where the path is null."""

    name: str
    paths: tuple[str, ...]
    many: tuple[str, str, str] | None = None
    single: tuple[tuple[str, str], ...] = ()
    #: Roles stay as they are written.
    own_roles: bool = False


LAYOUTS = (
    Layout("turn rows", ("rows[].role", "rows[].text", "rows[].turn"), ("rows", "role", "text"), own_roles=True),
    Layout("messages", ("messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value")),
    Layout("instruction", ("input", "instruction", "output"), single=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("short instruction", ("instruction", "output"), single=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt and completion", ("completion", "prompt"), single=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), single=(("user", "prompt"), ("assistant", "response"))),
    Layout("system prompt", ("prompt", "response", "system"), single=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", ("answer", "question"), single=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, sorted; an array's elements are at `[]`."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint_of(paths) -> Column:
    return F.xxhash64(F.lit(nested(sorted(paths))))


def nested(paths: list[str]) -> str:
    """Sorted field paths as one nested type whose scalars are all alike."""
    if paths == [""]:
        return "*"
    if all(p.startswith("[]") for p in paths):
        return f"ARRAY<{nested([p[2:].removeprefix('.') for p in paths])}>"
    inner: dict[str, list[str]] = {}
    for p in paths:
        name = re.match(r"[^.\[]*", p)[0]
        inner.setdefault(name, []).append(p[len(name) :].removeprefix("."))
    return "OBJECT<" + ", ".join(f"{k}: {nested(v)}" for k, v in inner.items()) + ">"


def _role(role: Column, layout: Layout) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    if layout.own_roles:
        return role
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(role)), role)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _read_typed(record: Column, layout: Layout) -> Column:
    if layout.many:
        at, role, text = layout.many
        return F.transform(record[at], lambda t: _turn(_role(t[role], layout), t[text]))
    turns = F.array(*[F.when(record[p].isNotNull() | (role == "assistant"), _turn(F.lit(role), record[p])) for role, p in layout.single])
    return F.filter(turns, lambda t: t.isNotNull())


def typed_turns(df: DataFrame, record: str) -> Column:
    """Turns of a struct column. Its layout is known from the schema, so the choice costs nothing."""
    paths = tuple(field_paths(df.schema[record].dataType))
    for layout in LAYOUTS:
        if tuple(sorted(layout.paths)) == paths:
            return F.coalesce(_read_typed(F.col(record), layout), F.array().cast(TURNS))
    raise ValueError(f"no mapping for fields {paths}")


_STRING = r'(?:[^"\\]++|\\.)*+'
#: A field's name with its colon, or a string that is a value, of which only the quotes are kept.
_NAME_OR_VALUE, _EMPTIED = f'("{_STRING}"\\s*:)|("){_STRING}(")', "$1$2$3"
#: How the type of a scalar is written, where no field's name can stand.
_SCALAR = r"(?<=: |<|^)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"


def json_fingerprint(record: Column) -> Column:
    """Of a JSON record: its nested field paths, at any depth and over all elements of its arrays. Values don't
    matter, so strings are emptied first and records of any length are parsed."""
    kind = F.schema_of_variant(F.try_parse_json(F.regexp_replace(record, _NAME_OR_VALUE, _EMPTIED)))
    return F.xxhash64(F.regexp_replace(kind, _SCALAR, "*"))


#: Texts in records may have up to 2 GB.
_LONG = {"maxStringLen": str(2**31 - 1)}


def _read_json(record: Column, layout: Layout) -> Column:
    if layout.many:
        at, role, text = layout.many
        turns = F.from_json(record, T.StructType([T.StructField(at, T.ArrayType(T.StructType([T.StructField(role, T.StringType()), T.StructField(text, T.StringType())])))]), _LONG)
        return F.transform(turns[at], lambda t: _turn(_role(t[role], layout), t[text]))
    fields = F.from_json(record, T.StructType([T.StructField(p, T.StringType()) for _, p in layout.single]), _LONG)
    return F.filter(F.array(*[F.when(fields[p].isNotNull() | (role == "assistant"), _turn(F.lit(role), fields[p])) for role, p in layout.single]), lambda t: t.isNotNull())


def json_turns(record: Column) -> Column:
    """Turns of a JSON record in any declared layout; null for an unknown layout or no JSON object."""
    mark, out = json_fingerprint(record), F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        out = F.when(mark == fingerprint_of(layout.paths), _read_json(record, layout)).otherwise(out)
    return out


# An escaped text has one backslash more after each '<' that begins a control string (with any number of
# backslashes already there), so no control string is left and taking one away gives the text back.
def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn>)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn>)", r"<$1$2")


# A role is one line: backslash and line feed become \b and \n, read from left to right.
def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(turns: Column) -> tuple[Column, Column]:
    """The formatted string, and the loss mask as (start, length) of code points: the assistants' texts."""
    parts = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    whole = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, length: long>>").alias("spans"))

    def add(state: Column, p: Column) -> Column:
        begin = (state["at"] + F.length(p["head"])).cast("long")
        span = F.struct(begin.alias("start"), F.length(p["body"]).cast("long").alias("length"))
        return F.struct(
            (begin + F.length(p["body"]) + len(CLOSE) + 1).cast("long").alias("at"),
            F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return whole, F.aggregate(parts, start, add)["spans"]


def read_back(formatted: Column) -> Column:
    """Turns of a formatted string."""
    pieces = F.filter(F.split(formatted, CLOSE + "\n", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        _unescape_role(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))


def format_chats(df: DataFrame, key: str, record: str) -> DataFrame:
    """key, formatted and loss_mask of each record. record: a struct in a declared layout or a JSON string.

    Null records and unknown JSON layouts give a null string and mask; no turns an empty string. Null
    texts and roles are empty. Other columns are left out, so their names can't clash."""
    turns = json_turns(F.col(record)) if isinstance(df.schema[record].dataType, T.StringType) else F.when(F.col(record).isNotNull(), typed_turns(df, record))
    whole, mask = render(F.col("__turns"))
    return df.select(F.col(key).alias("__key"), turns.alias("__turns")).select(F.col("__key").alias(key), whole.alias("formatted"), mask.alias("loss_mask"))


def records_of_rows(rows: DataFrame) -> DataFrame:
    """One JSON record for each conversation from rows (conv_id, turn, role, text): its turns by number, ties by
    role and text; null turns first. Repeated rows are repeated turns. A conversation is one row of the
    result, so it has to fit in memory, as its formatted string must."""
    picked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("r"))
    record = F.to_json(F.struct(F.array_sort(F.collect_list("r")).alias("rows")), {"ignoreNullFields": "false"})
    return picked.groupBy("conv_id").agg(record.alias("record"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted string and the mask."""
    lossy = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("back"), lossy.alias("loss")).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
