"""Chat formatting by schema fingerprints.

A record's nested field paths are written as one shape string and hashed; the hash selects a declarative mapping (a SQL
expression) that turns the record into canonical turns, `array<struct<role, text>>`. Records of many layouts may share
one column: `from_json_records` fingerprints every row. Whole tables of one layout go through `from_table`.

`render` writes turns with a template whose control strings are escaped inside roles and texts; `read_back` undoes it.

Defined cases: null roles and texts are empty, null or repeated turn numbers sort by (turn, role, text) with nulls first,
repeated rows stay, a null conversation id is a conversation of its own, records of an unknown shape give null turns,
empty tables give empty results, extra columns are left out of the mapping.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


def shape(kind: T.DataType) -> str:
    """Nested field names without leaf types, in the order and spelling of schema_of_variant."""
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {shape(f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{shape(kind.elementType)}>"
    return ""


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def variant_fingerprint(column: str) -> F.Column:
    """The same hash for a variant column: leaf types are cut from its schema string."""
    leaves = r"(?<=[<:] ?)(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>])"
    return F.sha2(F.regexp_replace(F.expr(f"schema_of_variant({column})"), leaves, ""), 256)


@dataclass(frozen=True)
class Layout:
    """One layout: its fields as a DDL schema and the SQL expression over them that gives canonical turns."""

    name: str
    schema: str
    turns: str

    @property
    def keys(self) -> tuple[str, str]:
        """Fingerprints of the layout's shape, and of a record whose lists are all empty and so show no element."""
        full = shape(T._parse_datatype_string(self.schema))
        return fingerprint(full), fingerprint(re.sub(r"ARRAY<OBJECT<[^<>]*>>", "ARRAY<>", full))


def _pair(*sides: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', coalesce({x}, ''))" for r, x in sides) + ")"


def _list(column: str, role: str, text: str) -> str:
    role = f"CASE x.{role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(x.{role}, '') END"
    return f"transform({column}, x -> named_struct('role', {role}, 'text', coalesce(x.{text}, '')))"


LAYOUTS = (
    Layout("messages", "messages array<struct<role:string,content:string>>", _list("messages", "role", "content")),
    Layout("conversation", "conversations array<struct<from:string,value:string>>", _list("conversations", "`from`", "value")),
    Layout("prompt_completion", "prompt string, completion string", _pair(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", "prompt string, response string", _pair(("user", "prompt"), ("assistant", "response"))),
    Layout("instruction_output", "instruction string, output string", _pair(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input_output", "instruction string, input string, output string",
           _pair(("user", "instruction || if(coalesce(input, '') = '', '', '\\n\\n' || input)"), ("assistant", "output"))),
    Layout("system_question_response", "system_prompt string, question string, response string",
           _pair(("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
)

#: Rows of one turn each; they are grouped before the other layouts apply.
TURN_ROWS = fingerprint("OBJECT<conv_id: , role: , text: , turn: >")


def from_json_records(df: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds `layout` and `turns`, in place of columns of these names, from a column of JSON records.

    Unknown shapes (a field more or less is another shape) and broken JSON get nulls; an empty list of messages gives no turns.
    """
    known = df.withColumn("__v", F.expr(f"try_parse_json(`{column}`)")).withColumn("__f", variant_fingerprint("__v"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        body = x.turns
        for f in T._parse_datatype_string(x.schema).fieldNames():
            body = _qualify(body, f)
        hit, record = F.col("__f").isin(*x.keys), f"from_json(to_json(__v), '{x.schema}')"
        name = F.when(hit, x.name).otherwise(name)
        # transform over a one-element array parses the record once and binds it by name
        turns = F.when(hit, F.expr(f"transform(array({record}), __r -> {body})[0]")).otherwise(turns)
    return known.withColumns({"layout": name, "turns": turns}).drop("__v", "__f")


def _qualify(body: str, field: str) -> str:
    return re.sub(rf"(?<![\w.'`]){field}(?![\w'`])", f"__r.{field}", body)


def from_table(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, fields: list[str] | None = None) -> DataFrame:
    """conv_id and turns of a table whose schema itself is the layout.

    `fields` names the columns that make up the record; by default those that are not the id `conv_id`, or, for rows of
    one turn, conv_id, turn, role and text. An unknown shape raises ValueError and lists the known ones.
    """
    rows = ["conv_id", "turn", "role", "text"]
    if fields is None:
        fields = rows if set(rows) <= set(df.columns) else [c for c in df.columns if c != "conv_id"]
    key = fingerprint(shape(T.StructType([df.schema[c] for c in fields])))
    if key == TURN_ROWS:
        return (
            df.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
            .groupBy("conv_id")
            .agg(F.array_sort(F.collect_list("t")).alias("t"))
            .select("conv_id", F.expr("transform(array_sort(t, (a, b) -> CASE WHEN a.turn IS NULL AND b.turn IS NULL THEN 0 WHEN a.turn IS NULL THEN -1"
                                      " WHEN b.turn IS NULL THEN 1 WHEN a.turn < b.turn THEN -1 WHEN a.turn > b.turn THEN 1 ELSE 0 END),"
                                      " x -> named_struct('role', x.role, 'text', x.text))").alias("turns"))
        )
    for x in layouts:
        if key in x.keys:
            return df.select("conv_id", F.expr(x.turns).cast(TURNS).alias("turns"))
    raise ValueError(f"no mapping for the fields {fields}; known layouts: {[x.name for x in layouts]}")


#: Breaks a control string after its first character; doubled where a text holds it itself.
ESCAPE = "⁣"
#: Control strings of the template and of common chat formats. None may stand in a rendered text.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_STARTS = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"


def escaped(c: str) -> str:
    return f"regexp_replace(replace({c}, '{ESCAPE}', '{ESCAPE}{ESCAPE}'), r'{_STARTS}', '$1{ESCAPE}')"


def unescaped(c: str) -> str:
    return f"regexp_replace({c}, '{ESCAPE}({ESCAPE}?)', '$1')"


def render(df: DataFrame, learn: str = "assistant") -> DataFrame:
    """Adds `formatted` and `loss_spans` (begin and length in code points of the texts of role `learn`)."""
    parts = (
        f"transform(turns, x -> named_struct('learn', x.role = '{learn}', 'head', concat('{TURN}', {escaped('x.role')}, '{TEXT}'), "
        f"'body', {escaped('x.text')}))"
    )
    spans = (
        "aggregate(__p, named_struct('at', 0, 'spans', cast(array() as array<struct<begin:int,length:int>>)), (a, x) -> named_struct("
        "'at', a.at + char_length(x.head) + char_length(x.body) + " + str(len(END)) + ", "
        "'spans', if(x.learn, concat(a.spans, array(named_struct('begin', a.at + char_length(x.head), 'length', char_length(x.body)))), a.spans))).spans"
    )
    return (
        df.withColumn("__p", F.expr(parts))
        .withColumns({"formatted": F.expr(f"array_join(transform(__p, x -> concat(x.head, x.body, '{END}')), '')"), "loss_spans": F.expr(spans)})
        .drop("__p")
    )


def read_back(df: DataFrame) -> DataFrame:
    """Adds `turns_read` and `loss_texts`, both taken from `formatted` and `loss_spans` alone."""
    turn = (
        f"transform(filter(split(formatted, r'<\\|turn\\|>', -1), (x, i) -> i > 0), x -> named_struct("
        f"'role', {unescaped(f'''substring_index(x, '{TEXT}', 1)''')}, "
        f"'text', {unescaped(f'''substring(x, instr(x, '{TEXT}') + {len(TEXT)}, char_length(x) - instr(x, '{TEXT}') + 1 - {len(TEXT)} - {len(END)})''')}))"
    )
    loss = f"transform(loss_spans, s -> {unescaped('substring(formatted, s.begin + 1, s.length)')})"
    return df.withColumns({"turns_read": F.expr(turn), "loss_texts": F.expr(loss)})
