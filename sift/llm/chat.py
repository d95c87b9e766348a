"""Chat formatting with schema fingerprints, in DataFrame functions only.

A record arrives as a VARIANT or a struct of any of the layouts.  Its fingerprint is a hash of its nested field
paths (``schema_of_variant`` without the leaf types, so ``"a": 1`` and
``"a": "x"`` are one layout).  A fingerprint selects a declarative mapping
(``Layout``): which paths hold the turns, or which single fields become a
system, user or assistant turn.  Every layout yields the same canonical turns,
an array of (role, text).

Template of a formatted conversation, turn by turn::

    ### <role>: <text></turn>

Inside a role or text every backslash and ``#`` gets a backslash before it, a
``/`` after ``<`` too, and in a role also ``:``.  So neither ``###`` nor
``</turn>`` can occur inside a text, and removing one backslash before each
escaped character gives the text back.  The loss mask is an array of
(start, length) spans, in code points of the formatted string, that cover the
assistant texts exactly, without the markers.

Defined cases: a null role or text counts as empty; turns with equal numbers
are ordered by role, then text, and repeated rows stay repeated turns; a null
turn number sorts first; rows with a null conversation id form one
conversation; an unknown layout has null turns and ``layout`` null; a record
with no turns has an empty formatted string; other columns are ignored.
A conversation is one row of output, so its turns meet in one task, as any
formatted conversation must; nothing else is gathered by key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_END = "</turn>\n"
LOSS_ROLES = ("assistant",)
#: Role names of other layouts and their canonical form.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where the turns of one family of records are.

    ``turns``: path of an array whose elements have ``role`` and ``text`` fields;
    else ``singles``: (role, paths): the non-empty values at the paths, joined by a blank line.
    ``shapes``: the field paths that select it, as ``field_paths`` writes them.
    """

    name: str
    shapes: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    rename_roles: bool = True
    singles: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())


LAYOUTS = (
    Layout("messages", ("{messages:[{content,role}]}", "{messages:[VOID]}"), turns="$.messages"),
    Layout("turn_rows", ("{turns:[{role,text,turn}]}", "{turns:[VOID]}"), turns="$.turns", text="text", rename_roles=False),
    Layout("sharegpt", ("{conversations:[{from,value}]}", "{conversations:[VOID]}"), turns="$.conversations", role="from", text="value"),
    Layout("instruction", ("{input,instruction,output}", "{instruction,output}"),
           singles=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("instruction_system", ("{input,instruction,output,system}", "{instruction,output,system}"),
           singles=(("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("prompt", ("{completion,prompt}",), singles=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("prompt_response", ("{prompt,response}",), singles=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("question", ("{answer,question}", "{answer,context,question}"),
           singles=(("user", ("$.context", "$.question")), ("assistant", ("$.answer",)))),
)


def field_paths(record: Column) -> Column:
    """The record's nested field names in name order, without leaf types: ``{messages:[{content,role>>>``."""
    shape = F.schema_of_variant(record)
    shape = F.regexp_replace(shape, "OBJECT<", "{")
    shape = F.regexp_replace(shape, "ARRAY<", "[")
    shape = F.regexp_replace(shape, r": (?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|FLOAT|DATE|BINARY|VARIANT|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\d+\))(?=[,>])", "")
    shape = F.regexp_replace(shape, ": ", ":")
    return F.regexp_replace(shape, ", ", ",")


def _flat(shape: str) -> str:
    """A shape as ``field_paths`` writes it, where ``>`` closes objects and arrays alike."""
    return shape.replace("}", ">").replace("]", ">")


def skeleton(value: Column, kind: T.DataType) -> Column:
    """A typed value with its texts cut to one character: the same field paths in a VARIANT of small size."""
    if isinstance(kind, T.StringType):
        return F.substring(value, 1, 1)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: skeleton(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[skeleton(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), fields)
    return value


def _has(kind: T.StructType, spec: "Layout") -> bool:
    """Whether a struct of this type has the fields that a mapping reads."""
    types = {f.name: f.dataType for f in kind.fields}
    if not spec.turns:
        return all(isinstance(types.get(p.removeprefix("$.")), T.StringType) for _, paths in spec.singles for p in paths)
    turns = types.get(spec.turns.removeprefix("$."))
    element = turns.elementType if isinstance(turns, T.ArrayType) else None
    return isinstance(element, T.StructType) and {spec.role, spec.text} <= set(element.names)


def fingerprint(paths: Column) -> Column:
    """64-bit hash of a record's field paths."""
    return F.xxhash64(paths)


def layout_of(mark: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Name of the layout that has a shape with this fingerprint; null if there is none."""
    named = F.lit(None).cast("string")
    for layout in layouts:
        named = F.when(mark.isin([fingerprint(F.lit(_flat(s))) for s in layout.shapes]), F.lit(layout.name)).otherwise(named)
    return named


def _canonical_role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(role)), role)


def _turn_reader(spec: Layout):
    def read(turn: Column) -> Column:
        role = _canonical_role(turn[spec.role]) if spec.rename_roles else F.coalesce(turn[spec.role], F.lit(""))
        return F.struct(role.alias("role"), F.coalesce(turn[spec.text], F.lit("")).alias("text"))
    return read


def _from_variant(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, path, kind)


def _from_struct(record: Column, path: str, kind: str) -> Column:
    return record[path.removeprefix("$.")]


def canonical_turns(record: Column, layout: Column, layouts: tuple[Layout, ...] = LAYOUTS, get=_from_variant) -> Column:
    """array<struct<role, text>> by the selected mapping; null for an unknown layout."""
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for spec in layouts:
        if spec.turns:
            raw = get(record, spec.turns, f"array<struct<`{spec.role}`:string,`{spec.text}`:string>>")
            found = F.transform(raw, _turn_reader(spec))
        else:
            single = []
            for role, paths in spec.singles:
                values = F.filter(F.array(*[get(record, p, "string") for p in paths]), lambda v: F.length(v) > 0)
                single.append(F.struct(F.lit(role).alias("role"), F.array_join(values, "\n\n").alias("text")))
            # a system or user field that is empty is no turn; the answer always is
            found = F.filter(F.array(*single), lambda t: (t["text"] != "") | (t["role"] == "assistant"))
        turns = F.when(layout == spec.name, found).otherwise(turns)
    return turns


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#]|(?<=<)/", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\#:]|(?<=<)/", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#:/])", "$1")


def render(turns: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": "),
                                                              escape(t["text"]), F.lit(TURN_END))), "")


def loss_spans(turns: Column, roles: tuple[str, ...] = LOSS_ROLES) -> Column:
    """Spans (start, length, from 0, in code points) of the texts of ``roles`` in ``render(turns)``."""
    fixed = len("### ") + len(": ") + len(TURN_END)
    walked = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + fixed + F.length(escape_role(t["role"])) + F.length(escape(t["text"]))).cast("long").alias("at"),
            F.when(t["role"].isin(*roles), F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + len("### ") + len(": ") + F.length(escape_role(t["role"]))).cast("long").alias("start"),
                F.length(escape(t["text"])).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return walked


def parse(formatted: Column) -> Column:
    """The turns read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, TURN_END), lambda p: p != "")
    # possessive: an escaped character or a run of others, never tried again, so a long role takes no stack
    marked = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, marked, 1)).alias("role"),
                                                  unescape(F.regexp_extract(p, marked, 2)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_records(records: DataFrame, record_col: str, *keep: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The kept columns, then layout, fingerprint, turns, formatted, loss_spans of each record.

    Each record is fingerprinted by its own field paths and looked up among all
    layouts, a struct by the VARIANT of its skeleton.  From a struct only the
    mappings can read whose fields its type has.
    """
    record, kind = F.col("__record"), records.schema[record_col].dataType
    if isinstance(kind, T.StructType):
        paths, get = field_paths(F.to_variant_object(skeleton(record, kind))), _from_struct
        readable = tuple(x for x in layouts if _has(kind, x))
    else:
        paths, get, readable = field_paths(record), _from_variant, layouts
    shaped = (records.select(*keep, F.col(record_col).alias("__record"))
                     .withColumn("fingerprint", fingerprint(paths))
                     .withColumn("layout", layout_of(F.col("fingerprint"), layouts)))
    turned = shaped.select(*keep, "layout", "fingerprint", canonical_turns(record, F.col("layout"), readable, get).alias("turns"))
    return turned.select("*", render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def records_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """Turn rows gathered as one record per conversation: (conv_id, record), the layout ``turn_rows``."""
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    return (rows.groupBy(F.col(conv).alias("conv_id"))
                .agg(F.sort_array(F.collect_list(one)).alias("turns"))
                .select("conv_id", F.struct("turns").alias("record")))
