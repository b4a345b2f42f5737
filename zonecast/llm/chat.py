"""Chat formatting by schema fingerprints, in DataFrame operations only.

Every record's nested field paths (those the record really fills) are hashed to a
fingerprint. The fingerprint selects a declarative mapping, which turns prompt,
instruction, message-list and row-per-turn layouts into canonical turns (role, text).
A template marks the turns; control strings inside roles and texts are escaped so that
the formatted conversation can be read back exactly.

Defined results for odd input:

* null role or text: empty string; a message list's null element: no turn;
* a record whose fingerprint no mapping declares: ``layout`` null and no turns (it is
  reported, not dropped);
* several rows with the same turn number: ordered by role, then text; equal rows all stay;
* null conversation ids form one conversation; an empty table gives an empty result;
* columns outside the mappings' vocabulary, also ones that share a name with a field but
  not its type, take no part in the fingerprint.

A row-per-turn conversation is assembled by one grouping, because its text is one value
of the result. A long conversation is therefore bounded by the size of one string, not
by this code; turns are escaped before the shuffle, by the tasks that read them.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

TURN_TYPE = "array<struct<role:string,text:string>>"


# ---------------------------------------------------------------- mappings

@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``kind`` is ``row`` (the record is one turn), ``list`` (the record holds a list of
    turns) or ``fields`` (named fields are turns). ``needs`` and ``may`` are the paths
    that a record of this layout fills always and sometimes. ``spec`` names the fields;
    ``roles`` renames a layout's own role names.
    """

    name: str
    kind: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    spec: dict = field(default_factory=dict, hash=False)
    roles: dict = field(default_factory=dict, hash=False)


MAPPINGS = (
    Mapping("messages", "list", ("messages[].role:string", "messages[].content:string"), (),
            {"list": "messages", "role": "role", "text": "content"}),
    Mapping("conversations", "list", ("conversations[].from:string", "conversations[].value:string"), ("system:string",),
            {"list": "conversations", "role": "from", "text": "value", "lead": "system"},
            {"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Mapping("instruction", "fields", ("instruction:string", "output:string"), ("input:string", "system:string"),
            {"turns": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))}),
    Mapping("prompt", "fields", ("prompt:string", "completion:string"), ("system:string",),
            {"turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))}),
    Mapping("prompt_response", "fields", ("prompt:string", "response:string"), ("system:string",),
            {"turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))}),
    # last: a row-per-turn record may leave both fields null
    Mapping("turn_row", "row", (), ("role:string", "text:string"), {"role": "role", "text": "text"}),
)


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """All leaf paths of a schema: ``a.b`` for nested fields, ``a[]`` for list elements, then the type."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, f"{prefix}{f.name}"
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, f"{path}[]"
        out += field_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [f"{path}:{kind.simpleString()}"]
    return out


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _top(path: str) -> str:
    return re.split(r"[.\[:]", path, maxsplit=1)[0]


def row_fingerprint(df: DataFrame, mappings=MAPPINGS) -> Column:
    """The fingerprint of each record: which of the mappings' paths it fills (top-level value not null)."""
    known = {p for m in mappings for p in (*m.needs, *m.may)}
    paths = sorted(known & set(field_paths(df.schema)))
    filled = [F.when(df[f"`{_top(p)}`"].isNotNull(), F.lit(p)) for p in paths]
    return F.sha2(F.concat_ws("\n", *filled) if filled else F.lit(""), 256)


def _fingerprints(m: Mapping, declared: set[str]) -> list[str]:
    """Every fingerprint that selects this mapping, for a table that declares these paths."""
    if not set(m.needs) <= declared or (m.kind == "row" and not set(m.may) <= declared):
        return []
    may = [p for p in m.may if p in declared]
    return [fingerprint((*m.needs, *some)) for n in range(len(may) + 1) for some in itertools.combinations(may, n)]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(m: Mapping, declared: set[str]) -> Column:
    """The mapping as an expression: an array of turns."""
    s, has = m.spec, lambda c: f"{c}:string" in declared
    if m.kind == "row":
        return F.array(_turn(F.col(s["role"]), F.col(s["text"])))
    if m.kind == "fields":
        made = []
        for role, cols in s["turns"]:
            cols = [F.col(c) for c in cols if has(c)]
            if cols:
                made.append(F.when(F.coalesce(*cols).isNotNull(), _turn(F.lit(role), F.concat_ws("\n", *cols))))
        return F.filter(F.array(*made), lambda t: t.isNotNull())

    def renamed(role: Column) -> Column:
        out = role
        for own, canonical in m.roles.items():
            out = F.when(role == own, F.lit(canonical)).otherwise(out)
        return out

    turns = F.transform(F.filter(F.col(s["list"]), lambda t: t.isNotNull()),
                        lambda t: _turn(renamed(t.getField(s["role"])), t.getField(s["text"])))
    if s.get("lead") and has(s["lead"]):
        lead = F.col(s["lead"])
        turns = F.when(lead.isNotNull(), F.concat(F.array(_turn(F.lit("system"), lead)), turns)).otherwise(turns)
    return turns


def canonical_turns(df: DataFrame, id_col: str, order_col: str | None = None, mappings=MAPPINGS) -> DataFrame:
    """(conv_id, turn, layout, turns): one row per record, its layout found by its fingerprint."""
    declared = set(field_paths(df.schema))
    fp, layout, turns = F.col("_fp"), F.lit(None).cast("string"), F.array().cast(TURN_TYPE)
    for m in reversed(mappings):
        if fps := _fingerprints(m, declared):
            layout = F.when(fp.isin(fps), F.lit(m.name)).otherwise(layout)
            turns = F.when(fp.isin(fps), _mapped(m, declared).cast(TURN_TYPE)).otherwise(turns)
    order = F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")
    return df.withColumn("_fp", row_fingerprint(df, mappings)).select(
        F.col(id_col).cast("long").alias("conv_id"), order.alias("turn"), layout.alias("layout"), turns.alias("turns"))


# ---------------------------------------------------------------- template

@dataclass(frozen=True)
class Template:
    """Marks of a turn and the control strings that texts may not hold unescaped."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|startoftext|>")
    trained: str = "assistant"

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.sep, self.end, *self.others)


def escape(text: Column, t: Template) -> Column:
    """Put one more backslash after the first character of each control string, however many are there."""
    return _each_control(text, t, r"(\\*)", r"$1\\$2$3")


def unescape(text: Column, t: Template) -> Column:
    """Take one backslash away again: the inverse of escape for every text."""
    return _each_control(text, t, r"\\(\\*)", r"$1$2$3")


def _each_control(text: Column, t: Template, slashes: str, to: str) -> Column:
    firsts = sorted({c[0] for c in t.controls})
    for a in firsts:  # no rest holds a first character, so the passes don't disturb each other
        rest = "|".join(re.escape(c[1:]) for c in t.controls if c[0] == a)
        text = F.regexp_replace(text, f"({re.escape(a)}){slashes}({rest})", to)
    return text


def template_chat(canonical: DataFrame, t: Template = Template()) -> DataFrame:
    """(conv_id, layout, formatted, loss_spans) of canonical turns.

    A turn's block is start, role, sep, text, end. loss_spans addresses the text of every
    trained turn as (block, start, length), in code points from the start of that block.
    """
    block = F.transform("turns", lambda x: F.struct(
        F.concat(F.lit(t.start), escape(x.role, t), F.lit(t.sep)).alias("head"),
        escape(x.text, t).alias("body"),
        (x.role == t.trained).alias("loss")))
    rows = canonical.select("conv_id", "layout", F.struct("turn", block.alias("blocks")).alias("part"))
    whole = rows.groupBy("conv_id").agg(F.min("layout").alias("layout"), F.sort_array(F.collect_list("part")).alias("parts"))
    blocks = F.flatten(F.transform("parts", lambda p: p.blocks))
    whole = whole.select("conv_id", "layout", blocks.alias("blocks"))
    spans = F.filter(F.transform("blocks", lambda b, i: F.struct(
        b.loss.alias("loss"), i.cast("int").alias("block"), F.length(b.head).alias("start"), F.length(b.body).alias("length"))), lambda s: s.loss)
    return whole.select(
        "conv_id", "layout",
        F.array_join(F.transform("blocks", lambda b: F.concat(b.head, b.body, F.lit(t.end))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s.block, s.start, s.length)).alias("loss_spans"))


def read_back(formatted: DataFrame, t: Template = Template()) -> DataFrame:
    """(..., turns, loss_text): what a formatted conversation says, from its string and its mask alone."""
    pieces = F.split("formatted", re.escape(t.end), -1)  # what follows the last end mark is empty
    df = formatted.withColumn("_blocks", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(b: Column) -> Column:
        at = F.instr(b, t.sep)
        return F.struct(
            unescape(F.substring(b, F.lit(len(t.start) + 1), at - len(t.start) - 1), t).alias("role"),
            unescape(F.substring(b, at + len(t.sep), F.length(b)), t).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.get(F.col("_blocks"), s.block), s.start + 1, s.length), t))
    return df.withColumn("turns", F.transform("_blocks", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("_blocks")
