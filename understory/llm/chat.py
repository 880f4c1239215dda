"""Chat formatting by schema fingerprints.

The nested field paths of a record are hashed; the hash selects a declarative mapping that turns the
layout into canonical turns (role, text). Tables have one layout, that of their schema; a column of JSON records has one
per record. Turns are then written with a template that marks them and escapes control strings inside texts:

    <|im_start|>role\\n text <|im_end|>\\n

Inside roles and texts a backslash is doubled, ``<|`` becomes ``<\\|`` and, in roles, a line feed ``<\\>``. So a mark in
the output is always the template's, and ``parse`` gives the turns back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from understory.llm.common import map_batches

START, END = "<|im_start|>", "<|im_end|>"


# ---------------------------------------------------------------- layouts


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """A mapping: either ``turns`` (path of an array, with the names of role and text), ``flat`` ((role, path) ...), or rows of turns (role, text, order columns)."""

    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    flat: tuple[tuple[str, str], ...] = ()
    order: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.paths))


SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("prompter", "user"))

LAYOUTS = (
    Layout(("turn", "role", "text"), role="role", text="text", order="turn"),
    Layout(("messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Layout(("messages[].role", "messages[].text"), turns="messages", role="role", text="text"),
    Layout(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=SHARED_ROLES),
    Layout(("system", "conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", flat=(("system", "system"),), roles=SHARED_ROLES),
    Layout(("prompt", "response"), flat=(("user", "prompt"), ("assistant", "response"))),
    Layout(("prompt", "completion"), flat=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("question", "answer"), flat=(("user", "question"), ("assistant", "answer"))),
    Layout(("instruction", "output"), flat=(("user", "instruction"), ("assistant", "output"))),
    Layout(("instruction", "input", "output"), flat=(("user", "instruction+input"), ("assistant", "output"))),
    Layout(("system", "instruction", "input", "output"), flat=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Layout(("system", "prompt", "response"), flat=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def layout_of(df: DataFrame, ident: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout whose fingerprint is that of the table's paths; of extra columns only those no layout names are left out."""
    known = {p for x in layouts for p in x.paths}
    tops = {re.split(r"[.\[]", p)[0] for p in known}
    paths = [p for p in schema_paths(df.schema) if p != ident and re.split(r"[.\[]", p)[0] in tops]
    by = {x.fingerprint: x for x in layouts}
    for some in (paths, [p for p in paths if p in known]):
        if found := by.get(fingerprint(some)):
            return found
    raise ValueError(f"no layout for paths {sorted(paths)}")


def _flat_turns(layout: Layout, get) -> list[Column]:
    """One struct a (role, path); ``a+b`` joins two fields by an empty line. Absent system prompts and inputs give nothing."""
    out = []
    for role, path in layout.flat:
        parts = [get(p) for p in path.split("+")]
        text = F.coalesce(parts[0], F.lit(""))
        for p in parts[1:]:
            text = F.when(F.coalesce(p, F.lit("")) == "", text).otherwise(F.concat(text, F.lit("\n\n"), p))
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        out.append(F.when(F.coalesce(parts[0], F.lit("")) != "", turn) if role == "system" else turn)
    return out


def _role(layout: Layout, role: Column) -> Column:
    for was, now in layout.roles:
        role = F.when(role == was, F.lit(now)).otherwise(role)
    return role


def _turn(layout: Layout) -> Callable[[Column], Column]:
    """An element of a layout's array as a turn."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return lambda t: F.struct(_role(layout, text(t[layout.role])).alias("role"), text(t[layout.text]).alias("text"))


TURNS = "array<struct<role:string,text:string>>"


def canonical(df: DataFrame, ident: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(ident, turns) of a table in any known layout. Null roles and texts become empty.

    Rows of turns are gathered by conversation, ordered by turn, then role and text, so ties have one order and repeated rows stay;
    rows without an id form one conversation of their own. A conversation is one value in the end, so it must fit a task.
    """
    layout = layout_of(df, ident, layouts)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if layout.order:
        one = F.struct(F.col(layout.order).alias("turn"), text(F.col(layout.role)).alias("role"), text(F.col(layout.text)).alias("text"))
        got = df.groupBy(F.col(ident).alias(ident)).agg(F.sort_array(F.collect_list(one)).alias("t"))
        return got.select(ident, F.transform("t", lambda t: F.struct(_role(layout, t["role"]).alias("role"), t["text"].alias("text"))).alias("turns"))
    lists = [F.array(*_flat_turns(layout, lambda p: F.col(p).cast("string")))] if layout.flat else []
    if layout.turns:
        lists.append(F.transform(F.coalesce(F.col(layout.turns), F.array().cast(df.schema[layout.turns].dataType)), _turn(layout)))
    return df.select(ident, F.filter(F.concat(*[x.cast(TURNS) for x in lists]), lambda t: t.isNotNull()).alias("turns"))


def canonical_json(df: DataFrame, record: str, ident: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(ident, fingerprint, turns) of JSON records of mixed layouts; turns are null where no layout has the record's fingerprint.

    The paths come from each record's own variant schema: field names outside, types left out.
    """
    v = F.try_parse_json(F.col(record))
    kinds: dict[str, Column] = {}
    for x in layouts:
        if x.order:
            continue
        get = lambda p: F.try_variant_get(v, "$." + p, "string")
        lists = [F.array(*_flat_turns(x, get)).cast(TURNS)] if x.flat else []
        if x.turns:
            lists.append(F.transform(F.try_variant_get(v, "$." + x.turns, f"array<struct<`{x.role}`:string,`{x.text}`:string>>"), _turn(x)).cast(TURNS))
        kinds[x.fingerprint] = F.filter(F.concat(*lists), lambda t: t.isNotNull())

    def start():
        tokens = re.compile(r"OBJECT<|ARRAY<|>|, |([^:<>,]+): |[A-Z_]+(?:\([0-9, ]+\))?").finditer
        seen: dict[str, str] = {}

        def paths(kind: str) -> list[str]:
            at, out, name = [""], [], ""
            for m in tokens(kind):
                s = m.group()
                if m.group(1) is not None:
                    name = (at[-1] + "." if at[-1] else "") + m.group(1).strip("`")
                elif s == "OBJECT<":
                    at.append(name)
                elif s == "ARRAY<":
                    name += "[]"
                    at.append(None)
                elif s == ">":
                    at.pop()
                elif s != ", ":
                    out.append(name)
            return out

        def one(b: pa.RecordBatch) -> dict:
            kinds_ = b.column(2).to_pylist()
            for k in set(kinds_):
                if k is not None and k not in seen:
                    seen[k] = fingerprint(paths(k))
            return {"id": b.column(0), "r": b.column(1), "fingerprint": pa.array([seen.get(k) for k in kinds_], pa.string())}

        return one

    known = dict(df.dtypes)[ident]
    marked = map_batches(df.select(F.col(ident).alias("id"), F.col(record).alias("r"), F.schema_of_variant(v).alias("k")), f"id {known}, r string, fingerprint string", start)
    turns = F.lit(None).cast(TURNS)
    for fp, c in kinds.items():
        turns = F.when(F.col("fingerprint") == fp, c).otherwise(turns)
    out = marked.withColumnRenamed("r", record) if record != "r" else marked
    return out.select(F.col("id").alias(ident), "fingerprint", turns.alias("turns"))


# ---------------------------------------------------------------- template


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(s: str) -> str:
    return s.replace("<\\>", "\n").replace("<\\|", "<|").replace("\\\\", "\\")


def formatted(turns: DataFrame, ident: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """(ident, text, mask): the formatted conversation, and the [begin, end) code points of the texts of turns whose role is ``trained``."""
    heads = F.transform("turns", lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("<\\>")), F.lit("\n")))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    df = turns.select(ident, "turns", heads.alias("h"), bodies.alias("b"))
    whole = F.concat_ws("", F.zip_with("h", "b", lambda h, b: F.concat(h, b, F.lit(END + "\n"))))
    sizes = F.zip_with("h", "b", lambda h, b: F.struct(F.length(h).alias("h"), F.length(b).alias("b")))
    marks = F.zip_with(sizes, F.col("turns"), lambda s, t: F.struct(s["h"].alias("h"), s["b"].alias("b"), (t["role"] == trained).alias("on")))
    return df.select(ident, whole.alias("text"), marks.alias("m")).withColumn("mask", _mask(F.col("m"))).drop("m")


def _mask(marks: Column) -> Column:
    """Spans from the sizes of heads and bodies, in one pass."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:long,end:long>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["h"]
        end = begin + m["b"]
        span = F.when(m["on"], F.array(F.struct(begin.alias("begin"), end.alias("end")))).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>"))
        return F.struct((end + len(END) + 1).cast("long").alias("at"), F.concat(acc["out"], span).cast("array<struct<begin:long,end:long>>").alias("out"))

    return F.aggregate(marks, start, step, lambda a: a["out"])


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in text.split(START)[1:]:
        head, _, body = part.partition("\n")
        out.append((unescape(head), unescape(body[: -len(END) - 1])))
    return out


def digests(formatted_: DataFrame, ident: str = "conv_id") -> DataFrame:
    """Digests of what is read back from the formatted text and its loss mask."""
    kind = dict(formatted_.dtypes)[ident]

    def start():
        def one(b: pa.RecordBatch) -> dict:
            n, turns, loss_n, loss, chars = [], [], [], [], []
            for text, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = parse(text)
                h, g, c = hashlib.sha256(), hashlib.sha256(), 0
                for role, body in got:
                    h.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in mask:
                    s = unescape(text[span["begin"] : span["end"]])
                    g.update(s.encode("utf-8", "surrogatepass"))
                    c += len(s)
                n.append(len(got))
                turns.append(h.hexdigest())
                loss_n.append(c)
                loss.append(g.hexdigest())
                chars.append(len(text))
            longs = lambda x: pa.array(x, pa.int64())
            return {"id": b.column(0), "n_turns": longs(n), "turns_sha256": pa.array(turns), "loss_chars": longs(loss_n), "loss_sha256": pa.array(loss), "formatted_chars": longs(chars)}

        return one

    return map_batches(formatted_.select(F.col(ident).alias("id"), "text", "mask"), f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", start).withColumnRenamed("id", ident)
