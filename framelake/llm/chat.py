"""Chat formatting: conversations rendered by a compiled template, with the spans a loss counts.

The default template marks turns by control strings. Inside texts and roles a
backslash becomes two, and one is put behind the first character of every
control string, so that no text can pass for a mark and all can be read back.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framelake.llm.template import compile_template
from framelake.llm.workspace import partitions

#: What the template may write as marks.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]")
TEMPLATE = """{{ '<s>' -}}
{% for m in messages -%}
  {% if m.role == 'user' %}{{ '[INST] ' ~ (m.text | escape) ~ ' [/INST]' }}
  {%- elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
  {%- else %}{{ '[ROLE]' }}{{ m.role | escape }}{{ '[TEXT]' }}{{ m.text | escape }}{{ '[/ROLE]' }}
  {%- endif -%}
{% endfor -%}"""
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation rendered by TEMPLATE."""
    turns: list[tuple[str, str]] = []
    at = len("<s>")
    if not text.startswith("<s>"):
        raise ValueError("not a rendered conversation")
    while at < len(text):
        if text.startswith("[INST] ", at):
            end = text.index("[/INST]", at + 7)
            turns.append(("user", unescape(text[at + 7 : end - 1])))
            at = end + 7
        elif text.startswith("[ROLE]", at):
            middle = text.index("[TEXT]", at)
            end = text.index("[/ROLE]", middle)
            turns.append((unescape(text[at + 6 : middle]), unescape(text[middle + 6 : end])))
            at = end + 7
        else:
            end = text.index("</s>", at)
            turns.append(("assistant", unescape(text[at:end])))
            at = end + 4
    return turns


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Conversations of batches in which each one's rows follow one another."""
    name, turns = None, []
    for b in batches:
        for conv, role, text in zip(b.column("conv").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
            if turns and conv != name:
                yield name, turns
                turns = []
            name = conv
            turns.append({"role": role or "", "text": text or ""})
    if turns:
        yield name, turns


def _batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == size or weight > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """(conv, formatted, spans): each conversation's rows by turn through the template.

    spans are [start, end) of generated text in code points. Null roles and texts
    count as empty; rows of one turn go by role, then text; a null conversation
    id or turn is a value like others, before all. Rows that repeat are turns
    that repeat. Other columns are not carried; an empty table gives none.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    schema = pa.schema([("conv", to_arrow_type(rows.schema[conv_col].dataType)), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def render(batches):
        run = compile_template(template, {"escape": escape})

        def rendered():
            for conv, turns in _conversations(batches):
                out = run({"messages": turns})
                yield conv, out.text, [{"start": a, "end": b} for a, b in out.spans]

        yield from _batched(rendered(), schema)

    named = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    sorted_ = named.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return sorted_.mapInArrow(render, f"conv {kind}, formatted string, spans array<struct<start:long,end:long>>").withColumnRenamed("conv", conv_col)


def read_formatted(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, turns, loss_text): what TEMPLATE's output says, unescaped: turns as structs of role and text."""
    kind = formatted.schema[conv_col].dataType.simpleString()
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def read(batches):
        for b in batches:
            turns, losses = [], []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("spans").to_pylist(), strict=True):
                turns.append([{"role": r, "text": t} for r, t in read_back(text)])
                losses.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans))
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("formatted"), pa.array(turns, pa.list_(turn)), pa.array(losses, pa.string())], names=["conv", "formatted", "turns", "loss_text"])

    named = formatted.select(F.col(conv_col).alias("conv"), "formatted", "spans")
    return named.mapInArrow(read, f"conv {kind}, formatted string, turns array<struct<role:string,text:string>>, loss_text string").withColumnRenamed("conv", conv_col)
