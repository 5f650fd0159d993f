"""Chat formatting with a grammar round trip."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template (fixed values).
BOS, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"

#: A control string, or one that escaping has already made harmless any number of times.
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(CLOSE) + r"(.*?)" + re.escape(END), re.S)


@dataclass(frozen=True)
class Parsed:
    """One turn as read back: its fields unescaped, and where its raw text stands."""

    role: str
    text: str
    begin: int
    end: int


def escape(text: str) -> str:
    """Puts one backslash after the bracket of each control string; adds one where there are some."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """Takes back one backslash of each escaped control string."""
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(formatted: str) -> list[Parsed] | None:
    """The turns of a formatted conversation; None if the text is not in the grammar.

    conversation := "<s>" turn*,  turn := "[INST]" role "[/INST]" text "</s>"; the first
    closing string ends a field, so there is one reading at most.
    """
    if not formatted.startswith(BOS):
        return None
    at, turns = len(BOS), []
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            return None
        turns.append(Parsed(unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)))
        at = found.end()
    return turns


def render(turns: list[tuple[str, str]]) -> str:
    """The template's text for (role, text) turns.

    First all content is written as it is. If the text does not parse back to
    the same turns, the fields that hold a control string (escaped ones too) are
    escaped, and the result is parsed again.
    """
    fields = [list(t) for t in turns]
    while True:
        formatted = BOS + "".join(f"{OPEN}{r}{CLOSE}{t}{END}" for r, t in fields)
        back = parse(formatted)
        if back is not None and [(x.role, x.text) for x in back] == [tuple(t) for t in turns]:
            return formatted
        conflicts = [(i, j) for i, t in enumerate(turns) for j in (0, 1) if fields[i][j] == t[j] and _CONTROL.search(t[j])]
        if not conflicts:
            raise ValueError("a conversation does not survive its template")
        for i, j in conflicts:
            fields[i][j] = escape(turns[i][j])


def format_chats(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) of (conv_id, turn, role, text) rows.

    Turns are in the order of turn, then role, then text; null roles and texts are
    empty. loss_spans are [begin, end) offsets, in code points, of the trained
    role's texts in the formatted string. Rows without conv_id are one
    conversation. Repeated rows are turns of their own. A conversation becomes one
    string, so its rows meet in one task, whole however long its texts; extra columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches):
        for batch in batches:
            out, spans, counts = [], [], []
            for turns in batch.column(1).to_pylist():
                formatted = render([(t["role"], t["text"]) for t in turns])
                out.append(formatted)
                counts.append(len(turns))
                spans.append([{"begin": x.begin, "end": x.end} for x in parse(formatted) if x.role == trained_role])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.string()), pa.array(spans, kind)], ["conv_id", "n_turns", "formatted", "loss_spans"])

    return grouped.mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_spans array<struct<begin:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) as the parser reads formatted conversations."""

    def run(batches):
        for batch in batches:
            turns, loss = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns.append([{"role": x.role, "text": x.text} for x in parse(text)])
                loss.append("".join(unescape(text[s["begin"] : s["end"]]) for s in spans))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array(loss, pa.string()), batch.column(1)], ["conv_id", "turns", "loss_text", "formatted"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
