"""Chat formatting: heterogeneous records to canonical turns by schema fingerprint, then to one masked text and back.

A record's fingerprint is a hash of its sorted nested field paths with their kinds (``messages[].role:text``). It selects a
declarative layout, and the layout's fields give the turns. A record of an unknown fingerprint keeps its row, with an error
and no text, so that a layout can be added for it.

The template is ``### role: text</turn>\\n`` per turn. A backslash goes before each backslash, ``###`` and ``</turn>`` of a text
(and each colon of a role), so no text can forge a mark and ``read_text`` gives back every turn exactly. The loss mask is the
spans of the assistant's escaped texts, in code points of the formatted text.

Cases: a null text or role is an empty one. Turns of equal number stand by role and text; a null number comes first. Repeated
rows are turns each. A conversation may be of any length; it is one row of the result, as its text is. A table without rows
gives none. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that other layouts use for the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Turns from a list of messages, or from single fields. ``(optional)`` paths may be missing."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""
    number: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, and the fields that its text joins by an empty line

    def prints(self) -> list[int]:
        """The fingerprints of all records of this layout."""
        return [fingerprint([*self.paths, *more]) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]

    def read(self, record: dict) -> list[tuple[str, str]]:
        if not self.messages:
            out = []
            for role, fields in self.turns:
                texts = [record[f] for f in fields if record.get(f)]
                if texts or any(f in record for f in fields) and role != "system":
                    out.append((role, "\n\n".join(texts)))
            return out
        rows = [(m.get(self.number) if self.number else i, m.get(self.role) or "", m.get(self.text) or "") for i, m in enumerate(record[self.messages])]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]) if self.number else r[0])
        return [(ROLES.get(r, r) if not self.number else r, t) for _, r, t in rows]


LAYOUTS = (
    Layout("rows", ("messages[].turn:number", "messages[].role:text", "messages[].text:text"), messages="messages", role="role", text="text", number="turn"),
    Layout("rows_unnumbered", ("messages[].role:text", "messages[].text:text"), ("messages[].turn:number",), messages="messages", role="role", text="text", number="turn"),
    Layout("messages", ("messages[].role:text", "messages[].content:text"), messages="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from:text", "conversations[].value:text"), messages="conversations", role="from", text="value"),
    Layout("prompt", ("prompt:text", "response:text"), ("system:text",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("completion", ("prompt:text", "completion:text"), ("system:text",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction:text", "output:text"), ("input:text", "system:text"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("question:text", "answer:text"), ("context:text",), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested paths with kinds; a null or an empty list has the kind of nothing and leaves no path."""
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()], set())
    if isinstance(value, list):
        return set().union(*[field_paths(v, f"{at}[]") for v in value], set())
    if value is None:
        return set()
    kind = "flag" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "text"
    return {f"{at}:{kind}"}


def fingerprint(paths: list[str] | set[str]) -> int:
    """Signed 64-bit hash of the sorted paths."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(set(paths))).encode(), 0)
    return h - (1 << 64) if h >> 63 else h


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_MARKS if role else _MARKS).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_MARKS = re.compile(r"\\|###|</turn>")
_ROLE_MARKS = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_ROLE_END = re.compile(r"\\(?:\\|###|</turn>|:)|: ")
_TEXT_END = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")


def format_text(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the loss mask."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, role=True)}: ", escape(text)
        if role == learned:
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len("</turn>\n")
        out += [head, body, "</turn>\n"]
    return "".join(out), mask


def read_text(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""

    def until(pattern: re.Pattern, at: int) -> re.Match:
        while (m := pattern.search(formatted, at)) and m[0][0] == "\\":
            at = m.end()
        if m is None:
            raise ValueError("a turn has no end")
        return m

    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("### ", at):
            raise ValueError(f"no turn begins at {at}")
        head = until(_ROLE_END, at + 4)
        tail = until(_TEXT_END, head.end())
        turns.append((unescape(formatted[at + 4 : head.start()]), unescape(formatted[head.end() : tail.start()])))
        at = tail.end()
    return turns


_SPANS = "array<struct<start: long, stop: long>>"


def format_records(records: DataFrame, key: str, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, schema_print, formatted, loss_spans, error) of JSON records."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {p: layout for layout in reversed(layouts) for p in layout.prints()}
        for batch in batches:
            names, prints, texts, spans, errors = [], [], [], [], []
            for raw in batch.column(1).to_pylist():
                name, text, mask, error, own = None, None, None, None, None
                try:
                    value = json.loads(raw) if raw is not None else None
                    own = fingerprint(field_paths(value))
                    if isinstance(value, dict) and own in known:
                        name = known[own].name
                        text, mask = format_text(known[own].read(value))
                    else:
                        error = "no layout for: " + ", ".join(sorted(field_paths(value)))
                except ValueError as e:
                    error = f"not a record: {e}"
                names.append(name)
                prints.append(own)
                texts.append(text)
                spans.append(None if mask is None else [{"start": a, "stop": b} for a, b in mask])
                errors.append(error)
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(prints, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pairs), pa.array(errors, pa.string())],
                names=["key", "layout", "schema_print", "formatted", "loss_spans", "error"],
            )

    out = records.select(F.col(key).alias("key"), F.col(record).alias("record")).mapInArrow(
        run, f"key {kind}, layout string, schema_print long, formatted string, loss_spans {_SPANS}, error string"
    )
    return out.withColumnRenamed("key", key)


def read_back(formatted: DataFrame, key: str) -> DataFrame:
    """(key, turns, loss_texts, formatted): what ``format_records`` wrote, parsed from its text and mask alone."""
    kind = formatted.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, losses = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns.append(None if text is None else [{"role": r, "text": t} for r, t in read_text(text)])
                losses.append(None if text is None else [unescape(text[s["start"] : s["stop"]]) for s in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(turns, turn), pa.array(losses, pa.list_(pa.string())), batch.column(1)], names=["key", "turns", "loss_texts", "formatted"]
            )

    out = formatted.select(F.col(key).alias("key"), "formatted", "loss_spans").mapInArrow(
        run, f"key {kind}, turns array<struct<role: string, text: string>>, loss_texts array<string>, formatted string"
    )
    return out.withColumnRenamed("key", key)


def records_of_rows(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, record): one JSON record of all messages per conversation, from a row per turn."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    message = F.struct(F.col(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    return rows.groupBy(F.col(key).alias("key")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(message)).alias("messages"))).alias("record")).withColumnRenamed("key", key)


def turns_text(turns: Column) -> Column:
    """role, newline, text, newline of every turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
