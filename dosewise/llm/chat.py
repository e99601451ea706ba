"""Chat formatting by schema fingerprints.

A record is JSON of whatever layout: a prompt and a completion, an instruction with input and output, a list of messages,
or one message of a conversation. Its fingerprint is a hash over its sorted nested field paths (list elements as ``[]``);
the fingerprint selects a declarative mapping, a list of turns that name a role and a path each. The canonical turns are
then written with a template whose marks cannot occur inside texts.

Template: ``<turn:ROLE>TEXT</turn>`` and a line feed per turn. Inside roles and texts a backslash becomes ``\\\\``, ``<``
becomes ``\\l`` and ``>`` becomes ``\\g``, so no control string survives there and every text comes back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, quoted

OPEN, CLOSE, END = "<turn:", ">", "</turn>\n"
_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_PLAIN = {"\\\\": "\\", "\\l": "<", "\\g": ">"}
_SPECIAL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\[\\lg]")
#: Characters of formatted text in one written row; a longer conversation goes on in further rows, cut between turns.
CHUNK_CHARS = 1 << 20


@dataclass(frozen=True)
class Mapping:
    """Where a layout's turns are: ``(role, text path)`` for fixed turns, or a list with paths inside its elements."""

    turns: tuple[tuple[str, str], ...] = ()
    each: str | None = None  # path of a list of messages; "" for a record that is one message itself
    role: str = "role"
    text: str = "text"


#: Canonical names of roles that layouts use (fixed values).
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def paths(value: object, prefix: str = "") -> set[str]:
    """Nested field paths; null fields count as present."""
    if isinstance(value, dict):
        return {p for key, inner in value.items() for p in paths(inner, f"{prefix}.{key}" if prefix else key)} or {prefix}
    if isinstance(value, list):
        return {p for inner in value for p in paths(inner, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def fingerprint(field_paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(field_paths))).encode()).hexdigest()[:16]


#: Layouts by the field paths that a record may have; ids and other fields are listed where records carry them.
LAYOUTS: list[tuple[tuple[str, ...], Mapping]] = [
    (("conv_id", "turn", "role", "text"), Mapping(each="")),
    (("role", "text"), Mapping(each="")),
    (("prompt", "completion"), Mapping((("user", "prompt"), ("assistant", "completion")))),
    (("prompt", "response"), Mapping((("user", "prompt"), ("assistant", "response")))),
    (("instruction", "output"), Mapping((("user", "instruction"), ("assistant", "output")))),
    (("instruction", "input", "output"), Mapping((("user", "instruction"), ("user", "input"), ("assistant", "output")))),
    (("system", "prompt", "response"), Mapping((("system", "system"), ("user", "prompt"), ("assistant", "response")))),
    (("messages[].role", "messages[].content"), Mapping(each="messages", text="content")),
    (("messages[].role", "messages[].text"), Mapping(each="messages")),
    (("conversations[].from", "conversations[].value"), Mapping(each="conversations", role="from", text="value")),
]


def registry(layouts: Iterable[tuple[Iterable[str], Mapping]] = LAYOUTS) -> dict[str, Mapping]:
    return {fingerprint(field_paths): mapping for field_paths, mapping in layouts}


def at(value: object, path: str) -> object:
    for key in path.split(".") if path else ():
        value = value.get(key) if isinstance(value, dict) else None
    return value


def as_text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: str | None, mappings: dict[str, Mapping]) -> tuple[str, list[tuple[str, str]] | None]:
    """The fingerprint of a record and its ``(role, text)`` turns; None for a layout without a mapping or no JSON."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return "", None
    mark = fingerprint(paths(value))
    mapping = mappings.get(mark)
    if mapping is None:
        return mark, None
    if mapping.each is None:
        found = [(role, as_text(at(value, path))) for role, path in mapping.turns]
        return mark, [(role, text) for n, (role, text) in enumerate(found) if text or mapping.turns[n][1] != "input"]
    elements = at(value, mapping.each) if mapping.each else [value]
    turns = [(as_text(at(e, mapping.role)), as_text(at(e, mapping.text))) for e in elements or ()]
    return mark, [(ROLES.get(role, role), text) for role, text in turns]


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: _ESCAPES[m[0]], text) if _SPECIAL.search(text) else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[0]], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """The formatted turn and the range of its escaped text."""
    head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
    return f"{head}{body}{END}", (len(head), len(head) + len(body))


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """``role, text, start, end`` of each turn of a formatted string."""
    at_char = 0
    while at_char < len(formatted):
        head = formatted.index(CLOSE, at_char)
        end = formatted.index(END, head)
        if not formatted.startswith(OPEN, at_char):
            raise ValueError("not a formatted conversation")
        yield unescape(formatted[at_char + len(OPEN) : head]), unescape(formatted[head + 1 : end]), head + 1, end
        at_char = end + len(END)


FORMATTED = "conv_id {kind}, chunk int, fingerprint string, formatted string, loss array<struct<start:bigint,end:bigint>>"


def format_records(records: DataFrame, tasks: int, id_col: str = "conv_id", order_cols: tuple[str, ...] = ("turn",), record_col: str = "record", mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """Format records (JSON strings) that belong to conversations, in the order of ``order_cols`` and then of the record.

    Returns rows ``conv_id, chunk, fingerprint`` (of the chunk's first record), ``formatted`` and ``loss``, the ranges of
    assistant texts. Rows of a conversation are sorted by Spark and streamed, so a conversation of any length needs no more
    memory than one chunk; chunks end between turns. Records without a mapping give no turn: see :func:`unmapped`. Equal
    order values are ordered by the record; null ids are one conversation; null texts and roles are empty.
    """
    spark = records.sparkSession
    known = registry() if mappings is None else mappings
    kind = records.schema[id_col].dataType.simpleString()
    order = [F.col(quoted(c)).alias(f"o{n}") for n, c in enumerate(order_cols)]
    rows = records.select(F.col(quoted(id_col)).alias("conv_id"), F.col(quoted(record_col)).alias("record"), *order)
    sorted_rows = rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", *[f"o{n}" for n in range(len(order_cols))], "record")
    schema_text = FORMATTED.format(kind=kind)
    schema = arrow_schema(spark, schema_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, chunk, first, parts, loss, size = none, 0, "", [], [], 0

        def row() -> dict:
            return {"conv_id": current, "chunk": chunk, "fingerprint": first, "formatted": "".join(parts), "loss": loss}

        for batch in batches:
            done = []
            for conv, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark, turns = canonical(record, known)
                if current is not none and (conv != current or size >= CHUNK_CHARS):
                    done.append(row())
                    chunk = chunk + 1 if conv == current else 0
                    parts, loss, size = [], [], 0
                if not parts:
                    first = mark
                current = conv
                for role, text in turns or ():
                    piece, (a, b) = format_turn(role, text)
                    if role == "assistant":
                        loss.append({"start": size + a, "end": size + b})
                    parts.append(piece)
                    size += len(piece)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if current is not none:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    return sorted_rows.select("conv_id", "record").mapInArrow(run, schema_text)


def unmapped(records: DataFrame, record_col: str = "record", mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """Fingerprints without a mapping: ``fingerprint, n_records, example``; ``''`` stands for what is no JSON object."""
    known = registry() if mappings is None else mappings
    spark = records.sparkSession
    schema = arrow_schema(spark, "fingerprint string, record string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"fingerprint": m, "record": r} for r in batch.column(0).to_pylist() for m, turns in [canonical(r, known)] if turns is None]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    odd = records.select(F.col(quoted(record_col)).alias("record")).mapInArrow(run, "fingerprint string, record string")
    return odd.groupBy("fingerprint").agg(F.count("*").alias("n_records"), F.min("record").alias("example"))


DIGEST = "conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(formatted: DataFrame, tasks: int) -> DataFrame:
    """Per conversation what its formatted rows say, parsed again: turns, their digest, and the texts under the loss ranges."""
    spark = formatted.sparkSession
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema_text = DIGEST.format(kind=kind)
    schema = arrow_schema(spark, schema_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current = none
        turns = loss = None
        n_turns = n_loss = n_chars = 0

        def row() -> dict:
            return {"conv_id": current, "n_turns": n_turns, "turns_sha256": turns.hexdigest(), "loss_chars": n_loss, "loss_sha256": loss.hexdigest(), "formatted_chars": n_chars}

        for batch in batches:
            done = []
            for conv, text, ranges in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if conv != current or current is none:
                    if current is not none:
                        done.append(row())
                    current, turns, loss, n_turns, n_loss, n_chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, said, _, _ in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for r in ranges:
                    said = unescape(text[r["start"] : r["end"]])
                    loss.update(said.encode())
                    n_loss += len(said)
                n_chars += len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if current is not none:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    rows = formatted.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "formatted", "loss")
    return rows.mapInArrow(run, schema_text)
