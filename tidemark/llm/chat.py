"""Chat formatting: heterogeneous records to canonical turns, a template, and the loss mask.

A record is JSON text. The set of its nested field paths ("messages[].content") is hashed, and the
hash chooses a declarative mapping: where turns are, in which order, and what their roles are called.
The template marks turns by control strings; control strings inside texts are escaped so that reading
back restores every text. Records of an unknown layout give one row with layout null and no text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """One layout: `fields` lists (role, path) of single turns in order; `turns` names a list of turns."""

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict, hash=False)


MAPPINGS = (
    Mapping("prompt", ("prompt",), fields=(("user", "prompt"),)),
    Mapping("response", ("response.text",), fields=(("assistant", "response.text"),)),
    Mapping("pair", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system", ("instruction",), fields=(("system", "instruction"),)),
    Mapping("instruction", ("input", "instruction", "output"), fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction_output", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("messages", ("messages[].content", "messages[].role"), turns="messages"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested paths of all leaves; lists add "[]", whatever their length."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _get(value: object, path: str) -> str:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: object, mapping: Mapping) -> list[tuple[str, str]]:
    if mapping.turns:
        found = [(_get(t, mapping.role), _get(t, mapping.text)) for t in record[mapping.turns]]
        return [(mapping.roles.get(role, role), text) for role, text in found]
    return [(role, _get(record, path)) for role, path in mapping.fields]


def escape(text: str) -> str:
    """No "<|" is left: each gets a backslash, and so does each that already looks escaped."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(block, start and end of the loss mask in it, in code points); no mask: two zeros."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    mask = (len(head), len(head) + len(body)) if role == TRAINED else (0, 0)
    return f"{head}{body}{END}\n", *mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, as they were."""
    turns = []
    for block in formatted.split(START)[1:]:
        role, _, body = block.partition("\n")
        turns.append((unescape_role(role), unescape(body[: body.rindex(END)])))
    return turns


def format_records(df: DataFrame, id_col: str, order_col: str, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """One row per turn: id, order, place (in the record), layout, role, block, loss_start, loss_end."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, order_col)}
    schema = f"`{id_col}` {kinds[id_col]}, `{order_col}` {kinds[order_col]}, place int, layout string, role string, block string, loss_start bigint, loss_end bigint"
    known = {fingerprint(m.paths): m for m in mappings}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("record").to_pylist()):
                try:
                    record = json.loads(text or "null")
                except ValueError:
                    record = None
                mapping = known.get(fingerprint(field_paths(record)))
                if mapping is None:
                    at.append(i)
                    rows.append((0, None, None, None, 0, 0))
                    continue
                for place, (role, said) in enumerate(canonical_turns(record, mapping)):
                    at.append(i)
                    rows.append((place, mapping.name, role, *format_turn(role, said)))
            index = pa.array(at, pa.int64())
            types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(index), batch.column("ord").take(index), *columns], names=[id_col, order_col, "place", "layout", "role", "block", "loss_start", "loss_end"])

    return df.select(F.col(id_col).alias("id"), F.col(order_col).alias("ord"), F.col(record_col).alias("record")).mapInArrow(run, schema)


def digest(turns: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """Read formatted turns back and sum up every conversation.

    Turns of a conversation pass through one task in order, one batch at a time: whatever its length,
    only running hashes are held. Rows with the same order stand by place and block.
    """
    kind = turns.schema[id_col].dataType.simpleString()
    ordered = turns.filter(F.col("block").isNotNull()).select(F.col(id_col).alias("id"), F.col(order_col).alias("ord"), "place", "block", "loss_start", "loss_end").repartition("id").sortWithinPartitions("id", "ord", "place", "block")
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, block, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("id", "block", "loss_start", "loss_end"))):
                if state is None or key != now:
                    if state is not None:
                        done.append((now, *_close(state)))
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                (role, text), = parse_turns(block)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if hi > lo:
                    trained = unescape(block[lo:hi])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(block)
            yield _rows(done, batch.schema.field("id").type, names, types)
        if state is not None:
            yield _rows([(now, *_close(state))], batch.schema.field("id").type, names, types)

    return ordered.select("id", "block", "loss_start", "loss_end").mapInArrow(run, f"`{id_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _close(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _rows(done: list, kind: pa.DataType, names: list[str], types: tuple) -> pa.RecordBatch:
    columns = zip(*done, strict=True) if done else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *types), strict=True)], names=names)
