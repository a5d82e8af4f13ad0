"""Cut documents into chunks. The order inside one document matters, so a document is one row of work;
documents run in parallel, batch by batch, and are never grouped or collected."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.session import spread

# What counts as a heading, a blank line and a line end.
HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")
LEVELS = 6
BLANK_LINES = re.compile(r"\n\s*\n")
LINE_ENDS = "\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
#: Characters of the chunks of one frame, about.
PIECE_CHARS = 1 << 20
ARROW_TYPES = {"string": pa.string(), "int": pa.int32()}
CHUNK_SCHEMA = (
    "id string, document_id string, chunk_index int, text string, heading_path string, line_start int, "
    "line_end int, token_count int, content_hash string, parent_id string, chunk_type string, parent_chunk_index int"
)


def _digest(prefix: str, *parts: object) -> str:
    return prefix + hashlib.sha1(":".join(map(str, parts)).encode()).hexdigest()[:20]


def _outline(lines: list[str]) -> tuple[np.ndarray, list[str]]:
    """First line of every section, and the headings it stands under.

    A section begins at each heading, and at the top if no heading is there. Of each level the latest
    heading counts, unless one of a lower level came after it.
    """
    found = [(i, len(m[1]), m[2].strip()) for i, m in enumerate(map(HEADING.match, lines)) if m]
    if not found:
        return np.zeros(1, np.int64), [""]
    at, level, titles = zip(*found)
    latest = np.full((LEVELS, len(found)), -1)
    latest[np.array(level) - 1, np.arange(len(found))] = np.arange(len(found))
    latest = np.maximum.accumulate(latest, axis=1)  # level x heading -> latest heading of the level so far
    above = np.vstack([np.full(len(found), -1), np.maximum.accumulate(latest, axis=0)[:-1]])
    paths = [" > ".join(titles[j] for j in column[column > over].tolist()) for column, over in zip(latest.T, above.T)]
    top = [0] if at[0] else []
    return np.array([*top, *at]), [""] * len(top) + paths


def _packed(lengths: np.ndarray, room: int, gap: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring blocks that fit into `room` with `gap` between two, filled from the left."""
    ends = np.cumsum(lengths + gap)
    out, start = [], 0
    while start < len(lengths):
        used = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, used + room + gap, side="right")))
        out.append((start, stop))
        start = stop
    return out


def _pieces(text: str, room: int, overlap: int) -> list[str]:
    """A section as pieces: packed paragraphs; a paragraph that has no room is cut every room - overlap characters."""
    if len(text) <= room:
        return [text] if text else []
    blocks = [b for b in (raw.strip() for raw in BLANK_LINES.split(text)) if b]
    out: list[str] = []
    for start, stop in _packed(np.array([len(b) for b in blocks]), room, 2):
        body, step = "\n\n".join(blocks[start:stop]), room - overlap
        cuts = 1 + max(0, -(-(len(body) - room) // step))
        out += [body] if cuts == 1 else [body[k * step : k * step + room].strip() for k in range(cuts)]
    return [piece for piece in out if piece]


def _limits(size: int, overlap: int) -> tuple[int, int]:
    size = max(200, int(size))
    return size, max(0, min(int(overlap), size // 2))


def _chunks(document_id: str, content: str, size: int, overlap: int) -> list[dict]:
    """Rows of one document. A piece is placed below the ones before it in its section, by counted lines."""
    room, shared = _limits(size, overlap)
    lines = content.splitlines()
    starts, paths = _outline(lines)
    found = [(path, int(a) + 1, piece) for path, a, b in zip(paths, starts, [*starts[1:], len(lines)]) for piece in _pieces("\n".join(lines[a:b]).strip(), room, shared)]
    height = np.array([piece.count("\n") + 1 for _, _, piece in found], np.int64)
    above = np.cumsum(height) - height
    section = np.array([first for _, first, _ in found], np.int64)
    line = section + above - above[np.searchsorted(section, section)] if found else section
    return [
        {
            "id": _digest("kchunk_", document_id, index, piece), "document_id": document_id, "chunk_index": index, "text": piece, "heading_path": path, "line_start": int(top), "line_end": int(top + tall) - 1,
            "token_count": max(1, len(piece) // 4), "content_hash": hashlib.sha256(piece.encode()).hexdigest(), "parent_id": None, "chunk_type": "child", "parent_chunk_index": None,
        }
        for index, ((path, _, piece), top, tall) in enumerate(zip(found, line, height))
    ]


def _families(document_id: str, content: str, parent: tuple[int, int], child: tuple[int, int]) -> list[dict]:
    """Parents, each followed by its children."""
    rows: list[dict] = []
    n_children = 0
    for index, row in enumerate(_chunks(document_id, content, *parent)):
        top = row | {"id": row["id"] + "_parent", "chunk_index": index, "chunk_type": "parent"}
        rows.append(top)
        for kid in _chunks(document_id, top["text"], *child):
            rows.append(
                kid
                | {
                    "id": _digest("kchild_", top["id"], n_children, kid["text"]),
                    "chunk_index": len(rows),
                    "heading_path": kid["heading_path"] or top["heading_path"],
                    "line_start": top["line_start"],
                    "line_end": top["line_end"],
                    "parent_id": top["id"],
                    "parent_chunk_index": index,
                }
            )
            n_children += 1
    return rows


def _map_documents(docs: DataFrame, cut, id_col: str, content_col: str) -> DataFrame:
    """The chunks of all documents. They leave in frames of about PIECE_CHARS, so a task holds one batch of texts and one frame."""
    schema = pa.schema([pa.field(name, ARROW_TYPES[kind]) for name, kind in (part.split() for part in CHUNK_SCHEMA.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column("k"), batch.column("t")):
                for row in cut(key.as_py(), text.as_py() or ""):
                    rows.append(row)
                    held += len(row["text"])
                    if held >= PIECE_CHARS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    slim = spread(docs.select(F.col(id_col).cast("string").alias("k"), F.col(content_col).alias("t")))
    return slim.mapInArrow(run, CHUNK_SCHEMA)


def chunk_markdown(docs: DataFrame, max_chars: int = 1200, overlap: int = 120, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """Chunks of at most `max_chars` per heading section, with heading path, lines, tokens and ids."""
    return _map_documents(docs, lambda k, t: _chunks(k, t, max_chars, overlap), id_col, content_col)


def chunk_parent_child(
    docs: DataFrame, parent: tuple[int, int] = (1800, 180), child: tuple[int, int] = (600, 80), id_col: str = "id", content_col: str = "content"
) -> DataFrame:
    """Parent chunks and the child chunks cut from them; sizes are (characters, overlap)."""
    return _map_documents(docs, lambda k, t: _families(k, t, parent, child), id_col, content_col)


def _full(parts: Column) -> Column:
    return F.filter(F.transform(parts, tx.strip), lambda p: p != "")


def chunk_memory_text(docs: DataFrame, max_chars: int = 400, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, pos, block) of a memory text: `##` sections, long ones by paragraph, long paragraphs by bullet."""
    short = lambda part, rest: F.when(F.length(part) <= max_chars, F.array(part)).otherwise(rest(part))
    each = lambda parts, rest: F.flatten(F.transform(parts, lambda p: short(p, rest)))
    solid = lambda part: F.array_join(_full(F.split(part, LINE_ENDS)), "\n")
    bullets = lambda part: F.split(solid(part), f"\n(?=[-*]{tx.SPACE})")
    paragraphs = lambda section: each(_full(F.split(section, "\n{2,}")), bullets)
    sections = _full(F.split(tx.strip(F.coalesce("text", F.lit(""))), f"(?md)(?=^##{tx.SPACE})"))
    slim = docs.select(F.col(id_col).alias("id"), F.col(content_col).alias("text"))
    return slim.select("id", F.posexplode(each(sections, paragraphs)).alias("pos", "block"))


def sample_chunks(blocks: DataFrame, n: int, seed: int) -> DataFrame:
    """`n` blocks per text, drawn by a seeded hash; a text with fewer blocks gives all of them."""
    from tidemark.operators.windows import top_rows

    if n <= 0:
        return blocks.limit(0)
    order = [F.xxhash64(F.col("id"), F.col("pos"), F.lit(seed)), F.col("pos")]
    return top_rows(blocks, ["id"], order, n, "draw")
