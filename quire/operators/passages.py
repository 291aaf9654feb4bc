"""Overlapping passages with exact offsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, OVERLAP = 1600, 200
#: Characters of text that are cut at a time, so that what a worker holds does not depend on its batches.
HELD = 1 << 21
_ENDS = (". ", "! ", "? ", ".\n", "\n")


def _seam(text: str, low: int, high: int) -> int:
    """Where a window that may reach ``high`` should end, -1 without a seam from ``low`` on."""
    if (at := text.rfind("\n\n", low, high)) >= 0:
        return at
    if (at := max(text.rfind(mark, low, high) for mark in _ENDS)) >= 0:
        return at + 1
    return text.rfind(" ", low, high)


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Offsets of the windows of a trimmed text: each ends at a seam in its last third if it can."""
    at, total = 0, len(text)
    while at < total:
        end = min(at + size, total)
        if end < total and (cut := _seam(text, at + size * 2 // 3, end)) > at:
            end = cut
        yield at, end
        if end == total:
            return
        at = max(end - overlap, at + 1)


def passages(sections: DataFrame, id_col: str | Sequence[str] = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, number (from 0), char_start, char_end and text (trimmed) of each section's passages.

    The id is one column or several, of any type; a key named as an output column is an error.
    Offsets are into the trimmed section. Blank and null sections have no passages.
    """
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    if taken := {"number", "char_start", "char_end", "text"} & set(keys):
        raise ValueError(f"key columns named as outputs: {sorted(taken)}")

    most = HELD

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            at, *columns = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 5, [pa.int64()] * 4 + [pa.string()], strict=True))
            return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *columns], [*keys, "number", "char_start", "char_end", "text"])

        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for i, value in enumerate(batch.column("__text")):
                text, number = value.as_py(), 0
                for a, b in windows(text, size, overlap):
                    if piece := text[a:b].strip():
                        rows.append((i, number, a, b, piece))
                        number, held = number + 1, held + len(piece)
                    if held >= most:
                        yield made(batch, rows)
                        rows, held = [], 0
            yield made(batch, rows)

    trimmed = F.regexp_replace(F.coalesce(text_col, F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = sections.select(*keys, trimmed.alias("__text")).where("__text <> ''")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__text"]).add("number", "long").add("char_start", "long").add("char_end", "long").add("text", "string")
    return rows.mapInArrow(cut, schema)
