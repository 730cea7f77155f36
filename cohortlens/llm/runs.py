"""Words as runs of bytes, found in whole slices of text at once, and counts of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct keys a task holds before it hands its counts on.
HELD = 1 << 19


class Runs(NamedTuple):
    """Words of several texts in a row. Word i is ``words[codes[i]]`` and stands in text
    ``rows[i]``; ``breaks[i]`` counts the breaking bytes of the slice before it."""

    codes: np.ndarray
    rows: np.ndarray
    breaks: np.ndarray
    words: pa.StringArray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each string starts (with the end)."""
    texts = pa.concat_arrays([texts])
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


def find_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, breaking: np.ndarray | None = None) -> Runs:
    """Maximal runs of the bytes marked ``inside``; texts end runs."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(inside)])
    cuts = np.append(before[starts], before[-1]).astype(np.int32)
    kept = np.ascontiguousarray(data[inside])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(kept))
    coded = words.dictionary_encode()
    rows = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.zeros(0, np.int64) if breaking is None else np.cumsum(breaking)[starts]
    return Runs(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows, breaks, coded.dictionary)


def group_sums(table: pa.Table, keys: list[str], value: str) -> pa.Table:
    out = table.group_by(keys, use_threads=False).aggregate([(value, "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*keys, value])


def summed(tables: Iterator[pa.Table], keys: list[str], value: str, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Sums by key over what a task reads, handed on when ``held`` keys are in memory."""
    parts: list[pa.Table] = []
    rows = 0
    for table in tables:
        parts.append(table)
        rows += table.num_rows
        if rows > held:
            parts = [group_sums(pa.concat_tables(parts), keys, value)]
            rows = parts[0].num_rows
            if rows > held // 2:
                yield from parts[0].to_batches()
                parts, rows = [], 0
    if parts:
        yield from group_sums(pa.concat_tables(parts), keys, value).to_batches()


def lower_texts(column: pa.Array) -> pa.Array:
    """A-Z in lower case; a null is an empty text."""
    return pc.ascii_lower(pc.fill_null(column, ""))
