"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts each text into chunks, so that passages documents share
give the same chunks wherever they stand. Documents are dealt out by a sketch of their
chunks, which brings copies and near copies to one task; there each chunk is encoded once.
The places where chunks meet are then repaired: text around them is encoded again until it
agrees with both chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from cohortlens.llm.arrow import append_columns, list_array, mixed, string_hashes
from cohortlens.llm.units import UnitEncoder

#: Bits of the rolling hash that must be zero at a cut: chunks of about 2**10 bytes.
CUT_BITS = 10
#: Longest chunk in bytes; text without cuts, as of one repeated word, is cut by length.
MAX_CHUNK = 8192
#: Bytes the rolling hash looks at.
WINDOW = 16
#: Chunks a task remembers before it starts with an empty memo again.
MEMO_CHUNKS = 8192
#: Units it remembers beside them: fewer than where there are no chunks.
MEMO_UNITS = 150_000

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Chunks of the texts: ``bounds`` in the texts' joined bytes, the chunk number at which
    each text starts, and the chunks themselves. An empty text has none."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    ends = offsets - base
    if size == 0:
        return np.zeros(1, np.int64), np.zeros(len(ends), np.int64), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, base)
    rolled = _GEAR[data]
    span = 1
    while span < WINDOW:  # the hash of a window from those of its halves
        rolled[span:] += rolled[:-span] << np.uint32(span)
        span *= 2
    found = np.flatnonzero(rolled < np.uint32(1 << 32 - CUT_BITS)) + 1
    found = found[found < size]
    # the window must lie inside the text
    found = found[found - ends[np.searchsorted(ends, found, "right") - 1] >= WINDOW]
    cuts = np.unique(np.concatenate([ends, found]))
    gaps = np.diff(cuts)
    extra = [np.arange(c + MAX_CHUNK, c + g, MAX_CHUNK) for c, g in
             zip(cuts[:-1][gaps > MAX_CHUNK].tolist(), gaps[gaps > MAX_CHUNK].tolist(), strict=True)]
    inner = np.concatenate([found, *extra]).astype(np.int64)
    for _ in range(3):  # back to the first byte of a character
        inner = inner - ((data[inner] & 0xC0) == 0x80)
    bounds = np.unique(np.concatenate([ends, inner]))
    chunks = pa.Array.from_buffers(
        pa.string(), len(bounds) - 1, [None, pa.py_buffer((bounds + base).astype(np.int32)), texts.buffers()[2]]
    )
    return bounds, np.searchsorted(bounds, ends), chunks


def _sketches():
    def make(texts: pa.Array) -> list[pa.Array]:
        _, first, chunks = chunk_bounds(texts)
        hashes = string_hashes(chunks).view(np.int64)
        out = np.full(len(texts), np.iinfo(np.int64).max)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            # the least hash of many chunks is small: mixed again, long texts don't gather in one range
            least = np.minimum.reduceat(hashes, first[full])
            out[full] = mixed(least.view(np.uint64)).view(np.int64)
        return [pa.array(out)]

    return make


class Chunk(NamedTuple):
    """A chunk's ids by units (parts that begin with a space); its first and its last unit
    may go on in the chunks beside it."""

    text: str
    ids: np.ndarray
    lens: np.ndarray


_NONE = np.zeros(0, np.uint32)


class Window(NamedTuple):
    """A place where chunks meet, with the unit on either side of it, and the ids that these
    units have in their chunks."""

    text: str
    left: np.ndarray
    right: np.ndarray


class ChunkEncoder:
    """Ids of texts from remembered chunks and repaired joins."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        self.units = UnitEncoder(path, memo_units=MEMO_UNITS)
        if not self.units.drops_space:
            raise ValueError("the joins need a tokenizer that starts anew at every space")
        self.memo: dict[str, Chunk] = {}
        self.memo_chunks = memo_chunks
        self.encoded = self.joins = self.whole = 0

    def _chunks(self, chunks: pa.Array) -> list[Chunk]:
        """Each chunk's ids; those not yet known are encoded."""
        coded = chunks.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        if len(self.memo) > self.memo_chunks:
            self.memo.clear()
        new = [t for t in texts if t not in self.memo]
        if new:
            rows, starts = self.units.unit_rows(pa.array(new, pa.string()))
            ids, ends = self.units.memo.ids(rows)
            lens = self.units.memo.lens[rows]
            for text, a, b in zip(new, starts.tolist(), starts[1:].tolist(), strict=False):
                self.memo[text] = Chunk(text, ids[ends[a] : ends[b]], lens[a:b])
            self.encoded += len(new)
        found = [self.memo[t] for t in texts]
        return [found[i] for i in coded.indices.to_pylist()]

    def _repaired(self, windows: list[Window]) -> list[np.ndarray | None]:
        """Ids of the middle of each window; None if the units beside it come out differently
        than alone."""
        together = self.units.tokenizer.encode_batch_fast([w.text for w in windows], add_special_tokens=False)
        out = []
        for found, w in zip(together, windows, strict=True):
            ids = found.ids
            start, end = len(w.left), len(ids) - len(w.right)
            agrees = start <= end and ids[:start] == w.left.tolist() and ids[end:] == w.right.tolist()
            out.append(np.array(ids[start:end], np.uint32) if agrees else None)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, those of encoding it as a whole."""
        _, first, chunk_texts = chunk_bounds(texts)
        chunks = self._chunks(chunk_texts)
        windows: list[Window] = []
        plans: list[list] = []
        for start, end in zip(first.tolist(), first[1:].tolist(), strict=False):
            parts: list = []
            # the unit before and its ids, the open text, its ids if not joined yet
            before, left, opened, alone = "", _NONE, None, None
            for c in chunks[start:end]:
                if len(c.lens) == 1:
                    opened, alone = (c.text, c.ids) if opened is None else (opened + c.text, None)
                    continue
                head, tail = int(c.lens[0]), len(c.ids) - int(c.lens[-1])
                last = c.text.rsplit(" ", 2)
                if opened is None:
                    parts.append(c.ids[:tail])
                else:
                    units = c.text.split(" ", 2)
                    after, right = (" " + units[1], c.ids[head : head + int(c.lens[1])]) if len(units) > 2 else ("", _NONE)
                    parts.append(len(windows))
                    windows.append(Window(before + opened + units[0] + after, left, right))
                    parts.append(c.ids[head:tail])
                opened, alone = " " + last[-1], c.ids[tail:]
                before, left = (" " + last[-2], c.ids[tail - int(c.lens[-2]) : tail]) if len(last) > 2 else ("", _NONE)
            if alone is not None:
                parts.append(alone)
            elif opened is not None:
                parts.append(len(windows))
                windows.append(Window(before + opened, left, _NONE))
            plans.append(parts)
        repaired = self._repaired(windows)
        self.joins += len(windows)
        out = []
        for i, parts in enumerate(plans):
            runs = [repaired[p] if isinstance(p, int) else p for p in parts]
            if any(r is None for r in runs):
                self.whole += 1  # no agreement nearby: the widest window there is
                ids = self.units.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
                runs = [np.array(ids, np.uint32)]
            out.append(np.concatenate(runs) if runs else np.zeros(0, np.uint32))
        return out


def ids_and_text(tokenizer, encoded: list[np.ndarray]) -> list[pa.Array]:
    """The ids of each text, and the text decoded from them."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in encoded])])
    flat = np.concatenate([*encoded, np.zeros(0, np.uint32)])
    decoded = tokenizer.decode_batch([x.tolist() for x in encoded], skip_special_tokens=False)
    return [list_array(flat.astype(np.int32), starts, pa.int32()), pa.array(decoded, pa.string())]


IDS_AND_TEXT = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]


def encode(
    docs: DataFrame, tokenizer: str, keep: list[str], id_col: str = "doc_id", text: str = "text",
    finish: Callable = ids_and_text, fields: list[StructField] | None = None, tasks: int | None = None,
) -> DataFrame:
    """``keep`` of each row with ``ids`` and ``decoded``: the ids of its whole text and the
    text decoded from them, as the tokenizers library gives them.

    ``finish(tokenizer, list of ids)`` may give other columns, described by ``fields``, so
    that what is derived from ids need not leave the task. Rows are dealt out by ranges of
    (sketch, id): a group of copies as large as a third of the table is split among tasks by
    its ids. A null text is empty, and an empty text has no ids and decodes to an empty one;
    an empty table gives an empty one; repeated rows are encoded like others; input columns
    with the names of new ones are replaced.
    """
    tasks = tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketch = "sketch"
    while sketch in docs.columns:
        sketch += "_"
    columns = list(dict.fromkeys([*keep, id_col, text]))
    routed = append_columns(docs, _sketches, [StructField(sketch, LongType())], columns, text)
    routed = routed.repartitionByRange(tasks, sketch, F.col(id_col)).sortWithinPartitions(sketch)

    def make():
        encoder = ChunkEncoder(tokenizer)

        def run(texts: pa.Array) -> list[pa.Array]:
            return finish(encoder.units.tokenizer, encoder.encode(pc.cast(texts, pa.string())))

        return run

    return append_columns(routed, make, fields or IDS_AND_TEXT, keep, text)
