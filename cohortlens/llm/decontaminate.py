"""Passages of benchmark items in documents, found by one Aho-Corasick automaton.

Texts are normalised to words; each distinct word of the benchmark is one symbol, all other
words are a symbol that no pattern has. The windows of all items, as strings of symbols, make
the automaton, and each document, as such a string, is scanned once. A place in it is a word's
number, from which the offsets in the original text follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from cohortlens.llm.arrow import Words, append_columns, coded, list_array

#: Words of a window.
WINDOW_WORDS = 10
#: Windows in one automaton (about half a kilobyte each); more make a further pass.
BLOCK_WINDOWS = 200_000
#: Distinct words in one automaton: each is a character, and there are 1,112,063 to be had.
BLOCK_WORDS = 1_000_000

#: Characters of words are all but these, after A-Z are in lower case.
_SPLIT = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in _SPLIT else b for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[str]:
    """Normalised words of one text."""
    return (text or "").encode().translate(_TABLE).decode().split()


def doc_words(texts: pa.Array) -> Words:
    """Normalised words of each text."""
    texts = pa.concat_arrays([texts])
    data = texts.buffers()[2]
    data = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_TABLE))
    plain = pa.Array.from_buffers(texts.type, len(texts), [None, texts.buffers()[1], data], 0, texts.offset)
    return coded(pc.ascii_split_whitespace(plain))


def windows(words: list[str], size: int = WINDOW_WORDS) -> list[tuple[str, ...]]:
    """All runs of ``size`` words; a shorter text is one run, one without words has none."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def window_blocks(
    items: DataFrame, id_col: str, text: str, limit: int, max_words: int = BLOCK_WORDS
) -> Iterator[dict]:
    """Window -> its items, at most ``limit`` windows of ``max_words`` different words (or a single
    window) at a time; items arrive one by one."""
    block: dict[tuple[str, ...], set] = {}
    known: set[str] = set()
    for row in items.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        for window in windows(item_words(row.t)):
            if window in block:
                block[window].add(row.i)
                continue
            more = sum(w not in known for w in set(window))
            if block and (len(block) >= limit or len(known) + more > max_words):
                yield block
                block, known = {}, set()
            block[window] = {row.i}
            known.update(window)
    if block:
        yield block


def _symbols(numbers: np.ndarray) -> str:
    """One character per number, surrogates left out."""
    numbers = numbers + 1
    return np.where(numbers < 0xD800, numbers, numbers + 0x800).astype("<u4").tobytes().decode("utf-32-le")


class Scanner:
    """The automaton of one block of windows."""

    def __init__(self, block: dict[tuple[str, ...], list]):
        vocabulary = list(dict.fromkeys(w for window in block for w in window))
        number = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = pa.array(vocabulary, pa.string())
        self.automaton = ahocorasick.Automaton()
        for window, items in block.items():
            key = _symbols(np.array([number[w] for w in window]))
            self.automaton.add_word(key, (len(window), items))
        if block:
            self.automaton.make_automaton()
        self.any = bool(block)

    def found(self, words: Words) -> list[tuple[int, int, list]]:
        """Places of windows in all texts' words in a row: first word, number of words, items."""
        if not self.any or not len(words.codes):
            return []
        known = pc.index_in(words.words, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        # between texts stands the symbol of unknown words
        string = _symbols(np.insert(known[words.codes].astype(np.int64), words.starts[1:-1], -1))
        inserted = words.starts[1:-1] + np.arange(len(words.starts) - 2)
        out = []
        for end, (size, items) in self.automaton.iter(string):
            first = end - size + 1
            out.append((first - int(np.searchsorted(inserted, first)), size, items))
        return out


HIT = StructType([StructField(c, IntegerType()) for c in ("word", "start", "end")])
FIELDS = [
    StructField("n_words", LongType()),
    StructField("hits", ArrayType(HIT)),
    StructField("item_ids", ArrayType(LongType())),
]


def _scan(block: dict[tuple[str, ...], list]):
    def make():
        scanner = Scanner(block)

        def scan(texts: pa.Array) -> list[pa.Array]:
            words = doc_words(texts)
            hit = np.zeros(len(words.codes) + 1, np.int32)
            items: list[set] = [set() for _ in range(len(texts))]
            for first, size, ids in scanner.found(words):
                hit[first] += 1
                hit[first + size] -= 1
                items[int(np.searchsorted(words.starts, first, "right")) - 1].update(ids)
            places = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
            counts = np.searchsorted(places, words.starts)
            start, end = np.zeros(len(places), np.int32), np.zeros(len(places), np.int32)
            for doc in np.flatnonzero(np.diff(counts)).tolist():
                # only texts with hits: where their words stand in the original
                spans = np.array([m.span() for m in _WORD.finditer(texts[doc].as_py())], np.int32)
                a, b = counts[doc], counts[doc + 1]
                start[a:b], end[a:b] = spans[places[a:b] - words.starts[doc]].T
            numbers = places - np.repeat(words.starts[:-1], np.diff(counts))
            hits = pa.StructArray.from_arrays(
                [pa.array(numbers.astype(np.int32)), pa.array(start), pa.array(end)], list(HIT.fieldNames())
            )
            found = [sorted(x - {None}) for x in items]
            return [
                pa.array(np.diff(words.starts), pa.int64()),
                pa.ListArray.from_arrays(pa.array(counts, pa.int32()), hits),
                list_array(
                    np.array([i for x in found for i in x], np.int64),
                    np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int64(),
                ),
            ]

        return scan

    return make


def scan(
    docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``keep`` of each row with ``n_words``, ``hits`` and ``item_ids``.

    ``hits`` has each word inside an occurrence of a window once: its number among the
    text's words and its place in the original text in code points, end exclusive.
    ``item_ids`` are the items with an occurring window, ascending; an item without an id
    marks words but isn't listed. A null or empty text has no words; items with equal windows
    are all listed; without items nothing is hit; an empty table gives an empty one; input
    columns with the names of new ones are replaced. The items are the small side: they are
    sent to the tasks in blocks of ``block_windows`` windows and ``BLOCK_WORDS`` different words
    at most, and more blocks are more passes.
    """
    blocks = [
        {w: list(i) for w, i in b.items()} for b in window_blocks(items, item_id, item_text, block_windows)
    ]
    keep = [c for c in keep if c not in ("n_words", "hits", "item_ids")]
    if len(blocks) <= 1:
        return append_columns(docs, _scan(blocks[0] if blocks else {}), FIELDS, keep, text)
    out, names = docs, []
    for number, block in enumerate(blocks):
        fields = [StructField(f"{f.name}__{number}", f.dataType) for f in FIELDS]
        out = append_columns(out, _scan(block), fields, list(dict.fromkeys([*keep, text, *names])), text)
        names += [f.name for f in fields]
    def merged(name: str):
        found = F.flatten(F.array(*[F.col(f"{name}__{i}") for i in range(len(blocks))]))
        return F.array_sort(F.array_distinct(found)).alias(name)

    return out.select(*keep, F.col("n_words__0").alias("n_words"), merged("hits"), merged("item_ids"))
