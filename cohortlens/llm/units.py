"""Token ids of texts from a bounded memo of units, equal to encoding the whole text.

A unit is a piece of text between two places where the tokenizer always starts anew, so
that the ids of a text are those of its units in a row. Most units of a corpus recur, and a
worker encodes one once while the memo holds it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Units a worker remembers; above that it starts with an empty memo again.
#: The same bound holds for parts of units that the model was asked for.
MEMO_UNITS = 500_000
#: Units that are learnt at once.
LEARNT = 50_000
#: Characters of a piece of a text that is not split into units.
PIECE_CHARS = 1 << 15

#: The white space of the tokenizers' patterns (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_RE2_SPACE = SPACE.replace(" - ", "\\x{2000}-\\x{200a}")
#: A space in a run where the byte-level pattern may join it to its neighbours.
_JOINED = f"[{_RE2_SPACE}] (?:[{_RE2_SPACE}]|\\z)"
#: Letters that the patterns surely take as such, and characters whose class is plain.
_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = rf"\A[{_L}0-9 \n!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]*\z"
#: Stands between units that are cut in one go; it is in no plain text.
_BETWEEN = "\x00"
#: How the two kinds of pre-tokenizers cut plain text (no apostrophes, nothing else).
_KEEPS_SPACE = re.compile(rf" ?[{_L}]+|\x00| ?[0-9]+| ?[^\s\x00{_L}0-9]+|\s+(?![^\s\x00])|\s+")
_DROPS_SPACE = re.compile(rf"[{_L}]+|\x00|[0-9]|[^\s\x00{_L}0-9]+")
_PROBE = "Ab cd, the (end).\n Éàü 42x7 == a_b|c  d!? [x]:y;<z> ß Ø-9"
_BREAK = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


class Ragged(NamedTuple):
    """Values of several texts in a row; text i has values[starts[i]:starts[i+1]]."""

    values: np.ndarray
    starts: np.ndarray


def load(path: str) -> Tokenizer:
    """The tokenizer at ``path`` without truncation and padding, on the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` cut before white space that follows something else, about every ``size``
    characters. No token spans such a place."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _BREAK.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def gathered(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs ``pool[start : start + len]`` in a row."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - (ends - lens), lens)]


def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs between ``starts``; empty runs are 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def _byte_letters() -> np.ndarray:
    """The code point that stands for each byte in a byte-level vocabulary: printable ones
    for themselves, the others in order from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    out = np.arange(256, dtype="<u4")
    out[hidden] = 256 + np.arange(len(hidden))
    return out


class Memo:
    """Ids of strings, one row each, in one pool; ``lengths_only`` keeps their numbers alone."""

    def __init__(self, lengths_only: bool):
        self.lengths_only = lengths_only
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.lens = np.zeros(1 << 12, np.int64)
        self.at = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def add(self, strings: list[str], values: np.ndarray, at: np.ndarray, lens: np.ndarray) -> None:
        """New strings; string i has the ids ``values[at[i] : at[i] + lens[i]]``."""
        row = len(self.rows)
        self.rows.update(zip(strings, range(row, row + len(strings)), strict=True))
        while len(self.lens) < len(self.rows):
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.lens[row : row + len(strings)] = lens
        if self.lengths_only:
            return
        while self.used + len(values) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(values)] = values
        self.at[row : row + len(strings)] = self.used + at
        self.used += len(values)

    def find(self, strings: list[str], learn: Callable[[list[str]], None]) -> np.ndarray:
        """Rows of distinct strings; ``learn`` adds those not yet known."""
        found = np.fromiter(map(self.rows.get, strings, repeat(-1)), np.int64, len(strings))
        unknown = np.flatnonzero(found < 0)
        new = [strings[i] for i in unknown.tolist()]
        for start in range(0, len(new), LEARNT):
            learn(new[start : start + LEARNT])
        found[unknown] = np.fromiter(map(self.rows.__getitem__, new), np.int64, len(new))
        return found

    def ids(self, rows: np.ndarray) -> Ragged:
        """Ids of the strings in ``rows``; only their places if lengths alone are kept."""
        lens = self.lens[rows]
        starts = np.concatenate([[0], np.cumsum(lens)])
        values = np.zeros(0, np.uint32) if self.lengths_only else gathered(self.pool, self.at[rows], lens)
        return Ragged(values, starts)


class Pretokens:
    """Ids of plain units by way of the library's model, without its regular expressions.

    Plain text (letters of Latin-1, digits, common punctuation, spaces, new lines) is cut as
    the tokenizer's pattern would, many units at once, and the model is asked for each
    distinct part once. No unit is plain if a probe doesn't come out as the library's.
    """

    def __init__(self, tokenizer: Tokenizer, drops_space: bool, lengths_only: bool = False):
        self.model, self.letters = tokenizer.model, _byte_letters()
        self.letters[0] = 0
        self.lower = drops_space
        self.pattern = _DROPS_SPACE if drops_space else _KEEPS_SPACE
        self.memo = Memo(False)
        probes = [_PROBE, "", " ", _PROBE + "\n", " " + _PROBE, "\n \n"]
        alone = [tokenizer.encode(p, add_special_tokens=False).ids for p in probes]
        values, starts = self.ids(probes)
        self.usable = [values[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == alone
        self.memo = Memo(lengths_only)

    def plain(self, units: list[str]) -> np.ndarray:
        """Which units :meth:`ids` can be asked for."""
        if not self.usable:
            return np.zeros(len(units), bool)
        units = pa.array(units, pa.string())
        special = pc.match_substring(units, "<|")
        return pc.and_not(pc.match_substring_regex(units, _PLAIN), special).to_numpy(zero_copy_only=False)

    def _learn(self, parts: list[str]) -> None:
        spelled = np.frombuffer(_BETWEEN.join(parts).encode(), np.uint8)
        spelled = self.letters[spelled].tobytes().decode("utf-32-le").split(_BETWEEN)
        tokenize = self.model.tokenize
        ids, lens = [], []
        for part in spelled:
            tokens = tokenize(part)
            lens.append(len(tokens))
            ids += [t.id for t in tokens]
        lens = np.array(lens, np.int64)
        self.memo.add(parts, np.array(ids, np.uint32), np.cumsum(lens) - lens, lens)

    def ids(self, units: list[str]) -> Ragged:
        """Ids of each of the plain ``units``; only their places if lengths alone are kept."""
        if not units:
            return Ragged(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        memo = self.memo
        text = _BETWEEN.join(units)
        found = pa.array(self.pattern.findall(text.lower() if self.lower else text), pa.string()).dictionary_encode()
        parts = _strings(found.dictionary)
        if _BETWEEN not in memo.rows:
            memo.add([_BETWEEN], *_flat([[]]))
        rows = memo.find(parts, self._learn)[found.indices.to_numpy(zero_copy_only=False)]
        values, starts = memo.ids(rows)
        ends = np.flatnonzero(rows == memo.rows[_BETWEEN])
        return Ragged(values, np.concatenate([starts[:1], starts[ends], starts[-1:]]))


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of ids in a row, with the place and length of each."""
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    values = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))
    return values, np.cumsum(lens) - lens, lens


class UnitEncoder:
    """Ids of texts by way of units; ``lengths_only`` remembers numbers of ids alone."""

    def __init__(self, path: str, lengths_only: bool = False, memo_units: int = MEMO_UNITS):
        self.tokenizer = load(path)
        self.memo_units = memo_units
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [x.content for x in special]
        pre = self.tokenizer.pre_tokenizer
        # a pattern that drops white space restarts at every space; a byte-level one keeps it
        self.drops_space = "ByteLevel" not in type(pre).__name__
        self.pretokens = Pretokens(self.tokenizer, self.drops_space, lengths_only)
        self.memo = Memo(lengths_only)

    def _learn(self, units: list[str]) -> None:
        """Plain units by parts, the others by the library."""
        if len(self.pretokens.memo.rows) > self.memo_units:
            self.pretokens.memo.clear()
        plain = self.pretokens.plain(units)
        known = [u for u, p in zip(units, plain.tolist(), strict=True) if p]
        values, starts = self.pretokens.ids(known)
        self.memo.add(known, values, starts[:-1], np.diff(starts))
        if len(known) < len(units):
            other = [u for u, p in zip(units, plain.tolist(), strict=True) if not p]
            found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
            self.memo.add(other, *_flat([x.ids for x in found]))

    def unit_rows(self, texts: pa.Array) -> Ragged:
        """Rows of the memo for the units of each text; valid until the next call."""
        if len(self.memo.rows) > self.memo_units:
            self.memo.clear()
        odd = np.zeros(len(texts), bool)
        if not self.drops_space:
            odd |= pc.match_substring_regex(texts, _JOINED).to_numpy(zero_copy_only=False)
            for content in self.special:
                odd |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        whole = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(whole, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        encoded = lists.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        pieces = encoded.dictionary
        spaced = pc.binary_join_element_wise(" ", pieces, "") if len(pieces) else pieces
        rows = self.memo.find(_strings(spaced), self._learn)[codes]
        first = starts[:-1]
        if len(first):
            heads, which = np.unique(codes[first], return_inverse=True)
            rows[first] = self.memo.find(_strings(pieces.take(pa.array(heads))), self._learn)[which]
        if odd.any():
            # texts that units would not give exactly: pieces between safe places instead
            which = np.flatnonzero(odd).tolist()
            cuts = [safe_pieces(texts[i].as_py()) for i in which]
            cut = pa.array([*chain.from_iterable(cuts)], pa.string()).dictionary_encode()
            found = self.memo.find(_strings(cut.dictionary), self._learn)
            found = found[cut.indices.to_numpy(zero_copy_only=False)]
            ends = np.cumsum([len(c) for c in cuts])
            parts = dict(zip(which, np.split(found, ends[:-1]), strict=True))
            runs = [parts.get(i, rows[a:b]) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]
            starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
            rows = np.concatenate(runs)
        return Ragged(rows, starts)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        rows, starts = self.unit_rows(texts)
        return summed(self.memo.lens[rows], starts)

    def ids(self, texts: pa.Array) -> Ragged:
        """Ids of each text."""
        rows, starts = self.unit_rows(texts)
        values, ends = self.memo.ids(rows)
        return Ragged(values, ends[starts])
