"""Secrets in texts: patterns, and strings that compression finds new.

Beside three fixed patterns, a long string near a sensitive word is measured by what it adds
to the zstandard frame of the text around it, with a compressor that a dictionary of code
identifiers has primed. A string that neither its surroundings nor the dictionary explains
adds nearly its own length, and is reported if its letters can carry that much at all.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from cohortlens.llm.arrow import append_columns

#: Kinds of spans in their order.
KINDS = ("assign", "access", "hex", "novel")
#: The patterns of the first three kinds, and the least length of what counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A run of the hex pattern that is long enough is found by its length at once.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

#: Strings that are measured, each part of ``name=value`` on its own (a value keeps the ``=`` at
#: its end), words that make a place sensitive, and how far they reach to either side.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{16,}(?:=+(?![A-Za-z0-9+/_.=-]))?")
SENSITIVE = re.compile(
    r"key|secret|token|passw|passphrase|pwd|auth|bearer|credential|private|signature|session|cookie|login", re.I | re.A
)
REACH = 48
#: Characters of text on either side that the frame holds.
AROUND = 256
#: Of the levels tried (3, 9, 15, 19) the one that finds the dictionary's words in joined names.
LEVEL = 9
#: Added bytes per byte of the string from which on it counts as new.
NOVELTY = 0.7
#: Bytes per character that the kinds of characters in a string must be able to carry. Digits
#: alone carry 0.42 and letters of one case 0.59: numbers and plain words, however rare.
CAPACITY = 0.6
_CLASSES = [(re.compile("[0-9]"), 10), (re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26)]

IDENTIFIERS = " ".join("""
abstract access account action address admin algorithm append application argument array assert async
attribute authorization await background base64 boolean break buffer builder bytes callback catch certificate
channel charset class client cluster column command comment commit compile component config configuration
connection console const constant constructor container content context continue controller cookie count
create credentials current data database datetime debug decode default delete description destination
development device dictionary directory disabled display document domain double download element else email
enabled encode encoding encrypt endpoint entity enum environment error event example exception execute
export expression extends factory false field file filename filter final finally float folder format from
function generate generic global group handler hash header height hidden host href html http https identifier
image implements import include index info init input insert instance integer interface internal iterator java
javascript json keyword label language length library license limit list listener load local localhost location
logger login manager master match memory message metadata method model module mutable namespace network node
null number object offset operator option order output override package page param parameter parent parse
password path pattern payload permission port position prefix primary print private process product profile
project property protected protocol provider proxy public python query queue random range reader record
reference region register release remote remove render replace request require reset resource response result
return role route schema scope script search secret section security select sequence server service session
setting signature size socket source stack start state static status storage stream string struct style
subject submit suffix super switch symbol system table target task template test text thread throw time
timestamp title token total trace transaction transform true type undefined union unique unit update upload
url user username utils valid validate value variable vector version view void volatile width window
worker write writer xml yaml
/usr/lib/python3/site-packages/ /usr/local/share/ /usr/bin/ /home/user/ /var/log/ /etc/ /opt/ /tmp/ node_modules/
src/main/java/ dist/index .html .json .yaml .txt .csv .log http://www. https://api. mail.example.com example.org example.net
""".split()).encode()


def capacity(string: str) -> float:
    """Bytes per character that random characters of the kinds in the string would carry. A
    capital at the start is that of a word."""
    size = sum(n for pattern, n in _CLASSES if pattern.search(string, 1))
    return math.log2(size) / 8 if size else 0.0

_ANY = (
    r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}|[A-Za-z0-9+/_=.\-]{16}"
)

SPAN = StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("novelty", DoubleType()),
])


class Scanner:
    """Spans of texts: ``(start, order of the kind, end, novelty or None)``."""

    def __init__(self, dictionary: bytes = IDENTIFIERS, novelty: float = NOVELTY):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False)
        self.least = novelty

    def novelty(self, before: str, string: str, after: str) -> float:
        """Bytes the string adds to the frame of its surroundings, per byte of its own."""
        around = (before + after).encode()
        own = string.encode()
        added = len(self.compressor.compress(around + own)) - len(self.compressor.compress(around))
        return added / len(own)

    def spans(self, text: str) -> list[tuple]:
        out = [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        out += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
        out += [(m.start(), 2, m.end(), None) for m in _LONG_HEX.finditer(text)]
        base = list(out)
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            if any(a < end and start < b for a, _, b, _ in base):
                continue
            before, after = max(0, start - REACH), min(len(text), end + REACH)
            if not SENSITIVE.search(text, before, start) and not SENSITIVE.search(text, end, after):
                continue
            score = self.novelty(text[max(0, start - AROUND) : start], m[0], text[end : end + AROUND])
            if score >= self.least and capacity(m[0]) >= CAPACITY:
                out.append((start, 3, end, score))
        return sorted(out)


def scan(docs: DataFrame, keep: list[str], text: str = "text", dictionary: bytes = IDENTIFIERS,
         novelty: float = NOVELTY) -> DataFrame:
    """``keep`` of each row with ``spans``: kind, place in code points (end exclusive) and, for
    strings found by compression, the bytes they add per byte.

    Spans are in order of start, then of kind. Matches of a kind don't overlap; those of
    different kinds may, but a string that overlaps a pattern's span isn't measured. Every other
    string with a sensitive word before or behind it, in reach, is; what is new is reported if its
    kinds of characters can carry as much (``CAPACITY``). A null
    or empty text has no spans; an empty table gives an empty one; repeated rows are scanned
    alike; an input column named ``spans`` is replaced.
    """

    def make():
        scanner = Scanner(dictionary, novelty)

        def run(texts: pa.Array) -> list[pa.Array]:
            # texts without anything to look at are passed over by one automaton
            some = pc.match_substring_regex(texts, _ANY).to_numpy(zero_copy_only=False)
            found = {i: scanner.spans(texts[i].as_py()) for i in np.flatnonzero(some).tolist()}
            flat = [s for spans in found.values() for s in spans]
            counts = np.zeros(len(texts) + 1, np.int64)
            for i, spans in found.items():
                counts[i + 1] = len(spans)
            kinds = [KINDS[s[1]] for s in flat]
            structs = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array([s[0] for s in flat], pa.int32()),
                 pa.array([s[2] for s in flat], pa.int32()), pa.array([s[3] for s in flat], pa.float64())],
                ["kind", "start", "end", "novelty"],
            )
            return [pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), structs)]

        return run

    return append_columns(docs, make, [StructField("spans", ArrayType(SPAN))], keep, text)
