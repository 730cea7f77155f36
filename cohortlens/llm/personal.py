"""Personal data in texts: four fixed kinds, and what stands where such data stand.

What the fixed kinds find are seeds. The two words before a seed and the two after it are
lexical patterns. A pattern's confidence is the share of its places, of all in the corpus, that
hold a known entity; an unseen identifier's score is the mean, over its places, of the better of
the two patterns there. Spark repeats both sums over the graph of patterns and identifiers: what
scores high supports patterns in the next round. Identifiers whose score stays high are
reported, wherever they stand.

A pattern's places are counted in a second pass over the texts. Tasks count only those pairs of
words that a filter of bounded size lets through; the join that follows is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType,
)

from cohortlens.llm.arrow import append_columns, coded, mixed, ship, slices, string_hashes
from cohortlens.llm.runs import lower_texts, summed
from cohortlens.session import durable

#: Kinds of spans in their order.
KINDS = ("email", "ip", "card", "phone", "context")
# The patterns of the first four kinds. An e-mail address starts with its run of
# letters, so every run is matched once, with what makes it an address or without.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, MOST_PART = (14, 19), (10, 15), 255

#: What may be an identifier: groups of digits, or a run with digits or an at sign in it.
IDENTIFIER = re.compile(r"[0-9]++(?:[\x20-][0-9]++)++|[A-Za-z0-9._%+#/@-]{6,}+")
LENGTHS, DIGITS = (6, 64), 4
_TRIM = "._%+#/@-"
#: Code points looked at on either side for words. Some marks are words of their own.
REACH = 80
MARKS = r"""[=:;,()<>\[\]{}"'|]"""
_MARK, _SPACE = re.compile(MARKS), re.compile(r"[\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BOUND = set(" \t\n\v\f\r=:;,()<>[]{}\"'|")

#: Entities a pattern needs, its least confidence, the score of an entity that counts as one of
#: them, the score from which on an identifier is reported, and rounds.
SUPPORT, CONFIDENCE, KNOWN, ACCEPTED, ROUNDS = 5, 0.5, 0.5, 0.8, 3
#: Bits of the filter for each pattern, and in all.
PATTERN_BITS, MOST_BITS = 16, 1 << 27

SPAN = "array<struct<start:int,kind:int,end:int>>"
SPANS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("start", "kind", "end")]))
PLACES = ArrayType(StructType([
    StructField("entity", StringType()), StructField("seed", BooleanType()), StructField("start", IntegerType()),
    StructField("end", IntegerType()), StructField("left", LongType()), StructField("right", LongType()),
]))
_PAIR = np.uint64(0xE7037ED1A0B428DB)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _PAIR + second).view(np.int64)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed kinds, in order."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text) if m[1]]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= MOST_PART for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if len(m[0]) >= CARD_DIGITS[0]:
            digits = _digits(m[0])
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]]
    return sorted(out)


def identifiers(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of what may be identifiers, outside ``spans``."""
    out = []
    ends = sorted((a, b) for a, _, b in spans)
    i = 0
    for m in IDENTIFIER.finditer(text):
        found = m[0].strip(_TRIM)
        start = m.start() + m[0].index(found) if found else 0
        end = start + len(found)
        if not LENGTHS[0] <= len(found) <= LENGTHS[1] or ("@" not in found and len(_digits(found)) < DIGITS):
            continue
        while i < len(ends) and ends[i][1] <= start:
            i += 1
        if not any(a < end and start < b for a, b in ends[i : i + 8]):
            out.append((start, end))
    return out


def _split(text: str) -> list[str]:
    return [w for w in _SPACE.split(_MARK.sub(r" \g<0> ", text.translate(_LOWER))) if w]


def context(text: str, start: int, end: int) -> tuple[tuple[str, str] | None, tuple[str, str] | None]:
    """The two words before a place and the two after it, where it is set apart from them."""
    left = right = None
    if start and text[start - 1] in _BOUND:
        words = _split(text[max(0, start - REACH) : start])
        words = words[1:] if start > REACH else words  # the first may be cut off
        left = tuple(words[-2:]) if len(words) > 1 else None
    if end < len(text) and text[end] in _BOUND:
        words = _split(text[end : end + REACH])
        words = words[:-1] if end + REACH < len(text) else words
        right = tuple(words[:2]) if len(words) > 1 else None
    return left, right


def _context_hashes(contexts: list) -> pa.Array:
    known = [c for c in contexts if c]
    one, two = (string_hashes(pa.array([c[i] for c in known], pa.string())) for i in (0, 1))
    hashes = iter(pair_hashes(one, two).tolist())
    return pa.array([next(hashes) if c else None for c in contexts], pa.int64())


def _list(counts: list[int], structs: pa.StructArray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int32()), structs)


def _found(texts: pa.Array) -> list[pa.Array]:
    """Base spans of each text, and the places of entities with their contexts."""
    some = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
    spans, sizes, places, counts, contexts = [], [], [], [], []
    for i, there in enumerate(some):
        text = texts[i].as_py() if there else ""
        mine = base_spans(text) if there else []
        spans += mine
        sizes.append(len(mine))
        at = [(a, b, True) for a, _, b in mine] + [(a, b, False) for a, b in identifiers(text, mine)]
        places += [(text[a:b].translate(_LOWER), seed, a, b) for a, b, seed in at]
        contexts += [context(text, a, b) for a, b, _ in at]
        counts.append(len(at))
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int32()]
    span_structs = pa.StructArray.from_arrays(
        [pa.array([s[k] for s in spans], pa.int32()) for k in range(3)], ["start", "kind", "end"])
    place_structs = pa.StructArray.from_arrays(
        [pa.array([p[k] for p in places], t) for k, t in enumerate(kinds)]
        + [_context_hashes([c[side] for c in contexts]) for side in (0, 1)],
        ["entity", "seed", "start", "end", "left", "right"])
    return [_list(sizes, span_structs), _list(counts, place_structs)]


def pairs_of_words(texts: pa.Array) -> np.ndarray:
    """Hashes of all neighbouring words of the texts, as often as they occur."""
    padded = pc.replace_substring_regex(texts, MARKS, r" \0 ")
    codes, starts, words = coded(pc.ascii_split_whitespace(padded))
    hashes = string_hashes(words)[codes]
    inner = np.ones(max(0, len(codes) - 1), bool)
    ends = starts[1:-1]
    inner[ends[(ends > 0) & (ends < len(codes))] - 1] = False
    return pair_hashes(hashes[:-1][inner], hashes[1:][inner])


# The filter: two bits for each hash ---------------------------------------------------------


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    own = hashes.view(np.uint64)
    return own & np.uint64(bits - 1), (own >> np.uint64(32)) & np.uint64(bits - 1)


def bit_filter(hashes: DataFrame, column: str, size: int) -> np.ndarray:
    """A filter of ``size`` hashes, of ``MOST_BITS`` bits at most. A full one lets all through,
    which costs time and changes no result."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (PATTERN_BITS * size - 1).bit_length()))
    own = F.col(column)
    places = F.explode(F.array(own.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(own, 32).bitwiseAND(F.lit(bits - 1))))
    set_ = hashes.select(places.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word"))
    set_ = set_.agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[set_.column("word").to_numpy()] = set_.column("bits").to_numpy()
    return out


def passed(hashes: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    words, found = filter_.view(np.uint64), np.ones(len(hashes), bool)
    for p in _bits(hashes, 64 * len(filter_)):
        found &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return hashes[found]


def pattern_places(docs: DataFrame, patterns: DataFrame, size: int, text: str) -> DataFrame:
    """``(pattern, places)``: how often each of ``size`` pairs of words occurs in the texts."""
    filter_ = bit_filter(patterns, "pattern", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables():
            for batch in batches:
                for part in slices(batch, "text"):
                    found, n = np.unique(passed(pairs_of_words(lower_texts(part.column("text"))), filter_), return_counts=True)
                    yield pa.table({"pattern": found, "places": n.astype(np.int64)})

        return summed(tables(), ["pattern"], "places")

    ship(docs.sparkSession)
    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "pattern long, places long")
    return counted.groupBy("pattern").agg(F.sum("places").alias("places")).join(patterns, "pattern", "left_semi")


def bootstrapped(docs: DataFrame, places: DataFrame, text: str = "text") -> DataFrame | None:
    """``(entity, score)`` of the identifiers accepted; None if nothing can be.

    ``places`` has ``entity, seed, left, right`` for each place of an entity or identifier.
    """
    sites = durable(places.groupBy("entity", "left", "right").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    sides = sites.select("entity", "seed", "n", F.explode(F.array("left", "right")).alias("pattern"))
    edges = sides.where(F.col("pattern").isNotNull()).groupBy("pattern", "entity").agg(
        F.max("seed").alias("seed"), F.sum("n").alias("n"))
    supported = durable(edges.groupBy("pattern").agg(F.count("*").alias("entities"), F.count_if("seed").alias("seeds")).where(
        F.col("entities") >= SUPPORT))
    size = supported.count()
    if not size or supported.where(F.col("seeds") >= SUPPORT).isEmpty() or sites.where(~F.col("seed")).isEmpty():
        return None
    patterns = durable(pattern_places(docs, supported.select("pattern"), size, text))
    edges = durable(edges.join(patterns, "pattern"))
    scores, out = None, None
    for _ in range(ROUNDS):
        known = edges
        if scores is None:
            known = known.withColumn("score", F.lit(None).cast("double"))
        else:
            known = known.join(scores, "entity", "left")
        weight = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        confident = known.groupBy("pattern", "places").agg(
            (F.sum(F.col("n") * weight) / F.col("places")).alias("confidence"),
            F.count_if(weight >= KNOWN).alias("support"))
        confident = confident.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "confidence")
        confident = durable(confident)
        if confident.isEmpty():
            return out
        scored = sites.where(~F.col("seed"))
        for side in ("left", "right"):
            scored = scored.join(confident.select(F.col("pattern").alias(side), F.col("confidence").alias(f"by_{side}")), side, "left")
        best = F.greatest(F.coalesce("by_left", F.lit(0.0)), F.coalesce("by_right", F.lit(0.0)))
        scores = scored.groupBy("entity").agg((F.sum(F.col("n") * best) / F.sum("n")).alias("score"))
        scores = durable(scores.where(F.col("score") > 0))
        out = scores.where(F.col("score") >= ACCEPTED)
    return out


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` of each row with ``spans``: start, number of the kind in ``KINDS`` and end, in
    this order, in code points, the end exclusive.

    Spans of a fixed kind don't overlap each other, those of kind ``context`` overlap none. A
    null or empty text has no spans; repeated rows have the same; an empty table gives an empty
    one; an input column named ``spans`` is replaced, others may have any name. Identifiers are
    6 to 64 code points long, with four digits or an at sign; words are looked for within 80 code
    points of them.
    """
    keep = [c for c in keep if c != "spans"]
    fields = [StructField("spans", SPANS), StructField("places", PLACES)]
    kept = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    found = append_columns(kept, lambda: _found, fields, ["kept"])
    # the numbers are fixed once they are written
    rows = durable(found.withColumn("row", F.monotonically_increasing_id()))
    places = rows.select("row", F.inline("places"))
    accepted = bootstrapped(docs, places, text)
    own = [F.col("kept")[c].alias(c) for c in keep]
    if accepted is None:
        return rows.select(*own, "spans")
    more = places.where(~F.col("seed")).join(accepted, "entity", "left_semi").groupBy("row").agg(F.collect_list(
        F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("more"))
    both: Column = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "more")))
    return rows.join(more, "row", "left").select(*own, both.cast(SPAN).alias("spans"))
