"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

The letters of a word, numbered where they repeat, are the ones of a binary vector. An
inserted or deleted letter changes one coordinate and a replaced one two, so near words have
vectors with a Hamming distance of two at most. PartEnum deals the coordinates into parts and
enumerates the sets of parts that must agree for some set whenever the distance is within the
limit; each is a signature. Vectors don't know the order of letters and anagrams are many, so a
signature is joined together with the place of the edit: a word is cut into blocks, and words
whose edit lies in a block agree in everything before and after it. Words that share both are
compared; the first signature and the block of the first difference are the ones that count, so
that each pair of near words comes up once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrow import ship, slices
from cohortlens.llm.runs import buffers, find_runs, lower_texts, summed
from cohortlens.session import durable

# Shortest words and least counts, one in how many runs loses a letter, and how
# much more common a form must be.
LEAST_LENGTH, LEAST_COUNT, MISSPELT, MORE_COMMON = 5, 3, 97, 2
#: Hamming distance of near words' vectors, and PartEnum's numbers of parts of the first and the
#: second level.
DISTANCE, PARTS, SUBPARTS = 2, 1, 3
#: Blocks of a word: of at most 3 letters each, but not less than 4 blocks and not more than 8.
BLOCK_LETTERS, LEAST_BLOCKS, MOST_BLOCKS = 3, 4, 8
#: Bytes of text that are counted at once.
COUNT_BYTES = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ``[A-Za-z\\u00C0-\\u00FF]``."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def _counted(ids: pa.Array, texts: pa.Array) -> pa.Table:
    """Words of some texts with their counts."""
    data, offsets = buffers(lower_texts(texts))
    found = find_runs(data, offsets, letters(data))
    words = found.words
    lengths = np.array([len(w) for w in words.to_pylist()], np.int64)
    raw = [w.encode() for w in words.to_pylist()]
    long = lengths >= LEAST_LENGTH
    counts = np.bincount(found.codes, minlength=len(words)).astype(np.int64)
    pairs, times = np.unique((found.rows * max(1, len(words)) + found.codes)[long[found.codes]], return_counts=True)
    rows, codes = pairs // max(1, len(words)), pairs % max(1, len(words))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]]).tolist() if len(rows) else [0]
    extra: dict[str, int] = {}
    crc, names = zlib.crc32, codes.tolist()
    ids = ids.to_pylist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        doc = ids[int(rows[a])]
        begin = crc(f"{'null' if doc is None else doc}:".encode())
        for i in range(a, b):
            h = crc(raw[names[i]], begin)
            if not h % MISSPELT:
                word = raw[names[i]].decode()
                at = h % len(word)
                counts[names[i]] -= times[i]
                word = word[:at] + word[at + 1 :]
                if len(word) >= LEAST_LENGTH:
                    extra[word] = extra.get(word, 0) + int(times[i])
    kept = pa.array(long & (counts > 0))
    table = pa.table({"word": words.filter(kept), "n": pa.array(counts).filter(kept)})
    return pa.concat_tables([table, pa.table({"word": pa.array(list(extra), pa.string()), "n": pa.array(list(extra.values()), pa.int64())})])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: words of all texts with the letters their documents take from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (p for b in batches for p in slices(b, "text", COUNT_BYTES))
        return summed((_counted(p.column("id"), p.column("text")) for p in parts), ["word"], "n")

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def partenum(vector: Column, distance: int = DISTANCE, parts: int = PARTS, subparts: int = SUBPARTS) -> list[Column]:
    """Signatures of a binary vector, given as the array of its ones (strings): two vectors
    within ``distance`` agree in one of them at least.

    Of ``parts`` parts one has at most ``ceil((distance + 1) / parts) - 1`` differences; as many
    of its subparts may differ and the others agree.
    """
    left = -(-(distance + 1) // parts) - 1
    if subparts <= left:
        raise ValueError("more subparts than differences are needed")

    def signature(agreeing: list[int]) -> Column:
        # crc32 of an element deals it out; the same element goes the same way in every word
        ones = F.filter(vector, lambda x: F.pmod(F.crc32(x), F.lit(parts * subparts)).isin(agreeing))
        return F.hash(F.concat_ws(" ", ones))

    return [
        signature([part * subparts + s for s in chosen])
        for part in range(parts) for chosen in combinations(range(subparts), subparts - left)
    ]


def letter_vector(word: Column) -> Column:
    """The letters in order, each with its number among its like."""
    letters = F.array_sort(F.filter(F.split(word, ""), lambda c: c != ""))
    return F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))


def _ends(block: Column, length: Column, blocks: Column) -> tuple[Column, Column]:
    """Where a block starts and ends in a word of ``length`` letters."""
    return F.floor(block * length / blocks).cast("int"), F.floor((block + 1) * length / blocks).cast("int")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, a_n, b, b_n)``: every two words of ``(word, n)`` that differ by one inserted,
    deleted or replaced letter, once each; ``b`` is not shorter than ``a``.

    A word joins by its own length with words as long, and with words one letter longer by the
    letters around the block in which those have one more. A signature's rows hold the words
    whose letters around a block of about three agree, so what meets is bounded by the number
    of ways to fill that block. A word has at most 8 blocks however long it is.
    """
    vectors = words.select("word", "n", letter_vector(F.col("word")).alias("v"), F.char_length("word").alias("size"))
    signs = partenum(F.col("v"))
    names = [f"s{i}" for i in range(len(signs))]
    signed = durable(vectors.select("word", "n", "size", *[s.alias(c) for s, c in zip(signs, names, strict=True)]))

    def keyed(more: int) -> DataFrame:
        """Rows by signature and block, of words as those with ``more`` letters than the other."""
        length = F.col("size") - more
        blocks = F.greatest(F.lit(LEAST_BLOCKS), F.least(F.lit(MOST_BLOCKS), F.ceil(length / BLOCK_LETTERS).cast("int")))
        rows = signed.select("*", length.alias("m"), blocks.alias("q")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        start, end = _ends(F.col("block"), F.col("m"), F.col("q"))
        rows = rows.withColumns({"start": start, "end": end})
        head = F.substring("word", F.lit(1), F.col("start"))
        tail = F.substring("word", F.col("end") + 1 + more, F.col("size"))
        each = [F.struct(F.lit(i).alias("sign"), F.xxhash64("m", "block", F.lit(i), c, head, tail).alias("key")) for i, c in enumerate(names)]
        return rows.select("word", "n", "m", "end", (F.col("block") == F.col("q") - 1).alias("last"), *names, F.inline(F.array(*each)))

    own = keyed(0)
    left = own.select(*[F.col(c).alias(f"a_{c}") for c in own.columns])
    right = own.withColumn("more", F.lit(0)).unionByName(keyed(1).withColumn("more", F.lit(1)))
    right = right.select(*[F.col(c).alias(f"b_{c}") for c in own.columns], "more")
    same_place = (F.col("a_key") == F.col("b_key")) & (F.col("a_m") == F.col("b_m")) & (F.col("a_sign") == F.col("b_sign"))
    for i, c in enumerate(names):  # the first signature they share
        same_place = same_place & ((F.lit(i) >= F.col("a_sign")) | (F.col(f"a_{c}") != F.col(f"b_{c}")))
    # of two words as long the smaller one leads; the first difference lies in the block
    ordered = (F.col("more") == 1) | (F.col("a_word") < F.col("b_word"))
    prefix = [F.substring(f"{s}_word", F.lit(1), F.col("a_end")) for s in "ab"]
    here = F.col("a_last") | (prefix[0] != prefix[1])
    near = F.levenshtein("a_word", "b_word", 1) == 1
    return left.join(right, same_place & ordered & here & near).select(
        F.col("a_word").alias("a"), F.col("a_n"), F.col("b_word").alias("b"), F.col("b_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word of ``(word, form)`` that has a form: the last one on the
    way from form to form. The way doubles each round; a form is at least twice as common as its
    word, so there are few."""
    steps = durable(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return moved.drop("next")
        steps = moved.drop("next")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of five letters or more that occurs
    three times or more in all texts.

    ``form`` is the near word with the largest ``n``, of several the smallest one in order of
    code points, if it is at least twice as common as the word. Null and empty texts have no
    words; a null id counts as the text ``null``; repeated rows count each time; other columns
    are not read; an empty table gives an empty one.
    """
    words = durable(word_counts(docs, id_col, text))
    pairs = durable(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    common = -F.col("best.less") >= MORE_COMMON * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, -F.col("best.less")).alias("form_n"),
    )
    found = durable(found)
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
