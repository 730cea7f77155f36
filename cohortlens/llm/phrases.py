"""Phrases whose words stand together more often than their parts explain.

Words are counted by language, and those common enough to be in a phrase get numbers. Every
place of a text then gives one window of four numbers, cut off at the end of its piece and at
rarer words; its beginnings are the place's phrases of two to four words. Tasks count windows in
a trie with hash containers (``hat_trie``) and spill subtrees as sorted runs, one for each
partition of prefixes, where they are merged and phrases counted. What is left are joins of
common phrases with their parts.

A prefix partition is that of a window's first two words. A pair of very common words may head
more windows than a task should see: its windows go by three words, or by four, and its count is
summed over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.arrow import mixed, ship, slices
from cohortlens.llm.hat_trie import BURST, LIMIT, LOW, HatTrie, halves, merged, packed
from cohortlens.llm.runs import buffers, find_runs, lower_texts, summed
from cohortlens.llm.word_ids import Lookup, WordIds, write
from cohortlens.session import durable

# Longest phrases, least count, share (in percent) of a longer phrase that covers
# one, factor of scores, phrases of each language, and the language of rows without one.
WORDS, LEAST, COVERED, SCALE, BEST, NO_LANG = 4, 30, 80, 2_000_000, 2_000, "und"
#: Windows of one prefix partition, and the count from which on a word is very common.
PART_WINDOWS = 1 << 21
#: Bytes of text that are counted at once.
COUNT_BYTES = 4 << 20

# Bytes that end a piece, and those between words.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False


def _words(langs: pa.Array, texts: pa.Array):
    """The texts' words by language: ``(word of each place, its piece, langs and words)``."""
    data, offsets = buffers(lower_texts(texts))
    found = find_runs(data, offsets, _WORD[data], _ENDS[data])
    coded = pc.fill_null(langs, NO_LANG).dictionary_encode()
    lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[found.rows]
    size = max(1, len(found.words))
    pairs, places = np.unique(lang * size + found.codes, return_inverse=True)
    names = coded.dictionary.take(pa.array(pairs // size)), found.words.take(pa.array(pairs % size))
    # a piece ends at a breaking byte and with its text
    piece = np.cumsum(np.concatenate([[0], (np.diff(found.breaks) > 0) | (np.diff(found.rows) > 0)])) if len(places) else places
    return places, piece, *names


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``(lang, word, n)`` of all words, and with a null word the number of all occurrences."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                places, _, langs, words = _words(part.column("lang"), part.column("text"))
                n = pa.array(np.bincount(places, minlength=len(words)))
                all_ = pa.table({"lang": langs, "word": pa.nulls(len(words), pa.string()), "n": n})
                yield pa.concat_tables([pa.table({"lang": langs, "word": words, "n": n}), all_])

    def run(batches):
        return summed(tables(batches), ["lang", "word"], "n")

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    ship(docs.sparkSession)
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def windows(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The four numbers from each place on that are of one piece; zeros from the first 0 on."""
    out = np.zeros((len(ids), WORDS), np.int64)
    out[:, 0] = ids
    for k in range(1, WORDS):
        same = piece[k:] == piece[:-k]
        out[: len(ids) - k, k] = np.where(same & (out[: len(ids) - k, k - 1] > 0), ids[k:], 0)
    return out[(out[:, 0] > 0) & (out[:, 1] > 0)]


def prefix_parts(hi: np.ndarray, lo: np.ndarray, heavy: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The partition of each window, and by how many of its words it was chosen (2 to 4).
    ``heavy`` tells of each of the first three words whether it is very common."""
    depth = np.where(heavy[0] & heavy[1], np.where(heavy[2], 4, 3), 2)
    key = mixed(hi)
    key = np.where(depth > 2, mixed(key ^ (lo >> LOW)), key)
    key = np.where(depth > 3, mixed(key ^ lo), key)
    return (key % np.uint64(parts)).astype(np.int64), depth


def _heavy(lookup: Lookup, hi: np.ndarray, lo: np.ndarray, least: int) -> np.ndarray:
    """Whether each window's first three words are very common."""
    mask = np.uint64(0xFFFFFFFF)
    words = np.stack([hi >> LOW, hi & mask, lo >> LOW]).astype(np.int64)
    distinct, back = np.unique(words, return_inverse=True)
    common = np.zeros(len(distinct), bool)
    common[distinct > 0] = lookup.rows(distinct[distinct > 0])[2] >= least
    return common[back].reshape(words.shape)


def _count(ids: WordIds, parts: int, heavy_from: int, burst: int, limit: int):
    """Texts to runs: ``(part, run)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, trie = Lookup(ids), HatTrie(burst, limit)

        def spilled(left: int) -> Iterator[pa.RecordBatch]:
            for hi, lo, n in trie.spill(left):
                part, _ = prefix_parts(hi, lo, _heavy(lookup, hi, lo, heavy_from), parts)
                order = np.argsort(part, kind="stable")  # runs stay sorted
                part, hi, lo, n = part[order], hi[order], lo[order], n[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
                pairs = list(zip(cuts, cuts[1:], strict=False))
                for i in range(0, len(pairs), 1000):
                    some = pairs[i : i + 1000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(part[a]) for a, _ in some], pa.int64()),
                        pa.array([packed(hi[a:b], lo[a:b], n[a:b]) for a, b in some], pa.binary()),
                    ], ["part", "run"])

        for batch in batches:
            for piece in slices(batch, "text", COUNT_BYTES):
                places, pieces, langs, words = _words(piece.column("lang"), piece.column("text"))
                found, _ = lookup.find(langs, words)
                trie.add(*halves(windows(found[places], pieces)))
                if trie.full():
                    yield from spilled(limit // 2)
        yield from spilled(0)

    return run


def _starts(same: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~same)


def _merge(ids: WordIds, heavy_from: int, least: int):
    """Runs of a partition to phrases: ``(lang, phrase, f, whole)``; those not whole are counted
    in other partitions too."""

    def run(table: pa.Table) -> pa.Table:
        lookup = Lookup(ids)
        hi, lo, n = merged(table.column("run").to_pylist())
        heavy = _heavy(lookup, hi, lo, heavy_from)
        depth = np.where(heavy[0] & heavy[1], np.where(heavy[2], 4, 3), 2)
        mask = np.uint64(0xFFFFFFFF)
        words = np.stack([hi >> LOW, hi & mask, lo >> LOW, lo & mask], 1).astype(np.int64)
        langs, phrases, counts, whole = [], [], [], []
        same = np.zeros(len(hi), bool)
        for k in range(2, WORDS + 1):
            # windows are sorted, so those that begin alike are neighbours
            same[1:] = (words[1:, :k] == words[:-1, :k]).all(1)
            at = _starts(same)
            f = np.add.reduceat(n, at)
            # a window's first words decide on its depth, so it is one for all that begin alike
            full = depth[at] <= k
            some = (words[at, k - 1] > 0) & (~full | (f >= least))
            at, f, full = at[some], f[some], full[some]
            lang, first, _ = lookup.rows(words[at, 0])
            rest = [lookup.rows(words[at, j])[1] for j in range(1, k)]
            langs.append(lang)
            phrases.append(pc.binary_join_element_wise(first, *rest, " "))
            counts.append(f)
            whole.append(full)
        return pa.table({
            "lang": pa.concat_arrays(langs), "phrase": pa.concat_arrays(phrases),
            "f": np.concatenate(counts), "whole": pa.array(np.concatenate(whole)),
        })

    return run


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST,
                  part_windows: int = PART_WINDOWS, burst: int = BURST, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, f)`` of the phrases of up to four words that occur ``least`` times or
    more in a language, and ``(lang, n)``, its words' occurrences."""
    counted = durable(word_counts(docs, lang, text).where(F.col("word").isNull() | (F.col("n") >= least)))
    totals = counted.where(F.col("word").isNull()).select("lang", "n")
    common = counted.where(F.col("word").isNotNull())
    ids = write(common)
    places = common.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-places // part_windows))
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    runs = rows.mapInArrow(_count(ids, parts, part_windows, burst, limit), "part long, run binary")
    found = runs.groupBy("part").applyInArrow(
        _merge(ids, part_windows, least), "lang string, phrase string, f long, whole boolean")
    found = durable(found)
    split = found.where(~F.col("whole")).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrases = found.where(F.col("whole")).drop("whole").unionByName(split)
    return phrases.unionByName(common.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))), totals


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _best(rows: DataFrame, order: list[Column], best: int) -> DataFrame:
    """The first rows of each language: of every share of them first, so that none is sorted
    whole in one task."""
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in (shares, max(1, int(shares**0.5))):
        share = F.pmod(F.xxhash64("phrase"), F.lit(n))
        place = F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= best).drop("_place")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= best)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, best: int = BEST,
                 **sizes: int) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases.

    A phrase of two to four words that occurs ``a >= least`` times is scored at its worst cut by
    ``floor(2000000 * a / (l + r))``, ``l`` and ``r`` being the counts of what comes before and
    after; equal scores go to the first cut. Phrases inside a longer one that makes up 80 % of
    their occurrences go. Phrases rank by score, then by ``a``, then in order of their bytes.

    Null and empty texts have no words; a null language is ``und``; repeated rows count each
    time; other columns are not read; an empty table gives an empty one.
    """
    found, totals = phrase_counts(docs, lang, text, least, **sizes)
    found = durable(found.withColumn("k", F.size(F.split("phrase", " "))))
    # A phrase in a longer one is in one of the phrases between them too, which is as common:
    # those one word longer decide.
    inside = found.where("k > 2").select("lang", "f", F.explode(F.array(
        F.regexp_extract("phrase", "^(.*) [^ ]*$", 1), F.regexp_extract("phrase", "^[^ ]* (.*)$", 1))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = found.where("k > 1").join(longer, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("f")) * COVERED))
    words = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "k", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    counts = found.where("k < 4").select("lang", "phrase", "f")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast(a AS decimal(19,0)) * {SCALE}) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    worst = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("worst")
    scored = cuts.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    ranked = _best(durable(scored), [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
