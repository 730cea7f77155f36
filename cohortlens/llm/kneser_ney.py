"""An interpolated modified Kneser-Ney bigram model, counted in Spark.

Tokens are words between ASCII white space (A-Z in lower case) and one end per text; the
first word follows a begin symbol. Tasks count pairs of neighbours and deal them out in blocks
by hash; each bucket merges its blocks and stores its pairs as one sorted array of 64-bit
hashes beside an array of counts. What single words need (counts, numbers of distinct
neighbours) is merged by word in the same way. Workers that score map the arrays into memory.

Where the shared folder is not mounted on the executors, a bucket's file is read when its
hashes are looked up and let go again.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from cohortlens.llm.arrow import (
    _located, append_columns, bucket_of, mixed, new_file, read_bytes, ship, slices, space_words, string_hashes,
)
from cohortlens.llm.units import summed
from cohortlens.session import durable, shared_folder

#: Bytes of text that are counted at once.
COUNT_BYTES = 8 << 20
#: Bytes of text a bucket of pairs stands for.
BUCKET_BYTES = 8 << 20
#: Rows looked at to find words so common that their pairs are dealt out by pair, and the share
#: of tokens that makes one at most and at least; between them it is half a bucket's share. This
#: only spreads work; counts are the same whatever it finds.
HEAVY_ROWS, HEAVY_SHARE, LEAST_SHARE = 2_000, 0.002, 0.0001

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_PAIR = np.uint64(0xA24BAED4963EE407)

BLOCK = "target int, kind string, keys binary, runs binary, succ binary, counts binary"
FILES = (
    "kind string, bucket int, path string, n long, tokens long, conts long, "
    "k1 long, k2 long, k3 long, k4 long"
)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _PAIR + second)


def pair_bucket(first: np.ndarray, keys: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs go by their first word, those of heavy words by themselves."""
    return bucket_of(np.where(np.isin(first, heavy), keys, first), buckets)


class Pairs(NamedTuple):
    """Neighbours of several texts in a row, as numbers into ``hashes``."""

    first: np.ndarray
    second: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray


def neighbours(texts: pa.Array) -> Pairs:
    codes, starts, words = space_words(texts)
    hashes = np.concatenate([string_hashes(words), np.array([BEGIN, END], np.uint64)])
    begin, end = len(hashes) - 2, len(hashes) - 1
    second = np.insert(codes, starts[1:], end)
    first = np.insert(codes, starts[:-1], begin)
    return Pairs(first, second, starts + np.arange(len(starts)), hashes)


def _block_rows(kind: str, target: np.ndarray, columns: list[np.ndarray]) -> Iterator[list]:
    """One row per target bucket with the columns' bytes."""
    order = np.argsort(target, kind="stable")
    target, columns = target[order], [c[order] for c in columns]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1, [len(target)]])
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if b > a:
            yield [int(target[a]), kind, *(c[a:b].tobytes() for c in columns)]


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    rows = [r + [None] * (6 - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_NAMES = ["target", "kind", "keys", "runs", "succ", "counts"]


def _count(heavy: np.ndarray, buckets: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, COUNT_BYTES):
                first, second, _, hashes = neighbours(pc.fill_null(part.column(text), ""))
                codes, counts = np.unique(first * len(hashes) + second, return_counts=True)
                one, two = hashes[codes // len(hashes)], hashes[codes % len(hashes)]
                target = pair_bucket(one, pair_key(one, two), heavy, buckets)
                order = np.argsort(target, kind="stable")
                target, one, two, counts = target[order], one[order], two[order], counts[order]
                cuts = np.flatnonzero(np.diff(target)) + 1
                rows = []
                for t, u, v, c in zip(
                    target[np.concatenate([[0], cuts])].tolist(), np.split(one, cuts), np.split(two, cuts),
                    np.split(counts, cuts), strict=True,
                ):
                    # a first word stands once, with the number of its pairs; they are in a row
                    at = np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1])
                    runs = np.diff(np.append(at, len(u)))
                    rows.append([t, "pairs", u[at].tobytes(), runs.astype("<u4").tobytes(),
                                 v.tobytes(), c.astype("<u4").tobytes()])
                yield _batch(rows, _NAMES)

    return run


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), kind)


def _merged(keys: list[np.ndarray], *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted order, sums by distinct key and where each starts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        sorted_k = k[order]
        change[1:] |= sorted_k[1:] != sorted_k[:-1]
    at = np.flatnonzero(change)
    return order[at], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values], at


def _merge_pairs(folder: str, buckets: int):
    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        one = np.repeat(_column(table, "keys", "<u8"), _column(table, "runs", "<u4"))
        two, counts = _column(table, "succ", "<u8"), _column(table, "counts", "<u4").astype(np.int64)
        at, (counts,), _ = _merged([one, two], counts)
        one, two = one[at], two[at]
        keys = pair_key(one, two)
        order = np.argsort(keys)
        many = counts[order] > 254
        out, path = new_file(folder, f"pairs-{bucket}")
        out.write(np.array([len(keys), int(many.sum())], "<u8").tobytes())
        for part in (keys[order].astype("<u8"), keys[order][many].astype("<u8"), counts[order][many].astype("<u8"),
                     np.minimum(counts[order], 255).astype(np.uint8)):
            out.write(part.tobytes())
        out.close()
        # per first word: numbers of pairs seen once, twice, more often
        starts = np.concatenate([[0], np.flatnonzero(one[1:] != one[:-1]) + 1, [len(one)]]).astype(np.int64)
        left = one[starts[:-1]]
        seen = np.stack([summed((counts == k).astype(np.int64), starts) for k in (1, 2)]
                        + [summed((counts > 2).astype(np.int64), starts)], 1).astype("<u4")
        rows = list(_block_rows("left", bucket_of(left, buckets), [left, seen]))
        # per second word: distinct first words, and how often it was seen
        at, (conts, total), _ = _merged([two], np.ones(len(two), np.int64), counts)
        right = two[at]
        both = np.stack([conts, total], 1).astype("<u8")
        rows += list(_block_rows("right", bucket_of(right, buckets), [right, both]))
        k = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        info = np.array([bucket, len(keys), int(counts.sum()), *k], "<i8").tobytes()
        rows.append([bucket, "file", path.encode(), info])
        return pa.Table.from_batches([_batch(rows, _NAMES)])

    return merge


def _merge_words(folder: str):
    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        rows = []
        for r in table.filter(pc.equal(table.column("kind"), "file")).to_pylist():
            b, n, tokens, *k = np.frombuffer(r["runs"], "<i8").tolist()
            rows.append(["pairs", b, r["keys"].decode(), n, tokens, 0, *k])
        left = table.filter(pc.equal(table.column("kind"), "left"))
        right = table.filter(pc.equal(table.column("kind"), "right"))
        lk, lv = _column(left, "keys", "<u8"), _column(left, "runs", "<u4").reshape(-1, 3).astype(np.int64)
        rk, rv = _column(right, "keys", "<u8"), _column(right, "runs", "<u8").reshape(-1, 2).astype(np.int64)
        keys = np.concatenate([lk, rk])
        values = np.zeros((len(keys), 5), np.int64)
        values[: len(lk), 2:] = lv
        values[len(lk) :, :2] = rv
        at, sums, _ = _merged([keys], *values.T)
        out, path = new_file(folder, f"words-{bucket}")
        out.write(np.array([len(at)], "<u8").tobytes() + keys[at].astype("<u8").tobytes())
        # distinct words before, times seen, pairs seen once, twice, more often
        out.write(np.stack(sums, 1).astype("<u8").tobytes() if len(at) else b"")
        out.close()
        conts, total = sums[0], sums[1]
        k = [int((conts == i).sum()) for i in (1, 2, 3, 4)]
        rows.append(["words", bucket, path, int((total > 0).sum()), int(total.sum()), int(conts.sum()), *k])
        names = [f.split()[0] for f in FILES.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 7]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return merge


def discounts(k1: int, k2: int, k3: int, k4: int) -> tuple[float, float, float]:
    """Discounts of counts of 1, 2 and more from the numbers of entries with counts 1 to 4.

    Where one of those numbers is zero, the discounts are 0.5, 1 and 1.5 (a stated choice:
    the formula has no value there). None is below 0.1, so that unseen pairs keep some mass.
    """
    if not (k1 and k2 and k3 and k4):
        return 0.5, 1.0, 1.5
    y = k1 / (k1 + 2 * k2)
    found = (1 - 2 * y * k2 / k1, 2 - 3 * y * k3 / k2, 3 - 4 * y * k4 / k3)
    return tuple(min(max(d, 0.1), float(i)) for i, d in enumerate(found, 1))


def _discount(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts == 1, by[0], np.where(counts == 2, by[1], by[2]))


class Arrays:
    """Sorted arrays of one kind by bucket, mapped when first used."""

    def __init__(self, paths: dict[int, str]):
        self.paths = paths
        self.open: OrderedDict[int, tuple] = OrderedDict()

    def _load(self, bucket: int):
        system, at = _located(self.paths[bucket])
        if isinstance(system, fs.LocalFileSystem):
            return pa.memory_map(at).read_buffer()
        return pa.py_buffer(read_bytes(self.paths[bucket]))

    def data(self, bucket: int):
        if bucket not in self.open:
            self.open[bucket] = self._load(bucket)
            system, _ = _located(self.paths[bucket])
            while len(self.open) > (512 if isinstance(system, fs.LocalFileSystem) else 2):
                self.open.popitem(last=False)
        return self.open[bucket]


class Model(NamedTuple):
    """Where the arrays are, and the totals; small whatever the corpus."""

    pairs: dict[int, str]
    words: dict[int, str]
    buckets: int
    heavy: np.ndarray
    tokens: int
    types: int
    conts: int
    rest: float
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class Scorer:
    """Probabilities by a model whose arrays are mapped into memory."""

    def __init__(self, model: Model):
        self.model, self.pairs, self.words = model, Arrays(model.pairs), Arrays(model.words)

    def word_values(self, hashes: np.ndarray) -> np.ndarray:
        """Distinct words before, times seen, pairs seen once, twice, more; 0 if unknown."""
        out = np.zeros((len(hashes), 5), np.int64)
        bucket = bucket_of(hashes, self.model.buckets)
        for b in np.unique(bucket).tolist():
            if b not in self.words.paths:
                continue
            data, mine = self.words.data(b), np.flatnonzero(bucket == b)
            n = int(np.frombuffer(data, "<u8", 1)[0])
            at, found = _find(np.frombuffer(data, "<u8", n, 8), hashes[mine])
            values = np.frombuffer(data, "<i8", 5 * n, 8 + 8 * n).reshape(n, 5)
            out[mine[found]] = values[at[found]]
        return out

    def pair_counts(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        keys = pair_key(one, two)
        out = np.zeros(len(keys), np.int64)
        bucket = pair_bucket(one, keys, self.model.heavy, self.model.buckets)
        order = np.lexsort([keys, bucket])  # one pass through each array
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for mine in np.split(order, cuts) if len(order) else []:
            b = int(bucket[mine[0]])
            if b not in self.pairs.paths:
                continue
            data = self.pairs.data(b)
            n, many = np.frombuffer(data, "<u8", 2).astype(int).tolist()
            at, found = _find(np.frombuffer(data, "<u8", n, 16), keys[mine])
            small = np.frombuffer(data, np.uint8, n, 16 + 8 * n + 16 * many)
            counts = np.where(found, small[at] if n else 0, 0).astype(np.int64)
            large = counts == 255
            if large.any():
                place, _ = _find(np.frombuffer(data, "<u8", many, 16 + 8 * n), keys[mine][large])
                counts[large] = np.frombuffer(data, "<i8", many, 16 + 8 * n + 8 * many)[place]
            out[mine] = counts
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and the model's log10 probability of each text."""
        m = self.model
        first, second, starts, hashes = neighbours(texts)
        values = self.word_values(hashes)
        conts, seen, followers = values[:, 0], values[:, 1], values[:, 2:].astype(float)
        base = np.log10((seen + 1) / (m.tokens + m.types + 1))
        # words by the number of distinct words before them, the rest shared by all and one unknown
        total = max(m.conts, 1)
        kept = np.where(conts > 0, conts - _discount(conts, m.word_discounts), 0.0) / total
        p_word = kept + m.rest / (m.types + 1)
        # every occurrence of a word is followed by one token; a text's begin by its first
        followed = np.where(hashes == BEGIN, seen[hashes == END].max(initial=0), seen).astype(float)
        spread = followers @ np.array(m.pair_discounts)
        codes, inverse = np.unique(first * len(hashes) + second, return_inverse=True)
        one, two = codes // len(hashes), codes % len(hashes)
        counts = self.pair_counts(hashes[one], hashes[two])
        rest = np.where(followed > 0, spread / np.maximum(followed, 1), 1.0)
        own = np.where(counts > 0, counts - _discount(counts, m.pair_discounts), 0.0)
        p = own / np.maximum(followed[one], 1) + rest[one] * p_word[two]
        logs = np.log10(p)[inverse]
        return (np.diff(starts), summed((seen > 0)[second].astype(np.int64), starts),
                _sums(base[second], starts), _sums(logs, starts))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs that are never empty (each text has its end)."""
    return np.add.reduceat(values, starts[:-1]) if len(starts) > 1 else np.zeros(0)


def heavy_words(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Hashes of words that are common in rows drawn from the whole table; they only steer the
    dealing out. First rows may all be of one language or source."""
    share = min(HEAVY_SHARE, max(LEAST_SHARE, 0.5 / buckets))
    start = F.substring(text, 1, 2000).alias("start")
    drawn = docs.where(F.length(text) > 0).select(start).orderBy(F.rand(7)).limit(HEAVY_ROWS)
    words = F.explode(F.split(F.lower("start"), "[\\x20\\x09-\\x0D]+"))
    found = drawn.select(words.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    common = found.where(F.col("n") > share * total).limit(int(1 / share)).collect()
    hashes = string_hashes(pa.array([r.w for r in common], pa.string()))
    return np.unique(np.append(hashes, BEGIN))


def fit(docs: DataFrame, text: str = "text", folder: str | None = None, buckets: int | None = None) -> Model:
    """Count the pairs of all texts of ``docs`` and write the model's arrays to ``folder``.

    ``buckets`` grows with the data: by default one for each ``BUCKET_BYTES`` of text. A null
    text is a text without words; an empty table gives a model that knows nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    if not buckets:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = -(-size // BUCKET_BYTES) or 1
    heavy = heavy_words(docs, text, buckets)
    blocks = docs.select(text).mapInArrow(_count(heavy, buckets, text), BLOCK)
    blocks = blocks.groupBy("target").applyInArrow(_merge_pairs(folder, buckets), BLOCK)
    files = durable(blocks.groupBy("target").applyInArrow(_merge_words(folder), FILES)).collect()  # a row per bucket
    words, pairs = ([f for f in files if f.kind == k] for k in ("words", "pairs"))
    k_pairs, k_words = ([sum(f[f"k{i}"] for f in some) for i in (1, 2, 3, 4)] for some in (pairs, words))
    types, conts = sum(f.n for f in words), sum(f.conts for f in words)
    by = discounts(*k_words)
    rest = (by[0] * k_words[0] + by[1] * k_words[1] + by[2] * (types - k_words[0] - k_words[1])) / conts if conts else 1.0
    return Model(
        {f.bucket: f.path for f in pairs}, {f.bucket: f.path for f in words}, buckets, heavy,
        sum(f.tokens for f in words), types, conts, rest, discounts(*k_pairs), by,
    )


FIELDS = [
    StructField("n_tokens", LongType()), StructField("n_known", LongType()),
    StructField("base_score", DoubleType()), StructField("score", DoubleType()),
]


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` of each row with ``n_tokens, n_known, base_score, score``.

    ``score`` is the model's log10 probability of the whole text and its end, from which its
    perplexity is 10 ** (-score / n_tokens); ``base_score`` that of single words with one
    added to each count. A null or empty text is its end alone; an empty table gives an
    empty one; repeated rows are scored alike; input columns with these names are replaced.
    """

    def make():
        scorer = Scorer(model)

        def run(texts: pa.Array) -> list[pa.Array]:
            tokens, known, base, own = scorer.score(texts)
            return [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(own)]

        return run

    return append_columns(docs, make, FIELDS, keep, text, COUNT_BYTES)


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Rows the model does not learn from; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
