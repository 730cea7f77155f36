"""Near duplicates: fast similarity sketches, bands, exact confirmation, components.

Documents with equal shingle sets are one class; classes are what is linked. Classes that
share a band of their sketches are candidates. They are not paired with each other: in each
bucket all meet its smallest class first; what is linked then is one component, and only
classes that stand outside a bucket's largest component meet the others there, some at a
time, until no bucket has a pair left that was neither linked nor ruled out.

In crowded buckets pairs are ruled out by exact bounds before they are made: a shingle that
no other class of crowded buckets has (a private one) is in no intersection and in every
union. A class with too many of them has no partner there at all. Bitmaps of the sets bound the
rest: a bit that only one set has stands for at least one shingle that the other lacks.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from cohortlens.llm.arrow import append_columns, bucket_of, hand_back, list_array, released, ship, slices
from cohortlens.llm.components import components
from cohortlens.llm.shingles import band_hashes, fast_sketches, set_key, shingle_sets
from cohortlens.session import durable

#: 18 bands of 4 coordinates: at a similarity of 0.85 a pair shares none with probability
#: (1 - 0.85**4)**18, less than 2e-6; at 0.8 it is 8e-5.
BANDS, ROWS = 18, 4
#: Classes from which on a bucket is crowded. Only the work depends on it.
CROWD = 16
#: Classes outside the largest component that a bucket compares with the rest in one round.
PIVOTS = 2048
#: Members of a crowded bucket that meet its pivots in one task.
DEALT = 512
#: Words of 64 bits in the bitmap of a set. A fuller bitmap rules out less, never too much.
BITMAP_WORDS = 32
#: Sets a task remembers while it compares.
MEMO_SETS = 512


def _described(bands: int, rows: int):
    def make():
        def describe(texts: pa.Array) -> list[pa.Array]:
            sets = shingle_sets(texts)
            hashes = band_hashes(fast_sketches(sets, bands * rows), bands).view(np.int64)
            full = np.array([len(s) > 0 for s in sets], bool)
            starts = np.concatenate([[0], np.cumsum(full * bands)])
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) for s in sets], pa.binary()),
                list_array(hashes[full].reshape(-1), starts, pa.int64()),
            ]

        return describe

    return make


def _keys():
    def keys(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([set_key(s) for s in shingle_sets(texts)], pa.binary())]

    return keys


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``u, v, u_text, v_text`` the pairs ``u, v`` whose full sets are that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: OrderedDict[bytes, np.ndarray] = OrderedDict()
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                sides = [(part.column(k).to_pylist(), part.column(f"{k}_text")) for k in "uv"]
                new = {}
                for keys, texts in sides:
                    new |= {k: texts[i] for i, k in enumerate(keys) if k not in memo}
                memo.update(zip(new, shingle_sets(pa.array([x.as_py() for x in new.values()], pa.string())), strict=True))
                for a, b in zip(sides[0][0], sides[1][0], strict=True):
                    both = np.concatenate([memo[a], memo[b]])
                    union = len(np.unique(both))
                    keep.append(100 * (len(both) - union) >= percent * union)
                while len(memo) > MEMO_SETS:
                    memo.popitem(last=False)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    ship(pairs.sparkSession)
    return pairs.mapInArrow(released(run), "u binary, v binary")


def _private_blocks(targets: int):
    """Per range of hashes and slice of texts: short hashes, the class of each (none if
    several of the slice have it) and the keys of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets = shingle_sets(part.column("text"))
                keys = np.frombuffer(b"".join(part.column("key").to_pylist()), np.uint8).reshape(-1, 16)
                owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                values, first, counts = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
                owner = np.where(counts == 1, owner[first], _NOBODY).astype("<u4")
                target = bucket_of(values, targets)  # ascending, as the values are
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1, [len(values)]]).tolist()
                rows = [[int(target[i]), values[i:j].astype("<u4"), owner[i:j]] for i, j in zip(cuts, cuts[1:], strict=False)]
                for row in rows:  # only the keys that the row's classes need
                    used, row[2] = np.unique(row[2], return_inverse=True)
                    own = used[used != _NOBODY]
                    row[2] = np.where(used[row[2]] == _NOBODY, _NOBODY, row[2]).astype("<u4")
                    row.append(keys[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()),
                     *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (1, 2, 3))],
                    ["target", "hashes", "owners", "keys"],
                )

    return run


_NOBODY = 2**32 - 1


def _private_sums(table: pa.Table) -> pa.Table:
    hashes, owners, keys, base = [], [], [], 0
    for row in table.to_pylist():
        own = np.frombuffer(row["owners"], "<u4").astype(np.int64)
        hashes.append(np.frombuffer(row["hashes"], "<u4"))
        owners.append(np.where(own == _NOBODY, -1, own + base))
        keys += [row["keys"][i : i + 16] for i in range(0, len(row["keys"]), 16)]
        base = len(keys)
    _, first, counts = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
    alone = np.concatenate(owners)[first[counts == 1]]
    sums = np.bincount(alone[alone >= 0], minlength=len(keys))
    some = np.flatnonzero(sums)
    out = pa.table({"key": pa.array([keys[i] for i in some], pa.binary()), "private": pa.array(sums[some], pa.int64())})
    del hashes, owners, keys, alone, sums, first, counts
    hand_back()
    return out


def private_counts(texts: DataFrame) -> DataFrame:
    """``key, private``: how many shingles of a class no other class of ``key, text`` has.

    Counted on 32 bits of a hash within ranges of it: what collides counts as shared, so a
    count is never too large. A shingle that many classes share leaves a task once.
    """
    spark = texts.sparkSession
    ship(spark)
    targets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = texts.select("key", "text").mapInArrow(
        released(_private_blocks(targets)), "target int, hashes binary, owners binary, keys binary"
    )
    sums = blocks.groupBy("target").applyInArrow(_private_sums, "key binary, private long")
    return sums.groupBy("key").agg(F.sum("private").alias("private"))


def possible(percent: int, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether two sets of ``(size, private)`` can be similar enough.

    ``private`` is null for a class outside the crowded buckets; then both count as without.
    """
    both = a[1].isNotNull() & b[1].isNotNull()
    (n, p), (m, q) = ((x[0], F.when(both, x[1]).otherwise(0)) for x in (a, b))
    return 100 * F.least(n - p, m - q) >= percent * F.greatest(n + q, m + p)


def _bitmaps():
    def bitmaps(texts: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(texts)
        out = np.zeros((len(sets), BITMAP_WORDS), np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        place = (np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(16)) % np.uint64(64 * BITMAP_WORDS)
        np.bitwise_or.at(out, (owner, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        starts = np.arange(len(sets) + 1) * BITMAP_WORDS
        return [list_array(out.reshape(-1).view(np.int64), starts, pa.int64())]

    return bitmaps


def possible_by_bitmap(percent: int, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether two sets of ``(size, bitmap)`` can be similar enough."""
    def missing(x: Column, y: Column) -> Column:
        words = [F.bit_count(x[i].bitwiseAND(F.bitwise_not(y[i]))) for i in range(BITMAP_WORDS)]
        return reduce(lambda p, q: p + q, words)

    (n, x), (m, y) = a, b
    shared = F.least(n - missing(x, y), m - missing(y, x))
    return 100 * shared >= percent * (n + m - shared)


class _Classes:
    """Classes of one run, their texts and the links found so far."""

    def __init__(self, classes: DataFrame, members: DataFrame, texts: DataFrame, bitmaps: DataFrame, percent: int):
        self.classes, self.members, self.texts, self.percent = classes, members, texts, percent
        self.bitmaps = bitmaps
        self.links: DataFrame | None = None

    def link(self, pairs: DataFrame) -> None:
        """Confirm the pairs ``u, v`` and add those that are similar enough."""
        for side in ("v", "u"):
            pairs = pairs.join(
                self.texts.select(F.col("key").alias(side), F.col("text").alias(f"{side}_text")).hint("merge"), side
            )
        found = durable(confirmed(pairs.select("u", "v", "u_text", "v_text"), self.percent))
        self.links = found if self.links is None else self.links.union(found)

    def roots(self) -> DataFrame:
        """Links replaced by their components, ``node, root``."""
        roots = durable(components(self.links))
        self.links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u != v")
        return roots

    def first_pairs(self) -> DataFrame:
        """Every class of a bucket with the bucket's smallest, unless their sizes rule it out."""
        least = self.members.groupBy("bucket").agg(F.min(F.struct("key", "n", "private")).alias("v"))
        pairs = self.members.withColumnRenamed("key", "u").join(least, "bucket").where("u != v.key")
        fits = possible(self.percent, (F.col("n"), F.col("private")), (F.col("v.n"), F.col("v.private")))
        pairs = pairs.where(fits).select("u", F.col("v.key").alias("v"), "n", F.col("v.n").alias("m")).distinct()
        for side in "uv":
            pairs = pairs.join(self.bitmaps.select(F.col("key").alias(side), F.col("bitmap").alias(f"{side}_bits")), side)
        fits = possible_by_bitmap(self.percent, (F.col("n"), F.col("u_bits")), (F.col("m"), F.col("v_bits")))
        return pairs.where(fits).select("u", "v")

    def next_pairs(self, roots: DataFrame, used: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Pairs of classes outside their bucket's largest component with those of other
        components there; the pairs, and the classes outside. A pair is made in the first
        bucket that both share, once."""
        named = roots.select(F.col("node").alias("key"), "root")
        rows = self.members.join(named, "key", "left").withColumn("root", F.coalesce("root", "key"))
        counts = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        largest = counts.groupBy("bucket").agg(
            F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("parts"),
            F.ceil(F.sum("n") / DEALT).cast("int").alias("salts"),
        ).where("parts > 1")
        rows = rows.join(largest, "bucket").join(self.classes.select("key", "bands"), "key").join(self.bitmaps, "key")
        # the members of a crowded bucket are dealt out, each part meets a copy of its pivots
        salt = F.pmod(F.xxhash64("key", F.lit(5)), F.col("salts")).cast("int").alias("salt")
        rows = durable(rows.select("bucket", salt, "salts", "key", "n", "private", "root", "largest", "bands", "bitmap"))
        outside = rows.where("root != largest")
        if used is not None:
            outside = outside.join(used, ["bucket", "key"], "left_anti")
        slot = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(PIVOTS))
        pivots = outside.groupBy("bucket", slot.alias("slot")).agg(
            F.min(F.struct("key", "n", "private", "root", "bands", "bitmap")).alias("p"), F.first("salts").alias("salts")
        )
        chosen = durable(pivots.select("bucket", "salts", "p"))
        pivots = chosen.select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "p")
        fits = possible(self.percent, (rows["n"], rows["private"]), (pivots["p.n"], pivots["p.private"]))
        fits = fits & possible_by_bitmap(
            self.percent, (rows["n"], rows["bitmap"]), (pivots["p.n"], pivots["p.bitmap"])
        )
        first = F.array_intersect(rows["bands"], pivots["p.bands"])[0]
        pairs = rows.join(
            pivots,
            (rows["bucket"] == pivots["bucket"]) & (rows["salt"] == pivots["salt"])
            & (rows["root"] != pivots["p.root"]) & fits & (first == rows["bucket"]),
        )
        pairs = pairs.select(F.greatest("key", "p.key").alias("u"), F.least("key", "p.key").alias("v"))
        return pairs.distinct(), chosen.select("bucket", F.col("p.key").alias("key"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text",
    percent: int = 85, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Two documents are linked if 100 * intersection >= percent * union of their sets of
    distinct 5-word shingles (words between ASCII white space, A-Z in lower case); a
    component is what links connect, named by its smallest doc_id. Texts of fewer words are
    one shingle; null and empty texts have an empty set and stand alone. Rows with equal sets
    are linked whatever their ids; a null id is larger than any other, and a component of
    rows without ids has a null ``component_id``. An empty table gives an empty one; other
    columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fields = [StructField("n_shingles", LongType()), StructField("key", BinaryType()),
              StructField("bands", ArrayType(LongType()))]
    described = durable(append_columns(base, _described(bands, rows), fields, ["doc_id"]))
    # rows of one set, as many as there may be, become one class before the shuffle
    classes = durable(
        described.where("n_shingles > 0").groupBy("key")
        .agg(F.min("doc_id").alias("min_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    in_bands = classes.select(F.explode("bands").alias("bucket"), "key", "n")
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = durable(in_bands.join(shared, "bucket"))
    wanted = members.groupBy("key").agg(F.max("size").alias("size"))
    texts = append_columns(base, lambda: _once(_keys()), [StructField("key", BinaryType())], ["text"])
    texts = texts.where(F.col("key").isNotNull()).join(wanted.hint("merge"), "key")
    texts = durable(texts.groupBy("key").agg(F.first("text").alias("text"), F.first("size").alias("size")))
    crowded = texts.where(F.col("size") >= CROWD).select("key", "text")
    private = private_counts(crowded).join(crowded.select("key"), "key", "right").withColumn(
        "private", F.coalesce("private", F.lit(0))
    )
    members = members.join(private, "key", "left").where(
        (F.col("size") < CROWD) | (100 * (F.col("n") - F.col("private")) >= percent * F.col("n"))
    )
    members = durable(members.select("bucket", "key", "n", "private"))

    bitmaps = durable(append_columns(texts, _bitmaps, [StructField("bitmap", ArrayType(LongType()))], ["key"]))
    state = _Classes(classes, members, texts, bitmaps, percent)
    state.link(state.first_pairs())
    roots, used = state.roots(), None
    while True:
        pairs, pivots = state.next_pairs(roots, used)
        if pivots.isEmpty():
            break
        state.link(pairs)
        roots = state.roots()
        used = pivots if used is None else used.union(pivots)

    named = roots.select(F.col("node").alias("key"), "root")
    named = classes.select("key", "min_id").join(named, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    named = named.join(least, "root").select("key", "component_id")
    out = described.where("n_shingles > 0").join(named, "key").select("doc_id", "n_shingles", "component_id")
    alone = described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.union(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _once(keys):
    """``keys`` without those the task has named already (null), so that copies of a text
    leave the task once."""
    seen: set[bytes] = set()

    def first(texts: pa.Array) -> list[pa.Array]:
        out = []
        for key in keys(texts)[0].to_pylist():
            out.append(None if key in seen or not key else key)
            seen.add(key)
        if len(seen) > 200_000:
            seen.clear()
        return [pa.array(out, pa.binary())]

    return first
