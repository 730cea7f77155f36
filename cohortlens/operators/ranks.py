"""Ranks, running totals and order statistics without a single-task sort.

Rows are put into buckets that respect the order. Buckets are summed first (few rows),
each bucket learns what lies before it, and only rows of one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import durable, joined, small_side, with_row

#: Hex digits of the hash that name a bucket: 16**3 buckets.
BUCKET_DIGITS = 3
#: Distinct values that are sorted together, and parts a range of values is cut into.
BOUND, CELLS = 10_000, 64


def hash_of(key: Column, seed: int | str) -> Column:
    """A fixed pseudo-random order of keys that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def running_totals(
    df: DataFrame,
    groups: list[str],
    bucket: str,
    order: list[str],
    sums: dict[str, str],
) -> DataFrame:
    """Add, for each ``name: column`` of ``sums``, ``name_cum`` (up to and including the
    row) and ``name_all`` (whole group), in ``order`` within ``groups``.

    ``bucket`` must never decrease along ``order``, and ``order`` must have no ties.
    """
    keys = [*groups, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_off") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_all") for n in sums],
    )
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.select("*", *[F.sum(c).over(local).alias(f"_{n}_loc") for n, c in sums.items()])
    # a NULL group or order is a group like any other
    found = joined(ranked, offsets, keys)
    return found.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_{n}_off") + F.col(f"_{n}_loc")).alias(f"{n}_cum") for n in sums],
        *[f"{n}_all" for n in sums],
    )


def hash_rank(
    df: DataFrame,
    key: str,
    groups: list[str],
    seed: int | str,
    lead: list[str] | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``rank`` (1-based) and ``rank_all`` (size) within ``groups``, ordered by the
    columns ``lead`` and then by the hash of ``key``. Hash prefixes make even buckets
    whatever the keys look like."""
    lead = lead or []
    hashed = df.withColumn("_hash", hash_of(F.col(key), seed)).withColumn("_one", F.lit(1))
    # Never NULL, so the join on it needs no filter that hashes once more.
    prefix = F.coalesce(F.substring("_hash", 1, digits), F.lit(""))
    bucket = F.struct(*[F.col(c) for c in lead], prefix.alias("_p")) if lead else prefix
    out = running_totals(
        hashed.withColumn("_bucket", bucket),
        groups,
        "_bucket",
        [*lead, "_hash", key],
        {"rank": "_one"},
    )
    renamed = out.withColumnRenamed("rank_cum", "rank")
    return renamed.drop("_hash", "_one", "_bucket")


def value_buckets(df: DataFrame, value: str, n: int = 256) -> DataFrame:
    """Add ``_bucket``: which of about ``n`` evenly filled ranges ``value`` lies in.

    The range bounds are the only thing fetched. They are literals of the plan, so every
    evaluation of it, also one after a lost executor, puts a row in the same bucket.
    """
    shares = [i / n for i in range(1, n)]
    bounds = df.stat.approxQuantile(value, shares, 1.0 / (4 * n)) if shares else []
    if not bounds:  # one range, or no value at all
        return df.withColumn("_bucket", F.lit(0.0))
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol="_bucket")
    return cut.transform(df)


def value_histogram(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Distinct values with their counts ``n``, written once because everything built on
    it reads it several times."""
    return durable(df.groupBy(*(groups or []), value).agg(F.count("*").alias("n")))


def order_values(
    df: DataFrame,
    value: str,
    wanted: DataFrame,
    groups: list[str],
    weight: str | None = None,
    bound: int = BOUND,
) -> DataFrame:
    """Exact order statistics of all groups at once, without a sort of a group.

    ``wanted`` has a row ``(groups, name, rank)`` for each number asked for, a few per group. The
    result gives each the smallest ``value`` of its group at which the number of rows up to it
    (or the whole-numbered ``weight`` of those rows) reaches ``rank``: ``(groups, name, value)``,
    no row if it never does. NULL values and weights that are not positive count for nothing.

    A bracket around each rank, at first the whole group, is cut at sketched quantiles of the
    distinct values in it and narrowed to the part that holds the rank, by counting. That
    repeats until no bracket holds more than ``bound`` distinct values, which are then counted
    one by one. Each round leaves about a ``CELLS``-th, so a few do at any size.
    """
    rows = _distinct(df, value, groups, weight)
    asked = wanted.select(_group(groups), "name", F.col("rank").cast("long").alias("rank"))
    brackets = narrowed(rows, asked, bound)
    found = _holding(_inside(rows, brackets).withColumnRenamed("_w", "_s"), "_v")
    return found.select(*[F.col("_g")[g].alias(g) for g in groups], "name", F.col("_v").alias(value))


_SIZE = ["_n", "_lo", "_hi"]


def _group(groups: list[str]) -> Column:
    return F.struct(F.lit(0).alias("_all"), *groups).alias("_g")


def _distinct(df: DataFrame, value: str, groups: list[str], weight: str | None) -> DataFrame:
    """``(_g, _v, _w)``: each distinct value of a group with its weight."""
    heft = F.col(weight) if weight else F.lit(1).cast("long")
    rows = df.select(_group(groups), F.col(value).alias("_v"), heft.alias("_w"))
    rows = rows.where(F.col("_v").isNotNull() & (F.col("_w") > 0))
    return durable(rows.groupBy("_g", "_v").agg(F.sum("_w").alias("_w")))


def _sizes() -> list[Column]:
    return [c.alias(n) for c, n in zip((F.count("*"), F.min("_v"), F.max("_v")), _SIZE, strict=True)]


def _inside(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    some = small_side(brackets.select("_g", "name", "rank", "_below", "_lo", "_hi"))
    return joined(rows, some, ["_g"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _holding(cells: DataFrame, order: str) -> DataFrame:
    """Of the cells of each bracket, with their weights ``_s``, the one its rank falls into."""
    upto = Window.partitionBy("_g", "name").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_to", F.col("_below") + F.sum("_s").over(upto))
    return cells.where((F.col("rank") <= F.col("_to")) & (F.col("rank") > F.col("_to") - F.col("_s")))


def narrowed(rows: DataFrame, asked: DataFrame, bound: int) -> DataFrame:
    """A bracket ``_lo`` to ``_hi`` around each rank of ``(_g, name, rank)``, with ``_n <= bound``
    distinct values in it and ``_below`` as the weight of those before it."""
    keys = ["_g", "name"]
    state = joined(asked, rows.groupBy("_g").agg(*_sizes()), ["_g"])
    state = durable(state.withColumn("_below", F.lit(0).cast("long")))
    bound = max(bound, 2 * CELLS)
    while True:
        open_ = state.where(F.col("_n") > bound)
        if open_.isEmpty():
            return state
        near = _inside(rows, open_)
        cuts = F.percentile_approx("_v", [i / CELLS for i in range(1, CELLS)], 10 * CELLS)
        cuts = small_side(near.groupBy(*keys).agg(cuts.alias("_cuts")))
        cell = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_cell")
        cells = joined(near, cuts, keys).select(*keys, "rank", "_below", "_v", "_w", cell)
        cells = cells.groupBy(*keys, "rank", "_below", "_cell").agg(F.sum("_w").alias("_s"), *_sizes())
        hit = _holding(cells, "_cell").withColumn("_below", F.col("_to") - F.col("_s")).select(*state.columns)
        state = durable(state.where(F.col("_n") <= bound).unionByName(hit))


def exact_quantile(
    df: DataFrame, value: str, q: float, groups: list[str] | None = None, bound: int = BOUND
) -> DataFrame:
    """Exact quantile with linear interpolation, one row per group: ``(groups, q_value, n)``."""
    groups = groups or []
    present = df.where(F.col(value).isNotNull()).select(*groups, value)
    sizes = durable(present.groupBy(*groups).agg(F.count("*").alias("n")).where(F.col("n") > 0))
    at = F.lit(q) * (F.col("n") - 1)
    ranks = F.array(
        F.struct(F.lit("lo").alias("name"), (F.floor(at) + 1).alias("rank")),
        F.struct(F.lit("hi").alias("name"), (F.ceil(at) + 1).alias("rank")),
    )
    found = order_values(present, value, sizes.select(*groups, F.inline(ranks)), groups, bound=bound)
    ends = [F.max(F.when(F.col("name") == e, F.col(value))).alias(f"_{e}") for e in ("lo", "hi")]
    found = found.groupBy(*groups).agg(*ends)
    if groups:
        found = joined(sizes, found, groups)
    else:  # one row, and none of an empty table
        found = with_row(sizes, found)
    value_at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))
    return found.select(*groups, value_at.alias("q_value"), "n")


def weighted_order(
    df: DataFrame,
    value: str,
    weight: str,
    wanted: DataFrame,
    groups: list[str],
    buckets: int | None = None,
) -> DataFrame:
    """Exact weighted order statistics of all groups in one pass, for many ranks per group.

    ``wanted`` has a row ``(groups, name, rank)`` for each number asked for. The result gives
    each the smallest ``value`` of its group at which the running total of ``weight``, in
    order of values, reaches ``rank``: ``(groups, name, value)``, no row if it never does.
    Weights are whole numbers, so that totals are the same in any order of summation; rows
    whose value is NULL or whose weight is not positive count for nothing. Ranges of values
    that are sorted together hold ``BOUND`` distinct ones, or a 4096th of them.
    """
    used = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    sums = durable(used.groupBy(*groups, value).agg(F.sum(weight).alias("_w")))
    buckets = buckets or min(4096, 1 + sums.count() // BOUND)
    ranked = running_totals(value_buckets(sums, value, buckets), groups, "_bucket", [value], {"_t": "_w"})
    cells = durable(
        ranked.select(*groups, "_bucket", value, (F.col("_t_cum") - F.col("_w")).alias("_from"), F.col("_t_cum").alias("_to"))
    )
    # a rank is first placed in its bucket, then looked for among that bucket's values
    spans = cells.groupBy(*groups, "_bucket").agg(F.min("_from").alias("_a"), F.max("_to").alias("_b"))
    placed = joined(wanted, spans, groups).where((F.col("rank") > F.col("_a")) & (F.col("rank") <= F.col("_b")))
    placed = placed.select(*groups, "_bucket", "name", "rank")
    found = joined(cells, placed, [*groups, "_bucket"])
    hit = (F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("_to"))
    return found.where(hit).select(*groups, "name", value)
