"""Conformal prediction sets for two classes: score quantiles, global and by partition.

The score of a class is ``1 - p``, as it is. Limits are exact order statistics found by counting,
so no partition is ever sorted whole however many distinct scores it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ranks import order_values
from cohortlens.session import durable, joined, small_side, with_row


def class_score(p1: Column, cls: int) -> Column:
    return F.lit(1.0) - p1 if cls == 1 else p1


def true_score(p1: Column, y: Column) -> Column:
    return F.when(y == 1, class_score(p1, 1)).otherwise(class_score(p1, 0))


def score_histogram(cal: DataFrame, groups: list[str]) -> DataFrame:
    """Counts ``n`` of the true-class scores, by class, per group, of calibration rows
    ``(p1, y)``. All limits can be read from it, and two of them add up to one."""
    scored = cal.withColumn("score", true_score(F.col("p1"), F.col("y")))
    return scored.groupBy(*groups, "y", "score").agg(F.count("*").alias("n"))


def merge_histograms(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """The state of all calibration rows from the states of parts of them."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy(*groups, "y", "score").agg(F.sum("n").alias("n"))


def quantile_of(hist: DataFrame, groups: list[str], alpha: float) -> DataFrame:
    """``k``-th smallest score with ``k = ceil((n+1)(1-alpha))``; NULL if ``k > n``, which
    stands for a limit no score exceeds."""
    sizes = durable(hist.groupBy(*groups).agg(F.sum("n").alias("n_cal")))
    k = F.ceil(F.round((F.col("n_cal") + 1) * F.lit(1.0 - alpha), 9))
    wanted = sizes.where(F.col("n_cal") > 0).select(*groups, F.lit("q").alias("name"), k.alias("rank"))
    found = order_values(hist, "score", wanted, groups, "n").select(*groups, F.col("score").alias("q"))
    if groups:
        return joined(sizes, found, groups, "left").select(*groups, "q", "n_cal")
    only = found.agg(F.max("q").alias("q"))  # one row, also without a limit
    return with_row(sizes, only).select("q", "n_cal")


def lac_quantile(cal: DataFrame, alpha: float, groups: list[str] | None = None) -> DataFrame:
    groups = groups or []
    return quantile_of(durable(score_histogram(cal, groups)), groups, alpha)


def sets_from(df: DataFrame, q: Column) -> DataFrame:
    """Add ``has0`` and ``has1``: the class is in the set if its score is at most ``q``."""
    member = [q.isNull() | (class_score(F.col("p1"), c) <= q) for c in (0, 1)]
    return df.withColumns({"has0": member[0], "has1": member[1]})


def _attach(rows: DataFrame, limits: DataFrame, groups: list[str]) -> DataFrame:
    if not groups:
        return with_row(rows, limits)
    found = joined(rows, small_side(limits), groups, "left")
    return found.select(*groups, *[F.col(f"`{c}`") for c in found.columns if c not in groups])


def lac_sets(
    rows: DataFrame, cal: DataFrame, alpha: float, groups: list[str] | None = None
) -> DataFrame:
    """Prediction sets of ``rows (p1)`` with one limit for all, or for each of ``groups``
    (the horizons, say)."""
    groups = groups or []
    limit = lac_quantile(cal, alpha, groups).select(*groups, F.col("q").alias("_q"))
    return sets_from(_attach(rows, limit, groups), F.col("_q")).drop("_q")


def partition_limits(
    cal: DataFrame, alpha: float, part: str, groups: list[str] | None = None
) -> DataFrame:
    """Per partition: its limit, its calibration rows, its lowest class, and whether both
    classes occur."""
    return limits_of(durable(score_histogram(cal, [*(groups or []), part])), alpha, part, groups)


def limits_of(hist: DataFrame, alpha: float, part: str, groups: list[str] | None = None) -> DataFrame:
    """The same from a stored state, at any level."""
    keys = [*(groups or []), part]
    classes = hist.groupBy(*keys).agg(
        F.min("y").alias("only_class"), (F.min("y") < F.max("y")).alias("both_classes")
    )
    return joined(quantile_of(hist, keys, alpha), classes, keys)


def mondrian_sets(
    rows: DataFrame,
    cal: DataFrame,
    alpha: float,
    part: str,
    fallback: str = "global",
    groups: list[str] | None = None,
) -> DataFrame:
    """Prediction sets with one limit per partition.

    A partition whose calibration rows are too few for the level, or of one class, uses
    the global limit; with ``fallback="only_class"`` one of a single class gets just that.
    A partition without any calibration row always uses the global limit.
    """
    if fallback not in ("global", "only_class"):
        raise ValueError(f"unknown fallback {fallback!r}")
    groups = groups or []
    hist = durable(score_histogram(cal, [*groups, part]))
    return mondrian_sets_of(rows, hist, alpha, part, fallback, groups)


def mondrian_sets_of(
    rows: DataFrame,
    hist: DataFrame,
    alpha: float,
    part: str,
    fallback: str = "global",
    groups: list[str] | None = None,
) -> DataFrame:
    """The same from a stored state: ``score_histogram`` by ``groups`` and ``part``."""
    groups = groups or []
    limits = limits_of(hist, alpha, part, groups).drop("n_cal")
    whole = hist.groupBy(*groups, "score").agg(F.sum("n").alias("n"))
    overall = quantile_of(whole, groups, alpha).select(*groups, F.col("q").alias("_q_all"))
    placed = _attach(_attach(rows, limits, [*groups, part]), overall, groups)
    own = F.when(F.col("both_classes"), F.col("q"))
    out = sets_from(placed, F.coalesce(own, F.col("_q_all")))
    if fallback == "only_class":
        single = F.col("both_classes").isNotNull() & ~F.col("both_classes")
        out = out.withColumns(
            {
                "has0": F.when(single, F.col("only_class") == 0).otherwise(F.col("has0")),
                "has1": F.when(single, F.col("only_class") == 1).otherwise(F.col("has1")),
            }
        )
    return out.drop("q", "only_class", "both_classes", "_q_all")
