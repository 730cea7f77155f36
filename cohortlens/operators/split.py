"""Stratified splits and class weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ranks import hash_rank
from cohortlens.session import joined, small_side, with_row

# Shares of the splits in percent, in the order the rows are dealt.
THREE_WAY = [("train", 60), ("cal", 20), ("test", 20)]
FOUR_WAY = [("train", 40), ("cal_cp", 20), ("cal_gate", 20), ("test", 20)]
SEED = 42


def split_name(rank: Column, size: Column, parts: list[tuple[str, int]]) -> Column:
    """The part a rank of ``size`` falls in; compared as integers."""
    done, bounds = 0, []
    for name, percent in parts:
        done += percent
        bounds.append((name, done))
    first, *rest = bounds[:-1]
    out = F.when(rank * 100 <= size * first[1], F.lit(first[0]))
    out = reduce(lambda c, b: c.when(rank * 100 <= size * b[1], F.lit(b[0])), rest, out)
    return out.otherwise(F.lit(bounds[-1][0]))


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    parts: list[tuple[str, int]] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: the same shares within each class, by the hash order of the keys."""
    ranked = hash_rank(df, key, [label], seed)
    named = split_name(F.col("rank"), F.col("rank_all"), parts or THREE_WAY)
    return ranked.withColumn("split", named).drop("rank", "rank_all")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class, rows / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("_all"), F.count("*").alias("_classes"))
    weight = F.col("_all") / (F.col("_classes") * F.col("n")).cast("double")
    return with_row(sizes, total).select(label, "n", weight.alias("weight"))


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    weights = small_side(class_weights(df, label).select(label, "weight"))
    return joined(df, weights, [label])
