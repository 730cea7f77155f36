"""Windows over an entity's steps, and sliding windows over one long sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.frames import entity_window
from cohortlens.operators.ranks import hash_rank


def last_positive(df: DataFrame, keys: list[str], mark: str = "mark") -> DataFrame:
    """Latest strictly positive mark of each entity, 0 if it has none."""
    latest = F.max_by(
        F.when(F.col(mark) > 0, F.col(mark)), F.when(F.col(mark) > 0, F.col("step_idx"))
    )
    return df.groupBy(*keys).agg(F.coalesce(latest, F.lit(0.0)).alias("last_mark"))


def last_n_positive(df: DataFrame, keys: list[str], n: int, mark: str = "mark") -> DataFrame:
    """The ``n`` latest positive marks, newest first (one row per entity and step in)."""
    pair = F.when(F.col(mark) > 0, F.struct((-F.col("step_idx")).alias("i"), F.col(mark).alias("m")))
    newest = F.slice(F.sort_array(F.collect_list(pair)), 1, n)
    return df.groupBy(*keys).agg(F.transform(newest, lambda p: p["m"]).alias("last_marks"))


def lag_windows(df: DataFrame, features: str, w: int, keys: list[str]) -> DataFrame:
    """Features of the ``w`` steps before each step, newest first, from step ``w`` on.

    ``df`` is dense (an entity has every step) and ``features`` an array column.
    """
    by_step = entity_window(keys=keys)
    lags = [F.lag(features, j).over(by_step) for j in range(1, w + 1)]
    out = df.withColumn("lags", F.concat(*lags))
    return out.where(F.col("step_idx") >= w)


def horizon_target(df: DataFrame, mark: str, horizon: int, keys: list[str]) -> DataFrame:
    """Mark ``horizon`` steps on, or the last step's mark beyond the end."""
    by_step = entity_window(keys=keys)
    end = by_step.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.lead(mark, horizon).over(by_step) if horizon else F.col(mark)
    return df.withColumn("target", F.coalesce(ahead, F.last(mark).over(end)))


def shift_forecast(forecast: DataFrame, value: str) -> DataFrame:
    """A forecast made for step k+1 becomes metric ``next_grade`` of step k."""
    return forecast.where(F.col("step_idx") > 0).select(
        *[c for c in forecast.columns if c not in ("step_idx", value)],
        (F.col("step_idx") - 1).alias("step_idx"),
        F.lit("next_grade").alias("metric"),
        F.col(value).alias("value"),
    )


def expanding_stats(df: DataFrame, mark: str = "mark") -> DataFrame:
    """Size and mean of everything before each step (what a fit for it may see).

    Steps are summed first, so the ordered window has one row per step.
    """
    per_step = df.groupBy("step_idx").agg(F.count(mark).alias("_n"), F.sum(mark).alias("_s"))
    before = Window.orderBy("step_idx").rowsBetween(Window.unboundedPreceding, -1)
    return per_step.select(
        "step_idx",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n_before"),
        F.try_divide(F.sum("_s").over(before), F.sum("_n").over(before)).alias("mean_before"),
    )


def sequence_index(df: DataFrame, key: str, step: str = "step_idx", seed: int = 42) -> DataFrame:
    """Add ``idx``, the 0-based place of each row in the step-major sequence.

    Within a step the order is that of the key hashes: fixed, and free of hot ranges.
    """
    one = df.withColumn("_all", F.lit(1))
    return (
        hash_rank(one, key, ["_all"], seed, lead=[step])
        .withColumn("idx", F.col("rank") - 1)
        .drop("_all", "rank", "rank_all")
    )


def _in_blocks(df: DataFrame, w: int, index: str, block: int | None):
    """The sequence cut into blocks, each with the last ``w`` rows of the one before as well, so
    that every window lies in one block. Blocks are much longer than ``w``, which keeps the
    copied share small. Returns the rows, the window of up to ``w`` rows before, and which rows
    are a block's own."""
    size = max(block or 20 * w, w)
    home = F.floor(F.col(index) / size)
    is_tail = F.pmod(F.col(index), F.lit(size)) >= size - w
    blocks = F.when(is_tail, F.array(home, home + 1)).otherwise(F.array(home))
    placed = df.select("*", home.alias("_home"), F.explode(blocks).alias("_block"))
    prior = Window.partitionBy("_block").orderBy(index).rowsBetween(-w, -1)
    return placed, prior, F.col("_block") == F.col("_home")


def sliding_windows(
    df: DataFrame, value: str, w: int, index: str = "idx", block: int | None = None
) -> DataFrame:
    """For each row of the sequence from the ``w``-th on, the ``w`` values before it."""
    placed, prior, own = _in_blocks(df, w, index, block)
    out = placed.withColumn("window", F.collect_list(value).over(prior))
    return out.where(own & (F.col(index) >= w)).drop("_block", "_home")


def window_moments(
    df: DataFrame, value: str, w: int, index: str = "idx", block: int | None = None
) -> DataFrame:
    """Add ``before_mean`` and ``before_sd`` of up to ``w`` values before each row of the
    sequence; NULL for the first row. No window is ever built."""
    placed, prior, own = _in_blocks(df, w, index, block)
    out = placed.withColumns(
        {"before_mean": F.avg(value).over(prior), "before_sd": F.stddev_pop(value).over(prior)}
    )
    return out.where(own).drop("_block", "_home")


def trailing_window(df: DataFrame, value: str, w: int, index: str = "idx") -> DataFrame:
    """One row: the last ``w`` values of the sequence, zeros in front if there are fewer."""
    last = df.orderBy(F.col(index).desc()).limit(w).select(index, value)
    kept = F.transform(
        F.sort_array(F.collect_list(F.struct(index, value))), lambda p: p[value]
    )
    packed = last.agg(kept.alias("_kept"))
    pad = F.array_repeat(F.lit(0.0), F.lit(w) - F.size("_kept"))
    return packed.select(F.concat(pad, F.col("_kept")).alias("window"))
