"""Table sinks: CSV, saved tables, per-step features, one document per activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import to_number
from cohortlens.operators.frames import select_names

# What happens if the table exists, in the words of the option.
MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
TEXT_COLUMNS = ("email", "city")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "replace"):
    """CSV with a header and a fixed column order."""
    chosen = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    chosen.write.mode(MODES[mode]).option("header", True).option("encoding", "UTF-8").csv(path)


def coerce_columns(df: DataFrame, skip: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """Every column but the listed ones as a number, NULL where it is not one."""
    return df.select(
        *[
            F.col(f"`{c}`") if c in skip else to_number(F.col(f"`{c}`")).alias(c)
            for c in df.columns
        ]
    )


def write_table(
    df: DataFrame,
    name: str | None = None,
    path: str | None = None,
    if_exists: str = "fail",
    keys: list[str] | None = None,
    buckets: int | None = None,
):
    """A saved table, or Parquet files at ``path``.

    ``keys`` that exist in the table lay it out for lookups, as an index would: rows are
    sorted by key inside files that hold narrow key ranges, so a filter on a key skips
    files by their statistics. The row hash after the keys lets a key with very many rows
    spread over several files. With ``buckets`` a saved table is bucketed instead, and
    joins on the key read it without a shuffle.
    """
    mode = MODES[if_exists]
    present = [k for k in keys or [] if k in df.columns]
    if name and buckets and present:
        writer = df.write.mode(mode).bucketBy(buckets, *present).sortBy(*present)
        writer.saveAsTable(name)
        return
    laid = df
    if present:
        spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        laid = df.repartitionByRange(*present, spread).sortWithinPartitions(*present)
    if name:
        laid.write.mode(mode).saveAsTable(name)
    else:
        laid.write.mode(mode).parquet(path)


def publish(
    df: DataFrame,
    prefixes: list[str],
    keep: list[str],
    name: str | None = None,
    path: str | None = None,
    if_exists: str = "fail",
    keys: list[str] | None = None,
):
    """Select by name prefix, coerce to numbers, write, lay out by key."""
    write_table(coerce_columns(select_names(df, prefixes, keep)), name, path, if_exists, keys)


def write_steps(df: DataFrame, path: str, mode: str = "replace"):
    """Features stored by ``step_idx``."""
    df.write.mode(MODES[mode]).partitionBy("step_idx").parquet(path)


def write_documents(df: DataFrame, path: str, mode: str = "replace"):
    """JSON documents in one folder per activity (``code``, ``slug``, ``instance``)."""
    df.write.mode(MODES[mode]).partitionBy("code", "slug", "instance").json(path)
