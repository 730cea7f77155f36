"""Flat tables: header CSV, Parquet by step, schema probes, artefact checks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlens.functions import text
from cohortlens.operators.frames import fill_group, stack_tables

# What stands for no value in a column of numbers.
NO_VALUE = ["", "nan", "na", "n/a", "null", "none"]


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Header CSV; types are inferred unless a schema is given (inference reads twice)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return reader.csv(path)


def file_path() -> Column:
    """The path of a row's file as it was given, not as an address."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def headers(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], list[str]]]:
    """``(columns, files)`` for each distinct header, in the order of the paths; one job that
    reads the files as lines. Files without a line have no header and are left out."""
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(paths).select("value", file_path().alias("path"), at.alias("at"))
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    # a row per file, of which a project has one for each site
    found = {r.path: r.header for r in first.collect()}
    place = {given.rsplit("/", 1)[-1]: i for i, given in enumerate(paths)}
    groups: dict[str, list[str]] = {}
    for path in sorted(found, key=lambda p: (place.get(p.rsplit("/", 1)[-1], len(paths)), p)):
        groups.setdefault(found[path].lstrip("\ufeff"), []).append(path)
    return [(next(csv.reader([line])), files) for line, files in groups.items()]


def read_sites(spark: SparkSession, paths: list[str], texts: tuple[str, ...] = ("email", "city")) -> DataFrame:
    """The site files of one project, whose headers may differ, as one table with ``city``.

    Files with the same header are one scan. Nothing is inferred: columns in ``texts`` are texts,
    all others numbers (true and false count as 1 and 0); another value is an error.
    """
    tables = []
    for columns, files in headers(spark, paths):
        schema = StructType([StructField(c, StringType()) for c in columns])
        raw = spark.read.schema(schema).option("header", True).csv(files)
        sited = fill_group(raw, text.city_token(text.file_stem(file_path())))
        tables.append(sited.select(*[
            F.col(f"`{c}`") if c in (*texts, "city") else _number(c).alias(c) for c in sited.columns
        ]))
    if not tables:
        raise ValueError("no site file has a header")
    return stack_tables(tables)


def _number(column: str) -> Column:
    value = F.trim(F.col(f"`{column}`"))
    plain = F.coalesce(text.to_number(value), F.lower(value).try_cast("boolean").cast("double"))
    wrong = F.raise_error(F.concat(F.lit(f"no number in column {column}: "), value)).cast("double")
    return F.when(F.lower(value).isin(NO_VALUE), F.lit(None)).when(value.isNotNull(), F.coalesce(plain, wrong))


def probe(spark: SparkSession, path: str, rows: int = 5) -> tuple[list[str], int, DataFrame]:
    """Column names, their number and the first rows of a CSV."""
    df = spark.read.option("header", True).csv(path)
    return df.columns, len(df.columns), df.limit(rows)


def read_steps(spark: SparkSession, path: str, steps: list[int] | None = None) -> DataFrame:
    """Feature table stored by ``step_idx``; only the listed partitions are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("step_idx").isin(steps)) if steps else df


def missing_artefacts(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are not there."""
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def require_artefacts(expected: DataFrame, present: DataFrame, keys: list[str]) -> None:
    gone = missing_artefacts(expected, present, keys).orderBy(*keys).limit(20).collect()
    if gone:
        raise FileNotFoundError("missing artefacts: " + ", ".join(str(tuple(r)) for r in gone))
