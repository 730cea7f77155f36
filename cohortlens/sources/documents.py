"""Nested result documents and activity listings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import names, text
from cohortlens.operators.frames import first_by
from cohortlens.session import small_side

RESULT_SCHEMA = """results array<struct<
  mark: double, virtualMark: double, prerequisitesMark: double,
  properties: struct<`group`: struct<members: array<string>>>,
  skillBreakdowns: map<string, array<struct<passed: double>>>,
  style: struct<CodingStyleSummary: struct<summary: struct<
      value: struct<fatal: double, major: double, minor: double, info: double>,
      penalty: struct<Penalty: struct<value: double>>>>>>>"""

LISTING_SCHEMA = """activities array<struct<id: bigint, unitTemplate: struct<code: string>,
  projectTemplate: struct<slug: string>, instance: struct<instanceCode: string>>>,
  hasNextPage boolean"""

BAD = "_corrupt"


def read_documents(
    spark: SparkSession, path: str, pattern: str = "*.json", schema: str = RESULT_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """All documents below a folder (or one file) with their ``path``, and the unreadable ones."""
    raw = (
        spark.read.schema(f"{schema}, {BAD} string")
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    # A document without its list holds no rows.
    good = raw.where(F.col(BAD).isNull() & F.col(raw.columns[0]).isNotNull()).drop(BAD)
    # Spark wants a data column next to the record of the failure.
    partly = F.col(raw.columns[0]).isNotNull().alias("partly_read")
    return good, raw.where(F.col(BAD).isNotNull()).select("path", BAD, partly)


def _metrics(result: Column, vocab: Column) -> Column:
    """All metrics of one result as an array of ``(metric, value)``.

    The tasks are those of the whole document: one this result lacks counts 0.
    """
    scores = result["skillBreakdowns"]

    def task(name: Column) -> Column:
        first = F.try_element_at(F.try_element_at(scores, name), F.lit(1))["passed"]
        return F.struct(
            F.concat(name, F.lit("_passed")).alias("metric"),
            F.coalesce(first, F.lit(0.0)).alias("value"),
        )

    summary = result["style"]["CodingStyleSummary"]["summary"]
    fixed = [(m, result[m]) for m in names.MARK_METRICS]
    fixed.append(("stylePenalty", summary["penalty"]["Penalty"]["value"]))
    fixed += [
        (f"style{c.capitalize()}", summary["value"][c]) for c in ("fatal", "major", "minor", "info")
    ]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in fixed])
    packed = "array<struct<metric:string,value:double>>"
    return F.concat(F.transform(vocab, task).cast(packed), cells.cast(packed))


def document_records(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per student of each result, metrics still packed: ``(entity, grp, unit,
    step, path, result_pos, member_pos, cells)`` and the columns to ``keep``.

    Everything is done inside a document's row, so nothing is shuffled. A document without
    any task and a result without members give no row.
    """
    stem = text.file_stem(F.col("path"))
    keys = F.transform(
        F.col("results"), lambda r: F.coalesce(F.map_keys(r["skillBreakdowns"]), F.array())
    )
    vocab = F.sort_array(F.array_distinct(F.flatten(keys)))
    prefix = text.project_prefix(stem)
    keep = keep or []
    per_doc = docs.select(
        *keep,
        "path",
        vocab.alias("vocab"),
        "results",
        text.city_token(stem).alias("grp"),
        F.substring_index(prefix, "_", 1).alias("unit"),
        F.regexp_replace(prefix, "^[^_]*_?", "").alias("step"),
    ).where(F.size("vocab") > 0)
    per_result = per_doc.select(
        *keep, "path", "grp", "unit", "step", "vocab", F.posexplode("results").alias("result_pos", "r")
    )
    cells = _metrics(F.col("r"), F.col("vocab"))
    return per_result.select(
        *keep, "path", "grp", "unit", "step", "result_pos", cells.alias("cells"),
        F.posexplode(F.col("r.properties.group.members")).alias("member_pos", "entity"),
    )


def project_table(records: DataFrame) -> DataFrame:
    """Long rows of the first record of each student, site and project."""
    keys = ["entity", "grp", "unit", "step"]
    kept = first_by(records, keys, ["path", "result_pos", "member_pos"])
    return kept.select(*keys, F.inline("cells"))


def zero_fill(
    got: DataFrame, file: str, members: list[str], task: str, value: str
) -> DataFrame:
    """Every member of a file with every task of that file, 0 where there is no value.

    For tables that come one row per (file, member, task). The vocabulary of a file is a
    short list; members look up their own tasks in it.
    """
    vocab = got.groupBy(file).agg(F.collect_set(task).alias("_tasks"))
    own = got.groupBy(file, *members).agg(
        F.map_from_entries(F.collect_list(F.struct(task, value))).alias("_own")
    )
    filled = own.join(small_side(vocab), file).select(
        file, *members, "_own", F.explode("_tasks").alias(task)
    )
    found = F.try_element_at(F.col("_own"), F.col(task))
    return filled.select(file, *members, task, F.coalesce(found, F.lit(0)).alias(value))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing pages."""
    return spark.read.schema(LISTING_SCHEMA).option("multiLine", True).option(
        "recursiveFileLookup", True
    ).json(path)


def flatten_listing(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per activity: ``(id, code, slug, instance)``."""
    one = pages.select(*(keep or []), F.explode("activities").alias("a"))
    return one.select(
        *(keep or []),
        F.col("a.id").alias("id"),
        F.col("a.unitTemplate.code").alias("code"),
        F.col("a.projectTemplate.slug").alias("slug"),
        F.col("a.instance.instanceCode").alias("instance"),
    )


def with_target(listing: DataFrame) -> DataFrame:
    """Add the safe name an activity's document is stored under."""
    return listing.withColumn(
        "target", text.target_name(F.col("code"), F.col("slug"), F.col("instance"))
    )


def filter_listing(
    listing: DataFrame, year: int, source: str, units: list[str], columns: dict[str, str] | None = None
) -> DataFrame:
    """Activities of a year, source and list of units (partition columns prune the scan)."""
    c = {"year": "year", "source": "source", "unit": "unit", **(columns or {})}
    return listing.where(
        (F.col(c["year"]) == year) & (F.col(c["source"]) == source) & F.col(c["unit"]).isin(units)
    )
