"""Operators on the long table ``(entity, grp, unit, step, step_idx, metric, value)``.

The long form is the canonical one: a merge of many project tables is a union and one
aggregation, and no plan grows with the number of columns. Wide tables are made at sinks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import names
from cohortlens.session import joined, small_side, with_row

KEYS = ["entity", "grp"]
LONG = ["entity", "grp", "unit", "step", "step_idx", "metric", "value"]


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep, for each key, the row that comes first in ``order``.

    An aggregate, not a ranking window: each task reduces its rows of a key to one before
    the shuffle, so a key that holds much of the table costs no more than the others.
    Null keys are keys like any other.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*lead)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep, for each key, the row that comes last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def wide_to_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unpivot every non-key column to ``(keys, name, value)``; NULL cells stay."""
    values = [c for c in df.columns if c not in keys]
    quoted = [F.col(f"`{c}`").cast("double").alias(c) for c in values]
    return df.select(*keys, *quoted).unpivot(keys, values, "name", "value")


def parse_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``unit``, ``step`` and ``metric`` parsed from a column name."""
    col = F.col(name)
    return df.withColumns(
        {
            "unit": names.name_unit(col),
            "step": names.name_step(col),
            "metric": names.name_metric(col),
        }
    )


def long_to_wide(long: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per key with one column per listed name (the N-way outer merge).

    Pass the list: finding it would be a job of its own. Null keys meet each other, as
    they do in the merge this stands for.
    """
    keys = keys or KEYS
    named = long.withColumn(
        "_name", names.wide_name(F.col("unit"), F.col("step"), F.col("metric"))
    )
    return named.groupBy(*keys).pivot("_name", columns).agg(F.max("value"))


def column_list(long: DataFrame) -> list[str]:
    """Ordered list of wide column names; a schema, so it is small enough to fetch."""
    cols = long.groupBy("unit", "step", "metric").agg(F.min("step_idx").alias("i"))
    rows = cols.orderBy("i", "unit", "step", "metric").collect()
    return [f"{r.unit}_{r.step}_{r.metric}" for r in rows]


def outer_merge(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of two or three wide tables on keys that may be NULL."""

    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
        seen = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
        lcols = [F.col(f"a.`{c}`") for c in left.columns if c not in keys]
        rcols = [F.col(f"b.`{c}`") for c in right.columns if c not in keys]
        return a.join(b, on, "full").select(*seen, *lcols, *rcols)

    return reduce(merge, tables)


def stack_tables(tables: list[DataFrame]) -> DataFrame:
    """Vertical concat; a column some table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def stack_common(tables: list[DataFrame]) -> DataFrame:
    """Vertical concat on the columns all tables share, in the first table's order."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    return reduce(lambda a, b: a.unionByName(b), [t.select(*common) for t in tables])


def common_metrics(years: list[DataFrame]) -> DataFrame:
    """Long form of the same: rows whose (unit, step, metric) occurs in every table."""
    cols = ["unit", "step", "metric"]
    tagged = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(years)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    shared = (
        rows.groupBy(*cols)
        .agg(F.count_distinct("_table").alias("n"))
        .where(F.col("n") == len(years))
        .select(*cols)
    )
    return rows.join(small_side(shared), cols, "left_semi").drop("_table")


def schema_rows(df: DataFrame) -> DataFrame:
    """The column names of a table as rows."""
    spark = df.sparkSession
    return spark.createDataFrame([(c,) for c in df.columns], "name string")


def merge_expected(long: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the expected steps, with their index, and the expected steps not found."""
    keys = ["unit", "step"]
    bare = long.drop("step_idx")
    found = bare.join(small_side(steps), keys, "inner")
    missing = steps.join(bare.select(*keys).distinct(), keys, "left_anti").orderBy("step_idx")
    return found, missing


def fill_group(df: DataFrame, derived: Column, column: str = "city") -> DataFrame:
    """Add the group column after ``email``, or fill its NULLs if it is there."""
    if column in df.columns:
        return df.withColumn(column, F.coalesce(F.col(column), derived))
    order = list(df.columns)
    at = order.index("email") + 1 if "email" in order else len(order)
    return df.withColumn(column, derived).select(*order[:at], column, *order[at:])


def null_counts(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per entity, how many of the table's columns have no value."""
    keys = keys or KEYS
    width = long.select("unit", "step", "metric").distinct().agg(F.count("*").alias("_width"))
    filled = long.groupBy(*keys).agg(F.count("value").alias("_filled"))
    return with_row(filled, width).select(
        *keys, (F.col("_width") - F.col("_filled")).alias("n_null")
    )


def keep_filled(long: DataFrame, max_nulls: int | None) -> DataFrame:
    """Rows of entities with fewer than ``max_nulls`` missing values; all for None."""
    if max_nulls is None:
        return long
    kept = null_counts(long).where(F.col("n_null") < max_nulls)
    k = KEYS
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in k])
    return long.alias("a").join(kept.alias("b"), on, "left_semi")


def null_count_row(columns: list[str]) -> Column:
    """Null count over the columns of a wide row; an array, since a nested sum of some
    hundred terms is too deep for the expression compiler."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    return F.size(F.filter(cells, lambda x: x.isNull()))


def mark_means(long: DataFrame) -> DataFrame:
    """Mean of every mark column over its non-null values."""
    marks = long.where(names.is_mark(F.col("metric")))
    return marks.groupBy("unit", "step", "metric").agg(F.avg("value").alias("_mean"))


def normalise_marks(long: DataFrame) -> DataFrame:
    """Divide each mark by the mean of its column; other metrics pass through.

    The means (one per mark column) go to the rows, the rows are not moved: grouping the
    rows by column would leave one task per column.
    """
    keys = ["unit", "step", "metric"]
    found = joined(long, small_side(mark_means(long)), keys, "left")
    scaled = F.when(
        names.is_mark(F.col("metric")), F.try_divide(F.col("value"), F.col("_mean"))
    ).otherwise(F.col("value"))
    return found.withColumn("value", scaled).select(*long.columns)


def select_pool(long: DataFrame, unit: str) -> DataFrame:
    """Clustering features: the pool unit without raw task results, NULL as 0."""
    name = names.wide_name(F.col("unit"), F.col("step"), F.col("metric"))
    return long.where(
        F.startswith(name, F.lit(unit)) & ~name.rlike(names.raw_task_pattern(unit))
    ).withColumn("value", F.coalesce(F.col("value"), F.lit(0.0)))


def select_success(long: DataFrame, unit: str) -> DataFrame:
    """The pool's ``Success of task`` results."""
    name = names.wide_name(F.col("unit"), F.col("step"), F.col("metric"))
    return long.where(name.rlike(names.success_pattern(unit)))


#: What names a column of the wide table.
COLUMN = ["unit", "step", "metric"]


def column_places(long: DataFrame) -> DataFrame:
    """``(unit, step, metric, pos)``: the columns of a selection in the order of the wide table.
    They are a schema, so one row may hold them all."""
    listed = long.groupBy(*COLUMN).agg(F.min("step_idx").alias("i"))
    ordered = F.sort_array(F.collect_list(F.struct("i", *COLUMN)))
    spread = listed.agg(ordered.alias("c")).select(F.posexplode("c").alias("pos", "c"))
    return spread.select(*[F.col(f"c.{c}").alias(c) for c in COLUMN], "pos")


def assemble(long: DataFrame, places: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One array ``name`` per key with the values at the places of their columns, 0 elsewhere.

    Columns that have no place are left out, of repeated cells the largest value counts. The
    rows move once, by key; the places go to them.
    """
    width = places.agg(F.count("*").alias("_width"))
    cells = joined(long, small_side(places), COLUMN).repartition(*keys)
    single = cells.groupBy(*keys, "pos").agg(F.max("value").cast("double").alias("value"))
    packed = single.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("_cells"))
    every = F.sequence(F.lit(0), F.col("_width").cast("int") - 1)
    value = F.transform(every, lambda i: F.coalesce(F.try_element_at(F.col("_cells"), i), F.lit(0.0)))
    return with_row(packed, width).select(*keys, value.alias(name))


def with_vectors(rows: DataFrame, vectors: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``rows`` with the array ``name`` of their key; zeros where a key has none."""
    width = vectors.agg(F.coalesce(F.max(F.size(name)), F.lit(0)).alias("_width"))
    found = with_row(joined(rows, vectors, keys, "left"), width)
    zeros = F.array_repeat(F.lit(0.0), F.col("_width"))
    return found.withColumn(name, F.coalesce(F.col(name), zeros)).drop("_width")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def select_names(df: DataFrame, prefixes: list[str], keep: list[str]) -> DataFrame:
    """Wide table: columns with one of the prefixes (all if none) or in ``keep``."""
    chosen = [
        c for c in df.columns if not prefixes or c in keep or any(c.startswith(p) for p in prefixes)
    ]
    return df.select(*[F.col(f"`{c}`") for c in chosen])


def to_bit(value: Column) -> Column:
    """NULL and 0 to 0, anything else to 1."""
    return (F.coalesce(value, F.lit(0.0)) != 0).cast("int")


def restore_marks(scored: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Wide tables: replace the mark columns of ``scored`` by those of ``raw``."""
    marks = [c for c in raw.columns if c.endswith(names.MARK_SUFFIX)]
    bare = scored.drop(*[c for c in scored.columns if c in marks])
    return joined(bare, raw.select(*keys, *[F.col(f"`{c}`") for c in marks]), keys, "left")


def densify(
    df: DataFrame, keys: list[str], n_steps: int, values: list[str], step: str = "step_idx"
) -> DataFrame:
    """Every entity at every step ``0 .. n_steps-1``, absent values as 0.

    ``df`` has one row per (keys, step). One shuffle by key; the grid is generated per
    entity from its own steps, so there is no join with the list of steps, and windows by
    the same key need no further shuffle.
    """
    cells = F.map_from_entries(F.collect_list(F.struct(F.col(step), F.struct(*values))))
    packed = df.groupBy(*keys).agg(cells.alias("_cells"))
    grid = packed.select(
        *keys, "_cells", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias(step)
    )
    cell = F.try_element_at(F.col("_cells"), F.col(step))
    out = []
    for v in values:
        kind = df.schema[v].dataType
        out.append(F.coalesce(cell[v], F.lit(0).cast(kind)).alias(v))
    return grid.select(*keys, step, *out)


def step_axis(steps: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """Rows of the step table for an ordered list of (unit, step)."""
    return [(unit, step, i) for i, (unit, step) in enumerate(steps)]


def entity_window(step: str = "step_idx", keys: list[str] | None = None):
    return Window.partitionBy(*(keys or ["entity"])).orderBy(step)
