"""The column-name grammar ``<unit>_<step>_<metric>`` and selections by name."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit codes by year, role suffixes and the file's own metric names.
FIRST_YEAR_OF_NEW_CODE = 2025
NEW_POOL_CODE = "G-CPE-100"
OLD_POOL_CODE = "B-CPE-100"
MARK_SUFFIX = "mark"
TEST_SUFFIX = "passed"
NEXT_MARK = "next_grade"
STYLE_METRICS = ["stylePenalty", "styleFatal", "styleMajor", "styleMinor", "styleInfo"]
MARK_METRICS = ["mark", "virtualMark", "prerequisitesMark"]


def pool_code(year: Column | int) -> Column | str:
    """Unit code of the first project pool in ``year``."""
    if isinstance(year, int):
        return NEW_POOL_CODE if year >= FIRST_YEAR_OF_NEW_CODE else OLD_POOL_CODE
    return F.when(year >= FIRST_YEAR_OF_NEW_CODE, F.lit(NEW_POOL_CODE)).otherwise(
        F.lit(OLD_POOL_CODE)
    )


def short_year(year: Column | int) -> Column | int:
    return year % 100 if isinstance(year, int) else F.pmod(year, F.lit(100))


def wide_name(unit: Column, step: Column, metric: Column) -> Column:
    return F.concat_ws("_", unit, step, metric)


def name_unit(name: Column) -> Column:
    return F.get(F.split(name, "_"), F.lit(0))


def name_step(name: Column) -> Column:
    return F.get(F.split(name, "_"), F.lit(1))


def name_metric(name: Column) -> Column:
    """Everything after the second ``_`` (metric names may hold ``_`` themselves)."""
    return F.regexp_extract(name, r"^[^_]*_[^_]*_(.*)$", 1)


def is_mark(name: Column) -> Column:
    """Case-sensitive, so ``virtualMark`` is not a mark."""
    return F.endswith(name, F.lit(MARK_SUFFIX))


def is_test(name: Column) -> Column:
    return F.endswith(name, F.lit(TEST_SUFFIX))


def starts_with_any(name: Column, prefixes: list[str]) -> Column:
    """True if one of the prefixes matches; no prefix at all selects everything."""
    if not prefixes:
        return F.lit(True)
    return reduce(or_, [F.startswith(name, F.lit(p)) for p in prefixes])


def raw_task_pattern(unit: str) -> str:
    """Raw task results of the pool (the ones a ``Success of`` result repeats)."""
    return "^" + re.escape(unit) + r"_cpoolday\d+_\d{2} - task\d+_passed"


def success_pattern(unit: str) -> str:
    """``Success of task…`` results of the pool, whole name, any case."""
    return "(?i)^" + re.escape(unit) + r"_cpoolday\d+_\d+\s+-\s+Success of task\d+_passed$"
