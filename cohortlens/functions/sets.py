"""Prediction sets over the classes 0 and 1, held as two boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The integer codes of a set and of a gate decision.
CODE_EMPTY, CODE_ZERO, CODE_ONE, CODE_BOTH = -1, 0, 1, 2
GATE_CONFORMAL, GATE_INTERVAL, GATE_UNION = 0, 1, 2
GATE_NAMES = {0: "MCP", 1: "SPCI", 2: "UNION"}


def width(has0: Column, has1: Column) -> Column:
    return has0.cast("int") + has1.cast("int")


def holds(has0: Column, has1: Column, y: Column) -> Column:
    """Is the true class in the set?"""
    return F.when(y == 1, has1).otherwise(has0)


def is_singleton(has0: Column, has1: Column) -> Column:
    return width(has0, has1) == 1


def code(has0: Column, has1: Column) -> Column:
    return (
        F.when(has0 & has1, F.lit(CODE_BOTH))
        .when(has1, F.lit(CODE_ONE))
        .when(has0, F.lit(CODE_ZERO))
        .otherwise(F.lit(CODE_EMPTY))
    )


def point(has0: Column, has1: Column) -> Column:
    """The class of a singleton, -1 for every other set."""
    return F.when(is_singleton(has0, has1), has1.cast("int")).otherwise(F.lit(-1))


def text(has0: Column, has1: Column) -> Column:
    return (
        F.when(has0 & has1, F.lit("{0,1}"))
        .when(has0, F.lit("{0}"))
        .when(has1, F.lit("{1}"))
        .otherwise(F.lit("∅"))
    )


def gate_name(choice: Column) -> Column:
    named = F.lit(None).cast("string")
    for key, name in GATE_NAMES.items():
        named = F.when(choice == key, F.lit(name)).otherwise(named)
    return F.coalesce(named, choice.cast("string"))


def from_labels(labels: Column) -> tuple[Column, Column]:
    """An array of class labels as ``(has0, has1)``."""
    return F.array_contains(labels, 0), F.array_contains(labels, 1)


def from_interval(lo: Column, hi: Column, threshold: Column) -> tuple[Column, Column]:
    """Wholly below the threshold is {1}, wholly above is {0}, else both (strict)."""
    below, above = threshold > hi, threshold < lo
    return above | ~below, below | ~above


def gate_label(ok_cp: Column, ok_iv: Column, w_cp: Column, w_iv: Column) -> Column:
    """Which of the two sets to trust; equal widths favour the interval."""
    return (
        F.when(ok_cp & ~ok_iv, F.lit(GATE_CONFORMAL))
        .when(ok_iv & ~ok_cp, F.lit(GATE_INTERVAL))
        .when(ok_cp & ok_iv & (w_cp < w_iv), F.lit(GATE_CONFORMAL))
        .when(ok_cp & ok_iv, F.lit(GATE_INTERVAL))
        .otherwise(F.lit(GATE_UNION))
    )


def gated(choice: Column, cp: Column, iv: Column) -> Column:
    """One membership flag of the combined set."""
    return (
        F.when(choice == GATE_CONFORMAL, cp).when(choice == GATE_INTERVAL, iv).otherwise(cp | iv)
    )
