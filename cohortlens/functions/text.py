"""String functions: tokens of file names, addresses, links and option lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a file name may keep, and the name given to an empty one.
UNSAFE_RUN = r"[^A-Za-z0-9._-]+"
EMPTY_NAME = "unknown"
NULL_NAME = "None"

# Fixed value: what counts as a number when a text column is coerced.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def file_stem(path: Column) -> Column:
    """Last path component without its extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def project_prefix(stem: Column) -> Column:
    """The stem up to its last ``_``; the whole stem if there is none."""
    return F.regexp_replace(stem, "_[^_]*$", "")


def city_token(stem: Column) -> Column:
    """``UNIT_project_TSE-3-2`` gives ``TSE``; a stem without ``_`` gives ``''``."""
    site = F.substring_index(F.substring_index(stem, "_", -1), "-", 1)
    return F.when(F.contains(stem, F.lit("_")), F.upper(F.trim(site))).otherwise(F.lit(""))


def sanitize(text: Column) -> Column:
    """A safe file-name part: each run of other characters becomes one ``_``."""
    safe = F.regexp_replace(F.coalesce(text.cast("string"), F.lit(NULL_NAME)), UNSAFE_RUN, "_")
    return F.when(safe == "", F.lit(EMPTY_NAME)).otherwise(safe)


def target_name(code: Column, slug: Column, instance: Column) -> Column:
    """``code_slug_instance`` of sanitised parts."""
    return F.concat_ws("_", sanitize(code), sanitize(slug), sanitize(instance))


def share_id(url: Column) -> Column:
    """The file id of a sharing link (path form first, then ``id=``), NULL if it has none."""
    in_path = F.split_part(F.split_part(url, F.lit("/file/d/"), F.lit(2)), F.lit("/"), F.lit(1))
    in_query = F.split_part(F.split_part(url, F.lit("id="), F.lit(2)), F.lit("&"), F.lit(1))
    return F.when(F.contains(url, F.lit("/file/d/")), in_path).when(
        F.contains(url, F.lit("id=")), in_query
    )


def name_token(address: Column) -> Column:
    """Second dot token of an address, up to the ``@``; NULL if there is no second token."""
    return F.get(F.split(F.get(F.split(address, r"\."), F.lit(1)), "@"), F.lit(0))


def option_list(text: Column) -> Column:
    """Comma-separated options as an array, trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def suffix_int(stem: Column) -> Column:
    """The integer after the last ``_``, NULL if it is not one."""
    return F.substring_index(stem, "_", -1).try_cast("int")


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    bare = F.trim(text.cast("string"))
    ok = bare.rlike(NUMBER) | bare.rlike(INFINITE)
    return F.when(ok, bare.try_cast("double"))
