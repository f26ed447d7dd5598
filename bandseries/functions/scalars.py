"""Column functions: each takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the keys alone, so no repartitioning changes it."""
    parts = [F.lit(str(k)) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def bin_of(t: Column, frac: Column) -> Column:
    """Whole number of steps of 1 / frac below t, by floating remainder (so that 1.0 at steps of 0.1 is bin 9)."""
    width = F.lit(1.0) / frac
    return F.round((t - t % width) / width).cast("long")


def value_and_error(text: Column) -> Column:
    """`value +- error` to a struct; nulls where a part is missing or no number."""
    parts = F.split(text, r"\+-")
    number = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("double")
    return F.struct(number(0).alias("value"), number(1).alias("error"))


def number_with_unit(text: Column, unit: str) -> Column:
    """The number before a unit suffix."""
    return F.trim(F.substring_index(text, unit, 1)).try_cast("double")


def class_name(comment: Column) -> Column:
    """The class in a comment such as `SN Type = Ia , MODEL = X`; null without one."""
    return F.nullif(F.trim(F.regexp_extract(comment, r"SN Type =([^,]*)", 1)), F.lit(""))


def lookup(mapping: dict, key: Column) -> Column:
    """The mapped value, null for an unknown key."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def sentinel_to_null(x: Column, sentinel: float = -999) -> Column:
    return F.nullif(x, F.lit(sentinel))


def scaled(x: Column, norm: float = 1.0) -> Column:
    return x / F.lit(norm)


def one_hot(label: Column, n_classes: int) -> Column:
    """n_classes numbers, 1 at the label; all 0 for a label outside (the width never depends on the data)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def argmax(values: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def predicted(score: Column, threshold: float = 0.5) -> Column:
    return (score >= F.lit(threshold)).cast("int")


def params_text(params: Column, digits: int = 6) -> Column:
    """`name: value, ...` of a map, by name; numbers with a fraction are rounded."""
    shown = lambda v: F.when(v.rlike(r"^-?[0-9]+\.[0-9]+([eE][-+]?[0-9]+)?$"), F.round(v.try_cast("double"), digits).cast("string")).otherwise(v)
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit(": "), shown(e["value"]))), ", ")
