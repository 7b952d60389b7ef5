"""Functions that expressions of the language may call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that go to the built-in of the same name.
BUILT_IN = frozenset(
    """abs ceil floor round sqrt pow exp ln log10 sign greatest least coalesce nullif lower upper length trim ltrim rtrim
    concat substr replace split reverse levenshtein soundex startswith endswith contains instr lpad rpad repeat translate
    year month day hour minute second date_trunc datediff to_date unix_timestamp sha2 md5 xxhash64 size array_contains
    element_at sort_array map_keys map_values get_json_object isnull isnotnull if""".split()
)


def aggregate(name: str, args: list[Column], value: Callable[[int], float]) -> Column:
    """An aggregate over compiled arguments; value(i) is the literal value of argument i."""
    one = args[0] if args else None
    if name == "count":
        return F.count("*") if one is None else F.count(one)
    if one is None:
        raise ValueError(f"{name} takes an argument")
    if name == "percentile":
        return F.percentile(one, F.lit(value(1) / 100.0))
    found = {
        "sum": F.try_sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct,
        "approx_distinct": F.approx_count_distinct, "stddev": F.stddev_samp, "variance": F.var_samp, "median": F.median,
        "collect": F.collect_list, "any": F.any_value,
    }.get(name)
    if found is None:
        raise ValueError(f"no aggregate is called {name}")
    return found(one)
