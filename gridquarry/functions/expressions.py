"""Scalar pieces: integer domains, comparisons, registries, ticks and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.plans.model import Domain

TICKS_PER_SECOND = 125

#: Aggregates by name, and functions that users add.
AGGREGATES: dict[str, Callable[[Column], Column]] = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def register_aggregate(name: str, make: Callable[[Column], Column]) -> None:
    AGGREGATES[name] = make


def aggregate(name: str, column: Column) -> Column:
    if name in AGGREGATES:
        return AGGREGATES[name](column)
    made = getattr(F, name, None)
    if made is None:
        raise ValueError(f"no aggregate {name}")
    return made(column)


def domain(d: Domain) -> Column:
    """The values of a decision variable as rows."""
    return F.explode(F.sequence(F.lit(d.lo).cast("long"), F.lit(d.last).cast("long"), F.lit(d.step).cast("long")))


def pairwise_max(*values: Column) -> Column:
    """The greatest value; null if any is null, for a region without values rejects its window."""
    some = values[0].isNotNull()
    for v in values[1:]:
        some &= v.isNotNull()
    return F.when(some, F.greatest(*values))


def ticks_to_interval(ticks: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ticks / TICKS_PER_SECOND).cast("decimal(18,6)"))


def tick_to_time(start: Column, ticks: Column) -> Column:
    return start + ticks_to_interval(ticks)


def parse_header_time(text: Column) -> Column:
    """Times as recordings' headers give them: with fractions of a second, without, or date and time the other way round."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ("HH:mm:ss.SSS dd/MM/yyyy", "HH:mm:ss dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss")]
    return F.coalesce(*tries)


def tokens(name: str, separators: str = "_") -> list[str]:
    out = [name]
    for s in separators:
        out = [x for part in out for x in part.split(s)]
    return [x for x in out if x]


def to_grid(rows: DataFrame, columns: dict[str, int], shifts: dict[str, int] | None = None) -> DataFrame:
    """Coordinates times a factor, cut to whole numbers, plus a shift."""
    for c, factor in columns.items():
        rows = rows.withColumn(c, (F.col(c).cast("double") * factor).cast("long") + (shifts or {}).get(c, 0))
    return rows
