"""Exact aggregates over all windows of a search space.

A cell belongs to the windows whose origin lies in an arithmetic range, so cells are dealt to windows by exploding that
range: no range join, no enumeration of windows without cells, and one pre-aggregated shuffle for each axis. The axes are
taken one after the other (rows, then columns), so a window of area lx * ly costs lx + ly contributions instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.functions import expressions
from gridquarry.plans.model import Axis, Span

PARTS = ("sum", "count", "min", "max")


def present(value: Column) -> Column:
    """A measure as double with NaN as missing."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def origins(axis: Axis, span: Span, at: Column, length: Column) -> Column:
    """The origins of the windows of ``length`` whose span covers coordinate ``at``, as an array."""
    lo, step = axis.origin.lo, axis.origin.step
    last = F.least(F.lit(axis.origin.last).cast("long"), F.lit(axis.end + 1).cast("long") - length)
    start = F.lit(span.a) + length * span.b
    size = F.lit(span.c) + length * span.d
    high = F.least(F.floor((last - lo) / F.lit(step)), F.floor((at - start - lo) / F.lit(step)))
    low = F.greatest(F.lit(0).cast("long"), F.ceil((at - start - size + 1 - lo) / F.lit(step)))
    return F.when((high >= low) & (size > 0), F.transform(F.sequence(low, high), lambda k: F.lit(lo) + k * step)).otherwise(F.array().cast("array<bigint>"))


def _aggregate(measures: Sequence[str], parts: Sequence[str]) -> list[Column]:
    fold = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    return [fold[p](f"{m}_{p}").alias(f"{m}_{p}") for m in measures for p in parts]


def region_parts(cells: DataFrame, axes: Sequence[Axis], spans: Sequence[Span], measures: dict[str, Column], parts: Sequence[str] = PARTS, keys: Sequence[str] = (), keep: Column | None = None) -> DataFrame:
    """For each window with at least one cell in the region: keys, origins, lengths and <measure>_<part> columns.

    ``keep`` is a condition on the window's origins and lengths, applied before the last shuffle. Parts are sum, count,
    min and max of the measure's values that are not missing; a region of missing values has count 0 and null parts.
    """
    seed = {"sum": lambda c: c, "count": lambda c: c.isNotNull().cast("long"), "min": lambda c: c, "max": lambda c: c}
    rows = cells.select(*keys, *[F.col(a.dim).cast("long").alias(a.dim) for a in axes], *[seed[p](present(c)).alias(f"{m}_{p}") for m, c in measures.items() for p in parts])
    for a, s in zip(axes, spans, strict=True):
        lowest = a.origin.lo + min(s.a + s.b * a.length.lo, s.a + s.b * a.length.last)
        highest = a.origin.last + max(s.a + s.b * n + s.c + s.d * n for n in (a.length.lo, a.length.last)) - 1
        rows = rows.where(F.col(a.dim).between(lowest, highest))
    done: list[str] = []
    for k, (axis, span) in enumerate(zip(axes, spans, strict=True)):
        lengths = F.sequence(*[F.lit(n).cast("long") for n in (axis.length.lo, axis.length.last, axis.length.step)])
        rows = rows.withColumnRenamed(axis.dim, "_at").withColumn(axis.length_col, F.explode(lengths))
        rows = rows.withColumn(axis.dim, F.explode(origins(axis, span, F.col("_at"), F.col(axis.length_col)))).drop("_at")
        done += [axis.dim, axis.length_col]
        last = k == len(axes) - 1
        if last and keep is not None:
            rows = rows.where(keep)
        rows = rows.groupBy(*keys, *done, *[a.dim for a in axes[k + 1 :]]).agg(*_aggregate(list(measures), parts))
    return rows


def region_aggregates(cells: DataFrame, axes: Sequence[Axis], measures: dict[str, Column], wanted: Sequence[str], keys: Sequence[str] = (), keep: Column | None = None) -> DataFrame:
    """The named aggregates of every window, as <measure>_<name>; windows without values are left out.

    avg, sum, min, max and count are put together from parts. With any other aggregate that the registry or Spark knows
    the cells of each window meet in one group, which works without ``keys`` only.
    """
    if set(wanted) - {"avg", *PARTS}:
        if keys:
            raise ValueError("aggregates that cannot be put together from parts take no keys")
        windows = enumerate_windows(cells.sparkSession, axes, F.lit(True) if keep is None else keep)
        full = by_equi_join(cells, windows, axes, measures, list(dict.fromkeys([*wanted, "count"])))
        filled = F.lit(False)
        for m in measures:
            filled |= F.col(f"{m}_count") > 0
        return full.where(filled).select(*windows.columns, *[f"{m}_{w}" for m in measures for w in wanted])
    parts = [p for p in PARTS if p in wanted or p == "count" or (p == "sum" and "avg" in wanted)]
    found = region_parts(cells, axes, [Span()] * len(axes), measures, parts, keys, keep)
    some = F.lit(False)
    for m in measures:
        some |= F.col(f"{m}_count") > 0
    named = [(F.col(f"{m}_sum") / F.when(F.col(f"{m}_count") > 0, F.col(f"{m}_count")) if w == "avg" else F.col(f"{m}_{w}")).alias(f"{m}_{w}") for m in measures for w in wanted]
    return found.where(some).select(*keys, *[c for a in axes for c in (a.dim, a.length_col)], *named)


def by_equi_join(cells: DataFrame, windows: DataFrame, axes: Sequence[Axis], measures: dict[str, Column], wanted: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The same over an explicit table of windows: each window is exploded into its cells for an equi-join."""
    rows = windows
    for a in axes:
        rows = rows.withColumn(f"_{a.dim}", F.explode(F.sequence(F.col(a.dim), F.col(a.dim) + F.col(a.length_col) - 1)))
    data = cells.select(*keys, *[F.col(a.dim).alias(f"_{a.dim}") for a in axes], *[present(c).alias(f"_{m}") for m, c in measures.items()])
    joined = rows.join(data, [*keys, *[f"_{a.dim}" for a in axes]])
    return joined.groupBy(*windows.columns).agg(*[expressions.aggregate(w, F.col(f"_{m}")).alias(f"{m}_{w}") for m in measures for w in wanted])


def enumerate_windows(spark, axes: Sequence[Axis], keep: Column | None = None) -> DataFrame:
    """Every window of the search space, cells or none; generated on the executors along the first axis."""
    out = None
    for a in axes:
        one = spark.range(len(a.origin.values())).select((F.col("id") * a.origin.step + a.origin.lo).alias(a.dim))
        one = one.withColumn(a.length_col, F.explode(F.array(*[F.lit(n).cast("long") for n in a.length.values()]))).where(F.col(a.dim) + F.col(a.length_col) <= a.end + 1)
        # The second factor is a generator whose size the configuration states.
        out = one if out is None else out.join(F.broadcast(one)) if len(a.origin.values()) * len(a.length.values()) <= 100_000 else out.crossJoin(one)
    return out if keep is None else out.where(keep)


def by_prefix_sums(cells: DataFrame, axes: Sequence[Axis], measure: Column, keep: Column | None = None) -> DataFrame:
    """sum and count of every window from a summed-area table: four lookups, whatever the area. Two dimensions, whole numbers.

    The table is made by running sums along rows and then columns of the occupied bounding box, padded by one.
    """
    from pyspark.sql import Window as W

    ax, ay = axes
    data = cells.select(F.col(ax.dim).cast("long").alias("x"), F.col(ay.dim).cast("long").alias("y"), present(measure).alias("v")).where(F.col("x").between(ax.origin.lo, ax.end) & F.col("y").between(ay.origin.lo, ay.end))
    spark = cells.sparkSession
    dense = spark.range(ax.origin.lo - 1, ax.end + 1).select(F.col("id").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(ay.origin.lo - 1).cast("long"), F.lit(ay.end).cast("long"))))
    one = data.groupBy("x", "y").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    full = dense.join(one, ["x", "y"], "left").fillna(0, ["s", "n"])
    along = W.partitionBy("x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    table = full.select("x", "y", F.sum("s").over(along).alias("s"), F.sum("n").over(along).alias("n"))
    table = table.select("x", "y", F.sum("s").over(down).alias("s"), F.sum("n").over(down).alias("n"))
    windows = enumerate_windows(spark, axes, keep)
    corners = F.array(*[F.struct((F.col(ax.dim) - 1 + (F.col(ax.length_col) if i else F.lit(0))).alias("x"), (F.col(ay.dim) - 1 + (F.col(ay.length_col) if j else F.lit(0))).alias("y"), F.lit(1 if i == j else -1).alias("sign")) for i in (0, 1) for j in (0, 1)])
    asked = windows.withColumn("k", F.explode(corners)).select(*windows.columns, F.col("k.x").alias("cx"), F.col("k.y").alias("cy"), F.col("k.sign").alias("sign"))
    found = asked.join(table.withColumnRenamed("x", "cx").withColumnRenamed("y", "cy"), ["cx", "cy"])
    return found.groupBy(*windows.columns).agg(F.sum(F.col("sign") * F.col("s")).alias("sum"), F.sum(F.col("sign") * F.col("n")).alias("count")).where("count > 0")
