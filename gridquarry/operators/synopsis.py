"""Aggregate synopses: block min, max, sum and count, and sound intervals of window aggregates from them.

A block of volume V with c values has V - c empty cells; a window that covers p of its cells holds at least
m = max(0, p - (V - c)) and at most M = min(c, p) of its values. Fully covered blocks are exact.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.operators.arrays import regrid
from gridquarry.operators.regions import present
from gridquarry.plans.model import ArrayMeta, Axis


@dataclass
class Synopsis:
    """Blocks (dims…, min, max, sum, count) of ``sizes`` cells, from the array's origin."""

    name: str
    blocks: DataFrame
    dims: tuple[str, ...]
    origin: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def volume(self) -> int:
        return int(np.prod(self.sizes))


def synopsis_name(array: str, attr: str, sizes: Sequence[int]) -> str:
    return f"{array}_{attr}_{'x'.join(map(str, sizes))}"


def parse_synopsis_name(name: str) -> dict:
    """Array, attribute and block sizes of an aggregate synopsis; kind, window length and features as well for a sequence synopsis."""
    m = re.fullmatch(r"(?:(dft|paa)_(\d+)_)?(.+)_([^_]+)_(\d+(?:[xX]\d+)*)", name)
    if not m:
        raise ValueError(f"not the name of a synopsis: {name}")
    kind, window, array, attr, sizes = m.groups()
    out = {"kind": kind or "aggregate", "array": array, "attr": attr, "sizes": tuple(int(x) for x in re.split("[xX]", sizes))}
    return out | ({"window": int(window)} if window else {})


def build_synopsis(cells: DataFrame, meta: ArrayMeta, attr: str, sizes: Sequence[int], box: dict[str, tuple[int, int]] | None = None) -> Synopsis:
    """Block aggregates of an attribute; a region must lie on the grid. Missing values (null, NaN) count as empty cells."""
    for d, size in zip(meta.dims, sizes, strict=True):
        lo, hi = (box or {}).get(d.name, (d.lo, d.hi))
        if (lo - d.lo) % size or ((hi - d.lo + 1) % size and hi != d.hi):
            raise ValueError(f"{d.name} {lo}..{hi} does not lie on a grid of {size}")
    rows = cells if box is None else cells.where(" and ".join(f"{d} between {lo} and {hi}" for d, (lo, hi) in box.items()))
    rows = rows.select(*[d.name for d in meta.dims], present(F.col(attr)).alias("_v")).where("_v is not null")
    blocks = regrid(rows, {d.name: (d.lo, s) for d, s in zip(meta.dims, sizes, strict=True)}, {"min": F.min("_v"), "max": F.max("_v"), "sum": F.sum("_v"), "count": F.count("_v")})
    return Synopsis(synopsis_name(meta.name, attr, sizes), blocks, tuple(d.name for d in meta.dims), tuple(d.lo for d in meta.dims), tuple(sizes))


def load_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks as read: NaN anywhere, a missing count or a count of 0 make a block empty, and empty blocks are left out."""
    bad = F.col("count").isNull() | (F.col("count") <= 0)
    for c in ("min", "max", "sum"):
        bad |= F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return blocks.where(~bad)


def region_cost(axes: Sequence[Axis], synopsis: Synopsis) -> Column:
    """Blocks that a window touches."""
    out = F.lit(1)
    for a, o, s in zip(axes, synopsis.origin, synopsis.sizes, strict=True):
        out = out * (F.floor((F.col(a.dim) + F.col(a.length_col) - 1 - o) / s) - F.floor((F.col(a.dim) - o) / s) + 1)
    return out


def aligned(axes: Sequence[Axis], synopsis: Synopsis) -> bool:
    """Whether every window of a search space consists of whole blocks, decided from the space alone."""
    return all((a.origin.lo - o) % s == 0 and a.origin.step % s == 0 and a.length.lo % s == 0 and (a.length.step % s == 0 or a.length.lo == a.length.last) for a, o, s in zip(axes, synopsis.origin, synopsis.sizes, strict=True))


def choose_synopsis(axes: Sequence[Axis], synopses: Sequence[Synopsis]) -> Synopsis | None:
    """The coarsest synopsis from which all windows of the space are answered exactly."""
    return max((s for s in synopses if aligned(axes, s)), key=lambda s: s.volume, default=None)


def from_aligned(axes: Sequence[Axis], synopsis: Synopsis, keep: Column | None = None) -> DataFrame:
    """Exact sum, count, min and max of aligned windows from blocks instead of cells."""
    from gridquarry.operators.regions import PARTS, origins
    from gridquarry.plans.model import Span

    rows = synopsis.blocks.select(*[(F.col(d) * s + o).alias(d) for d, o, s in zip(synopsis.dims, synopsis.origin, synopsis.sizes, strict=True)], *PARTS)
    done: list[str] = []
    for k, a in enumerate(axes):
        lengths = F.array(*[F.lit(n).cast("long") for n in a.length.values()])
        rows = rows.withColumnRenamed(a.dim, "_at").withColumn(a.length_col, F.explode(lengths)).withColumn(a.dim, F.explode(origins(a, Span(), F.col("_at"), F.col(a.length_col)))).drop("_at")
        done += [a.dim, a.length_col]
        if k == len(axes) - 1 and keep is not None:
            rows = rows.where(keep)
        rows = rows.groupBy(*done, *[x.dim for x in axes[k + 1 :]]).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))
    return rows


def parts(windows: DataFrame, axes: Sequence[Axis], synopsis: Synopsis) -> DataFrame:
    """One row for each window and block it touches that holds values: lo, hi, s, c, part, m, most, full, and the covered box."""
    rows = windows
    part = F.lit(1).cast("long")
    for a, o, s in zip(axes, synopsis.origin, synopsis.sizes, strict=True):
        first, last = F.col(a.dim), F.col(a.dim) + F.col(a.length_col) - 1
        low = F.greatest(F.floor((first - o) / s), F.lit(0).cast("long"))
        rows = rows.withColumn(f"_b_{a.dim}", F.explode(F.sequence(low, F.floor((last - o) / s))))
        left = F.greatest(first, F.col(f"_b_{a.dim}") * s + o)
        right = F.least(last, (F.col(f"_b_{a.dim}") + 1) * s + o - 1)
        rows = rows.withColumn(f"_lo_{a.dim}", left).withColumn(f"_hi_{a.dim}", right)
        part = part * (F.col(f"_hi_{a.dim}") - F.col(f"_lo_{a.dim}") + 1)
    blocks = load_blocks(synopsis.blocks).select(*[F.col(d).alias(f"_b_{d}") for d in synopsis.dims], F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("sum").alias("s"), F.col("count").cast("long").alias("c"))
    rows = rows.withColumn("part", part).join(blocks, [f"_b_{d}" for d in synopsis.dims])
    m = F.greatest(F.lit(0).cast("long"), F.col("part") - (F.lit(synopsis.volume) - F.col("c")))
    return rows.withColumn("m", m).withColumn("most", F.least("c", "part")).withColumn("full", F.col("part") == synopsis.volume)


def _clip(k: Column) -> Column:
    return F.greatest(F.col("m").cast("double"), F.least(F.col("most").cast("double"), k))


def _sum_bounds() -> tuple[Column, Column]:
    """Sound bounds of the sum of k of a block's c values, m <= k <= most, whatever their signs."""
    lo, hi, s, c = (F.col(x).cast("double") for x in ("lo", "hi", "s", "c"))
    f = lambda k: F.greatest(k * lo, s - (c - k) * hi)
    g = lambda k: F.least(k * hi, s - (c - k) * lo)
    m, most = F.col("m").cast("double"), F.col("most").cast("double")
    # The bounds are piecewise linear in k: the ends and the whole numbers around the bend suffice.
    bend_f, bend_g = F.try_divide(c * hi - s, hi - lo), F.try_divide(s - c * lo, hi - lo)
    around = lambda e: [_clip(F.floor(F.coalesce(e, F.lit(0.0))).cast("double")), _clip(F.ceil(F.coalesce(e, F.lit(0.0))).cast("double"))]
    lower = F.least(*[f(k) for k in (m, most, *around(bend_f))])
    upper = F.greatest(*[g(k) for k in (m, most, *around(bend_g))])
    return F.when(F.col("full"), s).otherwise(lower), F.when(F.col("full"), s).otherwise(upper)


def intervals(windows: DataFrame, axes: Sequence[Axis], synopsis: Synopsis) -> DataFrame:
    """For each window that touches a block with values: state and lower and upper bounds of min, max, sum and avg, and the cost.

    state is NON_NULL where some part must hold a value and MAY_NULL else; windows that are not in the result hold none.
    Bounds of min (upper) and max (lower) without a certain value are null: unbounded.
    """
    rows = parts(windows, axes, synopsis)
    sure = F.col("m") > 0
    low, high = _sum_bounds()
    keys = [c for a in axes for c in (a.dim, a.length_col)]
    return rows.groupBy(*keys).agg(
        F.when(F.max("m") > 0, "NON_NULL").otherwise("MAY_NULL").alias("state"),
        F.min("lo").alias("min_lo"), F.min(F.when(F.col("full"), F.col("lo")).when(sure, F.col("hi"))).alias("min_hi"),
        F.max(F.when(F.col("full"), F.col("hi")).when(sure, F.col("lo"))).alias("max_lo"), F.max("hi").alias("max_hi"),
        F.sum(low).alias("sum_lo"), F.sum(high).alias("sum_hi"), F.min("lo").alias("avg_lo"), F.max("hi").alias("avg_hi"),
        (F.sum(F.col("s") * F.col("part")) / F.sum(F.col("c") * F.col("part"))).alias("avg_val"),
    )


def tight_average(cells: list[tuple[float, float, float, int, int, int]], best: bool) -> float | None:
    """The greatest (``best``) or smallest mean that values consistent with blocks (lo, hi, sum, count, m, most) can have.

    Each block's extreme values are as many of one end as its sum allows, one remainder and the other end. The first m are
    there in any case; the rest come in, best first, while they move the mean.
    """
    sign = 1.0 if best else -1.0
    total, n, optional = 0.0, 0, []
    for lo, hi, s, c, m, most in cells:
        if m == c:
            total, n = total + s, n + c
            continue
        if hi == lo:
            values = [hi] * c
        elif best:
            k = min(c, int((s - c * lo) // (hi - lo)))
            values = [hi] * k + ([s - k * hi - (c - k - 1) * lo] if k < c else []) + [lo] * (c - k - 1)
        else:
            k = min(c, int((c * hi - s) // (hi - lo)))
            values = [lo] * k + ([s - k * lo - (c - k - 1) * hi] if k < c else []) + [hi] * (c - k - 1)
        total, n = total + sum(values[:m]), n + m
        optional += values[m:most]
    for v in sorted(optional, key=lambda v: -sign * v):
        if n and sign * v <= sign * total / n:
            break
        total, n = total + v, n + 1
    return total / n if n else None


def tight_intervals(windows: DataFrame, axes: Sequence[Axis], synopsis: Synopsis) -> DataFrame:
    """avg_lo and avg_hi of each window by ``tight_average``; a window's blocks are few and gathered with it."""
    keys = [c for a in axes for c in (a.dim, a.length_col)]
    rows = parts(windows, axes, synopsis).withColumn("m", F.when(F.col("full"), F.col("c")).otherwise(F.col("m"))).withColumn("most", F.when(F.col("full"), F.col("c")).otherwise(F.col("most")))
    names = ("lo", "hi", "s", "c", "m", "most")
    cells = rows.groupBy(*keys).agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in names])).alias("cells"))

    @F.pandas_udf("struct<avg_lo:double,avg_hi:double>")
    def both(column: pd.Series) -> pd.DataFrame:
        made = [[(lo, hi, s, int(c), int(m), int(most)) for lo, hi, s, c, m, most in some] for some in column]
        return pd.DataFrame({"avg_lo": [tight_average(x, False) for x in made], "avg_hi": [tight_average(x, True) for x in made]})

    return cells.withColumn("_a", both("cells")).select(*keys, "_a.avg_lo", "_a.avg_hi")


def multi_resolution(windows: DataFrame, axes: Sequence[Axis], synopses: Sequence[Synopsis], cell_threshold: float = 0.5) -> DataFrame:
    """Intervals from several synopses, coarse to fine: a part that covers less than ``cell_threshold`` of its block goes on to the next level."""
    keys = [c for a in axes for c in (a.dim, a.length_col)]
    ordered = sorted(synopses, key=lambda s: -s.volume)
    regions = windows.select(*keys, *[F.col(a.dim).alias(f"_r_{a.dim}") for a in axes], *[F.col(a.length_col).alias(f"_n_{a.dim}") for a in axes])
    made = None
    for level, synopsis in enumerate(ordered):
        inner = [Axis(f"_r_{a.dim}", a.origin, a.length, a.end, f"_n_{a.dim}") for a in axes]
        renamed = Synopsis(synopsis.name, synopsis.blocks.select(*[F.col(d).alias(f"_r_{d}") for d in synopsis.dims], "min", "max", "sum", "count"), tuple(f"_r_{d}" for d in synopsis.dims), synopsis.origin, synopsis.sizes)
        rows = parts(regions, inner, renamed)
        enough = F.lit(level == len(ordered) - 1) | (F.col("part") >= cell_threshold * synopsis.volume)
        low, high = _sum_bounds()
        taken = rows.where(enough).select(*keys, "lo", "hi", "m", "full", low.alias("low"), high.alias("high"))
        made = taken if made is None else made.unionByName(taken)
        regions = rows.where(~enough).select(*keys, *[F.col(f"_lo__r_{a.dim}").alias(f"_r_{a.dim}") for a in axes], *[(F.col(f"_hi__r_{a.dim}") - F.col(f"_lo__r_{a.dim}") + 1).alias(f"_n_{a.dim}") for a in axes])
    return made.groupBy(*keys).agg(F.min("lo").alias("avg_lo"), F.max("hi").alias("avg_hi"), F.sum("low").alias("sum_lo"), F.sum("high").alias("sum_hi"), F.when(F.max("m") > 0, "NON_NULL").otherwise("MAY_NULL").alias("state"))


def point_estimates(points: DataFrame, synopsis: Synopsis) -> DataFrame:
    """Bounds and mean of the block around each point; points of empty blocks have state NUL."""
    blocks = load_blocks(synopsis.blocks).select(*[F.col(d).alias(f"_b_{d}") for d in synopsis.dims], F.col("min").alias("lo"), F.col("max").alias("hi"), (F.col("sum") / F.col("count")).alias("val"), F.col("count").alias("_c"))
    rows = points
    for d, o, s in zip(synopsis.dims, synopsis.origin, synopsis.sizes, strict=True):
        rows = rows.withColumn(f"_b_{d}", F.floor((F.col(d) - o) / s))
    joined = rows.join(blocks, [f"_b_{d}" for d in synopsis.dims], "left")
    state = F.when(F.col("_c").isNull(), "NUL").when(F.col("_c") == synopsis.volume, "NON_NULL").otherwise("MAY_NULL")
    return joined.select(*points.columns, "lo", "hi", "val", state.alias("state"))


def open_blocks(axes: Sequence[Axis], synopsis: Synopsis, low: float, high: float, span: int) -> DataFrame:
    """Blocks of ``span`` window origins on each axis in which some window's mean may lie in low..high.

    The mean of any window lies between the least and greatest value that its block of windows can touch; after rounding,
    so does what is compared.
    """
    rows = load_blocks(synopsis.blocks)
    for a, o, s in zip(axes, synopsis.origin, synopsis.sizes, strict=True):
        at = F.col(a.dim) * s + o
        reach = a.length.last
        first = F.greatest(F.lit(0), F.ceil((at - reach - span + 2 - a.origin.lo) / F.lit(span)))
        last = F.least(F.lit((a.origin.last - a.origin.lo) // span), F.floor((at + s - 1 - a.origin.lo) / F.lit(span)))
        rows = rows.where(last >= first).withColumn(f"_o_{a.dim}", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    bounds = rows.groupBy(*[f"_o_{a.dim}" for a in axes]).agg(F.min("min").alias("lo"), F.max("max").alias("hi"))
    return bounds.where((F.floor("lo") <= high) & (F.ceil("hi") >= low)).drop("lo", "hi")
