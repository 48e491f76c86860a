"""Similarity search over series: distances, piecewise means, Fourier features, bounding rectangles and the filter they give."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.operators.regions import present
from gridquarry.plans.model import Domain

#: Ticks of one record that a window function sees at a time; a longer record is cut into tiles with a halo.
TILE = 1 << 20


def sliding(series: DataFrame, key: str, tick: str, halo: int, columns, tile: int = TILE) -> DataFrame:
    """``columns`` (given a window ordered by tick) for every row, looking at most ``halo`` ticks ahead.

    A record's tiles overlap by the halo, so a long record is dealt over many tasks.
    """
    rows = series.withColumn("_tile", F.floor(F.col(tick) / tile))
    own = F.array(F.struct(F.col("_tile").alias("t"), F.lit(True).alias("own")))
    back = F.floor((F.col(tick) - halo) / tile)
    both = F.when(back < F.col("_tile"), F.concat(own, F.transform(F.sequence(back, F.col("_tile") - 1), lambda t: F.struct(t.alias("t"), F.lit(False).alias("own"))))).otherwise(own)
    dealt = rows.withColumn("_p", F.explode(both)).withColumn("_t", F.col("_p.t")).withColumn("_own", F.col("_p.own")).drop("_tile", "_p")
    over = W.partitionBy(key, "_t").orderBy(tick)
    return dealt.select("*", *columns(over)).where("_own").drop("_own", "_t")


def squared_distances(series: DataFrame, key: str, tick: str, value: Column, query: Sequence[float], starts: Domain, end: int) -> DataFrame:
    """(key, start, sqdist) of every start whose subsequence has a value at each of the query's ticks."""
    n = len(query)
    literal = F.array(*[F.lit(float(q)) for q in query])
    rows = series.select(F.col(key), F.col(tick).alias("_t"), present(value).alias("_v")).where(F.col("_t").between(starts.lo, min(end, starts.last + n - 1)) & F.col("_v").isNotNull())
    last = min(starts.last, end - n + 1)
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_t") - n + 1 - starts.lo) / F.lit(starts.step)))
    high = F.least(F.lit((last - starts.lo) // starts.step).cast("long"), F.floor((F.col("_t") - starts.lo) / F.lit(starts.step)))
    rows = rows.where(high >= low).withColumn("_k", F.explode(F.sequence(low, high))).withColumn("start", F.col("_k") * starts.step + starts.lo)
    gap = F.col("_v") - F.element_at(literal, (F.col("_t") - F.col("start") + 1).cast("int"))
    return rows.groupBy(key, "start").agg(F.sum(gap * gap).alias("sqdist"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).drop("_n")


def paa(values: Sequence[float], window: int, features: int) -> list[list[float]]:
    """Frame means of each disjoint piece of ``window`` values; the tail is dropped."""
    frame = window // features
    x = np.asarray(values, float)
    return [x[k : k + window].reshape(features, frame).mean(1).tolist() for k in range(0, len(x) - window + 1, window)]


def dft(values: Sequence[float], window: int, coefficients: int) -> list[list[float]]:
    """The first coefficients (re, im, …) of each disjoint piece's Fourier transform, scaled by 1/sqrt(window)."""
    x = np.asarray(values, float)
    return [_flat(np.fft.rfft(x[k : k + window]) / np.sqrt(window), coefficients).tolist() for k in range(0, len(x) - window + 1, window)]


def _flat(c: np.ndarray, coefficients: int) -> np.ndarray:
    out = np.empty((*c.shape[:-1], 2 * c.shape[-1]))
    out[..., 0::2], out[..., 1::2] = c.real, c.imag
    return out[..., :coefficients]


def paa_features(series: DataFrame, key: str, tick: str, value: Column, window: int, features: int) -> DataFrame:
    """(key, start, f): frame means of every sliding window without a missing value."""
    frame = window // features
    rows = series.select(F.col(key), F.col(tick), present(value).alias("_v")).where("_v is not null")

    def columns(over):
        out = [F.count("_v").over(over.rangeBetween(0, window - 1)).alias("_n")]
        for j in range(features):
            out.append(F.avg("_v").over(over.rangeBetween(j * frame, (j + 1) * frame - 1)).alias(f"_f{j}"))
        return out

    found = sliding(rows, key, tick, window, columns).where(F.col("_n") == window)
    return found.select(key, F.col(tick).alias("start"), F.array(*[f"_f{j}" for j in range(features)]).alias("f"))


def rectangles(points: DataFrame, key: str, per: int, features: int) -> DataFrame:
    """(key, mbr, low, high): bounding rectangles of the features of ``per`` consecutive starts."""
    sides = [fold(F.col("f")[j]).alias(f"_{name}{j}") for name, fold in (("l", F.min), ("h", F.max)) for j in range(features)]
    grouped = points.groupBy(key, F.floor(F.col("start") / per).alias("mbr")).agg(*sides)
    return grouped.select(key, "mbr", F.array(*[f"_l{j}" for j in range(features)]).alias("low"), F.array(*[f"_h{j}" for j in range(features)]).alias("high"))


def dft_features(series: DataFrame, key: str, tick: str, value: str, window: int, coefficients: int) -> DataFrame:
    """(key, start, f): Fourier features of every sliding window inside a run without gaps; a missing value restarts the window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tick)
        t, v = pdf[tick].to_numpy(), pdf[value].to_numpy(float)
        made = []
        cuts = np.flatnonzero(np.diff(t) != 1) + 1
        for ts, vs in zip(np.split(t, cuts), np.split(v, cuts), strict=True):
            if len(vs) >= window:
                f = _flat(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(vs, window), axis=1) / np.sqrt(window), coefficients)
                mine = ts[: len(f)]
                own = mine // TILE == pdf["_t"].iloc[0]
                made.append(pd.DataFrame({key: pdf[key].iloc[0], "start": mine[own], "f": f[own].tolist()}))
        return pd.concat(made) if made else pd.DataFrame({key: [], "start": [], "f": pd.Series([], dtype=object)})

    rows = series.select(F.col(key), F.col(tick), present(F.col(value)).alias(value)).where(F.col(value).isNotNull())
    tile, back = F.floor(F.col(tick) / TILE), F.floor((F.col(tick) - window + 1) / TILE)
    rows = rows.withColumn("_t", F.explode(F.sequence(back, tile)))
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key, "_t").applyInPandas(run, f"{key} {kind}, start long, f array<double>")


def mindist(low: str, high: str, query: Sequence[float], scale: float) -> Column:
    """Squared distance from a feature vector to a rectangle, times ``scale``."""
    total = F.lit(0.0)
    for j, q in enumerate(query):
        gap = F.greatest(F.col(low)[j] - float(q), F.lit(float(q)) - F.col(high)[j], F.lit(0.0))
        total = total + gap * gap
    return total * scale


def starts_within(boxes: DataFrame, key: str, per: int, query: Sequence[float], window: int, features: int, bound: float, starts: Domain, end: int) -> DataFrame:
    """(key, start) whose lower bound of the squared distance is at most ``bound``: pieces of the query against the rectangles of their starts.

    A start of which some piece meets no rectangle has a missing value there and is left out.
    """
    pieces = paa(query, window, features)
    last = min(starts.last, end - len(query) + 1)
    near = None
    for k, piece in enumerate(pieces):
        rows = boxes.withColumn("_d", mindist("low", "high", piece, window / features)).where(F.col("_d") <= bound)
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("mbr") * per - k * window - starts.lo) / F.lit(starts.step)))
        final = F.least(F.lit((last - starts.lo) // starts.step).cast("long"), F.floor(((F.col("mbr") + 1) * per - 1 - k * window - starts.lo) / F.lit(starts.step)))
        rows = rows.where(final >= first).select(key, F.explode(F.sequence(first, final)).alias("_k"), "_d")
        near = rows if near is None else near.unionByName(rows)
    summed = near.groupBy(key, "_k").agg(F.sum("_d").alias("bound"), F.count(F.lit(1)).alias("_n"))
    return summed.where((F.col("_n") == len(pieces)) & (F.col("bound") <= bound)).select(key, (F.col("_k") * starts.step + starts.lo).alias("start"), "bound")
