"""Relaxation (too few results) and contraction (too many)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.plans.model import Relaxable

Valued = Sequence[tuple[Relaxable, Column]]


def violations(constraints: Valued) -> Column:
    return sum(((~c.holds(v)).cast("int") for c, v in constraints), F.lit(0))


def relaxation_degree(constraints: Valued, weight: float = 0.5) -> Column:
    """weight * the largest distance + (1 - weight) * the share of violated constraints; 0 where none is violated."""
    worst = F.greatest(F.lit(0.0), *[c.distance(v) for c, v in constraints])
    count = violations(constraints)
    return F.when(count == 0, F.lit(0.0)).otherwise(F.lit(weight) * worst + F.lit(1 - weight) * count / F.lit(len(constraints)))


def unit_relaxation(limit: float, weight: float, violated: int, total: int) -> float:
    """The largest distance that any constraint may have in a result of degree at most ``limit`` with ``violated`` violations."""
    return min(1.0, (limit - (1 - weight) * violated / total) / weight) if weight else 1.0


def within(constraints: Valued, limit: float = 1.0, weight: float = 0.5) -> Column:
    """A conservative filter for degrees up to ``limit``: every value inside its interval, widened as far as one violation allows."""
    share = max(0.0, unit_relaxation(limit, weight, 1, len(constraints)))
    ok = F.lit(True)
    for c, v in constraints:
        if c.l is not None:
            ok &= v >= c.l - share * (c.l - c.max_l)
        if c.h is not None:
            ok &= v <= c.h + share * (c.max_h - c.h)
    return ok


def top_relaxed(rows: DataFrame, constraints: Valued, k: int, weight: float = 0.5, limit: float = 1.0) -> DataFrame:
    """``rows`` with rd: those within the relaxed bounds whose degree is among the ``k`` smallest, ties kept.

    The k-th degree is found first by a top-k that keeps k rows a task, and then filters all rows, so no task ever
    sorts the whole result.
    """
    valued = rows.where(within(constraints, limit, weight)).withColumn("rd", relaxation_degree(constraints, weight)).where(F.col("rd") <= limit)
    return top_k(valued, "rd", k, smallest=True)


def top_k(rows: DataFrame, column: str, k: int, smallest: bool) -> DataFrame:
    """The ``k`` smallest or largest rows, ties kept. The bar is found on whole rows, so both readings share the shuffles below."""
    order = F.col(column).asc() if smallest else F.col(column).desc()
    best = rows.orderBy(order).limit(k)
    whole = F.struct(column, *[c for c in rows.columns if c != column])
    bar = best.agg((F.max if smallest else F.min)(whole)[column].alias("_bar"))
    return rows.join(F.broadcast(bar), (F.col(column) <= F.col("_bar")) if smallest else (F.col(column) >= F.col("_bar"))).drop("_bar")


def point_rank(c: Relaxable, value: Column) -> Column:
    """1 for the best value of the ranking interval, 0 for the worst; values outside are clipped."""
    low = c.rank_l if c.rank_l is not None else c.l if c.l is not None else c.max_l
    high = c.rank_h if c.rank_h is not None else c.h if c.h is not None else c.max_h
    clipped = F.least(F.greatest(value.cast("double"), F.lit(float(low))), F.lit(float(high)))
    width = float(high - low) or 1.0
    return 1 - (F.lit(float(high)) - clipped) / width if c.contract == 1 else 1 - (clipped - F.lit(float(low))) / width


def rank_of(constraints: Valued) -> Column:
    ranked = [point_rank(c, v) for c, v in constraints if c.contract]
    return sum(ranked[1:], ranked[0]) / F.lit(float(len(ranked)))


def top_ranked(rows: DataFrame, constraints: Valued, k: int) -> DataFrame:
    """``rows`` that meet all constraints, with rank: the ``k`` highest, ties kept."""
    ok = F.lit(True)
    for c, v in constraints:
        ok &= c.holds(v)
    return top_k(rows.where(ok).withColumn("rank", rank_of(constraints)), "rank", k, smallest=False)


def skyline(rows: DataFrame, goals: Sequence[tuple[str, bool]]) -> DataFrame:
    """``rows`` that no other row dominates over ``goals`` (column, maximise); equal rows all stay, null and NaN values never do.

    Each partition first keeps the rows of its own skyline, which is all that is held; their distinct vectors then meet in
    an anti-join on dominance.
    """
    import numpy as np
    import pyarrow as pa

    names = [c for c, _ in goals]
    signs = [1.0 if up else -1.0 for _, up in goals]

    def local(batches):
        kept = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            kept = new if kept is None else pa.concat_tables([kept, new])
            v = np.stack([kept[c].to_numpy().astype(float) for c in names], 1) * signs
            whole = ~np.isnan(v).any(1)
            kept, v = kept.filter(pa.array(whole)), v[whole]
            if not len(v):
                continue
            distinct, which = np.unique(v, axis=0, return_inverse=True)
            # By descending sum, a vector can only be dominated by one that comes before it.
            front, size, best = np.empty_like(distinct), 0, np.zeros(len(distinct), bool)
            for k in np.argsort(-distinct.sum(1), kind="stable"):
                if not (front[:size] >= distinct[k]).all(1).any():
                    front[size], best[k], size = distinct[k], True, size + 1
            kept = kept.filter(pa.array(best[which.reshape(-1)]))
        if kept is not None:
            yield from kept.to_batches()

    # Read by both sides of the join; lost parts are made again from their lineage.
    held = rows.mapInArrow(local, rows.schema).persist()
    vectors = held.select(*[F.col(c).cast("double").alias(c) for c in names]).distinct()
    a, b = vectors.alias("a"), vectors.alias("b")
    better, strictly = F.lit(True), F.lit(False)
    for c, up in goals:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        better &= (y >= x) if up else (y <= x)
        strictly |= (y > x) if up else (y < x)
    front = a.join(b, better & strictly, "left_anti").select(*[F.col(c).alias(f"_{c}") for c in names])
    on = F.lit(True)
    for c in names:
        on &= F.col(c).cast("double") == F.col(f"_{c}")
    return held.join(front, on, "left_semi")


def dominates(low: Sequence[Column], point: Sequence[Column], maximise: Sequence[bool]) -> Column:
    """Whether a point dominates every vector of a range: ``low`` holds the range's best value for each goal."""
    better, strictly = F.lit(True), F.lit(False)
    for best, p, up in zip(low, point, maximise, strict=True):
        better &= (p >= best) if up else (p <= best)
        strictly |= (p > best) if up else (p < best)
    return better & strictly


def step_relax(search: Callable[[dict], DataFrame], start: dict, steps: dict[str, float], target: int, strategy: str = "all", tries: int = 20, seed: int = 0) -> tuple[DataFrame, dict, int]:
    """Widen parameters step by step until a search has more than ``target`` results: all at once, in turn (rr) or at random."""
    import random

    rng, params, names = random.Random(seed), dict(start), list(steps)
    for n in range(tries + 1):
        found = search(params)
        if n == tries or len(found.limit(target + 1).collect()) > target:
            break
        for name in names if strategy == "all" else [names[n % len(names)]] if strategy == "rr" else [rng.choice(names)]:
            params[name] += steps[name]
    return found, params, n
