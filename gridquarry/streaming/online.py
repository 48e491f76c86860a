"""Online delivery: slices of the widest variable, one after the other, with a limit, a deadline and cancelling."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridquarry.plans.model import Config, Domain


def slice_configs(config: Config, p: str, variable: str, slices: int) -> list[Config]:
    """The configuration once for each slice of a variable's domain; the ends of the search space stay."""
    import copy

    whole = Domain(config.num(f"{p}.l{variable}"), config.num(f"{p}.u{variable}"), config.num(f"{p}.step_{variable}", 1))
    out = []
    for part in whole.slices(slices):
        one = Config(copy.deepcopy(config.tree))
        one.set(f"{p}.slice", {"variable": variable, "lo": part.lo, "hi": part.hi})
        out.append(one)
    return out


def slice_impact(windows: DataFrame, hit, variable: str, width: int) -> DataFrame:
    """(slice, tries, hits, ratio): how promising each slice of a variable looks on probed windows."""
    grouped = windows.groupBy(F.floor(F.col(variable) / width).alias("slice"))
    return grouped.agg(F.count(F.lit(1)).alias("tries"), F.sum(hit.cast("long")).alias("hits"), (F.sum(hit.cast("double")) / F.count(F.lit(1))).alias("ratio"))


def random_probe(windows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` windows at random, the same ones each time."""
    return windows.orderBy(F.xxhash64(F.lit(seed), *windows.columns), *windows.columns).limit(n)


class OnlineSearch:
    """Results of a search as they come. Slices run as jobs of one group, which ``cancel`` stops."""

    def __init__(self, spark: SparkSession, search: Callable[[Domain], DataFrame], domain: Domain, slices: int = 4, limit: int | None = None, deadline_s: float | None = None):
        self.spark, self.search, self.parts = spark, search, domain.slices(slices)
        self.limit, self.deadline_s, self.group = limit, deadline_s, f"search-{uuid.uuid4().hex}"
        self.stopped, self.sent, self.delays, self.started = threading.Event(), 0, [], time.monotonic()

    def cancel(self) -> None:
        self.stopped.set()
        self.spark.sparkContext.cancelJobsWithTag(self.group)

    def __iter__(self) -> Iterator[Row]:
        # The timer ends a slice that has no rows to show, too.
        timer = None
        if self.deadline_s is not None:
            timer = threading.Timer(max(0.0, self.started + self.deadline_s - time.monotonic()), self.cancel)
            timer.daemon = True
            timer.start()
        try:
            yield from self._rows()
        finally:
            if timer:
                timer.cancel()

    def _rows(self) -> Iterator[Row]:
        last = self.started
        for part in self.parts:
            if self.stopped.is_set():
                return
            self.spark.sparkContext.addJobTag(self.group)
            try:
                for row in self.search(part).toLocalIterator():
                    if self.stopped.is_set() or (self.limit is not None and self.sent >= self.limit):
                        return
                    if self.deadline_s is not None and time.monotonic() - self.started > self.deadline_s:
                        return
                    now = time.monotonic()
                    self.delays.append(now - last)
                    last, self.sent = now, self.sent + 1
                    yield row
            except Exception:
                if self.stopped.is_set():  # the job was cancelled
                    return
                raise
            finally:
                self.spark.sparkContext.removeJobTag(self.group)

    def statistics(self) -> dict[str, float]:
        """Number of results and the first, shortest, longest and mean gap between them; gaps of nothing are left out."""
        gaps = [d for d in self.delays if d > 0]
        some = {"first_delay": gaps[0], "min_delay": min(gaps), "max_delay": max(gaps), "avg_delay": sum(gaps) / len(gaps)} if gaps else {}
        return {"results": self.sent, "total": time.monotonic() - self.started, **some}


def delay_statistics(log: DataFrame) -> DataFrame:
    """Per run, from rows (run, at): results, total time and the first, shortest, longest and mean gap, gaps of nothing left out."""
    from pyspark.sql import Window as W

    gap = F.col("at") - F.lag("at").over(W.partitionBy("run").orderBy("at"))
    rows = log.withColumn("gap", gap).withColumn("gap", F.when(F.col("gap") > 0, F.col("gap")))
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("results"), (F.max("at") - F.min("at")).alias("total"), F.min("gap").alias("min_delay"), F.max("gap").alias("max_delay"), F.avg("gap").alias("avg_delay"))
