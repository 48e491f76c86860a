"""Files: query sequences, CSV, binary rows, size-limited output, waveform catalogues and synthetic grids."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: struct codes of the binary row format.
ROW_CODES = {"int64": "q", "uint64": "Q", "double": "d"}


def read_sequence(path: str) -> list[float]:
    """A query sequence 'n v1 … vn'; fewer values than n is an error."""
    with open(path) as f:
        parts = f.read().split()
    n = int(parts[0]) if parts else 0
    if not parts or len(parts) < n + 1:
        raise ValueError(f"{path} holds fewer than {n} values")
    return [float(x) for x in parts[1 : n + 1]]


def write_sequence(path: str, values: Sequence[float]) -> None:
    with open(path, "w") as f:
        f.write(" ".join([str(len(values)), *map(str, values)]))


def read_points(spark: SparkSession, path: str, schema: str = "coord long, value double", header: bool = False) -> DataFrame:
    """CSV with a stated schema; a row that does not fit fails the read."""
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def write_rectangles(boxes: DataFrame, path: str, key: str = "record") -> None:
    """Bounding rectangles as rows key, mbr, coefficient, low, high."""
    rows = boxes.select(key, "mbr", F.posexplode(F.arrays_zip("low", "high")).alias("coeff", "z")).select(key, "mbr", "coeff", "z.low", "z.high")
    rows.write.mode("overwrite").csv(path)


def write_limited(rows: DataFrame, path: str, rows_per_file: int, fmt: str = "csv") -> None:
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def pack_row(types: Sequence[str], row: Sequence) -> bytes:
    """One row in the little binary format: a marker byte before nullable fields (-1 present, 0 null), strings with their
    length and a closing zero, everything else as 8 bytes."""
    out = b""
    for kind, value in zip(types, row, strict=True):
        name, *null = kind.split()
        if null:
            out += struct.pack("=b", 0 if value is None else -1)
        elif value is None:
            raise ValueError(f"null in a field of type {kind}")
        if name == "string":
            raw = b"" if value is None else value.encode() + b"\0"
            out += struct.pack("=i", len(raw)) + raw
        else:
            out += struct.pack("=" + ROW_CODES[name], 0 if value is None else value)
    return out


def unpack_rows(types: Sequence[str], data: bytes) -> Iterable[tuple]:
    at = 0
    while at < len(data):
        row = []
        for kind in types:
            name, *null = kind.split()
            there = True
            if null:
                there, at = data[at] == 255, at + 1
            if name == "string":
                (n,) = struct.unpack_from("=i", data, at)
                value, at = data[at + 4 : at + 4 + max(0, n - 1)].decode(), at + 4 + n
            else:
                (value,) = struct.unpack_from("=" + ROW_CODES[name], data, at)
                at += 8
            row.append(value if there else None)
        yield tuple(row)


def binary_rows(rows: DataFrame, types: Sequence[str]) -> DataFrame:
    """One binary column: each row of ``rows`` packed, made on the executors."""
    import pyarrow as pa

    names = rows.columns

    def run(batches):
        for batch in batches:
            columns = [batch[c].to_pylist() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([pack_row(types, r) for r in zip(*columns, strict=True)], pa.binary())], names=["row"])

    return rows.mapInArrow(run, "row binary")


def segment_starts(segments: DataFrame) -> DataFrame:
    """Segments (record, segment, Ticks) with StartTick: the ticks of a record's earlier segments; an empty segment has none."""
    before = W.partitionBy("record").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    ticks = F.coalesce("Ticks", F.lit(0))
    return segments.withColumn("StartTick", F.coalesce(F.sum(ticks).over(before), F.lit(0)).cast("long"))


def tick_to_segment(ticks: DataFrame, segments: DataFrame, bin_ticks: int = 1024) -> DataFrame:
    """``ticks`` (record, tick) with the segment they fall into: an equi-join on bins of ticks and then the exact range."""
    spans = segments.where("Ticks > 0").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("StartTick") / bin_ticks), F.floor((F.col("StartTick") + F.col("Ticks") - 1) / bin_ticks))))
    asked = ticks.withColumn("_bin", F.floor(F.col("tick") / bin_ticks))
    joined = asked.join(spans, ["record", "_bin"]).where((F.col("tick") >= F.col("StartTick")) & (F.col("tick") < F.col("StartTick") + F.col("Ticks")))
    return joined.drop("_bin").withColumn("offset", F.col("tick") - F.col("StartTick"))


def waveform(series: DataFrame, record: int, start: int, length: int, attr: str) -> DataFrame:
    """The ticks from ``start`` to the last one present before start + length, with 0 where a tick or its value is missing."""
    found = series.where((F.col("record") == record) & F.col("tick").between(start, start + length - 1)).select("tick", F.col(attr).alias("_v"))
    last = found.agg(F.max("tick").alias("last"))
    # The request states the number of ticks.
    ticks = last.where("last is not null").select(F.explode(F.sequence(F.lit(start).cast("long"), F.col("last"))).alias("tick"))
    return ticks.join(found, "tick", "left").select("tick", F.coalesce("_v", F.lit(0)).alias(attr))


def synthetic_grid(spark: SparkSession, size: int, clusters: int, mean: float, spread: float, density: float, seed: int = 0) -> DataFrame:
    """A square grid (x, y, val) in which each cluster of columns has its own mean; a share of cells is left out."""
    cells = spark.range(size * size).select(F.floor(F.col("id") / size).alias("x"), (F.col("id") % size).alias("y"), "id")
    centre = F.lit(mean) * (1 + F.pmod(F.col("x"), F.lit(clusters)) / clusters)
    return cells.where(F.rand(seed) < density).select("x", "y", (centre + F.randn(seed + 1) * spread).alias("val"))
