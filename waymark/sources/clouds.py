"""Clouds and rasters from loosely named columns, packed bytes and nested grids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.scalars import clamp, finite

# Column names that each canonical field may have, in order of preference.
ALIASES = {
    "label": ["label", "semantic", "class_id", "label_id"],
    "conf": ["confidence", "probability", "prob", "score"],
    "instance": ["instance_id", "instance", "object_id"],
    "t": ["offset_time", "time", "t", "timestamp"],
}


def resolve(columns: list[str], aliases: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """The column that stands for each canonical field, where there is one."""
    return {field: found for field, names in aliases.items() if (found := next((n for n in names if n in columns), None))}


def decode(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Finite points with label in 0-255 (0 if unknown), confidence in 0-1 (1 if unknown), instance and time where given. Without x, y and z the cloud is empty."""
    if not {"x", "y", "z"} <= set(df.columns):
        return df.select(*keep).limit(0)
    at = resolve(df.columns)
    xyz = [F.col(c).cast("double").alias(c) for c in "xyz"]
    label = F.least(F.lit(255), F.greatest(F.lit(0), F.col(at["label"]).cast("int"))) if "label" in at else F.lit(0)
    conf = clamp(F.col(at["conf"]).cast("double"), 0, 1) if "conf" in at else F.lit(1.0)
    more = [F.col(at[k]).alias(k) for k in ("instance", "t") if k in at]
    return df.filter(finite(*[F.col(c).cast("double") for c in "xyz"])).select(*keep, *xyz, label.alias("label"), conf.alias("conf"), *[m for m in more if m is not None])


def encode_binary(df: DataFrame, key: str, fields: list[tuple[str, str]]) -> DataFrame:
    """(key, data): each row's fields packed into bytes in their order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([(n, d) for n, d in fields])
        for b in batches:
            rows = np.empty(b.num_rows, kind)
            for n, _ in fields:
                rows[n] = b.column(n).to_numpy(zero_copy_only=False)
            raw = rows.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([raw[k : k + kind.itemsize] for k in range(0, len(raw), kind.itemsize)], pa.binary())], [key, "data"])

    return df.select(key, *[n for n, _ in fields]).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, data binary")


def decode_binary(df: DataFrame, key: str, data: str, fields: dict[str, tuple[str, int]], step: int) -> DataFrame:
    """One row per point of packed clouds: fields by type and offset, points step bytes apart (a cut-off rest is dropped)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": step})
        for b in batches:
            keys, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            counts = [len(x or b"") // step for x in raw]
            points = np.frombuffer(b"".join((x or b"")[: n * step] for x, n in zip(raw, counts, strict=True)), kind)
            owner = pa.array([k for k, n in zip(keys, counts, strict=True) for _ in range(n)], b.column(0).type)
            yield pa.RecordBatch.from_arrays([owner, *[pa.array(points[n].astype("<f8")) for n in fields]], [key, *fields])

    return df.select(key, data).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in fields))


def occupancy_cells(df: DataFrame, keys: list[str], cells: str) -> DataFrame:
    """One row per cell of grids as arrays: place and occupancy, negative (unknown) as 0, else hundredths."""
    rows = df.select(*keys, F.posexplode(cells).alias("ix", "cell"))
    return rows.select(*keys, F.col("ix").cast("long").alias("ix"), F.when(F.col("cell") < 0, 0.0).otherwise(F.col("cell") / 100.0).alias("occ"))


def probe(df: DataFrame, topic: str, stamp: str) -> DataFrame:
    """Messages, first and last stamp of each topic."""
    return df.groupBy(topic).agg(F.count("*").alias("messages"), F.min(stamp).alias("first_stamp"), F.max(stamp).alias("last_stamp"))


def pixel_position(u: Column, v: Column, width: int, height: int, east: tuple[float, float], north: tuple[float, float]) -> tuple[Column, Column]:
    """Metric position of a pixel's centre, held inside the raster."""
    fu = (clamp(u, 0, width - 1) + 0.5) / width
    fv = (clamp(v, 0, height - 1) + 0.5) / height
    return east[0] + fu * (east[1] - east[0]), north[1] - fv * (north[1] - north[0])


def packed_points(packets: DataFrame, keys: list[str], order: list[str], stride: int, least: float, most: float) -> DataFrame:
    """Points of a packed sensor: every stride-th of a packet whose range lies between least and most, with intensity from reflectivity, line, its offset from the packet's stamp in nanoseconds, and its own time in microseconds.

    Packets are (keys, order, x, y, z, reflectivity, line, offset_time, stamp). The stride counts
    points before the range gate, as the sensor sends them.
    """
    from waymark.operators.select import every_nth

    r2 = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2
    rows = every_nth(packets, stride, keys, order).filter(r2.between(least * least, most * most))
    return rows.withColumnRenamed("reflectivity", "intensity").withColumn("t", F.col("stamp") + F.floor(F.col("offset_time") / 1000).cast("long"))
