"""Writers of trajectories, point files, request documents and reports.

Spark writes folders and commits them as a whole, so a reader never sees half a result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Colours of labels 0 to 6 in point files.
PALETTE = [(128, 128, 128), (128, 64, 128), (244, 35, 232), (70, 70, 70), (107, 142, 35), (220, 20, 60), (250, 170, 30)]


def write_trajectory(df: DataFrame, path: str, columns: list[str] = ("t", "x", "y", "z", "qx", "qy", "qz", "qw"), order: str = "t") -> None:
    """A trajectory as CSV with nine decimals, in the order of time over all files."""
    text = [F.format_string("%.9f", F.col(c).cast("double")).alias(c) for c in columns]
    df.repartitionByRange(order).sortWithinPartitions(order).select(*text).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, separator: str = ",") -> None:
    """Rows as delimited text with a header."""
    df.write.mode("overwrite").csv(path, header=True, sep=separator)


#: Columns of an object file, in their order.
OBJECT_COLUMNS = ["id", "label", "x", "y", "z", "cov_x", "cov_y", "cov_z", "observations", "reliability", "reachable"]


def object_rows(df: DataFrame) -> DataFrame:
    """Objects with the columns of an object file, as write_table() takes them."""
    return df.select(*OBJECT_COLUMNS)


def write_ply(df: DataFrame, folder: str) -> list[str]:
    """Points (x, y, z, label, conf) as binary little-endian point files with label colours, one per partition; the names written.

    A file is written under another name and renamed when it is whole. The folder must be one that all executors reach.
    """
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        body = bytearray()
        n = 0
        for b in batches:
            for x, y, z, label, conf in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body += struct.pack("<fff4Bf", x, y, z, *PALETTE[label % len(PALETTE)], label & 255, conf)
                n += 1
        if n:
            name = f"cloud-{TaskContext.get().partitionId():05d}.ply"
            fields = "".join(f"property {k} {f}\n" for k, f in [*[("float", c) for c in "xyz"], *[("uchar", c) for c in ("red", "green", "blue", "label")], ("float", "confidence")])
            head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n{fields}end_header\n".encode()
            with store.open_output_stream(tmp := f"{base}/{name}.{uuid.uuid4().hex}") as out:
                out.write(head + bytes(body))
            store.move(tmp, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return sorted(r.name for r in df.select("x", "y", "z", "label", "conf").mapInArrow(run, "name string").collect())


def status_document(df: DataFrame, keys: list[str], counters: dict[str, str]) -> DataFrame:
    """(keys, document): JSON of counters, each an aggregate in SQL, per key."""
    made = df.groupBy(*keys).agg(*[F.expr(sql).alias(name) for name, sql in counters.items()])
    return made.select(*keys, F.to_json(F.struct(*counters)).alias("document"))


def request_document(df: DataFrame, ident: str, meta: list[str]) -> DataFrame:
    """(ident, document): JSON with the values of the meta columns and their layout."""
    values, layout = F.array(*[F.col(c).cast("double") for c in meta]), F.array(*[F.lit(c) for c in meta])
    return df.select(ident, F.to_json(F.struct(F.col(ident).alias("request_id"), values.alias("meta"), layout.alias("meta_layout"))).alias("document"))


def markdown_row(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """(name, line): a Markdown table row with three decimals, "-" for missing values."""
    cells = [F.when(F.col(v).isNull(), "-").otherwise(F.format_string("%.3f", F.col(v))) for v in values]
    return df.select(name, F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name).cast("string"), *cells), F.lit(" |")).alias("line"))
