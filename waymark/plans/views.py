"""Views over the driver's tables that stand for clouds, rasters, trajectories and descriptors.

Each view is one SQL text for both engines; HASH60[...] (an integer from md5) and MICROS[...]
(microseconds of a timestamp without zone) are written out per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SQL = {
    # labelled cloud: frames of points with label, confidence and instance
    "pts": """select HASH60[concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint), cast(l_quantity as bigint))] as id,
        l_quantity as x, l_extendedprice / 997.0 as y, l_discount * 50 as z, cast(l_suppkey % 7 as int) as label,
        least(cast(1 as double), 0.05 + l_tax * 10) as conf, l_suppkey as instance, l_orderkey % 64 as frame, MICROS[l_shipdate] as stamp
        from lineitem""",
    # raster of cells
    "raster": """select ix, iy, max(occ) as occ, max(label) as label from (
        select cast(p_partkey % 64 as bigint) as ix, cast(floor(p_partkey / 64) as bigint) % 64 as iy, p_size / 49.0 as occ, cast(p_partkey % 7 as int) as label from part) r group by ix, iy""",
    # trajectory: run, time, speed, position from steps in varying directions
    "track": """select user_id as run, event_id as id, MICROS[ts] as t, value / 0.997 as v,
        sum(value / 0.997 * cos(radians(event_id % 360))) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as x,
        sum(value / 0.997 * sin(radians(event_id % 360))) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as y
        from events""",
    # poses: position, unit quaternion about a fixed axis
    "poses": """select run, id, t, x, y, v / 7 as z, cos(radians(id % 97)) as qw, sin(radians(id % 97)) * 0.6 as qx, cast(0 as double) as qy, sin(radians(id % 97)) * 0.8 as qz from track""",
    "est": """select user_id as run, event_id as id, MICROS[ts] as t, value / 0.997 as x, value * 0.7013 as y, value / 3 as z from events where event_type = 'view'""",
    "gt": """select user_id as run, event_id as id, MICROS[ts] as t, value / 0.991 as x, value * 0.7117 as y, value / 3.1 as z from events where event_type = 'click'""",
    "imu": """select user_id as run, event_id as id, MICROS[ts] as t, value / 997.0 as w from events where event_type = 'signup'""",
    "geo": """select s_suppkey as id, s_acctbal / 200 as lat, s_suppkey * 0.001 as lon, s_acctbal / 10 as alt from supplier""",
    # pose-graph edges: orders of a customer in turn
    "ranked": """select o_custkey as run, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as k, o_totalprice / 99991.0 as d from orders""",
    # keyframes: raw poses that drift, and poses that a graph gives them
    "kf": """select run, k, k * 2000000 as t, s + 0.03 * k as x, sin(k / 3.0) + 0.02 * k as y, 0.01 * k as z, 0.1 * sin(k / 2.0) + 0.004 * k as yaw,
        s as gx, sin(k / 3.0) as gy, cast(0 as double) as gz, 0.1 * sin(k / 2.0) as gyaw from (select run, k, sum(d) over (partition by run order by k rows between unbounded preceding and current row) - d as s from ranked) q""",
    # proposals of loops: reference i, current j, both poses, a measured pose near the graph's
    "loops": """select e.run, e.i, e.j, a.t as t_ref, b.t as t_cur, a.x as ax, a.y as ay, a.z as az, a.yaw as ayaw, b.x as bx, b.y as b_y, b.z as bz, b.yaw as byaw,
        a.gx as gax, a.gy as gay, a.gz as gaz, a.gyaw as gayaw, b.gx as gbx, b.gy as gby, b.gz as gbz, b.gyaw as gbyaw,
        cos(a.gyaw) * (b.gx - a.gx) + sin(a.gyaw) * (b.gy - a.gy) + ((e.run * 31 + e.i * 17 + e.j * 13) % 41 - 20) / 25.0 as mx, cos(a.gyaw) * (b.gy - a.gy) - sin(a.gyaw) * (b.gx - a.gx) + ((e.run * 7 + e.i * 5 + e.j * 3) % 41 - 20) / 50.0 as my,
        b.gz - a.gz + ((e.run * 3 + e.i) % 21 - 10) / 40.0 as mz, b.gyaw - a.gyaw + ((e.run + e.i * 7) % 21 - 10) / 100.0 as myaw,
        ((e.run * 11 + e.i * 3 + e.j) % 20) / 20.0 as quality
        from edges e join kf a on a.run = e.run and a.k = e.i join kf b on b.run = e.run and b.k = e.j where e.loop""",
    "edges": """select a.run, a.k as i, b.k as j, a.d as dx, b.k - a.k > 1 as loop from ranked a join ranked b on a.run = b.run and b.k in (a.k + 1, a.k + 5)""",
}


def dialect(sql: str, engine: str) -> str:
    """The macros of a view written out for "spark" or "duckdb"; numbers with a point become doubles, not decimals."""
    sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", sql)
    if engine == "spark":
        sql = re.sub(r"HASH60\[(.*?)\]", r"cast(conv(substr(md5(\1), 1, 15), 16, 10) as bigint)", sql)
        return re.sub(r"MICROS\[(.*?)\]", r"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', \1)", sql)
    sql = re.sub(r"HASH60\[(.*?)\]", r"cast('0x' || substr(md5(\1), 1, 15) as bigint)", sql)
    return re.sub(r"MICROS\[(.*?)\]", r"epoch_us(\1)", sql)


def _used(sql: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"(?:from|join|,)\s+{n}\b", sql, re.IGNORECASE)]


def oracle(sql: str) -> str:
    """DuckDB SQL that defines the views it needs before the query."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in _used(text, list(SQL)):
            if name not in need:
                add(SQL[name])
                need.append(name)

    add(sql)
    if not need:
        return dialect(sql, "duckdb")
    heads = ", ".join(f"{n} as ({dialect(SQL[n], 'duckdb')})" for n in need)
    sql = dialect(sql, "duckdb").strip()
    recursive = re.match(r"with recursive\s", sql, re.IGNORECASE)
    if re.match(r"with\s", sql, re.IGNORECASE):
        return f"with {'recursive ' if recursive else ''}{heads}, {re.sub(r'^with(?: recursive)?', '', sql, flags=re.IGNORECASE)}"
    return f"with {heads} {sql}"


class Views:
    """The tables and views of one data folder, each read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in [*TABLES, *SQL]:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in TABLES else self.sql(SQL[name])
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over tables and views."""
        text = dialect(text, "spark")
        names = _used(text, [*TABLES, *SQL])
        for n in names:
            text = re.sub(rf"((?:from|join|,)\s+){n}\b", rf"\1{{{n}}}", text, flags=re.IGNORECASE)
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})
