"""Trajectories, point files, metadata, tables and JSON documents as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TUM = ["t", "x", "y", "z", "qx", "qy", "qz", "qw"]


def parse_tum(lines: DataFrame, line: str = "value", keep: list[str] = ()) -> DataFrame:
    """Rows of eight numbers split by commas or blanks, quaternion normalised; blank and comment lines are skipped, others without eight numbers are marked bad."""
    text = F.trim(F.regexp_replace(F.col(line), "[,\\s]+", " "))
    rows = lines.select(*keep, text.alias("_l")).filter((F.col("_l") != "") & ~F.col("_l").startswith("#")).withColumn("_p", F.split("_l", " "))
    rows = rows.select(*keep, *[F.expr(f"try_cast(get(_p, {k}) as double)").alias(n) for k, n in enumerate(TUM)])
    good = F.lit(True)
    for n in TUM:
        good = good & F.col(n).isNotNull()
    norm = F.sqrt(sum((F.col(n) ** 2 for n in TUM[5:]), F.col("qx") ** 2))
    return rows.withColumn("bad", ~good).withColumns({n: F.try_divide(F.col(n), norm) for n in TUM[4:]})


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """The good rows of a trajectory file; an error if there are none."""
    rows = parse_tum(spark.read.text(path)).filter("not bad").drop("bad")
    if rows.isEmpty():
        raise ValueError(f"no poses in {path}")
    return rows


def parse_pcd(lines: DataFrame, number: str, line: str = "value", keys: list[str] = ()) -> DataFrame:
    """Points of ASCII point files: the first three numbers of the lines after the one that says DATA ascii; none for binary files."""
    head = lines.filter(F.col(line).startswith("DATA")).groupBy(*keys).agg(F.min(F.struct(number, F.lower(F.col(line)).contains("ascii").alias("ascii"))).alias("_h"))
    rows = lines.join(head, list(keys)) if keys else lines.join(F.broadcast(head))  # one row
    rows = rows.filter(F.col("_h.ascii") & (F.col(number) > F.col(f"_h.{number}"))).withColumn("_p", F.split(F.trim(F.col(line)), "\\s+"))
    rows = rows.select(*keys, number, *[F.expr(f"try_cast(get(_p, {k}) as double)").alias(a) for k, a in enumerate("xyz")])
    return rows.filter("x is not null and y is not null and z is not null")


def parse_flat_yaml(lines: DataFrame, line: str = "value", keys: list[str] = ()) -> DataFrame:
    """(key, value) of lines "key: value"; comments, blanks and quotes go."""
    text = F.regexp_replace(F.col(line), "\\s*#.*$", "")
    rows = lines.select(*keys, F.split(text, ":", 2).alias("_p")).filter(F.size("_p") == 2)
    return rows.select(*keys, F.trim(F.col("_p")[0]).alias("key"), F.regexp_replace(F.trim(F.col("_p")[1]), "^['\"]|['\"]$", "").alias("value")).filter("key <> ''")


def entrances(df: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """east and north of rows with either east, north or lat, lon; rows with neither are left out."""
    from waymark.functions.scalars import enu_from_lat_lon

    has = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    e, n = enu_from_lat_lon(has("lat"), has("lon"), lat0, lon0)
    rest = [c for c in df.columns if c not in ("east", "north", "lat", "lon")]
    return df.select(*rest, F.coalesce(has("east"), e).alias("east"), F.coalesce(has("north"), n).alias("north")).filter("east is not null and north is not null")


def json_value(text: Column, path: str, default: str | None = None) -> Column:
    """Value at a path of a JSON text as a string, default where it isn't there."""
    found = F.get_json_object(text, f"$.{path}")
    return found if default is None else F.coalesce(found, F.lit(default))


def message_id(stamp: Column, session: Column, sequence: Column) -> Column:
    """Id from a stamp, a session and a sequence number."""
    return F.format_string("%d_%s_%06d", stamp, session, sequence)


def clean_name(text: Column) -> Column:
    """Lower-case name of letters, digits and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def number_list(text: Column) -> Column:
    """Numbers of a text, split by commas, semicolons or blanks; what is no number is left out."""
    parts = F.split(F.trim(text), "[,;\\s]+")
    return F.filter(F.transform(parts, lambda x: F.try_to_number(x, F.lit("999999999.999999")).cast("double")), lambda x: x.isNotNull())
