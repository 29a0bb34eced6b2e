"""Planes of nearest points, however dense the points are."""

import random

from pyspark.sql import functions as F

from waymark.operators import equations


def test_points_met_do_not_follow_density(spark, monkeypatch):
    """Ten times the points of a floor and a wall: as many meet a query, and its nearest five are those of a loop, copies counted."""
    met = []
    plain = equations._nearest

    def counted(found, ident, order, most, least):
        out = plain(found, ident, order, most, least)
        met.append(found.count())
        return out

    monkeypatch.setattr(equations, "_nearest", counted)
    per_query = []
    for n in (500, 5000):
        rng = random.Random(7)
        places = [(k, rng.uniform(0, 6), rng.uniform(0, 6) if k % 2 else 0.0, 0.0 if k % 2 else rng.uniform(0, 6)) for k in range(n)]
        rows = places + [(n + k, *p[1:]) for k, p in enumerate(places[:50])]
        df = spark.createDataFrame(rows, "id long, x double, y double, z double")
        asked = df.filter(F.col("id") % (n // 50) == 0)
        met.clear()
        got = {r.id: r for r in equations.point_planes(asked, df, "id", 1.0, 1.8, 5, 0.1).collect()}
        per_query.append(sum(met) / asked.count())
        assert len(got) == asked.count()
        for r in asked.collect():
            five = sorted((a - r.x) ** 2 + (b - r.y) ** 2 + (c - r.z) ** 2 for _, a, b, c in rows)[:5]
            assert five[4] <= 1.8**2 and got[r.id].used == 5
    assert max(per_query) <= 16
