"""Queries whose SQL leaves out what lies at a tie."""

import duckdb
import pytest

from waymark.catalog import ORACLE_SQL, QUERIES


def test_yaw_near_half_a_turn(spark, tmp_path):
    """Headings a little off half a turn stand where the SQL has them, on either side of its margin."""
    con = duckdb.connect()
    pi = "3.141592653589793"
    rows = ", ".join(f"({10 * k + i}, {k}, timestamp '2024-01-01 00:00:0{i}', 'signup', ({pi}e0 - {off}) * 997e3)" for k, off in enumerate((0.0, 5e-7, 2e-6, 3e-6, 4e-6, 1e-3)) for i in (0, 1))
    con.sql(f"copy (select event_id::bigint as event_id, user_id::bigint as user_id, ts, event_type, value::double as value from (values {rows}) t(event_id, user_id, ts, event_type, value)) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted((r.id, r.yaw) for r in QUERIES["WN20_yaw_integral"](spark, str(tmp_path)).collect())
    want = sorted(con.sql(f"select id, yaw from ({ORACLE_SQL['WN20_yaw_integral']})").fetchall())
    assert got == want and len(want) == 6 + 2


def test_keyframes_at_the_distance(spark, tmp_path):
    """Steps of just the distance that makes a keyframe count as in the SQL, whichever way they round."""
    con = duckdb.connect()
    rows = "select 2 * k + i as event_id, timestamp '2024-01-01' + to_seconds(i) as ts, k as user_id, 'view' as event_type, case when i = 0 then k % 997 + 0.25 else 149.55 end::double as value, '{}' as props from range(2000) a(k), range(2) b(i)"
    con.sql(f"copy ({rows}) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, QUERIES["WN6_keyframes_or"](spark, str(tmp_path)).select("run", "id").collect()))
    want = sorted(con.sql(f"select run, id from ({ORACLE_SQL['WN6_keyframes_or']})").fetchall())
    assert got == want
    assert 2000 < len(want) < 4000  # steps on both sides


@pytest.mark.parametrize(("name", "limit"), [("JN24_loop_candidates", 40), ("JN24_gated_candidates", 150)])
def test_candidates_at_the_limit(spark, tmp_path, name, limit):
    """Steps of whole length along one axis have the same sums in any order, so every row equals the SQL, at the limit and at equal ranks too."""
    con = duckdb.connect()
    rows = "select 360 * i as event_id, timestamp '2024-01-01' + to_seconds(1300 * i) as ts, i % 35 as user_id, 'view' as event_type, round(0.997e0 * [0, 10, 0, 20, 40, 75, 150][i * i // 11 % 7 + 1], 3) as value, '{}' as props from range(2000) r(i)"
    con.sql(f"copy ({rows}) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    rel = con.sql(ORACLE_SQL[name])
    want = sorted(rel.project(", ".join(got.columns)).fetchall())
    assert sorted(map(tuple, got.collect())) == want
    distance = [row[got.columns.index("distance")] for row in want]
    assert distance.count(float(limit)) > 20 and max(distance) == limit
