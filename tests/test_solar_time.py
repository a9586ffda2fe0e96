import datetime as dt

import duckdb

from trackdensity.plans import model_queries, registry

# (second of the day, longitude in tenths from -180) whose hours + lon / 15 is -1.8e-15, and others nearby
EDGE = [(43176, 1), (43152, 2), (43056, 6), (43032, 7), (43200, 0), (43175, 1), (43177, 1), (86399, 3599)]


def _events(spark, path):
    """Events whose ids give these longitudes: (91 id + 1800) % 3600 are the tenths."""
    ids = {(i * 91 + 1800) % 3600: i for i in range(3600)}
    rows = [(ids[k] + 3600 * n, dt.datetime(2024, 1, 2) + dt.timedelta(seconds=s), n, "view", 1.5, '{"k": 3}') for n, (s, k) in enumerate(EDGE)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.withColumn("ts", df.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def _both(spark, sf, name, query):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet/*.parquet'")
    return sorted(map(tuple, query(spark, sf).collect())), sorted(con.sql(registry.SQL[name]).fetchall())


def test_solar_time_a_hair_before_midnight(spark, tmp_path):
    got, want = _both(spark, _events(spark, tmp_path), "solar_time_features", registry.solar_time_features)
    assert got == want and sum(r[1] == 24.0 for r in got) == 4


def test_profile_has_the_rows_of_its_sql(spark, tmp_path):
    got, want = _both(spark, _events(spark, tmp_path), "reference_profile", model_queries.reference_profile)
    assert got == want and len(got) == 4
