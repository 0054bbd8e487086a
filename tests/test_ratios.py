"""Ratios over zero: as floating point has them, as the SQL does."""

import datetime
import math

import duckdb

from carelog.functions.util import float_ratio
from carelog.plans.catalog import ORACLE, QUERIES


def test_float_ratio(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)]
    found = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(float_ratio("a", "b")).collect()]
    assert found[0] == math.inf and found[1] == -math.inf and math.isnan(found[2]) and found[3:] == [None, None, 1.5]


def test_interval_pick_with_a_click_of_value_zero(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for user, click, purchase in ((1, 0.0, 5.0), (2, 0.0, 0.0), (3, 2.0, 5.0), (4, None, 5.0)):
        for hour, kind, value in ((1, "click", click), (2, "purchase", purchase), (24, "view", 1.0), (47, "view", 1.0), (70, "view", 1.0)):
            rows.append((len(rows), start + datetime.timedelta(hours=hour), user, kind, value))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = {r.user_id: r.ratio for r in QUERIES["interval_pick"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    wanted = {r[0]: r[3] for r in duck.execute(ORACLE["interval_pick"]).fetchall()}
    assert set(found) == {1, 2, 3, 4} and found[1] == math.inf and math.isnan(found[2]) and found[3] == 250.0 and found[4] is None
    assert {k: str(v) for k, v in found.items()} == {k: str(v) for k, v in wanted.items()}
