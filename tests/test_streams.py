"""Streams give what the whole table gives, over several files, after restarts, and without late rows counting twice."""

from __future__ import annotations

import datetime as dt
import shutil
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillwise.plans.streams import EventReports, batch_days, daily_categories, event_reports
from tillwise.streaming import runs
from tillwise.streaming.summaries import _changes, _typed

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def add(spark, folder, name, rows):
    """One more file: ``(day, hour, user, kind, value)`` rows."""
    made = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h), u, kind, v, None) for k, (d, h, u, kind, v) in enumerate(rows)]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(Path(f"{folder}-{name}").glob("part-*.parquet"))
    Path(folder).mkdir(exist_ok=True)
    shutil.copy(part, f"{folder}/{name}.parquet")


def plain_days(rows):
    n, amount = Counter(), Counter()
    for d, _, _, kind, v in rows:
        n[d, kind] += 1
        amount[d, kind] += round(100 * v)
    return {(dt.datetime(2024, 1, 1) + dt.timedelta(days=d), kind): (n[d, kind], amount[d, kind] / 100) for d, kind in n}


def plain_retention(rows):
    first, sums = {}, {}
    for d, _, u, _, _ in rows:
        first[u] = min(first.get(u, d // 7), d // 7)
    for d, _, u, _, v in rows:
        key = (dt.date(2024, 1, 1) + dt.timedelta(days=d // 7 * 7), "New" if d // 7 == first[u] else "Returning")
        n, users, cents = sums.get(key, (0, set(), 0))
        sums[key] = (n + 1, users | {u}, cents + round(100 * v))
    return {key: (n, len(users), cents / 100) for key, (n, users, cents) in sums.items()}


def days_of(reports):
    return {(r.window_start, r.category): (r.orders, r.revenue) for r in reports.days().collect()}


def retention_of(reports):
    return {(r.period, r.customer_type): (r.orders, r.customers, r.revenue) for r in reports.retention().collect()}


FIRST = [(d, 5, u, "view" if (d + u) % 3 else "buy", 0.25 * d + u) for d in (14, 15, 16, 22) for u in range(5)]
SECOND = [(d, 7, u, "view", 1.1) for d in (20, 23, 29) for u in range(3, 9)]


def test_several_files_and_restarts(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, "a", FIRST)
    reports = EventReports(spark, folder, str(tmp_path / "out"), files_per_batch=1)
    reports.refresh()
    assert days_of(reports) == plain_days(FIRST) and retention_of(reports) == plain_retention(FIRST)

    reports.refresh()  # nothing new
    assert days_of(reports) == plain_days(FIRST) and retention_of(reports) == plain_retention(FIRST)

    add(spark, folder, "b", SECOND)
    again = EventReports(spark, folder, str(tmp_path / "out"), files_per_batch=1)  # as after a restart
    again.refresh()
    assert days_of(again) == plain_days(FIRST + SECOND) and retention_of(again) == plain_retention(FIRST + SECOND)


def test_late_rows(spark, tmp_path):
    """Rows older than the watermark are dropped from windows; a customer's earlier first week takes back the later one."""
    folder = str(tmp_path / "in")
    add(spark, folder, "a", FIRST)
    reports = EventReports(spark, folder, str(tmp_path / "out"), files_per_batch=1)
    reports.refresh()
    late = [(3, 1, 0, "buy", 9.0), (16, 1, 1, "buy", 2.0), (21, 1, 77, "buy", 4.0)]  # day 22 less 7 days: 3 is late, 16 is not
    add(spark, folder, "b", late)
    reports.refresh()
    assert days_of(reports) == plain_days(FIRST + late[1:])
    assert retention_of(reports) == plain_retention(FIRST + late)


def test_a_failed_batch_counts_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    add(spark, folder, "a", FIRST)
    reports = EventReports(spark, folder, str(tmp_path / "out"), files_per_batch=1)
    reports.refresh("retention")
    add(spark, folder, "b", SECOND)

    stream = reports.streams["retention"]

    def broken(rows, batch):
        rows.write.mode("overwrite").parquet(f"{reports.folder}/retention/{runs.BATCH}={batch}")
        raise RuntimeError("lost after the rows were written, before the batch was finished")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(broken)
        .option("checkpointLocation", f"{reports.folder}/progress/retention").trigger(availableNow=True).start()
    )
    with pytest.raises(Exception, match="lost after"):
        query.awaitTermination()
    reports.refresh("retention")
    assert retention_of(reports) == plain_retention(FIRST + SECOND)


def test_same_as_the_whole_table(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(4, F.hash("event_id")).write.parquet(str(tmp_path / "in"))  # files in no order of time
    whole = event_reports(spark, data)
    whole.refresh()
    parts = EventReports(spark, str(tmp_path / "in"), str(tmp_path / "out"), files_per_batch=1)
    parts.refresh("retention")
    assert retention_of(parts) == retention_of(whole)
    key = lambda r: str(tuple(r))
    assert sorted(whole.days().collect(), key=key) == sorted(batch_days(spark, data).collect(), key=key)


def test_state_leaves_with_the_watermark(spark, tmp_path):
    """What is kept is the windows still open, not all there ever were."""
    folder = str(tmp_path / "in")
    for k in range(4):
        add(spark, folder, f"f{k}", [(40 * k + d, 1, 1, "view", 1.0) for d in range(5)])
    stream = daily_categories(runs.stream_files(spark, folder, spark.read.parquet(folder).schema, 1))
    query = (
        stream.writeStream.outputMode("update").foreachBatch(lambda rows, _: rows.write.format("noop").mode("overwrite").save())
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] <= 10 and sum(p["numInputRows"] for p in query.recentProgress) == 20


def test_odd_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, dt.datetime(2024, 1, 2), None, "view", 1.0, None), (2, None, 3, "view", 1.0, None),
            (3, dt.datetime(2024, 1, 2), 4, None, None, None), (3, dt.datetime(2024, 1, 2), 4, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    reports = EventReports(spark, folder, str(tmp_path / "out"))
    reports.refresh()
    assert days_of(reports) == {(dt.datetime(2024, 1, 2), "view"): (1, 1.0)}
    assert retention_of(reports) == {(dt.date(2024, 1, 1), "New"): (2, 1, 0.0)}


def test_changes_of_one_customer():
    class State:
        exists, held = False, None

        @property
        def get(self):
            return self.held

        def update(self, new):
            self.held, self.exists = new, True

    import pandas as pd

    state, sums = State(), Counter()
    for periods in ([5, 5, 7], [6], [3], [5]):
        for frame in _changes(("x",), iter([pd.DataFrame({"period": periods, "amount": [10] * len(periods)})]), state):
            for r in frame.itertuples():
                sums.update({(r.period, r.customer_type): r.orders})
    assert {k: n for k, n in sums.items() if n} == {(3, "New"): 1, (5, "Returning"): 3, (6, "Returning"): 1, (7, "Returning"): 1}
    assert _typed({}) == set()
