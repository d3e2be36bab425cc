"""Streams over small files, batch by batch."""

import datetime as dt

import pytest

from fairline.streaming import live

T = dt.datetime(2024, 1, 1, 12)
AT = lambda m: T + dt.timedelta(minutes=m)


@pytest.fixture
def run(spark, tmp_path):
    """Runs an operator over batches of rows and returns what comes out."""

    def go(schema, batches, operator, mode="append"):
        src, out = str(tmp_path / "in"), []
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            stream = operator(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
            q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
        return out

    return go


def test_versions_only_advance(run):
    rows = [[(1, AT(0), 5), (1, AT(1), 4), (2, AT(1), 1)], [(1, AT(2), 5), (1, AT(3), 7), (2, AT(3), 2)]]
    out = run("event_id long, captured_at timestamp, version long", rows, lambda s: live.advanced(s, ["event_id"]))
    assert sorted((r.event_id, r.version) for r in out) == [(1, 5), (1, 7), (2, 1), (2, 2)]


def test_empty_runs_fire_once(run):
    rows = [[("a", 1, 0), ("a", 2, 0)], [("a", 3, 0), ("a", 4, 0)], [("a", 5, 3), ("a", 6, 0)]]
    out = run("source string, batch long, fresh long", rows, lambda s: live.empty_runs(s, after=3))
    assert sorted((r.batch, r.streak, r.fires) for r in out) == [(1, 1, False), (2, 2, False), (3, 3, True), (4, 4, False), (5, 0, False), (6, 1, False)]


def test_duplicates_are_claimed_once(run):
    rows = [[("k", AT(0)), ("k", AT(1)), ("m", AT(1))], [("k", AT(5)), ("n", AT(6))]]
    out = run("alert string, captured_at timestamp", rows, lambda s: live.unseen(s, ["alert"]))
    assert sorted(r.alert for r in out) == ["k", "m", "n"]


def test_started_events_are_left_out(spark, run):
    events = spark.createDataFrame([(1, AT(10)), (2, None)], "event_id long, kickoff timestamp")
    out = run("event_id long, captured_at timestamp", [[(1, AT(9)), (1, AT(10)), (2, AT(99)), (3, AT(1))]], lambda s: live.not_started(s, events))
    assert sorted((r.event_id, r.captured_at) for r in out) == [(1, AT(9)), (2, AT(99)), (3, AT(1))]


def test_windows(run):
    rows = [[(1, "b", "home", AT(m), o) for m, o in ((0, 2.0), (3, 2.2), (4, 1.0), (7, 2.4))], [(1, "b", "home", AT(600), 2.0)]]
    out = run(live.CHANGED, rows, lambda s: live.trajectories(s, length="10 minutes", slide="10 minutes"), "append")
    assert [(r.first, r.last, r.points) for r in out if r.window.start == T] == [(2.0, 2.4, 3)]


def test_counts_by_window(run):
    rows = [[(1, "b", "home", AT(m), 2.0) for m in (0, 1, 6)], [(1, "b", "away", AT(900), 2.0)]]
    out = run(live.CHANGED, rows, live.counted)
    assert {(r.window.start, r.rows) for r in out} >= {(T, 2), (AT(5), 1)}


def test_months(run):
    rows = [[(T, 0.5, 1.0), (T, 0.7, 0.0)], [(T + dt.timedelta(days=60), 0.5, 1.0)]]
    out = run("captured_at timestamp, p double, won double", rows, live.by_month, "complete")
    assert {(r.n, r.mean_p, r.rate) for r in out if r.month == dt.datetime(2024, 1, 1)} == {(2, 0.6, 0.5)}


def test_stale_rows_are_counted(spark, tmp_path):
    seen, out = [], []
    schema = "i int, captured_at timestamp, ingested_at timestamp"
    spark.createDataFrame([(1, T, T), (2, T - dt.timedelta(hours=1), T), (3, None, T)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.observed_fresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = live.polled(stream, lambda df, _: out.extend(r.i for r in df.collect()), str(tmp_path / "c"), every=None)
    q.awaitTermination()
    seen = [p.observedMetrics["freshness"] for p in q.recentProgress if "freshness" in p.observedMetrics]
    assert out == [1] and [(m["rows"], m["stale"]) for m in seen][0] == (3, 2)
    assert live.stale_alarm({"rows": 3, "stale": 2}) and not live.stale_alarm({"rows": 0, "stale": 0})


