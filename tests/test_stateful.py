"""State operators over small files, batch by batch, with a restart from the checkpoint after each."""

import datetime as dt
import time

import pytest

from fairline.streaming import live, stateful

T = dt.datetime(2024, 1, 1, 12)
AT = lambda m: T + dt.timedelta(minutes=m)
PRICE = lambda event, minute, odds: (event, "bwin", "home", AT(minute), odds)


@pytest.fixture
def run(spark, tmp_path):
    """Each batch is a query of its own that starts from the checkpoint of the one before."""
    names = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.shuffle.partitions"
    before = [spark.conf.get(n) for n in names]
    stateful.configured(spark).conf.set("spark.sql.shuffle.partitions", "1")

    def go(schema, batches, operator, pause=0.0):
        src, out = str(tmp_path / "in"), []
        for k, rows in enumerate(batches):
            if k:
                time.sleep(pause)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            q = operator(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
        return out

    yield go
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_changes_over_restarts(run):
    batches = [[PRICE(1, 0, 2.0), PRICE(1, 1, 2.0), PRICE(2, 0, 3.0)], [PRICE(1, 2, 2.0), PRICE(1, 3, 2.1), PRICE(2, 5, 3.0)], [PRICE(1, 1, 9.9), PRICE(1, 4, 2.1), PRICE(1, 6, 2.0)]]
    out = run(live.CHANGED, batches, stateful.changed)
    assert sorted((r.event_id, r.captured_at, r.odds) for r in out) == [(1, AT(0), 2.0), (1, AT(3), 2.1), (1, AT(6), 2.0), (2, AT(0), 3.0)]


def test_a_timer_forgets_a_key(run):
    """Once event time has passed the days of a key without rows, the same price is a change again."""
    day = 24 * 60
    batches = [[PRICE(1, 0, 2.0)], [PRICE(2, 9 * day, 3.0)], [PRICE(2, 10 * day, 3.1)], [PRICE(1, 10 * day, 2.0)]]
    out = run(live.CHANGED, batches, lambda s: stateful.changed(s, keep_days=2))
    assert [(r.captured_at, r.odds) for r in out if r.event_id == 1] == [(AT(0), 2.0), (AT(10 * day), 2.0)]


def test_versions_and_their_time_to_live(run):
    schema = "event_id long, captured_at timestamp, version long"
    rows = [[(1, AT(0), 5), (1, AT(1), 4), (2, AT(1), 1)], [(1, AT(2), 5), (1, AT(3), 7), (2, AT(3), 2)]]
    out = run(schema, rows, lambda s: stateful.advanced(s, ["event_id"]))
    assert sorted((r.event_id, r.version) for r in out) == [(1, 5), (1, 7), (2, 1), (2, 2)]


def test_state_expires(run):
    out = run("event_id long, captured_at timestamp, version long", [[(1, AT(0), 5)], [(1, AT(1), 3)]], lambda s: stateful.advanced(s, ["event_id"], keep_days=0.5 / 86_400), pause=2.0)
    assert [r.version for r in out] == [5, 3]


def test_empty_runs_fire_once_over_restarts(run):
    rows = [[("a", 1, 0), ("a", 2, 0)], [("a", 3, 0), ("a", 4, 0)], [("a", 5, 3), ("a", 6, 0)]]
    out = run("source string, batch long, fresh long", rows, lambda s: stateful.empty_runs(s, after=3))
    assert sorted((r.batch, r.streak, r.fires) for r in out) == [(1, 1, False), (2, 2, False), (3, 3, True), (4, 4, False), (5, 0, False), (6, 1, False)]


def test_alerts_are_claimed_once(run):
    rows = [[("k", AT(0)), ("k", AT(1)), ("m", AT(1))], [("k", AT(5)), ("n", AT(6))]]
    out = run("alert string, captured_at timestamp", rows, lambda s: stateful.unseen(s, ["alert"]))
    assert sorted((r.alert, r.captured_at) for r in out) == [("k", AT(0)), ("m", AT(1)), ("n", AT(6))]


def test_state_can_be_read(spark, run, tmp_path):
    run("source string, batch long, fresh long", [[("a", 1, 0), ("a", 2, 0), ("b", 1, 4)]], lambda s: stateful.empty_runs(s, after=3))
    state = spark.read.format("statestore").option("stateVarName", "streak").load(str(tmp_path / "c"))
    assert sorted((r.key.source, r.value.streak) for r in state.collect()) == [("a", 2), ("b", 0)]
