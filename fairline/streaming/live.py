"""Structured Streaming forms of the live operators: change-only and version-gated rows, duplicates, stale rows, trajectories, started events, empty runs, alerts."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ["event_id", "book", "selection"]
CHANGED = "event_id long, book string, selection string, captured_at timestamp, odds double"


def fresh(stream: DataFrame, seconds: int = 300) -> DataFrame:
    """Rows at most some seconds older than they arrived; a row from the future has age 0, one without a time is stale."""
    age = F.unix_timestamp("ingested_at") - F.unix_timestamp("captured_at")
    return stream.where(F.coalesce(age <= seconds, F.lit(False)))


def observed_fresh(stream: DataFrame, seconds: int = 300, name: str = "freshness") -> DataFrame:
    """fresh(), with the rows of every batch and how many of them were stale as observed metrics of that name; late rows fall behind the watermark."""
    age = F.unix_timestamp("ingested_at") - F.unix_timestamp("captured_at")
    counted = stream.withWatermark("captured_at", f"{seconds} seconds").observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(age <= seconds, F.lit(False))).alias("stale"))
    return fresh(counted, seconds)


def stale_alarm(metrics: dict, share: float = 0.5) -> bool:
    """Whether too much of a batch was stale. metrics: rows, stale."""
    return metrics["rows"] > 0 and metrics["stale"] / metrics["rows"] > share


def trajectories(stream: DataFrame, *, length: str = "6 hours", slide: str = "5 minutes") -> DataFrame:
    """First and last price of each series over sliding windows of event time; a price of 1 or less is none."""
    rows = stream.where("odds > 1").withWatermark("captured_at", slide)
    return rows.groupBy(F.window("captured_at", length, slide), *KEY).agg(F.min_by("odds", "captured_at").alias("first"), F.max_by("odds", "captured_at").alias("last"), F.count("*").alias("points"))


def by_month(stream: DataFrame) -> DataFrame:
    """Observations of calibration by month: rows, mean chance and share won; for complete or update output, as state is one row a month."""
    return stream.groupBy(F.date_trunc("month", "captured_at").alias("month")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("won").alias("rate"))


def not_started(stream: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of events that have not started when they were captured; an event without a kickoff has not. events: event_id, kickoff, a static table."""
    return stream.join(events, "event_id", "left").where(F.col("kickoff").isNull() | (F.col("captured_at") < F.col("kickoff"))).drop("kickoff")


def advanced(stream: DataFrame, key: list[str], *, version: str = "version", keep_days: int = 3) -> DataFrame:
    """Rows whose version is over every one seen of their key; a key without rows for some days is forgotten."""
    types = dict(stream.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in stream.columns)

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("captured_at", kind="stable")
        top = state.get[0] if state.exists else None
        before = rows[version].cummax().shift()
        if top is not None:
            before = before.fillna(top).clip(lower=top)
        yield rows[before.isna() | (rows[version] > before)]
        highest = int(rows[version].max())
        state.update((max(highest, top) if top is not None else highest,))
        state.setTimeoutTimestamp(max(int(rows["captured_at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_days * 86_400_000)

    return stream.withWatermark("captured_at", f"{keep_days} days").groupBy(*key).applyInPandasWithState(update, schema, "top long", "append", GroupStateTimeout.EventTimeTimeout)


def empty_runs(batches: DataFrame, *, after: int) -> DataFrame:
    """Length of the run of batches without fresh rows, and whether it fires: once a run, at `after`. batches: source, batch, fresh, in order of arrival."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        for b, n in pd.concat(list(rows)).sort_values("batch", kind="stable")[["batch", "fresh"]].itertuples(index=False):
            streak = 0 if n > 0 else streak + 1
            out.append((key[0], b, streak, streak == after))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["source", "batch", "streak", "fires"])

    return batches.groupBy("source").applyInPandasWithState(update, "source string, batch long, streak long, fires boolean", "streak long", "append", GroupStateTimeout.NoTimeout)


def polled(stream: DataFrame, write, checkpoint: str, *, every: str | None = "300 seconds"):
    """Starts a query that hands each micro-batch to write(batch, id), one at a time; without an interval it takes what is there and ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def unseen(stream: DataFrame, key: list[str], *, time: str = "captured_at", keep: str = "7 days") -> DataFrame:
    """The first row of each key within the time that keys are remembered."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark(key)


def changed(stream: DataFrame, *, keep_days: int = 3) -> DataFrame:
    """Rows whose price differs from the last one of their (event, book, selection).

    Rows that arrive together are taken in order of their time, an older one than the last seen is
    dropped; a key without rows for some days of event time is forgotten, so state is bounded by
    the live keys. Needs no order between keys and shuffles once, on the key.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("captured_at", kind="stable")
        price, at = state.get if state.exists else (None, None)
        if at is not None:
            rows = rows[rows["captured_at"] >= at]
        if rows.empty:
            return
        before = rows["odds"].shift()
        if price is not None:
            before.iloc[0] = price
        yield rows[before.ne(rows["odds"])][[*KEY, "captured_at", "odds"]]
        last = rows.iloc[-1]
        state.update((float(last["odds"]), last["captured_at"].to_pydatetime()))
        state.setTimeoutTimestamp(max(int(last["captured_at"].timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_days * 86_400_000)

    rows = stream.select(*KEY, "captured_at", "odds").withWatermark("captured_at", f"{keep_days} days")
    return rows.groupBy(*KEY).applyInPandasWithState(update, CHANGED, "odds double, at timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def counted(stream: DataFrame, *, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and distinct series by tumbling windows of event time."""
    return stream.withWatermark("captured_at", late).groupBy(F.window("captured_at", window), "book").agg(F.count("*").alias("rows"), F.approx_count_distinct(F.struct(*KEY)).alias("series"))
