"""Keyed state with a schema, timers and a time to live, by the arbitrary state API over RocksDB.

Each operator is a processor: its state variables are declared in init with their schemas and
their time to live, so the store drops what no one asks for any more, and state can be
read by the state data source. The provider has to be RocksDB's; `configured` sets it.
"""

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["event_id", "book", "selection"]
DAY = 86_400_000


def configured(spark: SparkSession) -> SparkSession:
    """The session with RocksDB as its state store; changes are written to the checkpoint as logs, not as whole snapshots.

    Batches without data are off: state with a time to live would ask for them without end, so a run over what is there would not finish.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return spark


def schema_of(stream: DataFrame, columns: list[str] | None = None) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields if columns is None or f.name in columns])


class ChangedPrices(StatefulProcessor):
    """Rows whose price differs from the key's last one; rows of one arrival in order of their time, one older than the last seen is dropped."""

    def __init__(self, keep_days: int) -> None:
        self.keep = keep_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "odds double, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("captured_at", kind="stable")
        price = None
        if self.last.exists():
            price, at = self.last.get()
            new = new[new["captured_at"] >= pd.Timestamp(at)]
        if new.empty:
            return
        before = new["odds"].shift()
        if price is not None:
            before.iloc[0] = price
        last = new.iloc[-1]
        self.last.update((float(last["odds"]), last["captured_at"].to_pydatetime()))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(last["captured_at"].timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.keep)
        yield new[before.ne(new["odds"])][[*KEY, "captured_at", "odds"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame(columns=[*KEY, "captured_at", "odds"])

    def close(self) -> None:
        pass


class HighestVersions(StatefulProcessor):
    """Rows whose version is over every one of their key that the state remembers."""

    def __init__(self, version: str, keep_ms: int) -> None:
        self.version, self.keep = version, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "version long", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("captured_at", kind="stable")
        top = self.top.get()[0] if self.top.exists() else None
        before = new[self.version].cummax().shift()
        if top is not None:
            before = before.fillna(top).clip(lower=top)
        highest = int(new[self.version].max())
        self.top.update((highest if top is None else max(highest, top),))
        yield new[before.isna() | (new[self.version] > before)]

    def close(self) -> None:
        pass


class EmptyRuns(StatefulProcessor):
    """The length of the run of batches without fresh rows, and whether it fires: once a run."""

    def __init__(self, after: int) -> None:
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "streak long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        streak, out = self.streak.get()[0] if self.streak.exists() else 0, []
        for b, n in pd.concat(list(rows)).sort_values("batch", kind="stable")[["batch", "fresh"]].itertuples(index=False):
            streak = 0 if n > 0 else streak + 1
            out.append((key[0], b, streak, streak == self.after))
        self.streak.update((int(streak),))
        yield pd.DataFrame(out, columns=["source", "batch", "streak", "fires"])

    def close(self) -> None:
        pass


class SeenKeys(StatefulProcessor):
    """The first row of each key; a key is known for as long as its state lives."""

    def __init__(self, keep_ms: int) -> None:
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at timestamp", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("captured_at", kind="stable").head(1)
        known = self.seen.exists()
        if not known:
            self.seen.update((dt.datetime.now(),))
        yield new.iloc[:0] if known else new

    def close(self) -> None:
        pass


def changed(stream: DataFrame, *, keep_days: int = 3) -> DataFrame:
    """Rows whose price differs from the last one of their (event, book, selection); an event-time timer forgets a key without rows for some days."""
    rows = stream.select(*KEY, "captured_at", "odds").withWatermark("captured_at", f"{keep_days} days")
    return rows.groupBy(*KEY).transformWithStateInPandas(ChangedPrices(keep_days), schema_of(rows), "append", "EventTime")


def advanced(stream: DataFrame, key: list[str], *, version: str = "version", keep_days: float = 3) -> DataFrame:
    """Rows whose version is over every one seen of their key; what a key's highest was is forgotten some days after its last row."""
    return stream.groupBy(*key).transformWithStateInPandas(HighestVersions(version, int(keep_days * DAY)), schema_of(stream), "append", "ProcessingTime")


def empty_runs(batches: DataFrame, *, after: int) -> DataFrame:
    """Length of the run of batches without fresh rows, and whether it fires: once a run, at `after`. batches: source, batch, fresh."""
    return batches.groupBy("source").transformWithStateInPandas(EmptyRuns(after), "source string, batch long, streak long, fires boolean", "append", "None")


def unseen(stream: DataFrame, key: list[str], *, keep_ms: int = 7 * DAY) -> DataFrame:
    """The first row of each key; an alert that comes again within the time to live is none."""
    return stream.groupBy(*key).transformWithStateInPandas(SeenKeys(keep_ms), schema_of(stream), "append", "ProcessingTime")
