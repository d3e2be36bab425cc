"""Movement of prices before a start: trajectories, steam verdicts, drift by time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.odds import normal_book, time_bucket
from fairline.operators.market import TIME


def trajectories(quotes: DataFrame, now: Column, *, hours: float, keys: tuple[str, ...], history: DataFrame | None = None) -> DataFrame:
    """Per (market, selection, book) its first and last price within the hours before now, how many, and the last one's time.

    history: earlier quotes to join in. Nothing after now takes part, nor prices of 1 or less. The ends are aggregated map-side,
    so a series is never gathered.
    """
    rows = quotes if history is None else quotes.unionByName(history.select(*quotes.columns))
    inside = rows.where((F.col("captured_at") <= now) & (F.col("captured_at") >= now - F.expr(f"INTERVAL {int(hours * 3600)} SECOND")) & (F.col("odds") > 1))
    at = F.struct(*TIME)
    return inside.groupBy(*keys, "sel_idx", normal_book(F.col("book")).alias("norm")).agg(
        F.min_by(1 / F.col("odds"), at).alias("first"), F.max_by(1 / F.col("odds"), at).alias("last"), F.count("*").alias("points"), F.max("captured_at").alias("at"), F.any_value("kickoff").alias("kickoff"),
    )


def verdicts(
    t: DataFrame, fill: str, anchor: str, now: Column, *, keys: tuple[str, ...], stale_seconds: float = 7200, steam: float = 0.04, close_fraction: float = 0.5, least_gap: float = 0.01, least_points: int = 2, demote_on_steam: bool = False,
) -> DataFrame:
    """What the fill book's and the anchor's trajectories say of a price: stale (no anchor price, or an old one), toward (the gap to the anchor has closed), steamed (running away), tripped.

    fill, anchor: normal names of books.
    """
    ours = t.where(F.col("norm") == fill)
    theirs = t.where(F.col("norm") == anchor).select(*keys, "sel_idx", F.col("first").alias("anchor_first"), F.col("last").alias("anchor_last"), F.col("at").alias("anchor_at"))
    both = ours.join(theirs, [*keys, "sel_idx"], "left")
    enough, gap, left = F.col("points") >= least_points, F.col("anchor_first") - F.col("first"), F.col("anchor_last") - F.col("last")
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("anchor_at").cast("timestamp"))
    closed = F.when(enough & (gap >= least_gap), (gap - left) / gap)
    out = both.withColumns({"anchor_age": age, "closed_fraction": closed, "soft_move": F.when(enough, F.col("last") - F.col("first")), "stale": age.isNull() | (age > stale_seconds)})
    toward, steamed = F.coalesce((F.col("closed_fraction") >= close_fraction) & (left < gap), F.lit(False)), F.coalesce(-F.col("soft_move") >= steam, F.lit(False))
    return out.withColumns({"toward": toward, "steamed": steamed}).withColumn("tripped", F.col("toward") | F.col("stale") | (F.col("steamed") & F.lit(demote_on_steam)))


def qualified(quotes: DataFrame, *, keys: tuple[str, ...], gap_hours: int = 4) -> DataFrame:
    """Quotes of markets that are quoted at two times at least and to within the gap of the start."""
    before = quotes.where("captured_at <= kickoff")
    good = before.groupBy(*keys).agg(F.countDistinct("captured_at").alias("times"), F.max("captured_at").alias("last"), F.any_value("kickoff").alias("start")).where(f"times >= 2 AND last >= timestampadd(HOUR, -{gap_hours}, start)")
    return before.join(good.select(*keys), list(keys), "left_semi")


def drift_by_bucket(quotes: DataFrame, *, keys: tuple[str, ...]) -> DataFrame:
    """ln(close/then) of every price but the closing one, averaged by time before the start."""
    series = Window.partitionBy(*keys, "book_id", "sel_idx").orderBy(*[F.desc(c) for c in TIME])
    rows = quotes.where("captured_at <= kickoff").withColumn("back", F.row_number().over(series)).withColumn("close", F.first("odds").over(series)).where("back > 1")
    hours = F.expr("timestampdiff(HOUR, captured_at, kickoff)")
    return rows.groupBy(time_bucket(hours).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.log(F.col("close") / F.col("odds"))), 6).alias("drift"))
