"""Ordered operators over price histories."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.odds import time_bucket

KEY = ["event_id", "book_id", "sel_idx"]
ORDER = ["captured_at", "l_orderkey", "l_linenumber"]


def price_changes(book: DataFrame) -> DataFrame:
    """Only the rows whose price differs from the one before of the same (event, book, selection)."""
    before = F.lag("odds").over(Window.partitionBy(*KEY).orderBy(*ORDER))
    return book.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("odds")))


def movement(book: DataFrame) -> DataFrame:
    """Open, close, lowest, highest and number of prices of each series up to kickoff."""
    at = F.struct(*ORDER)
    return book.where("captured_at <= kickoff").groupBy(*KEY).agg(
        F.min_by("odds", at).alias("open"), F.max_by("odds", at).alias("close"), F.min("odds").alias("low"), F.max("odds").alias("high"), F.count("*").alias("prices")
    )


def steam(book: DataFrame, *, lookback_days: int = 60, least_points: int = 2) -> DataFrame:
    """Implied probability at the first and last price within the lookback before kickoff, and the move between them."""
    recent = book.where(F.expr(f"captured_at <= kickoff AND captured_at >= timestampadd(DAY, -{lookback_days}, kickoff) AND odds > 1"))
    at = F.struct(*ORDER)
    ends = recent.groupBy(*KEY).agg(F.min_by("odds", at).alias("first"), F.max_by("odds", at).alias("last"), F.count("*").alias("points")).where(F.col("points") >= least_points)
    return ends.withColumn("move", 1 / F.col("last") - 1 / F.col("first"))


def drift_by_bucket(book: DataFrame) -> DataFrame:
    """ln(close/then) of the rows before each series' close, averaged by time before the start."""
    close = Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in ORDER])
    rows = book.where("captured_at <= kickoff").withColumn("rn", F.row_number().over(close)).withColumn("close", F.first("odds").over(close)).where("rn > 1")
    hours = F.expr("timestampdiff(HOUR, captured_at, kickoff)")
    return rows.withColumn("bucket", time_bucket(hours)).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg(F.log(F.col("close") / F.col("odds"))), 6).alias("drift"))


def rolling_form(matches: DataFrame, sizes: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Means of a team's goals over its last matches, strictly before each one, home and away together."""
    sides = [("home", "away"), ("away", "home")]
    long = None
    for own, other in sides:
        part = matches.select("match_id", "played", F.col(own).alias("team"), F.lit(own).alias("side"), F.col(f"{own}_goals").alias("scored"), F.col(f"{other}_goals").alias("conceded"))
        long = part if long is None else long.unionByName(part)
    w = Window.partitionBy("team").orderBy("played", "match_id")
    for n in sizes:
        for c in ("scored", "conceded"):
            long = long.withColumn(f"{c}_r{n}", F.avg(c).over(w.rowsBetween(-n, -1)))
    return long


def dead_man(batches: DataFrame, after: int) -> DataFrame:
    """Length of the run of empty batches up to each one, and whether it fires: once a run, at `after`."""
    runs = F.sum(F.when(F.col("fresh") > 0, 1).otherwise(0)).over(Window.partitionBy("source").orderBy("batch"))
    w = Window.partitionBy("source", "run").orderBy("batch")
    streak = F.when(F.col("fresh") > 0, 0).otherwise(F.sum(F.when(F.col("fresh") > 0, 0).otherwise(1)).over(w))
    return batches.withColumn("run", runs).withColumn("streak", streak).withColumn("fires", F.col("streak") == after)
