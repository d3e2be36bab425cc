"""The odds book as derived from the driver's order lines, in Spark and in DuckDB SQL.

Both sides use the same integer arithmetic: event, book and selection from keys, the price
from a probability by event, a margin by book and a small deterministic noise.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Book names by number; fixed values of the test bridge.
BOOKS = ("pinnacle", "bet365", "unibet", "betfair exchange", "bwin", "matchbook", "ladbrokes")
SELECTIONS = ("home", "draw", "away")
EVENTS = 300

ODDS_SQL = """
  SELECT event_id, book_id, ['pinnacle','bet365','unibet','betfair exchange','bwin','matchbook','ladbrokes'][book_id + 1] AS book, sel_idx, ['home','draw','away'][sel_idx + 1] AS selection,
         round(CAST(1e0 / (CASE sel_idx WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE 1e0 - w0 - w1 END * (1.02e0 + 0.01e0 * book_id)) * (1e0 + (noise - 20) / 250e0) AS DOUBLE), 4) AS odds,
         captured_at, kickoff, liquidity, l_orderkey, l_linenumber
  FROM (SELECT *, 0.30e0 + 0.20e0 * ((event_id * 37) % 100) / 100e0 AS w0, 0.22e0 + 0.08e0 * ((event_id * 53) % 100) / 100e0 AS w1,
               TIMESTAMP '1996-01-01' + INTERVAL 1 DAY * CAST(event_id * 2 AS INTEGER) AS kickoff
        FROM (SELECT l_partkey % 300 AS event_id, l_suppkey % 7 AS book_id, l_linenumber % 3 AS sel_idx, l_shipdate AS captured_at,
                     (7 * l_partkey + l_orderkey) % 41 AS noise, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity * 10 END AS liquidity, l_orderkey, l_linenumber FROM lineitem))
"""
#: Common table expressions that the oracles begin with: every observation, and the state at kickoff.
BOOK_CTE = f"""
book AS ({ODDS_SQL}),
state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, book_id, sel_idx ORDER BY captured_at DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM book WHERE captured_at <= kickoff) WHERE rn = 1),
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def odds_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price observation: event_id, book_id, book, sel_idx, selection, odds, captured_at, kickoff, liquidity and the observation's key."""
    event, book, sel = F.col("event_id"), F.col("book_id"), F.col("sel_idx")
    keys = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % EVENTS).alias("event_id"), (F.col("l_suppkey") % 7).alias("book_id"), (F.col("l_linenumber") % 3).alias("sel_idx"),
        F.col("l_shipdate").alias("captured_at"), ((7 * F.col("l_partkey") + F.col("l_orderkey")) % 41).alias("noise"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity") * 10).alias("liquidity"), "l_orderkey", "l_linenumber",
    )
    w0, w1 = 0.30 + 0.20 * ((event * 37) % 100) / 100.0, 0.22 + 0.08 * ((event * 53) % 100) / 100.0
    p = F.when(sel == 0, w0).when(sel == 1, w1).otherwise(1.0 - w0 - w1)
    odds = F.round(1.0 / (p * (1.02 + 0.01 * book)) * (1.0 + (F.col("noise") - 20) / 250.0), 4)
    names = F.array(*map(F.lit, BOOKS)), F.array(*map(F.lit, SELECTIONS))
    return keys.select(
        "event_id", "book_id", names[0][book].alias("book"), "sel_idx", names[1][sel].alias("selection"), odds.alias("odds"), "captured_at",
        F.expr("timestampadd(DAY, CAST(event_id * 2 AS INT), TIMESTAMP_NTZ'1996-01-01 00:00:00')").alias("kickoff"), "liquidity", "l_orderkey", "l_linenumber",
    )


def finals(spark: SparkSession) -> DataFrame:
    """A final score of every event."""
    event = F.col("id")
    return spark.range(EVENTS).select(event.alias("event_id"), ((event * 7 + 3) % 5).cast("int").alias("home_score"), ((event * 11 + 1) % 4).cast("int").alias("away_score"))


FINALS_CTE = "finals AS (SELECT range AS event_id, CAST((range * 7 + 3) % 5 AS INTEGER) AS home_score, CAST((range * 11 + 1) % 4 AS INTEGER) AS away_score FROM range(300)),"
