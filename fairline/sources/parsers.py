"""Files of other sources as DataFrames: season tables, price histories, odds matrices, American prices."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions.odds import american_to_decimal, parsed_odds

#: Columns of a season's table: our name, theirs. Fixed values.
PRICES = {f"{ours}_{side.lower()}": f"{theirs}{side}" for ours, theirs in (("soft", "B365"), ("sharp", "PS"), ("best", "Max"), ("sharp_close", "PSC"), ("best_close", "MaxC")) for side in "HDA"}
#: Hours in an odds matrix; its columns are those of home, then draw, then away.
HOURS = 72


def played_on(text: Column) -> Column:
    """A date with a four- or two-digit year, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("dd/MM/yyyy", "dd/MM/yy"))).cast("date")


def whole(text: Column) -> Column:
    """A whole number of digits alone, else null."""
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int"))


def season_matches(spark: SparkSession, path: str) -> DataFrame:
    """Matches of season tables: rows without sides, date or whole goals are left out; absent price columns are null."""
    raw = spark.read.csv(path, header=True)
    price = lambda c: parsed_odds(F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("double")
    rows = raw.select(
        played_on(F.col("Date")).alias("played"), F.trim("HomeTeam").alias("home"), F.trim("AwayTeam").alias("away"), whole(F.col("FTHG")).alias("home_goals"), whole(F.col("FTAG")).alias("away_goals"),
        *(price(theirs).alias(ours) for ours, theirs in PRICES.items()),
    )
    return rows.where("played IS NOT NULL AND home <> '' AND away <> '' AND home_goals IS NOT NULL AND away_goals IS NOT NULL")


def history_open_close(histories: DataFrame) -> DataFrame:
    """histories with open and close: the first and last active price over 1 of the JSON array `entries`."""
    entries = F.from_json("entries", "array<struct<createdAt: string, price: double, active: boolean>>")
    good = F.array_sort(F.transform(F.filter(entries, lambda e: e["active"] & (e["price"] > 1)), lambda e: F.struct(e["createdAt"].alias("at"), e["price"].alias("price"))))
    return histories.withColumn("open", F.try_element_at(good, F.lit(1))["price"]).withColumn("close", F.try_element_at(good, F.lit(-1))["price"])


def matrix_triples(matrices: DataFrame) -> DataFrame:
    """(match_id, book, hour, home, draw, away) where a book prices all three at an hour; matrices: match_id, text of one line a book."""
    lines = matrices.select("match_id", F.posexplode(F.split("text", "\n")).alias("book", "line")).withColumn("cells", F.split("line", r"[,\s]+"))
    at = lambda side: parsed_odds(F.get("cells", F.col("hour") + side * HOURS))
    hours = lines.select("match_id", "book", "cells", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hour"))
    return hours.select("match_id", "book", "hour", *(at(i).alias(n) for i, n in enumerate(("home", "draw", "away")))).where("home IS NOT NULL AND draw IS NOT NULL AND away IS NOT NULL")


def american(price: Column) -> Column:
    """An American price of at least 100 either way, as a decimal one."""
    return F.when(F.abs(price) >= 100, american_to_decimal(price))
