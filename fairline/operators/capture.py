"""Reports on what was captured: coverage, available games, capture targets, completeness and anomalies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.keys import covered, family_of
from fairline.functions.odds import normal_book

MONEY_LINES = ("1x2", "home_away")


def line_width(sport: Column) -> Column:
    """Selections of a whole money line."""
    return F.when(sport == "soccer", 3).otherwise(2)


def upcoming(quotes: DataFrame, now: Column, until: Column) -> DataFrame:
    return quotes.where((F.col("kickoff") > now) & (F.col("kickoff") <= until))


def coverage(quotes: DataFrame, now: Column, until: Column, *, sharp: str = "pinnacle", exchange: str = "betfair exchange") -> DataFrame:
    """Of upcoming events, by sport and in all (sport null): with the sharp book, with the exchange's whole money line, rates, and a headline."""
    book = normal_book(F.col("book"))
    leg = F.when((book == exchange) & F.col("key").isin(*MONEY_LINES), F.concat_ws("|", "key", "sel_idx"))
    events = upcoming(quotes, now, until).groupBy("event_id", "sport").agg(F.bool_or(book == sharp).alias("sharp"), F.count_distinct(leg).alias("legs"))
    whole = F.col("legs") >= line_width(F.col("sport"))
    n = F.count("*")
    out = events.groupingSets([["sport"], []], "sport").agg(n.alias("events"), F.count_if("sharp").alias("with_sharp"), F.count_if(whole).alias("with_exchange"))
    rate = lambda c: F.round(F.col(c) / F.nullif(F.col("events"), F.lit(0)), 6)
    out = out.withColumns({"sharp_rate": rate("with_sharp"), "exchange_rate": rate("with_exchange")})
    return out.withColumn("headline", F.format_string("%d events, sharp %s%%, exchange %s%%", F.col("events"), F.bround(F.col("sharp_rate") * 100).cast("int").cast("string"), F.bround(F.col("exchange_rate") * 100).cast("int").cast("string")))


def available(quotes: DataFrame) -> DataFrame:
    """By event: distinct markets and books in order, first and last capture, number of quotes."""
    return quotes.groupBy("event_id", "sport").agg(
        F.array_sort(F.collect_set("key")).alias("markets"), F.array_sort(F.collect_set(normal_book(F.col("book")))).alias("books"), F.min("captured_at").alias("first"), F.max("captured_at").alias("last"), F.count("*").alias("n"),
    )


def targets(quotes: DataFrame, now: Column, until: Column, *, prefix: str = "betfair", limit: int) -> DataFrame:
    """The next events to capture from a book: priced by another one, never captured first, then the longest ago, the earliest start, the id."""
    own = normal_book(F.col("book")).startswith(prefix)
    events = upcoming(quotes, now, until).groupBy("event_id").agg(F.max(F.when(own, F.col("captured_at"))).alias("captured"), F.count_if(~own).alias("others"), F.any_value("kickoff").alias("kickoff")).where("others > 0")
    return events.orderBy(F.asc_nulls_first("captured"), "kickoff", "event_id").limit(limit)


def completeness(rows: DataFrame, markets: tuple[str, ...], *, floor: float = 0.5) -> DataFrame:
    """By cycle: rows, those of the cycle before, whether they collapsed, and the wanted markets without any line.

    A cycle is one row, so the order of cycles is one small sort.
    """
    cycles = rows.groupBy("cycle").agg(F.count("*").alias("n"), F.collect_set("key").alias("keys"))
    missing = F.array_compact(F.array(*(F.when(~covered(m, F.col("keys")), m) for m in markets)))
    found = cycles.withColumn("prev", F.lag("n").over(Window.orderBy("cycle")))
    return found.select("cycle", "n", "prev", F.coalesce(F.col("n") < floor * F.col("prev"), F.lit(False)).alias("collapsed"), F.array_join(missing, ",").alias("missing"))


def per_market(rows: DataFrame) -> DataFrame:
    """Quotes by family and line."""
    return rows.groupBy(family_of(F.col("key")).alias("family"), "key").agg(F.count("*").alias("n"))


def anomalies(state: DataFrame, *, backlog: int = 50, stale_hours: float = 2.0) -> DataFrame:
    """Alarms of one row of counts: awaiting (picks without a result), newest (time of the last quote), now."""
    late = F.col("newest").isNull() | (F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("newest").cast("timestamp")) > stale_hours * 3600)
    found = F.array_compact(F.array(F.when(F.col("awaiting") > backlog, F.struct(F.lit("settlement_backlog").alias("code"), F.lit("WARN").alias("level"))), F.when(late, F.struct(F.lit("stale_odds").alias("code"), F.lit("ERROR").alias("level")))))
    return state.select(F.explode(found).alias("a")).select("a.*")
