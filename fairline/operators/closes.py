"""Closes over sources: the last whole prices of each source before the start, by their freshness and rank, and picks graded by the best that can be trusted.

A source is a set of books, on the event itself or in an archive of its own whose events are found by
reference. Every source is judged by itself: its last capture must be near the start and its books must
price every selection; so a fresh soft book never lends its time to a stale sharp one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.devig import devig
from fairline.functions.odds import clv_log
from fairline.operators.market import TIME

#: Hours before the start within which a source's last capture must be.
GAP_HOURS = 4


def archived(archive: DataFrame, references: DataFrame, *, prefix: str) -> DataFrame:
    """The archive's quotes under our events' numbers. archive: ref and a quote's columns; references: event_id, ref without the prefix, null if none is known."""
    return archive.join(references.where("ref IS NOT NULL").select("event_id", F.concat(F.lit(prefix), F.col("ref").cast("string")).alias("ref")), "ref").drop("ref")


def source_closes(quotes: DataFrame, sources: dict[str, Column], *, keys: tuple[str, ...] = ("event_id", "key"), gap_hours: int = GAP_HOURS, method: str = "multiplicative") -> DataFrame:
    """(keys, source, sel_idx, fair, at): chances without margin of each source's close, of the first of its books by name that is fresh and whole, with prices over 1.

    quotes: keys, book, sel_idx, odds, captured_at, kickoff and the order's l_orderkey, l_linenumber; sources: a condition on a quote's book, each. The last
    capture before the start counts, of quotes that tie on time and order the one with the highest odds; a market has as many selections as any book has
    priced by then.
    """
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in sources.items())))
    last = quotes.where("captured_at <= kickoff").groupBy(*keys, F.lower(F.trim("book")).alias("book"), "sel_idx").agg(F.max_by("odds", F.struct(*TIME)).alias("odds"), F.max("captured_at").alias("at"), F.any_value("kickoff").alias("kickoff"))
    width = last.groupBy(*keys).agg(F.count_distinct("sel_idx").alias("width"))
    books = last.groupBy(*keys, "book").agg(F.array_sort(F.collect_list(F.struct("sel_idx", "odds"))).alias("legs"), F.max("at").alias("at"), F.any_value("kickoff").alias("kickoff")).join(width, list(keys))
    fresh = F.unix_seconds(F.col("kickoff").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp")) <= gap_hours * 3600
    usable = F.forall("legs", lambda x: x["odds"] > 1)
    whole = books.where(fresh & (F.size("legs") == F.col("width")) & (F.col("width") >= 2) & usable).withColumn("source", F.explode(named))
    first = whole.groupBy(*keys, "source").agg(F.min_by(F.struct("legs", "at"), "book").alias("b")).select(*keys, "source", "b.*")
    fair = first.withColumn("d", devig(F.transform("legs", lambda x: x["odds"]), method)).where("d IS NOT NULL")
    return fair.select(*keys, "source", "at", F.explode(F.arrays_zip(F.transform("legs", lambda x: x["sel_idx"]).alias("sel_idx"), F.col("d.fair").alias("fair"))).alias("l")).select(*keys, "source", "l.sel_idx", "l.fair", "at")


def graded_by_close(picks: DataFrame, closes: list[DataFrame], ranking: list[str], *, keys: tuple[str, ...] = ("event_id", "key")) -> DataFrame:
    """picks (keys, sel_idx, book, odds) with close_source, close_fair, close_at and clv by the first source of the ranking that has a close and is not the pick's own book; tried: the sources with a close."""
    every = closes[0]
    for c in closes[1:]:
        every = every.unionByName(c)
    rank = F.coalesce(*(F.when(F.col("source") == n, F.lit(i)) for i, n in enumerate(ranking)))
    met = picks.select(*keys, "sel_idx", "book").join(every, [*keys, "sel_idx"]).where(F.lower(F.trim("book")) != F.col("source")).withColumn("rank", rank).where("rank IS NOT NULL")
    best = met.groupBy(*keys, "sel_idx", "book").agg(F.min_by(F.struct(F.col("source").alias("close_source"), F.col("fair").alias("close_fair"), F.col("at").alias("close_at")), "rank").alias("c"), F.array_sort(F.collect_set("source")).alias("tried"))
    return picks.join(best, [*keys, "sel_idx", "book"], "left").select(*picks.columns, "c.*", "tried").withColumn("clv", clv_log(F.col("odds"), F.col("close_fair")))
