"""Writes that depend on what is there: upserts, ratchets, get-or-create dimensions and change-only capture."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_picks(kept: DataFrame, incoming: DataFrame, key: tuple[str, ...], *, closing: tuple[str, ...] = ()) -> DataFrame:
    """One row a key and version with what happened to it: inserted, upgraded (volume to premium, with the new stake), duplicate or kept.

    Both: key, version, tier, stake, odds, seq, status, and what is known of the close, by the names of closing. Only an alerted row is
    upgraded; what its close said was of the old price, so an upgrade has none, as a new row has none. A premium row is never overwritten by a volume one; of several rows of a
    side the best tier counts, then the first. superseded: a newer version of the key is there; a volume row
    supersedes only volume rows.
    """
    rank = F.when(F.col("tier") == "premium", 1).otherwise(0)
    best = lambda side: F.max_by(F.struct("stake", "odds", "status", *closing, rank.alias("rank")), F.when(F.col("side") == side, F.struct(rank, -F.col("seq"))))
    both = kept.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1))).groupBy(*key, "version").agg(best(0).alias("old"), best(1).alias("new"))
    outcome = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when((F.col("new.rank") > F.col("old.rank")) & (F.col("old.status") == "alerted"), "upgraded").otherwise("duplicate")
    taken = F.when(F.col("outcome").isin("inserted", "upgraded"), F.col("new")).otherwise(F.col("old"))
    out = both.withColumn("outcome", outcome).withColumn("p", taken)
    of_key = Window.partitionBy(*key)
    newest, newest_premium = F.max("version").over(of_key), F.max(F.when(F.col("p.rank") == 1, F.col("version"))).over(of_key)
    newer = (newest > F.col("version")) & ((F.col("p.rank") == 0) | (newest_premium > F.col("version")))
    return out.select(*key, "version", F.when(F.col("p.rank") == 1, "premium").otherwise("volume").alias("tier"), "p.stake", "p.odds", *(F.when(F.col("outcome").isin("kept", "duplicate"), F.col(f"old.{c}")).alias(c) for c in closing), "outcome", F.coalesce(newer, F.lit(False)).alias("superseded"))


def with_stakes(picks: DataFrame, granted: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """picks with the stake that the ledger granted, where it did. granted: key, stake."""
    return picks.join(granted.withColumnRenamed("stake", "granted"), list(key), "left").withColumn("stake", F.coalesce("granted", "stake")).drop("granted")


def appended(kept: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The incoming rows that are not there yet: the first of each key, none whose key is kept."""
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c not in key]), F.struct(*order)).alias("r")).select(*key, "r.*")
    return first.join(kept.select(*key), key, "left_anti")


def get_or_create(dimension: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """dimension (id, key) with a row for every new key; ids follow from the key, so a rerun gives the same and parallel writers agree."""
    new = incoming.select(*key).dropDuplicates().join(dimension, key, "left_anti")
    return dimension.select("id", *key).unionByName(new.select(F.xxhash64(*key).alias("id"), *key))


def attached(rows: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Only the rows of events that exist."""
    return rows.join(events.select(*key), key, "left_semi")


def changed_only(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before of their key, nulls included."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    return rows.withColumn("fresh", first | ~before.eqNullSafe(F.col(value))).where("fresh").drop("fresh")


def advanced_only(rows: DataFrame, key: list[str], order: list[str], version: str) -> DataFrame:
    """Rows whose version is over all before of their key."""
    top = F.max(version).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("top", top).where(F.col("top").isNull() | (F.col(version) > F.col("top"))).drop("top")


def alert_key(*parts: Column) -> Column:
    """What makes an alert the same one, whatever row it came from."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def alert_text(event: Column, selection: Column, book: Column, odds: Column, edge: Column) -> Column:
    """One line for people."""
    return F.format_string("%s: %s at %.2f (%s), edge %.1f%%", event, selection, odds, book, edge * 100)
