"""Models as a source of chances beside the anchors: their predictions joined to quotes, gated and sized."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions.devig import devig
from fairline.functions.odds import expected_value, recommended_stake, stake_amount
from fairline.operators.goals import chance, score_grid

#: What every model gives: a chance for each selection of an event's market, and how sure it is of the event.
PREDICTION = "event_id long, key string, sel_idx int, probability double, confidence double"


def null_model(spark: SparkSession) -> DataFrame:
    """The model that predicts nothing, so nothing is picked."""
    return spark.createDataFrame([], PREDICTION)


def grid_model(expectancies: DataFrame, *, line: float = 2.5, rho: float = -0.06) -> DataFrame:
    """Predictions of the goals model for the result and the goals line. expectancies: event_id, home_exp, away_exp, confidence.

    Events share their grid with all others of the same expectancies, so each grid is made once.
    """
    grids = expectancies.select("home_exp", "away_exp").distinct().withColumn("g", score_grid(F.col("home_exp"), F.col("away_exp"), F.lit(rho)))
    cells = [("1x2", 0, lambda h, a: h > a), ("1x2", 1, lambda h, a: h == a), ("1x2", 2, lambda h, a: h < a), (f"over_under_{str(line).replace('.', '_')}", 0, lambda h, a: h + a > line), (f"over_under_{str(line).replace('.', '_')}", 1, lambda h, a: h + a < line)]
    rows = grids.select("home_exp", "away_exp", F.explode(F.array(*(F.struct(F.lit(key).alias("key"), F.lit(i).alias("sel_idx"), chance(F.col("g"), won).alias("probability")) for key, i, won in cells))).alias("c"))
    return expectancies.join(rows, ["home_exp", "away_exp"]).select("event_id", "c.key", "c.sel_idx", "c.probability", "confidence")


def model_candidates(predictions: DataFrame, markets: DataFrame, *, books: str = "close", method: str = "multiplicative") -> DataFrame:
    """A row a prediction and book: the model's chance against what the book's own prices say without their margin.

    markets: rows of market.with_anchor(), with the books' last captures. Only books that price the whole market have own chances.
    """
    each = markets.select("event_id", "key", "sels", F.col(books).alias("books"), F.explode("full").alias("b"))
    at = F.array_max(F.transform(F.filter("books", lambda x: x["norm"] == F.col("b.norm")), lambda x: x["at"]))
    legs = each.withColumn("at", at).withColumn("d", devig(F.col("b.gross"), method)).where("d IS NOT NULL").select("event_id", "key", F.col("b.book").alias("book"), "at", F.explode(F.arrays_zip("sels", F.col("d.fair").alias("fair"), F.col("b.gross").alias("gross"))).alias("l"))
    legs = legs.select("event_id", "key", "book", "at", F.col("l.sels").cast("int").alias("sel_idx"), F.col("l.fair").alias("book_fair"), F.col("l.gross").alias("odds"))
    joined = legs.join(predictions, ["event_id", "key", "sel_idx"])
    return joined.withColumns({"edge": F.col("probability") - F.col("book_fair"), "ev": expected_value(F.col("probability"), F.col("odds"))})


def model_picks(candidates: DataFrame, age_hours: Column, *, min_edge: float = 0.02, min_ev: float = 0.0, min_probability: float = 0.1, max_odds: float = 8.0, min_confidence: float = 0.6, max_age_hours: float = 48.0, bankroll: float = 1000.0) -> DataFrame:
    """The candidates that pass every gate, with stakes; a model's picks have one tier. A candidate without a capture time is stale."""
    gates = (F.col("edge") >= min_edge) & (F.col("ev") > min_ev) & (F.col("probability") >= min_probability) & (F.col("odds") <= max_odds) & (F.col("confidence") >= min_confidence) & F.coalesce(age_hours <= max_age_hours, F.lit(False))
    stake = recommended_stake(F.col("probability"), F.col("odds"))["final"]
    return candidates.where(gates).withColumn("fraction", stake).withColumns({"stake": stake_amount(F.col("fraction"), bankroll).cast("double"), "tier": F.lit("premium")})
