"""Backtests over matches with an anchor's and the best prices: candidates, one bet a market, sweeps, cells and training windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.devig import devig
from fairline.functions.odds import clv_log, edge, expected_value, kelly_fraction, odds_band
from fairline.operators.reports import ratio


def candidates(matches: DataFrame, method: str = "power", *, floor: float | None = None) -> DataFrame:
    """A row a selection: fair chance by the anchor, edge of the best price, the close's fair chance, and whether it won.

    matches: match_id, sharp, best, close (arrays of prices in order of the selections) and result (a
    selection's number, null if unknown). Matches without a full anchor have none. floor: the least edge kept.
    """
    m = matches.withColumn("d", devig(F.col("sharp"), method)).withColumn("c", devig(F.col("close"), method)).where("d IS NOT NULL")
    legs = m.select(*matches.columns, F.col("d.fell_back").alias("fell_back"), F.size("sharp").alias("width"), F.posexplode(F.arrays_zip(F.col("d.fair").alias("fair"), "best", F.coalesce(F.col("c.fair"), F.transform("best", lambda x: F.lit(None).cast("double"))).alias("close_fair"))).alias("pick", "l"))
    c = legs.select(*matches.columns, "fell_back", "width", "pick", F.col("l.fair").alias("fair"), F.col("l.best").alias("odds"), F.col("l.close_fair").alias("close_fair")).drop("sharp", "close", "best")
    c = c.where("odds > 1").withColumns({"edge": edge(F.col("fair"), F.col("odds")), "ev": expected_value(F.col("fair"), F.col("odds")), "clv": clv_log(F.col("odds"), F.col("close_fair")), "won": (F.col("result") == F.col("pick")).cast("double")})
    c = c.withColumns({"unit": F.when(F.col("won") == 1, F.col("odds") - 1).when(F.col("won") == 0, -1.0), "kind": selection_type(F.col("fair"), F.col("pick"), F.col("width")), "band": odds_band(F.col("odds"))})
    return c if floor is None else c.where(F.col("edge") >= floor)


def selection_type(fair: Column, pick: Column, width: Column) -> Column:
    """draw, or favourite or underdog by the fair chance."""
    return F.when((width == 3) & (pick == 1), "draw").when(fair >= 0.5, "favourite").otherwise("underdog")


def bets_for(cands: DataFrame, threshold: float | Column, *, min_odds: float = 1.2, max_odds: float | None = None, by: tuple[str, ...] = ("match_id",), score: str = "edge") -> DataFrame:
    """One bet a market: the largest edge (or score) among selections in the price band that reach the threshold, the first if equal."""
    good = cands.where((F.col(score) >= threshold) & (F.col("odds") >= min_odds) & (F.col("odds") <= max_odds if max_odds else F.lit(True)))
    rest = [c for c in cands.columns if c not in by]
    return good.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col("pick"))).alias("b")).select(*by, "b.*")


def bet_stats() -> list[Column]:
    """Aggregates of bets: how many, hits, return, closing value with its error, and the share that beat the close."""
    n = F.count("clv")
    return [
        F.count("unit").alias("n"), F.round(F.avg("won"), 6).alias("hit"), F.round(ratio(F.sum("unit"), F.count("unit")), 6).alias("roi"), F.round(F.avg("clv"), 6).alias("clv"),
        F.round(F.when(n >= 2, F.stddev_samp("clv") / F.sqrt(n)), 6).alias("clv_se"), F.round(F.when(n > 0, F.stddev_pop("clv") / F.sqrt(n)), 6).alias("clv_se_pop"), F.round(F.avg((F.col("clv") > 0).cast("int")), 6).alias("beat"),
    ]


def swept(cands: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """Statistics of the bets at every threshold, in one pass: each candidate counts at those it reaches."""
    rows = cands.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    bets = bets_for(rows, F.col("threshold"), by=("match_id", "threshold", *by))
    return bets.groupBy(*by, "threshold").agg(*bet_stats())


def chosen_point(sweep: DataFrame, by: list[str], *, least: int, order: tuple[str, ...] = ("roi",), fallback: float | None = None) -> DataFrame:
    """The best row of a sweep by its order among those with enough bets, the lowest threshold if equal; the fallback where none has."""
    fits = F.col("n") >= least
    best = sweep.groupBy(*by).agg(F.max_by("threshold", F.when(fits, F.struct(*(F.coalesce(F.col(c), F.lit(-9.0)) for c in order), -F.col("threshold")))).alias("threshold"), F.max(F.when(fits, 1)).alias("viable"))
    return best.withColumn("threshold", F.coalesce("threshold", F.lit(fallback))).withColumn("viable", F.col("viable").isNotNull())


def operating_point(points: DataFrame, *, least: int) -> DataFrame:
    """The point with the best return whose bets are enough and whose closing value is over two errors."""
    return points.where((F.col("n") >= least) & (F.col("clv") - 2 * F.col("clv_se") > 0)).orderBy(F.desc("roi"), "threshold").limit(1)


def cell_bets(cands: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Bets under each cell's own threshold. cells: by, threshold; they are few and broadcast, so no cell's candidates go to one task."""
    return bets_for(cands.join(F.broadcast(cells.select(*by, F.col("threshold").alias("cell_threshold"))), by).withColumn("over", F.col("edge") - F.col("cell_threshold")).where("over >= 0"), -9.0)


def settled_at(bets: DataFrame, odds: str) -> DataFrame:
    """The same bets settled at another price."""
    price = F.col(odds)
    return bets.withColumn("unit", F.when(price > 1, F.when(F.col("won") == 1, price - 1).when(F.col("won") == 0, -1.0))).withColumn("clv", clv_log(price, F.col("close_fair")))


def verdict(n: Column, clv: Column, se: Column, low: Column, base_clv: Column, *, least: int = 150) -> Column:
    """What a test says by its rules: too few, no close, no better than betting all, proven or promising."""
    return (
        F.when(n < least, "too few bets").when(clv.isNull(), "no closing line").when(clv <= base_clv, "no better than all")
        .when((clv - 2 * se > 0) & (low > 0), "proven").when(clv > 0, "promising").otherwise("negative")
    )


def bankroll(bets: DataFrame, *, starting: float = 1.0, fraction: float = 0.25, cap: float = 0.02, order: list[str], by: list[str]) -> DataFrame:
    """Compounded bankroll with Kelly's stakes: wealth after each bet, its peak and fall; a bet without a result leaves it."""
    share = F.least(kelly_fraction(F.col("fair"), F.col("odds")) * fraction, F.lit(cap))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    b = bets.withColumn("stake_share", share).withColumn("wealth", starting * F.exp(F.sum(F.log(1 + F.col("stake_share") * F.coalesce("unit", F.lit(0.0)))).over(w)))
    b = b.withColumn("peak", F.greatest(F.lit(starting), F.max("wealth").over(w)))
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("staked", F.when(F.col("unit").isNotNull(), F.col("stake_share") * F.coalesce(F.last("wealth").over(before), F.lit(starting))))
    return b.withColumn("drawdown", (F.col("peak") - F.col("wealth")) / F.col("peak"))


def bankroll_summary(path: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Bets, return on turnover, last wealth and the worst fall of each path."""
    return path.groupBy(*by).agg(
        F.count("unit").alias("n"), F.round(ratio(F.sum(F.col("staked") * F.col("unit")), F.sum("staked")), 6).alias("roi"), F.round(F.max_by("wealth", F.struct(*order)), 6).alias("final"), F.round(F.max("drawdown"), 6).alias("drawdown"),
    )


def epochs(matches: DataFrame, first: Column, *, every_days: int = 7) -> DataFrame:
    """matches with the day of the model that scores them: the last refit at or before, every so many days from the first."""
    days = F.datediff(F.col("played"), first)
    return matches.withColumn("epoch", F.when(days >= 0, F.date_add(first, (F.floor(days / every_days) * every_days).cast("int"))))


def training_rows(matches: DataFrame, refits: DataFrame, *, window_days: int = 540, by: tuple[str, ...] = ()) -> DataFrame:
    """(epoch, match): what each refit may see, strictly before its day and within the window. refits: epoch and by, whose values must agree.

    Matches meet refits by blocks of the window's length, so no pair outside two neighbouring blocks is formed.
    """
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / window_days)
    ends = refits.select(*by, "epoch", F.explode(F.array(block(F.col("epoch")) - 1, block(F.col("epoch")))).alias("block"))
    inside = matches.withColumn("block", block(F.col("played"))).join(ends, ["block", *by])
    return inside.where((F.col("played") < F.col("epoch")) & (F.datediff("epoch", "played") <= window_days)).drop("block")
