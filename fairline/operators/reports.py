"""Headline, significance and calibration reports: grouped sums, no rows at the driver."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of a share; null without trials."""
    p = successes / n
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - spread)), F.when(n > 0, F.least(F.lit(1.0), centre + spread))


def mean_significance(value: str) -> list[Column]:
    """n, mean, standard error (ddof 1) and t of a column; null under two values, t infinite without variance."""
    n, mean, se = F.count(value), F.avg(value), F.stddev_samp(value) / F.sqrt(F.count(value))
    t = F.when(n < 2, None).when(F.min(value) == F.max(value), F.when(mean == 0, 0.0).otherwise(F.signum(mean) * math.inf)).otherwise(mean / se)
    return [n.alias("n"), F.round(mean, 8).alias("mean"), F.when(n >= 2, F.round(se, 8)).alias("se"), F.round(t, 6).alias("t")]


def headline(rows: DataFrame, by: list[str], min_n: int = 50) -> DataFrame:
    """Counts, turnover, profit, ROI, stake-weighted closing value and beat rate; rates are null under min_n."""
    enough = F.count("*") >= min_n
    known = F.col("clv_log").isNotNull()
    low, high = wilson(F.sum(F.when(F.col("clv_log") > 0, 1).otherwise(0)), F.count("clv_log"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("outcome") == "won", 1).otherwise(0)).alias("won"),
        F.round(F.sum("stake"), 2).alias("turnover"), F.round(F.sum("pnl"), 2).alias("pnl"),
        F.when(enough, F.round(ratio(F.sum("pnl"), F.sum("stake")), 6)).alias("roi"),
        F.when(enough, F.round(ratio(F.sum(F.when(known, F.col("stake") * F.col("clv_log"))), F.sum(F.when(known, F.col("stake")))), 6)).alias("clv"),
        F.when(enough, F.round(ratio(F.sum(F.when(F.col("clv_log") > 0, 1).otherwise(0)), F.count("clv_log")), 6)).alias("beat_rate"),
        F.when(enough, F.round(low, 6)).alias("beat_low"), F.when(enough, F.round(high, 6)).alias("beat_high"),
    )


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of p: n, mean p, share won."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("won"), 6).alias("rate"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Log loss, Brier score, expected and largest calibration error, in two passes of sums."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -F.when(F.col("won") == 1, F.log(p)).otherwise(F.log(1 - p))
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    parts = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("won").alias("sw"), F.sum(loss).alias("sl"), F.sum(F.pow(F.col("p") - F.col("won"), 2)).alias("sb"))
    gap = F.abs(F.col("sp") - F.col("sw"))
    return parts.agg(
        F.sum("n").alias("n"), F.round(F.sum("sl") / F.sum("n"), 6).alias("log_loss"), F.round(F.sum("sl") / F.sum("n") / math.log(2), 6).alias("bits"),
        F.round(F.sum("sb") / F.sum("n"), 6).alias("brier"), F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap / F.col("n")), 6).alias("mce"),
    )
