"""Walk-forward with refits: which day's model scores a match, the goals model fitted for every refit at once, its forecasts and bets.

A refit's model needs of its window only the weighted sums of each pair of teams. Matches meet refits
by blocks of the window's length and are summed before the shuffle; each (league, refit) is then one
small group, fitted by itself, so refits run beside each other in place of one after the other.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.functions.devig import devig, let
from fairline.functions.odds import clv_log
from fairline.operators.backtest import training_rows
from fairline.operators.goals import fit_pair_sums, market_of, summed_pairs


def evaluated(matches: DataFrame, *, warmup: int) -> DataFrame:
    """The matches with a price (eligible) but each league's first `warmup` by day and id.

    The matches before a day are a running sum of one row a day; only matches of one day are numbered.
    """
    priced = matches.where("eligible")
    days = priced.groupBy("league", "played").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("league").orderBy("played").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("league", "played").orderBy("match_id"))
    return priced.join(days.select("league", "played", ahead.alias("ahead")), ["league", "played"]).withColumn("place", place).where(F.col("ahead") + F.col("place") > warmup).drop("ahead", "place")


def refits(scored: DataFrame, *, every_days: int) -> DataFrame:
    """(league, played, epoch): the refit that scores each day's matches: the first day, then the first one at least so many days after the last refit. One entry a calendar day is folded."""
    days = scored.groupBy("league").agg(F.array_sort(F.collect_set("played")).alias("days"))
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<struct<played:date,epoch:date>>").alias("out"))

    def step(s, d):
        due = s["last"].isNull() | (F.datediff(d, s["last"]) >= every_days)
        return let(F.when(due, d).otherwise(s["last"]), lambda e: F.struct(e.alias("last"), F.array_append(s["out"], F.struct(d.alias("played"), e.alias("epoch"))).alias("out")))

    return days.select("league", F.explode(F.aggregate("days", start, step)["out"]).alias("r")).select("league", "r.*")


def pair_sums(matches: DataFrame, epochs: DataFrame, *, window_days: int, xi: float) -> DataFrame:
    """What a refit needs of each pair of teams in its window: matches, weight, weighted goals, and weights of the four low scores. Equal results of a day are counted before they meet the refits."""
    kinds = ["league", "played", "home", "away", "home_goals", "away_goals", "neutral"]
    days = matches.groupBy(*kinds).agg(F.count("*").alias("times"))
    rows = training_rows(days, epochs, window_days=window_days, by=("league",))
    return summed_pairs(rows, ["league", "epoch"], F.col("times") * F.exp(-xi * F.datediff("epoch", "played")), F.col("times"))


def fitted_epochs(sums: DataFrame, *, least: int = 100, rounds: int = 200) -> DataFrame:
    """(league, epoch, team, attack, defence, home, rho) of every refit with at least so many matches.

    Groups are small and dear, so they are dealt to a set number of tasks, whatever their size in bytes.
    """
    tasks = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["league", "epoch", "team", "attack", "defence", "home", "rho"]
        if pdf["n"].sum() < least:
            return pd.DataFrame(columns=columns)
        return fit_pair_sums(pdf, rounds).assign(league=pdf["league"].iloc[0], epoch=pdf["epoch"].iloc[0])[columns]

    return sums.repartition(tasks, "league", "epoch").groupBy("league", "epoch").applyInPandas(fit, "league string, epoch date, team string, attack double, defence double, home double, rho double")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("p_home", "p_draw", "p_away", "p_over")]))
def outcome_chances(home: pd.Series, away: pd.Series, rho: pd.Series) -> pd.DataFrame:
    """Chances of home, draw, away and over 2.5 from goal expectancies, of a whole batch at once; null without them."""
    names = ["p_home", "p_draw", "p_away", "p_over"]
    theta = np.column_stack([np.log(home.to_numpy(float)), np.log(away.to_numpy(float)), rho.to_numpy(float)])
    good, out = np.isfinite(theta).all(1), np.full((len(theta), 4), np.nan)
    if good.any():
        out[good] = market_of(theta[good])
    return pd.DataFrame(out, columns=names).astype("Float64")


def forecasts(fixtures: DataFrame, fitted: DataFrame) -> DataFrame:
    """fixtures (league, epoch, home, away, neutral) with p_home, p_draw, p_away and p_over, only those whose refit has a model that knows both teams."""
    key = ["league", "epoch"]
    h = fitted.select(*key, F.col("team").alias("home"), F.col("attack").alias("ha"), F.col("defence").alias("hd"), F.col("home").alias("edge"), "rho")
    a = fitted.select(*key, F.col("team").alias("away"), F.col("attack").alias("aa"), F.col("defence").alias("ad"))
    both = fixtures.join(h, [*key, "home"]).join(a, [*key, "away"])
    home_exp, away_exp = F.col("ha") * F.col("ad") * F.when(F.col("neutral"), 1.0).otherwise(F.col("edge")), F.col("aa") * F.col("hd")
    return both.withColumn("p", outcome_chances(home_exp, away_exp, F.col("rho"))).select(*fixtures.columns, "p.*")


def walk_forward(matches: DataFrame, *, warmup: int = 300, window_days: int = 540, every_days: int = 7, least: int = 100, xi: float = 0.0019) -> DataFrame:
    """The evaluated matches with their refit's forecasts, null where there is no model; matches: match_id, league, played, home, away, home_goals, away_goals, neutral, eligible."""
    scored = evaluated(matches, warmup=warmup)
    plan = refits(scored, every_days=every_days)
    sums = pair_sums(matches, plan.select("league", "epoch").distinct(), window_days=window_days, xi=xi)
    due = scored.join(plan, ["league", "played"])
    pair = ["league", "epoch", "home", "away", "neutral"]
    known = forecasts(due.select(*pair).distinct(), fitted_epochs(sums, least=least)).select(*pair, "p_home", "p_draw", "p_away", "p_over")  # once a pair of teams and refit
    return due.join(known, pair, "left")


def model_bets(forecast: DataFrame, *, method: str = "power") -> DataFrame:
    """A row a selection with edge and value over zero: the model's chance against the fair one of the prices that it would take. forecast: best and close (arrays of prices), result, p_home, p_draw, p_away."""
    f = forecast.where("p_home IS NOT NULL").withColumns({"d": devig(F.col("best"), method), "c": devig(F.col("close"), method)}).where("d IS NOT NULL")
    legs = f.select("match_id", "league", "epoch", "result", F.posexplode(F.arrays_zip(F.array("p_home", "p_draw", "p_away").alias("p"), F.col("d.fair").alias("fair"), "best", F.coalesce(F.col("c.fair"), F.transform("best", lambda x: F.lit(None).cast("double"))).alias("close"))).alias("pick", "l"))
    legs = legs.select("match_id", "league", "epoch", "pick", F.col("l.p").alias("model_p"), F.col("l.fair").alias("fair"), F.col("l.best").alias("odds"), F.col("l.close").alias("close_fair"), "result")
    legs = legs.withColumns({"edge": F.col("model_p") - F.col("fair"), "ev": F.col("model_p") * (F.col("odds") - 1) - (1 - F.col("model_p"))}).where("edge > 0 AND ev > 0")
    won = (F.col("result") == F.col("pick")).cast("double")
    return legs.withColumns({"won": won, "unit": F.when(won == 1, F.col("odds") - 1).when(won == 0, -1.0), "clv": clv_log(F.col("odds"), F.col("close_fair"))}).drop("result", "close_fair")
