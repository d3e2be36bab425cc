"""The goals model: score grids, market chances, handicap prices, implied expectancies and the time-decayed fit."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.functions.devig import let

MOST = 15


def poisson_row(rate: Column, most: int = MOST) -> Column:
    """Chances of 0 to most goals."""
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.exp(k * F.log(rate) - rate) / F.factorial(k))


def score_grid(home: Column, away: Column, rho: Column, most: int = MOST) -> Column:
    """array of (h, a, p) with Dixon's and Coles's correction of low scores, summing to 1."""

    def tau(h: Column, a: Column) -> Column:
        low = F.when((h == 0) & (a == 0), 1 - home * away * rho).when((h == 0) & (a == 1), 1 + home * rho).when((h == 1) & (a == 0), 1 + away * rho)
        return low.when((h == 1) & (a == 1), 1 - rho).otherwise(F.lit(1.0))

    cells = lambda x, y: F.flatten(F.transform(x, lambda p, h: F.transform(y, lambda q, a: F.struct(h.alias("h"), a.alias("a"), (p * q * tau(h, a)).alias("p")))))
    raw = let(F.struct(poisson_row(home, most).alias("x"), poisson_row(away, most).alias("y")), lambda s: cells(s["x"], s["y"]))
    return let(raw, lambda c: let(F.aggregate(c, F.lit(0.0), lambda s, x: s + x["p"]), lambda t: F.transform(c, lambda x: F.struct(x["h"].alias("h"), x["a"].alias("a"), (x["p"] / t).alias("p")))))


def chance(grid: Column, event) -> Column:
    """The chance of what event says of (home goals, away goals)."""
    return F.aggregate(grid, F.lit(0.0), lambda s, c: s + F.when(event(c["h"], c["a"]), c["p"]).otherwise(0.0))


def grid_chances(grid: Column, line: float = 2.5) -> dict[str, Column]:
    """Home, draw, away, over, under, both score or not."""
    return {
        "home": chance(grid, lambda h, a: h > a), "draw": chance(grid, lambda h, a: h == a), "away": chance(grid, lambda h, a: h < a),
        "over": chance(grid, lambda h, a: h + a > line), "under": chance(grid, lambda h, a: h + a < line), "both": chance(grid, lambda h, a: (h > 0) & (a > 0)), "not_both": chance(grid, lambda h, a: (h == 0) | (a == 0)),
    }


def handicap_price(grid: Column, side: Column, line: Column, odds: Column) -> Column:
    """win, push, lose and ev of a handicap at any line; a quarter line is two half stakes on the lines beside it."""

    def at(shift: float, won) -> Column:
        margin = lambda h, a: F.when(side == "home", h - a).otherwise(a - h) + line + shift
        return chance(grid, lambda h, a: won(margin(h, a)))

    quarter = F.abs(line * 4) % 2 == 1
    share = lambda won: F.when(quarter, (at(-0.25, won) + at(0.25, won)) / 2).otherwise(at(0.0, won))
    parts = F.struct(share(lambda m: m > 0).alias("win"), share(lambda m: m == 0).alias("push"), share(lambda m: m < 0).alias("lose"))
    return let(parts, lambda p: F.struct(p["win"].alias("win"), p["push"].alias("push"), p["lose"].alias("lose"), (p["win"] * (odds - 1) - p["lose"]).alias("ev")))


def grid_of(home: np.ndarray, away: np.ndarray, rho: np.ndarray, most: int = MOST) -> np.ndarray:
    """Score grids of many matches at once: (match, home goals, away goals)."""
    k = np.arange(most + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    x, y = (np.exp(k * np.log(r)[:, None] - r[:, None] - logs) for r in (home, away))
    g = x[:, :, None] * y[:, None, :]
    g[:, 0, 0] *= 1 - home * away * rho
    g[:, 0, 1] *= 1 + home * rho
    g[:, 1, 0] *= 1 + away * rho
    g[:, 1, 1] *= 1 - rho
    g = np.maximum(g, 1e-15)
    return g / g.sum((1, 2), keepdims=True)


def market_of(theta: np.ndarray) -> np.ndarray:
    """(home, draw, away, over 2.5) of rows of (log home, log away, rho)."""
    g = grid_of(np.exp(theta[:, 0]), np.exp(theta[:, 1]), theta[:, 2])
    i, j = np.indices(g.shape[1:])
    return np.stack([g[:, i > j].sum(1), g[:, i == j].sum(1), g[:, i < j].sum(1), g[:, i + j > 2].sum(1)], 1)


def implied_goals(markets: DataFrame, *, tolerance: float = 0.02) -> DataFrame:
    """markets with home_exp, away_exp, rho and fit_error: the goals model that gives their fair chances; null if they aren't chances of one match.

    markets: p_home, p_draw, p_away, p_over. A batch of matches is solved together by damped
    Gauss-Newton steps.
    """
    names = ["home_exp", "away_exp", "rho", "fit_error"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            target = pdf[["p_home", "p_draw", "p_away", "p_over"]].to_numpy(float)
            good = np.isfinite(target).all(1) & (target > 0).all(1) & (target < 1).all(1) & (np.abs(target[:, :3].sum(1) - 1) <= tolerance)
            theta = np.tile([0.3, 0.1, -0.05], (int(good.sum()), 1))
            goal = target[good]
            for _ in range(60):
                base = market_of(theta)
                jac = np.stack([(market_of(theta + h * np.eye(3)[c]) - base) / h for c, h in ((0, 1e-6), (1, 1e-6), (2, 1e-6))], 2)
                left = goal - base
                step = np.linalg.solve(jac.transpose(0, 2, 1) @ jac + 1e-7 * np.eye(3), (jac.transpose(0, 2, 1) @ left[:, :, None]))[:, :, 0]
                theta = theta + np.clip(step, -0.3, 0.3)
                theta[:, :2], theta[:, 2] = np.clip(theta[:, :2], -3.0, 2.0), np.clip(theta[:, 2], -0.4, 0.4)
            out = np.full((len(pdf), 4), np.nan)
            out[good] = np.column_stack([np.exp(theta[:, :2]), theta[:, 2], ((market_of(theta) - goal) ** 2).sum(1)])
            for k, n in enumerate(names):
                pdf[n] = pd.Series(out[:, k], index=pdf.index).astype("Float64")
            yield pdf

    return markets.mapInPandas(solve, T.StructType([*markets.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def summed_pairs(rows: DataFrame, by: list[str], weight: Column, n: Column) -> DataFrame:
    """What a fit needs of each pair of teams: matches, weight, weighted goals, and weights of the four low scores. rows: by, home, away, neutral, home_goals, away_goals."""
    low = lambda h, a: F.sum(F.when((F.col("home_goals") == h) & (F.col("away_goals") == a), weight).otherwise(0.0)).alias(f"low_{h}{a}")
    return rows.groupBy(*by, "home", "away", "neutral").agg(
        F.sum(n).alias("n"), F.sum(weight).alias("weight"), F.sum(weight * F.col("home_goals")).alias("home_sum"), F.sum(weight * F.col("away_goals")).alias("away_sum"), low(0, 0), low(0, 1), low(1, 0), low(1, 1)
    )


def fit_leagues(matches: DataFrame, as_of: Column, *, xi: float = 0.0019, least: int = 50, rounds: int = 200) -> DataFrame:
    """(league, team, attack, defence, home, rho): each league's time-decayed fit on its matches strictly before a day.

    matches: league, played, home, away, home_goals, away_goals, neutral. Matches are summed by pair of teams where
    they are, so a league's group holds a row a pair, however many matches it has. Attack and defence follow by iterative
    proportional fitting of the weighted goals, the home edge likewise, the correction of low scores by a search.
    """
    before = matches.where(F.col("played") < as_of)
    sums = summed_pairs(before, ["league"], F.exp(-xi * F.datediff(as_of, F.col("played"))), F.lit(1))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["league", "team", "attack", "defence", "home", "rho"]
        if pdf["n"].sum() < least:
            return pd.DataFrame(columns=columns)
        return fit_pair_sums(pdf, rounds).assign(league=pdf["league"].iloc[0])[columns]

    return sums.groupBy("league").applyInPandas(fit, "league string, team string, attack double, defence double, home double, rho double")


def fit_pair_sums(pdf: pd.DataFrame, rounds: int = 200) -> pd.DataFrame:
    """(team, attack, defence, home, rho) from one row a pair of teams: home, away, neutral, weight, home_sum, away_sum (weighted goals) and low_00 to low_11 (weights of low scores).

    The fit of fit_leagues: its steps need no more of the matches than these sums.
    """
    teams, codes = np.unique(np.concatenate([pdf["home"], pdf["away"]]), return_inverse=True)
    n, size = len(pdf), len(teams)
    h, a = codes[:n], codes[n:]
    w, hg, ag, own = (pdf[c].to_numpy(t) for c, t in (("weight", float), ("home_sum", float), ("away_sum", float), ("neutral", bool)))
    own = ~own
    add = lambda at, x: np.bincount(at, x, size)
    scored, conceded, played_home = add(h, hg) + add(a, ag), add(a, hg) + add(h, ag), hg[own].sum()
    goals_each = (hg.sum() + ag.sum()) / max(2 * w.sum(), 1e-300)
    attack, defence, edge = np.ones(size), np.full(size, max(1e-6, goals_each)), 1.2
    for _ in range(rounds):
        e, was = np.where(own, edge, 1.0), defence
        attack = (scored + 1e-6) / (add(h, w * e * defence[a]) + add(a, w * defence[h]) + 1e-6)
        attack /= attack.mean()
        defence = (conceded + 1e-6) / (add(a, w * e * attack[h]) + add(h, w * attack[a]) + 1e-6)
        edge = max(0.2, played_home / max((w * attack[h] * defence[a])[own].sum(), 1e-9)) if own.any() else 1.0
        if np.abs(defence - was).max() < 1e-13:
            break
    lh, la = attack[h] * defence[a] * np.where(own, edge, 1.0), attack[a] * defence[h]
    low = [pdf[f"low_{c}"].to_numpy(float) for c in ("00", "01", "10", "11")]

    def likelihood(rho: float) -> float:
        parts = (1 - lh * la * rho, 1 + lh * rho, 1 + la * rho, np.full(n, 1 - rho))
        return float(sum((x * np.log(np.maximum(v, 1e-9))).sum() for x, v in zip(low, parts, strict=True)))

    rho = max(np.linspace(-0.2, 0.2, 81), key=likelihood)
    return pd.DataFrame({"team": teams, "attack": attack, "defence": defence, "home": edge, "rho": rho})


def predicted(fixtures: DataFrame, fitted: DataFrame, line: float = 2.5) -> DataFrame:
    """fixtures with the model's chances; those with an unknown team have nulls. fixtures: league, home, away, neutral.

    A grid is worked out once a pair of teams. Pairs are few beside fixtures, so they are broadcast to them.
    """
    keys = ["league", "home", "away", "neutral"]
    pairs = fixtures.groupBy(*keys).agg(F.max("neutral").alias("neutral_ground"))  # an aggregate, so that no filter on chances gets behind it
    h = fitted.select("league", F.col("team").alias("home"), F.col("attack").alias("ha"), F.col("defence").alias("hd"), F.col("home").alias("edge"), "rho")
    a = fitted.select("league", F.col("team").alias("away"), F.col("attack").alias("aa"), F.col("defence").alias("ad"))
    both = pairs.join(h, ["league", "home"], "left").join(a, ["league", "away"], "left")
    both = both.withColumns({"home_exp": F.col("ha") * F.col("ad") * F.when(F.col("neutral_ground"), 1.0).otherwise(F.col("edge")), "away_exp": F.col("aa") * F.col("hd")})
    both = both.withColumn("grid", F.when(F.col("home_exp").isNotNull() & F.col("away_exp").isNotNull(), score_grid(F.col("home_exp"), F.col("away_exp"), F.col("rho"))))
    both = both.withColumns({f"p_{n}": F.when(F.col("grid").isNotNull(), c) for n, c in grid_chances(F.col("grid"), line).items()}).drop("grid", "ha", "hd", "aa", "ad", "edge", "neutral_ground")
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    return fixtures.alias("f").join(F.broadcast(both.alias("p")), same, "left").select("f.*", *(F.col(f"p.{c}") for c in both.columns if c not in keys))
