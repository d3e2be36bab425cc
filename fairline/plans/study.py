"""Queries of research: goals model, calibration, resampling, backtests and exposure, over a match an order."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.operators import backtest, calibrate, goals, ledger, resampling, walkforward
from fairline.plans.value import rounded
from fairline.sources.bridge import table
from fairline.sources.picks import cte, picks

THRESHOLDS = [0.0, 0.01, 0.02, 0.03, 0.05]
XS, YS = [0.1, 0.3, 0.5, 0.8], [0.15, 0.25, 0.55, 0.75]
LINES = (-1.5, -0.25, 0.0, 0.5, 0.75)
#: A three-way match an order: an anchor's, the best and the closing prices, goals, league and season.
WIDE_SQL = """
SELECT match_id, played, league, season, result, home_goals, away_goals, home, away,
       array(CAST(round(1e0 / (a * 1.03e0), 4) AS DOUBLE), CAST(round(1e0 / (0.26e0 * 1.03e0), 4) AS DOUBLE), CAST(round(1e0 / ((0.74e0 - a) * 1.03e0), 4) AS DOUBLE)) AS sharp,
       array(CAST(round((1e0 + n1 / 50e0) / (a * 1.03e0), 4) AS DOUBLE), CAST(round((1e0 + n2 / 50e0) / (0.26e0 * 1.03e0), 4) AS DOUBLE), CAST(round((1e0 + n3 / 50e0) / ((0.74e0 - a) * 1.03e0), 4) AS DOUBLE)) AS best,
       CASE WHEN match_id % 9 <> 0 THEN array(CAST(round(1e0 / ((a + k) * 1.02e0), 4) AS DOUBLE), CAST(round(1e0 / (0.26e0 * 1.02e0), 4) AS DOUBLE), CAST(round(1e0 / ((0.74e0 - a - k) * 1.02e0), 4) AS DOUBLE)) END AS close
FROM (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS played, concat('L', CAST(o_custkey % 5 AS STRING)) AS league, CAST(year(o_orderdate) AS INT) AS season, CAST(CASE WHEN o_orderkey % 5 > o_custkey % 4 THEN 0 WHEN o_orderkey % 5 = o_custkey % 4 THEN 1 ELSE 2 END AS INT) AS result,
             CAST(o_orderkey % 5 AS INT) AS home_goals, CAST(o_custkey % 4 AS INT) AS away_goals, concat('T', CAST(o_custkey % 20 AS STRING)) AS home, concat('T', CAST((o_custkey + 1 + o_orderkey % 19) % 20 AS STRING)) AS away,
             0.2e0 + 0.35e0 * (o_orderkey % 31) / 31e0 AS a, (o_custkey + o_orderkey) % 13 - 6 AS n1, (o_custkey * 3 + o_orderkey) % 11 - 5 AS n2, (o_custkey + 5 * o_orderkey) % 13 - 6 AS n3, ((o_orderkey * 7 + o_custkey) % 9 - 4) / 200e0 AS k FROM {orders})
"""
WIDE_CTE = cte("wide", WIDE_SQL)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WIDE_SQL, orders=table(spark, sf_dir, "orders"))


def cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.candidates(wide(spark, sf_dir), "multiplicative")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal rates that occur among orders, and how often."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((0.7 + (F.col("o_custkey") % 8) / 5.0).alias("h"), (0.5 + (F.col("o_orderkey") % 6) / 4.0).alias("a")).agg(F.count("*").alias("n"))


def goal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market chances of the score grid of every pair of rates."""
    g = rates(spark, sf_dir).withColumn("grid", goals.score_grid(F.col("h"), F.col("a"), F.lit(-0.06)))
    return g.select("h", "a", "n", *(F.round(c, 8).alias(k) for k, c in goals.grid_chances(F.col("grid")).items()))


def handicap_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win, push, lose and value of both sides at whole, half and quarter lines."""
    g = rates(spark, sf_dir).withColumn("grid", goals.score_grid(F.col("h"), F.col("a"), F.lit(-0.06)))
    g = g.withColumn("line", F.explode(F.array(*map(F.lit, LINES)))).withColumn("side", F.explode(F.array(F.lit("home"), F.lit("away"))))
    p = g.withColumn("p", goals.handicap_price(F.col("grid"), F.col("side"), F.col("line"), F.lit(1.95)))
    return p.select("h", "a", "line", "side", *(F.round(F.col(f"p.{c}"), 8).alias(c) for c in ("win", "push", "lose", "ev")))


def implied_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates back from their own market chances."""
    g = rates(spark, sf_dir).withColumn("grid", goals.score_grid(F.col("h"), F.col("a"), F.lit(-0.06)))
    c = goals.grid_chances(F.col("grid"))
    m = g.select("h", "a", c["home"].alias("p_home"), c["draw"].alias("p_draw"), c["away"].alias("p_away"), c["over"].alias("p_over"))
    return rounded(goals.implied_goals(m), "home_exp", "away_exp", "rho").select("h", "a", "home_exp", "away_exp", "rho")


def goal_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each league's time-decayed fit on its earlier matches, applied to the later ones."""
    m = wide(spark, sf_dir).select("match_id", "league", "played", "home", "away", "home_goals", "away_goals", (F.col("match_id") % 7 == 0).alias("neutral"))
    day = F.lit("1997-06-01").cast("date")
    return rounded(goals.predicted(m.where(F.col("played") >= day), goals.fit_leagues(m, day)), "p_home", "p_draw", "p_away", "p_over").select("match_id", "league", "p_home", "p_draw", "p_away", "p_over")


def calibrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt's, beta and isotonic maps of given numbers, and logits, of every candidate's chance."""
    p = F.col("fair")
    return cands(spark, sf_dir).select(
        "match_id", F.col("pick").cast("long").alias("pick"), F.round(calibrate.platt(p, 3.5, -1.8), 8).alias("platt"), F.round(calibrate.beta_map(p, 0.9, 1.2, 0.1), 8).alias("beta"), F.round(calibrate.isotonic(p, XS, YS), 8).alias("isotonic"), F.round(calibrate.logit(calibrate.clipped(p)), 8).alias("logit"),
    )


def band_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of bets between the outer tenths of their own prices."""
    return calibrate.band_reliability(cands(spark, sf_dir).select(F.col("fair").alias("p"), "won", "odds"))


def quantile_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability by tenths of the candidates."""
    return calibrate.quantile_bins(cands(spark, sf_dir).select(F.col("fair").alias("p"), "won"))


def calibration_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a beta map fitted on all earlier quarters gains in each."""
    c = cands(spark, sf_dir).select(F.concat_ws("-", F.year("played"), F.quarter("played")).alias("period"), F.col("fair").alias("p"), F.col("won").alias("y"))
    return rounded(calibrate.walk_forward_gain(c, least_train=1000, least_test=200), "gain")


def clv_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean closing value by league and kind of selection with Student's interval, both errors and whether it is over zero."""
    b = backtest.bets_for(cands(spark, sf_dir), 0.02).where("clv IS NOT NULL")
    n, mean, sd = F.count("clv"), F.avg("clv"), F.stddev_samp("clv")
    g = b.groupBy("league", "kind").agg(n.alias("n"), mean.alias("mean"), sd.alias("sd"), F.stddev_pop("clv").alias("pop"))
    half = calibrate.t_bound(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    g = g.withColumns({"se": F.col("sd") / F.sqrt("n"), "low": F.col("mean") - half, "high": F.col("mean") + half, "pop_se": F.col("pop") / F.sqrt("n")})
    return rounded(g.withColumn("significant", F.coalesce(F.col("low") > 0, F.lit(False))), "mean", "se", "pop_se", "low", "high").drop("sd", "pop")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets of each method of margin removal at each least edge."""
    both = None
    for method in ("multiplicative", "additive"):
        one = backtest.candidates(wide(spark, sf_dir), method).withColumn("method", F.lit(method))
        both = one if both is None else both.unionByName(one)
    return backtest.swept(both, THRESHOLDS, ["method"])


def cell_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best least edge of each league's cell on early seasons, and the bets that it gives on later ones."""
    c = cands(spark, sf_dir)
    cells = backtest.chosen_point(backtest.swept(c.where("season < 1997"), THRESHOLDS, ["league"]), ["league"], least=15, order=("clv", "roi"), fallback=0.03)
    stats = backtest.cell_bets(c.where("season >= 1997"), cells, ["league"]).groupBy("league").agg(*backtest.bet_stats())
    return cells.join(stats, "league", "left")


def holdout_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules say of each league's bets against betting on all; also what they return at the anchor's own price."""
    c = cands(spark, sf_dir).join(wide(spark, sf_dir).select("match_id", F.col("sharp").alias("own")), "match_id").withColumn("own", F.get("own", F.col("pick")))
    base = backtest.bets_for(c, -9.0).groupBy("league").agg(F.avg("clv").alias("base"))
    bets = backtest.bets_for(c, 0.02)
    own = backtest.settled_at(bets, "own").groupBy("league").agg(F.round(F.avg("unit"), 6).alias("roi_own"))
    s = bets.groupBy("league").agg(*backtest.bet_stats()).join(base, "league").join(own, "league")
    return s.select("league", "n", "roi_own", backtest.verdict(F.col("n"), F.col("clv"), F.col("clv_se"), F.col("roi"), F.round("base", 6), least=20).alias("verdict"))


def kelly_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounded bankroll of each league's bets with a quarter of Kelly's stake."""
    b = backtest.bankroll(backtest.bets_for(cands(spark, sf_dir), 0.02), order=["played", "match_id"], by=["league"])
    return backtest.bankroll_summary(b, ["league"], ["played", "match_id"])


def walk_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which model scores each month's matches: how many matches each weekly refit may see, and how many it scores."""
    m = wide(spark, sf_dir).select("match_id", "played")
    scored = backtest.epochs(m, F.lit("1997-01-01").cast("date")).where("epoch IS NOT NULL")
    refits = scored.groupBy("epoch").agg(F.count("*").alias("scored"))
    seen = backtest.training_rows(m, refits, window_days=540).groupBy("epoch").agg(F.count("*").alias("seen"))
    return refits.join(seen, "epoch", "left").select(F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), "scored", F.coalesce("seen", F.lit(0)).alias("seen"))


def draw(cluster, replicate):
    """A draw by plain arithmetic, so that SQL has the same."""
    return ((cluster % 100003 * 7919 + replicate * 104729 + 17) % 1000003 * 48271 % 2147483647) / 2147483647.0


def roi_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return of the bets with an interval, resampled by match."""
    b = backtest.bets_for(cands(spark, sf_dir), 0.02).withColumn("stake", F.lit(1.0))
    return rounded(resampling.poisson_bootstrap(b, "match_id", "unit", "stake", replicates=40, draw=draw), "mean", "low", "high")


def clv_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more closing value the bets have than betting on all, on the same draws of matches."""
    c = cands(spark, sf_dir)
    return rounded(resampling.paired_increment(backtest.bets_for(c, 0.02), backtest.bets_for(c, -9.0), "match_id", "clv", replicates=40, draw=draw), "mean", "low", "high")


def staking_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal wealth and falls of staking policies over the same bootstrap paths of all bets, and which one the rules choose."""
    c = cands(spark, sf_dir).where("won IS NOT NULL").select("match_id", "pick", "edge", "odds", "played", "fair", "unit")
    b = backtest.bets_for(c, 0.02)
    kelly = F.greatest((F.col("fair") * F.col("odds") - 1) / (F.col("odds") - 1), F.lit(0.0))
    series = resampling.positioned(b.select("match_id", "played", "unit", kelly.alias("kelly")), "played", ["match_id"])
    shares = {"quarter": F.least(F.col("kelly") / 4, F.lit(0.02)), "tenth": F.least(F.col("kelly") / 10, F.lit(0.01)), "flat": F.lit(0.01)}
    return rounded(resampling.recommended_policy(resampling.policy_paths(series, shares, paths=100, block=10), "quarter"), "median", "p5", "p95", "drawdown_p95")


def event_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants under a day's and an event's cap, in order, with some taken before and some given back."""
    p = picks(spark, sf_dir).select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "event_id", "pick_id", F.when(F.col("pick_id") % 13 == 0, -0.01).otherwise(0.004 * (1 + F.col("pick_id") % 4)).alias("fraction"))
    before = p.where("pick_id % 10 = 3").groupBy("day", "event_id").agg(F.sum(F.abs("fraction")).alias("fraction"))
    g = ledger.reserved(p.where("pick_id % 10 <> 3"), day_cap=0.03, event_cap=0.01, preloaded=before, order=["pick_id"])
    return rounded(g, "granted").select("day", "pick_id", "event_id", "granted")


def walk_forward_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets of a goals model that is fitted anew every week on the matches of 540 days before, judged against the fair prices of the day and of the close."""
    m = wide(spark, sf_dir).withColumns({"neutral": F.col("match_id") % 7 == 0, "eligible": F.col("match_id") % 11 != 0})
    found = walkforward.walk_forward(m, warmup=100)
    return rounded(walkforward.model_bets(found), "model_p", "fair", "edge", "ev", "clv").select("match_id", "league", F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), "pick", "model_p", "fair", "odds", "edge", "ev", "won", "clv")


def written_stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakes of each day's picks after the ledger: new and upgraded ones reserve, repeated ones don't, and what kept premium picks have taken comes first."""
    p = picks(spark, sf_dir).select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "event_id", "pick_id", F.lit("premium").alias("tier"), (0.004 * (1 + F.col("pick_id") % 4)).alias("fraction"), F.when(F.col("pick_id") % 5 == 0, "duplicate").when(F.col("pick_id") % 5 == 1, "upgraded").otherwise("inserted").alias("outcome"))
    out = ledger.written_stakes(p.where("pick_id % 10 <> 3"), bankroll=10_000.0, day_cap=0.03, event_cap=0.01, preloaded=ledger.seeded(p.where("pick_id % 10 = 3")), order=["pick_id"])
    return rounded(out, "granted").select("day", "pick_id", "event_id", "outcome", "granted", F.col("stake").cast("double").alias("stake"), "clipped", "skipped")


QUERIES = {
    "goal_grid": goal_grid, "handicap_prices": handicap_prices, "implied_goals": implied_goals, "goal_model": goal_model, "calibrators": calibrators, "band_reliability": band_reliability, "quantile_reliability": quantile_reliability,
    "calibration_drift": calibration_drift, "clv_significance": clv_significance, "threshold_sweep": threshold_sweep, "cell_thresholds": cell_thresholds, "holdout_verdicts": holdout_verdicts, "kelly_path": kelly_path,
    "walk_forward_windows": walk_forward_windows, "roi_bootstrap": roi_bootstrap, "clv_increment": clv_increment, "staking_policies": staking_policies, "event_exposure": event_exposure,
    "walk_forward_bets": walk_forward_bets, "written_stakes": written_stakes,
}
RATES_CTE = """
rt AS (SELECT 0.7e0 + (o_custkey % 8) / 5e0 AS h, 0.5e0 + (o_orderkey % 6) / 4e0 AS a, count(*) AS n FROM orders GROUP BY ALL),
gl AS (SELECT unnest(range(0, 16)) AS g),
ce AS (SELECT h, a, n, x.g AS i, y.g AS j, exp(x.g * ln(h) - h) / factorial(x.g::INTEGER) * exp(y.g * ln(a) - a) / factorial(y.g::INTEGER) * CASE WHEN x.g = 0 AND y.g = 0 THEN 1 + h * a * 0.06e0 WHEN x.g = 0 AND y.g = 1 THEN 1 - h * 0.06e0 WHEN x.g = 1 AND y.g = 0 THEN 1 - a * 0.06e0 WHEN x.g = 1 AND y.g = 1 THEN 1.06e0 ELSE 1e0 END AS p FROM rt, gl x, gl y),
gr AS (SELECT h, a, n, i, j, p / sum(p) OVER (PARTITION BY h, a) AS p FROM ce),
"""


def cand_sql(name: str, fair: str, close: str) -> str:
    """Oracle candidates under a margin method: the fair chance by q0 to q2 that sum to b, and of the close by the prices close that sum to cb."""
    return f"""
{name}w AS (SELECT *, 1 / sharp[1] AS q0, 1 / sharp[2] AS q1, 1 / sharp[3] AS q2, 1 / close[1] + 1 / close[2] + 1 / close[3] AS cb FROM wide),
{name}v AS (SELECT *, q0 + q1 + q2 AS b FROM {name}w),
{name} AS (SELECT match_id, played, league, season, result, pick, {fair} AS fair, best[pick + 1] AS odds, sharp[pick + 1] AS own, {close} AS close_fair, {fair} - 1 / best[pick + 1] AS edge, CASE WHEN {close} > 0 THEN ln(best[pick + 1] * {close}) END AS clv,
  CASE WHEN result = pick THEN 1e0 ELSE 0e0 END AS won, CASE WHEN result = pick THEN best[pick + 1] - 1 ELSE -1e0 END AS unit FROM {name}v, (SELECT unnest([0, 1, 2]) AS pick) WHERE best[pick + 1] > 1),
"""


CANDS = WIDE_CTE + cand_sql("ca", "[q0, q1, q2][pick + 1] / b", "1 / close[pick + 1] / cb")
ADDITIVE = cand_sql("ad", "CASE WHEN least(q0, q1, q2) - (b - 1) / 3 <= 0 THEN [q0, q1, q2][pick + 1] / b ELSE ([q0, q1, q2][pick + 1] - (b - 1) / 3) END", "CASE WHEN 1 / greatest(close[1], close[2], close[3]) - (cb - 1) / 3 <= 0 THEN 1 / close[pick + 1] / cb ELSE 1 / close[pick + 1] - (cb - 1) / 3 END")
BETS = "{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY edge DESC, pick) AS rk FROM ca WHERE edge >= {t} AND odds >= 1.2) WHERE rk = 1),"
STATS = "count(unit) AS n, round(avg(won), 6) AS hit, round(sum(unit) / count(unit), 6) AS roi, round(avg(clv), 6) AS clv, round(CASE WHEN count(clv) >= 2 THEN stddev_samp(clv) / sqrt(count(clv)) END, 6) AS clv_se, round(CASE WHEN count(clv) > 0 THEN stddev_pop(clv) / sqrt(count(clv)) END, 6) AS clv_se_pop, round(avg(CASE WHEN clv > 0 THEN 1 WHEN clv <= 0 THEN 0 END), 6) AS beat"
STEPS = "[" + ", ".join(f"{t}e0" for t in THRESHOLDS) + "]"
KIND = "CASE WHEN pick = 1 THEN 'draw' WHEN fair >= 0.5 THEN 'favourite' ELSE 'underdog' END"
T_LIST = "[" + ", ".join(repr(calibrate.t_quantile(0.975, d)) for d in range(1, 101)) + "]"
POISSON_SQL = "CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(resampling.POISSON)) + f" ELSE {len(resampling.POISSON)} END"
DRAW_SQL = "((match_id % 100003 * 7919 + r * 104729 + 17) % 1000003 * 48271 % 2147483647) / 2147483647e0"
INTERVAL = "SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS replicates"
ISO_SQL = "CASE WHEN fair <= 0.1 THEN 0.15e0 WHEN fair <= 0.3 THEN 0.15e0 + 0.1e0 * (fair - 0.1e0) / 0.2e0 WHEN fair <= 0.5 THEN 0.25e0 + 0.3e0 * (fair - 0.3e0) / 0.2e0 WHEN fair <= 0.8 THEN 0.55e0 + 0.2e0 * (fair - 0.5e0) / 0.3e0 ELSE 0.75e0 END"
REPORT = """parts AS (SELECT bin, count(*) AS n, sum(p) AS sp, sum(won) AS sw, sum(-CASE WHEN won = 1 THEN ln(p) ELSE ln(1 - p) END) AS sl, sum((p - won) * (p - won)) AS sb FROM binned GROUP BY bin)
  SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(sl) / sum(n), 6) AS log_loss, round(sum(sl) / sum(n) / ln(2), 6) AS bits, round(sum(sb) / sum(n), 6) AS brier, round(sum(abs(sp - sw)) / sum(n), 6) AS ece, round(max(abs(sp - sw) / n), 6) AS mce FROM parts"""
ORACLES = {
    "goal_grid": f"""WITH {RATES_CTE} z AS (SELECT 1) SELECT h, a, any_value(n) AS n, round(sum(p) FILTER (i > j), 8) AS home, round(sum(p) FILTER (i = j), 8) AS draw, round(sum(p) FILTER (i < j), 8) AS away, round(sum(p) FILTER (i + j > 2), 8) AS over, round(sum(p) FILTER (i + j < 3), 8) AS under,
      round(sum(p) FILTER (i > 0 AND j > 0), 8) AS both, round(sum(p) FILTER (i = 0 OR j = 0), 8) AS not_both FROM gr GROUP BY h, a""",
    "handicap_prices": f"""WITH {RATES_CTE} m AS (SELECT h, a, line, side, p, CASE side WHEN 'home' THEN i - j ELSE j - i END + line + s AS m, CASE WHEN abs(line * 4) % 2 = 1 THEN 0.5e0 WHEN s = 0.25 THEN 1e0 ELSE 0e0 END AS w, line AS l0, s FROM gr, (SELECT unnest([{', '.join(f'{x}e0' for x in LINES)}]) AS line), (SELECT unnest(['home', 'away']) AS side), (SELECT unnest([-0.25e0, 0.25e0]) AS s)),
      k AS (SELECT h, a, line, side, p * w AS p, CASE WHEN abs(line * 4) % 2 = 1 THEN m ELSE m - s END AS m FROM m), t AS (SELECT h, a, line, side, coalesce(sum(p) FILTER (m > 0), 0) AS win, coalesce(sum(p) FILTER (m = 0), 0) AS push, coalesce(sum(p) FILTER (m < 0), 0) AS lose FROM k GROUP BY ALL)
      SELECT h, a, line, side, round(win, 8) AS win, round(push, 8) AS push, round(lose, 8) AS lose, round(win * 0.95e0 - lose, 8) AS ev FROM t""",
    "calibrators": f"WITH {CANDS} z AS (SELECT 1) SELECT match_id, pick::BIGINT AS pick, round(1 / (1 + exp(-(3.5e0 * fair - 1.8e0))), 8) AS platt, round(1 / (1 + exp(-(0.9e0 * ln(fair) - 1.2e0 * ln(1 - fair) + 0.1e0))), 8) AS beta, round({ISO_SQL}, 8) AS isotonic, round(ln(fair / (1 - fair)), 8) AS logit FROM ca",
    "band_reliability": f"WITH {CANDS} q AS (SELECT quantile_cont(odds, 0.1) AS lo, quantile_cont(odds, 0.9) AS hi FROM ca), binned AS (SELECT fair AS p, won, least(floor(fair * 10), 9) AS bin FROM ca, q WHERE odds BETWEEN lo AND hi), {REPORT}",
    "quantile_reliability": f"""WITH {CANDS} e AS (SELECT list_distinct(quantile_cont(fair, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM ca), b AS (SELECT fair, won, CAST(len(list_filter(e, lambda x: x < fair)) AS INTEGER) AS bin FROM ca, e)
      SELECT bin, count(*) AS n, round(avg(fair), 6) AS mean_p, round(avg(won), 6) AS rate, round(abs(avg(fair) - avg(won)), 6) AS gap FROM b GROUP BY bin""",
    "clv_significance": f"""WITH {CANDS} {BETS.format(n="be", t=0.02)} g AS (SELECT league, {KIND} AS kind, count(*) AS n, avg(clv) AS mean, stddev_samp(clv) AS sd, stddev_pop(clv) AS pop FROM be WHERE clv IS NOT NULL GROUP BY ALL), z AS (SELECT *, 1.959963984540054e0 AS z, n - 1 AS df FROM g),
      t AS (SELECT *, CASE WHEN df < 1 THEN NULL WHEN df <= 100 THEN {T_LIST}[df] ELSE z + (z ** 3 + z) / 4 / df + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96 / df ** 2 + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384 / df ** 3 END * sd / sqrt(n) AS half FROM z)
      SELECT league, kind, n, round(mean, 6) AS mean, round(sd / sqrt(n), 6) AS se, round(pop / sqrt(n), 6) AS pop_se, round(mean - half, 6) AS low, round(mean + half, 6) AS high, coalesce(mean - half > 0, false) AS significant FROM t""",
    "threshold_sweep": f"""WITH {CANDS} {ADDITIVE} u AS (SELECT *, 'multiplicative' AS method FROM ca UNION ALL SELECT *, 'additive' AS method FROM ad), r AS (SELECT *, row_number() OVER (PARTITION BY match_id, method, threshold ORDER BY edge DESC, pick) AS rk FROM u, (SELECT unnest({STEPS}) AS threshold) WHERE edge >= threshold AND odds >= 1.2)
      SELECT method, threshold, {STATS} FROM r WHERE rk = 1 GROUP BY ALL""",
    "cell_thresholds": f"""WITH {CANDS} r AS (SELECT *, row_number() OVER (PARTITION BY match_id, threshold ORDER BY edge DESC, pick) AS rk FROM ca, (SELECT unnest({STEPS}) AS threshold) WHERE season < 1997 AND edge >= threshold AND odds >= 1.2), s AS (SELECT league, threshold, {STATS} FROM r WHERE rk = 1 GROUP BY ALL),
      c AS (SELECT league, max(n) >= 15 AS viable FROM s GROUP BY league), p AS (SELECT league, threshold FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY coalesce(clv, -9) DESC, coalesce(roi, -9) DESC, threshold) AS rk FROM s WHERE n >= 15) WHERE rk = 1), t AS (SELECT c.league, coalesce(p.threshold, 0.03e0) AS threshold, viable FROM c LEFT JOIN p ON c.league = p.league),
      l AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY edge DESC, pick) AS rk FROM ca JOIN t USING (league) WHERE season >= 1997 AND edge >= threshold AND odds >= 1.2), m AS (SELECT league, {STATS} FROM l WHERE rk = 1 GROUP BY league) SELECT t.*, m.* EXCLUDE league FROM t LEFT JOIN m ON t.league = m.league""",
    "holdout_verdicts": f"""WITH {CANDS} {BETS.format(n="be", t=0.02)} {BETS.format(n="al", t=-9)} s AS (SELECT league, {STATS}, round(avg(CASE WHEN own > 1 THEN CASE WHEN won = 1 THEN own - 1 ELSE -1 END END), 6) AS roi_own FROM be GROUP BY league), b AS (SELECT league, round(avg(clv), 6) AS base FROM al GROUP BY league)
      SELECT s.league, n, roi_own, CASE WHEN n < 20 THEN 'too few bets' WHEN clv IS NULL THEN 'no closing line' WHEN clv <= base THEN 'no better than all' WHEN clv - 2 * clv_se > 0 AND roi > 0 THEN 'proven' WHEN clv > 0 THEN 'promising' ELSE 'negative' END AS verdict FROM s JOIN b ON s.league = b.league""",
    "kelly_path": f"""WITH {CANDS} {BETS.format(n="be", t=0.02)} s AS (SELECT *, least(greatest(((odds - 1) * fair - (1 - fair)) / (odds - 1), 0) * 0.25e0, 0.02e0) AS f FROM be), w AS (SELECT *, exp(sum(ln(1 + f * unit)) OVER v) AS wealth FROM s WINDOW v AS (PARTITION BY league ORDER BY played, match_id ROWS UNBOUNDED PRECEDING)),
      p AS (SELECT *, greatest(1e0, max(wealth) OVER (PARTITION BY league ORDER BY played, match_id ROWS UNBOUNDED PRECEDING)) AS peak, f * coalesce(lag(wealth) OVER (PARTITION BY league ORDER BY played, match_id), 1e0) AS staked FROM w)
      SELECT league, count(*) AS n, round(sum(staked * unit) / sum(staked), 6) AS roi, round(arg_max(wealth, (played, match_id)), 6) AS final, round(max((peak - wealth) / peak), 6) AS drawdown FROM p GROUP BY league""",
    "walk_forward_windows": f"""WITH {WIDE_CTE} e AS (SELECT match_id, played, DATE '1997-01-01' + CAST(floor(date_diff('day', DATE '1997-01-01', played) / 7.0) * 7 AS INTEGER) AS epoch FROM wide WHERE played >= DATE '1997-01-01'), r AS (SELECT epoch, count(*) AS scored FROM e GROUP BY epoch),
      s AS (SELECT epoch, count(*) AS seen FROM r JOIN wide ON played < epoch AND date_diff('day', played, epoch) <= 540 GROUP BY epoch) SELECT strftime(r.epoch, '%Y-%m-%d') AS epoch, scored, coalesce(seen, 0) AS seen FROM r LEFT JOIN s ON r.epoch = s.epoch""",
    "roi_bootstrap": f"""WITH {CANDS} {BETS.format(n="be", t=0.02)} d AS (SELECT unit, {DRAW_SQL} AS u, r FROM be, (SELECT unnest(range(0, 40)) AS r)), w AS (SELECT r, unit, {POISSON_SQL} AS w FROM d), s AS (SELECT r, sum(unit * w) / nullif(sum(w), 0) AS v FROM w GROUP BY r) {INTERVAL} FROM s""",
    "clv_increment": f"""WITH {CANDS} {BETS.format(n="be", t=0.02)} {BETS.format(n="al", t=-9)} b AS (SELECT match_id, clv AS s, 1 AS n, 0 AS bs, 0 AS bn FROM be WHERE clv IS NOT NULL UNION ALL SELECT match_id, 0, 0, clv, 1 FROM al WHERE clv IS NOT NULL), d AS (SELECT b.*, {DRAW_SQL} AS u, r FROM b, (SELECT unnest(range(0, 40)) AS r)),
      w AS (SELECT *, {POISSON_SQL} AS w FROM d), s AS (SELECT r, sum(s * w) / nullif(sum(n * w), 0) - sum(bs * w) / nullif(sum(bn * w), 0) AS v FROM w GROUP BY r), i AS ({INTERVAL} FROM s) SELECT *, replicates >= 50 AS stable FROM i""",
}
