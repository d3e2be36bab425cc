"""Queries after the event: outcomes, closing value, reports, calibration, exposure and threshold sweeps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import odds as fo
from fairline.operators import market, reports, settlement
from fairline.plans.value import MARKET_CTE, anchored, exploded, rounded
from fairline.sources.bridge import FINALS_CTE, finals, odds_book, table

#: Days before kickoff at which picks are made; the close is the state at kickoff.
EARLY_DAYS = 180
STAKE = 10.0
THRESHOLDS = (0.015, 0.02, 0.03, 0.04, 0.06, 0.08)
LINES = (-1.5, -1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.5)

EARLY_CTE = MARKET_CTE.replace("captured_at <= kickoff)", f"captured_at <= kickoff - INTERVAL {EARLY_DAYS} DAY)")
#: Early picks with the close's fair probability, the outcome and the profit in cents, half to even in integers.
GRADED_CTE = f"""{FINALS_CTE}
early AS (WITH {EARLY_CTE} done AS (SELECT 1) SELECT s.*, CASE WHEN edge >= 0.03 THEN 'premium' ELSE 'volume' END AS tier FROM scan s),
closing AS (WITH {MARKET_CTE} done AS (SELECT 1) SELECT event_id, sel_idx, anchor_book AS close_book, fair AS close_fair FROM fair),
won AS (SELECT e.*, c.close_book, c.close_fair, CASE WHEN e.selection = CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' ELSE 'draw' END THEN 'won' ELSE 'lost' END AS outcome,
        CAST(round((odds - 1) * 10000) AS BIGINT) AS k, CASE WHEN odds > 1 AND close_fair > 0 AND close_fair < 1 THEN ln(odds * close_fair) END AS clv_log
        FROM early e LEFT JOIN closing c ON e.event_id = c.event_id AND e.sel_idx = c.sel_idx JOIN finals f ON e.event_id = f.event_id),
graded AS (SELECT *, 10e0 AS stake, CASE outcome WHEN 'won' THEN (k // 10 + CASE WHEN k % 10 > 5 OR (k % 10 = 5 AND (k // 10) % 2 = 1) THEN 1 ELSE 0 END) / 100e0 ELSE -10e0 END AS pnl FROM won),
"""


def graded_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every early pick with the close it is graded by, its outcome and its profit; both states come from one pass."""
    early = F.expr(f"timestampadd(DAY, -{EARLY_DAYS}, kickoff)")
    rows = market.market_rows(odds_book(spark, sf_dir), {"early": early, "close": F.col("kickoff")})
    close = market.with_anchor(rows, "close", method="multiplicative", prefix="close_").where("size(close_sels) = 3")
    both = market.with_anchor(close, "early", method="multiplicative").where("size(sels) = 3")
    picks = market.value_scan(both, "early", guard=False)
    graded = picks.withColumn("close_fair", F.get("close_fair", F.array_position("close_sels", F.col("sel_idx")).cast("int") - 1)).withColumn("close_book", F.col("close_anchor_book"))
    found = settlement.settled(graded.drop("early", "close", "close_full"), finals(spark), STAKE)
    return found.withColumn("clv_log", fo.clv_log(F.col("odds"), F.col("close_fair")))


def settle_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, profit, closing value and whether the close is independent of the fill, by pick."""
    g = graded_picks(spark, sf_dir)
    independent = settlement.close_independent(F.col("close_book"), F.col("book"), F.col("anchor_book"))
    same = settlement.tautological(F.col("clv_log"), F.col("close_fair"), F.col("odds"))
    return rounded(g, "clv_log").select("event_id", "selection", "book", "odds", "outcome", "pnl", "clv_log", F.coalesce(F.col("clv_log") > 0, F.lit(False)).alias("beat"), independent.alias("independent"), F.coalesce(same, F.lit(False)).alias("same_price"))


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled totals by tier; rates are withheld under 20 picks."""
    return reports.headline(graded_picks(spark, sf_dir), ["tier"], min_n=20)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata by tier and anchor, with every subtotal, in one pass."""
    g = graded_picks(spark, sf_dir).groupingSets([["tier", "anchor_type"], ["tier"], ["anchor_type"], []], "tier", "anchor_type")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("clv_log"), 6).alias("clv"), F.round(reports.ratio(F.sum("pnl"), F.sum("stake")), 6).alias("roi"))


def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean closing value with its standard error and t by tier."""
    return graded_picks(spark, sf_dir).groupBy("tier").agg(*reports.mean_significance("clv_log"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, won) of every selection of every anchored market."""
    fair = exploded(anchored(spark, sf_dir)).select("event_id", "sel_idx", F.col("fair").alias("p"))
    result = F.when(F.col("home_score") > F.col("away_score"), 0).when(F.col("home_score") < F.col("away_score"), 2).otherwise(1)
    return fair.join(finals(spark), "event_id").select("p", (F.col("sel_idx") == result).cast("double").alias("won"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.calibration(observations(spark, sf_dir))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability and share won by equal-width bins."""
    return reports.calibration_bins(observations(spark, sf_dir))


def bankroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running bankroll and drawdown of each tier, in order of the events."""
    path = settlement.bankroll_path(graded_picks(spark, sf_dir), 1000.0, ["event_id", "sel_idx"], ["tier"])
    return path.select("tier", "event_id", "selection", F.round("bankroll", 2).alias("bankroll"), F.round("drawdown", 6).alias("drawdown"))


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants of Kelly stakes under a cap by month of the start."""
    g = graded_picks(spark, sf_dir)
    month = F.date_format(F.expr("timestampadd(DAY, CAST(event_id * 2 AS INT), TIMESTAMP_NTZ'1996-01-01 00:00:00')"), "yyyy-MM")
    asked = g.select("event_id", "selection", "sel_idx", month.alias("month"), fo.recommended_stake(F.col("fair"), F.col("net"))["final"].alias("fraction"))
    return rounded(settlement.reserved_exposure(asked, day_cap=0.05, order=["event_id", "sel_idx"], by=["month"]), "fraction", "granted").drop("sel_idx")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks, profit and closing value at each least edge; one pick a market, the first selection if equal."""
    rows = graded_picks(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold")).where("edge >= threshold")
    best = rows.groupBy("threshold", "event_id").agg(F.max_by(F.struct("pnl", "stake", "clv_log", "outcome"), F.struct("edge", -F.col("sel_idx"))).alias("p")).select("threshold", "p.*")
    return best.groupBy("threshold").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "won").alias("won"), F.round(reports.ratio(F.sum("pnl"), F.sum("stake")), 6).alias("roi"), F.round(F.avg("clv_log"), 6).alias("clv")
    )


def handicaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and profit of both sides of every handicap line, draw no bet, double chance, totals and both-score of every match."""
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 5).cast("int").alias("home_score"), (F.col("o_custkey") % 4).cast("int").alias("away_score"))
    home, away = F.col("home_score"), F.col("away_score")
    legs = f.select("event_id", "home_score", "away_score", F.explode(F.array(*map(F.lit, LINES))).alias("line"))
    sides = legs.select("*", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    spreads = sides.select("event_id", F.format_string("ah %s %.2f", "side", "line").alias("leg"), settlement.settle_handicap(F.col("side"), F.col("line"), home, away).alias("outcome"))
    totals = f.select("*", F.explode(F.array(F.lit("over"), F.lit("under"))).alias("side")).select("event_id", F.concat(F.lit("total "), F.col("side")).alias("leg"), settlement.settle_totals(F.col("side"), F.lit(3.0), home, away).alias("outcome"))
    dnb = f.select("*", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side")).select("event_id", F.concat(F.lit("dnb "), F.col("side")).alias("leg"), settlement.settle_draw_no_bet(F.col("side"), home, away).alias("outcome"))
    double = f.select("*", F.explode(F.array(F.lit("1X"), F.lit("X2"), F.lit("12"))).alias("side")).select("event_id", F.concat(F.lit("dc "), F.col("side")).alias("leg"), settlement.settle_double_chance(F.col("side"), home, away).alias("outcome"))
    both = f.select("event_id", F.lit("both").alias("leg"), settlement.settle_both_score(F.lit(True), home, away).alias("outcome"))
    every = spreads.union(totals).union(dnb).union(double).union(both)
    return every.withColumn("pnl", settlement.pick_pnl(F.col("outcome"), F.lit(STAKE), F.lit(1.9)))


QUERIES = {
    "settle_picks": settle_picks, "headline": headline, "evidence": evidence, "significance": significance, "calibration": calibration, "reliability": reliability,
    "bankroll": bankroll, "exposure": exposure, "sweep": sweep, "settle_legs": handicaps,
}
OBSERVED_CTE = f"""{MARKET_CTE} {FINALS_CTE}
obs AS (SELECT fair AS p, CASE WHEN sel_idx = CASE WHEN home_score > away_score THEN 0 WHEN home_score < away_score THEN 2 ELSE 1 END THEN 1e0 ELSE 0e0 END AS won FROM fair JOIN finals ON fair.event_id = finals.event_id),
binned AS (SELECT *, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin FROM obs),
"""
WILSON = "{sign}(CASE WHEN nk > 0 THEN {limit}((bk / nk + z2 / (2 * nk)) / (1 + z2 / nk) {op} z / (1 + z2 / nk) * sqrt((bk / nk) * (1 - bk / nk) / nk + z2 / (4 * nk * nk)), {edge}) END)"
LOW, HIGH = WILSON.format(sign="", limit="greatest", op="-", edge="0e0"), WILSON.format(sign="", limit="least", op="+", edge="1e0")
COMPONENT = "CASE WHEN {m} > 0 THEN 'won' WHEN {m} = 0 THEN 'push' ELSE 'lost' END"
ORACLES = {
    "settle_picks": f"""WITH {GRADED_CTE} done AS (SELECT 1) SELECT event_id, selection, book, odds, outcome, pnl, round(clv_log, 6) AS clv_log, coalesce(clv_log > 0, false) AS beat,
      coalesce(close_book, '') = '' OR close_book LIKE 'consensus%' OR (close_book <> book AND close_book <> coalesce(anchor_book, '')) AS independent, coalesce(abs(close_fair - 1 / odds) <= 1e-9, false) AS same_price FROM graded""",
    "headline": f"""WITH {GRADED_CTE} s AS (SELECT tier, count(*) AS n, count(*) FILTER (outcome = 'won') AS won, sum(stake) AS st, sum(pnl) AS p, sum(stake * clv_log) AS sc, sum(stake) FILTER (clv_log IS NOT NULL) AS sk, count(*) FILTER (clv_log > 0) AS bk, count(clv_log) AS nk, {reports.Z95!r} AS z, {reports.Z95 ** 2!r} AS z2 FROM graded GROUP BY tier)
      SELECT tier, n, won, round(st, 2) AS turnover, round(p, 2) AS pnl, CASE WHEN n >= 20 THEN round(p / st, 6) END AS roi, CASE WHEN n >= 20 AND sk <> 0 THEN round(sc / sk, 6) END AS clv, CASE WHEN n >= 20 AND nk > 0 THEN round(bk / nk, 6) END AS beat_rate,
        CASE WHEN n >= 20 THEN round({LOW}, 6) END AS beat_low, CASE WHEN n >= 20 THEN round({HIGH}, 6) END AS beat_high FROM s""",
    "evidence": f"WITH {GRADED_CTE} done AS (SELECT 1) SELECT tier, anchor_type, count(*) AS n, round(avg(clv_log), 6) AS clv, round(sum(pnl) / sum(stake), 6) AS roi FROM graded GROUP BY GROUPING SETS ((tier, anchor_type), (tier), (anchor_type), ())",
    "significance": f"""WITH {GRADED_CTE} s AS (SELECT tier, count(clv_log) AS n, avg(clv_log) AS m, stddev_samp(clv_log) / sqrt(count(clv_log)) AS se FROM graded GROUP BY tier)
      SELECT tier, n, round(m, 8) AS mean, CASE WHEN n >= 2 THEN round(se, 8) END AS se, CASE WHEN n >= 2 THEN round(m / se, 6) END AS t FROM s""",
    "calibration": f"""WITH {OBSERVED_CTE} parts AS (SELECT bin, count(*) AS n, sum(p) AS sp, sum(won) AS sw, sum(-CASE WHEN won = 1 THEN ln(p) ELSE ln(1 - p) END) AS sl, sum((p - won) * (p - won)) AS sb FROM binned GROUP BY bin)
      SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(sl) / sum(n), 6) AS log_loss, round(sum(sl) / sum(n) / ln(2), 6) AS bits, round(sum(sb) / sum(n), 6) AS brier, round(sum(abs(sp - sw)) / sum(n), 6) AS ece, round(max(abs(sp - sw) / n), 6) AS mce FROM parts""",
    "reliability": f"WITH {OBSERVED_CTE} done AS (SELECT 1) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(won), 6) AS rate FROM binned GROUP BY bin",
    "bankroll": f"""WITH {GRADED_CTE} b AS (SELECT *, 1000 + sum(pnl) OVER (PARTITION BY tier ORDER BY event_id, sel_idx) AS roll FROM graded), p AS (SELECT *, greatest(1000e0, max(roll) OVER (PARTITION BY tier ORDER BY event_id, sel_idx)) AS peak FROM b)
      SELECT tier, event_id, selection, round(roll, 2) AS bankroll, round((peak - roll) / peak, 6) AS drawdown FROM p""",
    "exposure": f"""WITH {GRADED_CTE} r AS (SELECT event_id, selection, sel_idx, strftime(TIMESTAMP '1996-01-01' + INTERVAL 1 DAY * CAST(event_id * 2 AS INTEGER), '%Y-%m') AS month, least(greatest(((net - 1) * fair - (1 - fair)) / (net - 1), 0) * 0.25e0, 0.02e0) AS fraction FROM graded),
      u AS (SELECT *, least(coalesce(sum(fraction) OVER (PARTITION BY month ORDER BY event_id, sel_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0.05e0) AS used FROM r)
      SELECT event_id, selection, month, round(fraction, 6) AS fraction, round(greatest(0, least(fraction, 0.05e0 - used)), 6) AS granted FROM u""",
    "sweep": f"""WITH {GRADED_CTE} t AS (SELECT *, row_number() OVER (PARTITION BY threshold, event_id ORDER BY edge DESC, sel_idx) AS rk FROM graded, (SELECT unnest([{', '.join(f'{x}e0' for x in THRESHOLDS)}]) AS threshold) WHERE edge >= threshold)
      SELECT threshold, count(*) AS n, count(*) FILTER (outcome = 'won') AS won, round(sum(pnl) / sum(stake), 6) AS roi, round(avg(clv_log), 6) AS clv FROM t WHERE rk = 1 GROUP BY threshold""",
    "settle_legs": f"""WITH finals AS (SELECT o_orderkey AS event_id, CAST(o_orderkey % 5 AS INTEGER) AS home_score, CAST(o_custkey % 4 AS INTEGER) AS away_score FROM orders), h AS (SELECT event_id, printf('ah %s %.2f', side, line) AS leg, line, CASE side WHEN 'home' THEN home_score - away_score ELSE away_score - home_score END + line AS m FROM finals, (SELECT unnest([{', '.join(f'{x}e0' for x in LINES)}]) AS line), (SELECT unnest(['home', 'away']) AS side)),
      q AS (SELECT event_id, leg, abs(line * 4) % 2 = 1 AS quarter, m, {COMPONENT.format(m='(m - 0.25)')} AS a, {COMPONENT.format(m='(m + 0.25)')} AS b FROM h),
      o AS (SELECT event_id, leg, CASE WHEN quarter THEN CASE WHEN a = 'won' AND b = 'won' THEN 'won' WHEN a = 'lost' AND b = 'lost' THEN 'lost' WHEN a = 'won' OR b = 'won' THEN 'half_won' ELSE 'half_lost' END WHEN m > 0 THEN 'won' ELSE 'lost' END AS outcome FROM q
        UNION ALL SELECT event_id, 'total over', {COMPONENT.format(m='(home_score + away_score - 3)')} FROM finals UNION ALL SELECT event_id, 'total under', {COMPONENT.format(m='(3 - home_score - away_score)')} FROM finals
        UNION ALL SELECT event_id, 'dnb home', {COMPONENT.format(m='(home_score - away_score)')} FROM finals UNION ALL SELECT event_id, 'dnb away', {COMPONENT.format(m='(away_score - home_score)')} FROM finals
        UNION ALL SELECT event_id, 'dc 1X', CASE WHEN home_score >= away_score THEN 'won' ELSE 'lost' END FROM finals UNION ALL SELECT event_id, 'dc X2', CASE WHEN home_score <= away_score THEN 'won' ELSE 'lost' END FROM finals
        UNION ALL SELECT event_id, 'dc 12', CASE WHEN home_score <> away_score THEN 'won' ELSE 'lost' END FROM finals UNION ALL SELECT event_id, 'both', CASE WHEN home_score > 0 AND away_score > 0 THEN 'won' ELSE 'lost' END FROM finals)
      SELECT event_id, leg, outcome, CASE outcome WHEN 'won' THEN 9e0 WHEN 'half_won' THEN 4.5e0 WHEN 'push' THEN 0e0 WHEN 'half_lost' THEN -5e0 ELSE -10e0 END AS pnl FROM o""",
}
