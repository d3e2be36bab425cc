"""Queries of the learned filter: features with labels, scope, quality, out-of-fold scores and the cut that they allow."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions.keys import family_of, line_of_key
from fairline.operators import backtest, filtering
from fairline.plans.study import CANDS, wide
from fairline.plans.value import rounded
from fairline.session import cut
from fairline.sources.picks import KEYED_CTE, keyed



def team_rows(matches: DataFrame) -> DataFrame:
    """A row a team and match; every sixth match has no goals recorded."""
    goals = lambda c: F.when(F.col("match_id") % 6 != 0, F.col(c))
    side = lambda own, other: matches.select("match_id", "played", F.lit(own).alias("side"), F.concat_ws("|", "league", own).alias("team"), goals(f"{own}_goals").alias("scored"), goals(f"{other}_goals").alias("conceded"))
    return side("home", "away").unionByName(side("away", "home"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with an edge, their features and labels."""
    m = wide(spark, sf_dir)
    c = backtest.candidates(m, "multiplicative")
    other = backtest.candidates(m, "additive").select("match_id", "pick", F.col("fair").alias("fair2"))
    f = filtering.form(team_rows(m), ("scored", "conceded")).where("side = 'home'").select("match_id", "scored_r5", "conceded_r5", "scored_r10")
    c = c.withColumn("rank", filtering.fair_rank(["match_id"])).where("edge > 0").join(other, ["match_id", "pick"]).join(f, "match_id")
    c = c.withColumns({"spread": filtering.method_spread([F.col("fair"), F.col("fair2")]), "days_left": F.datediff(filtering.season_end(F.col("played")), F.col("played")).cast("double"), "beat_close": (F.col("clv") > 0).cast("double"), "code": filtering.season_code(F.col("played"))})
    return c.withColumn("rank", F.col("rank").cast("double"))


def filter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels of every candidate."""
    f = rounded(features(spark, sf_dir), "edge", "fair", "spread", "scored_r5", "conceded_r5", "scored_r10")
    return f.select("match_id", F.col("pick").cast("long").alias("pick"), "kind", F.col("band").cast("int").alias("band"), "edge", "fair", "spread", F.col("rank").cast("long").alias("rank"), "scored_r5", "conceded_r5", "scored_r10", F.col("days_left").cast("long").alias("days_left"), "code", "beat_close")


def filter_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which leagues and markets the filter knows, local kickoffs in UTC and half lines."""
    k = keyed(spark, sf_dir)
    family = family_of(F.col("key"))
    width = F.when(F.col("key") == "1x2", 3).otherwise(2)
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("id") % 360).cast("int"))
    kickoff = filtering.local_kickoff(day, F.when(F.col("id") % 4 != 0, F.concat(F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit(":30"))))
    return k.select("id", filtering.league_code(F.col("league")).alias("code"), filtering.market_scope(family, F.col("key"), width).alias("scope"), F.coalesce(filtering.half_line(line_of_key(F.col("key"))), F.lit(False)).alias("half"), F.date_format(kickoff, "yyyy-MM-dd HH:mm").alias("kickoff"))


def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of nulls of each feature and label."""
    return filtering.quality_report(features(spark, sf_dir), ["edge", "scored_r5", "conceded_r5", "clv", "close_fair"])


def filter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores' log loss of every season but the first two, next to the base rate's."""
    f = cut(features(spark, sf_dir).where("clv IS NOT NULL").select(*filtering.KEYS, "season", *filtering.NUMBERS, *filtering.WORDS, F.col("beat_close").alias("y")))
    seasons = [r.season for r in f.select("season").distinct().orderBy("season").collect()]
    return rounded(filtering.fold_metrics(filtering.out_of_fold(f, seasons)), "loss", "base_loss")


QUERIES = {"filter_features": filter_features, "filter_scope": filter_scope, "feature_quality": feature_quality, "filter_scores": filter_scores}
BAND = "CASE WHEN odds <= 1.5 THEN 0 WHEN odds <= 2 THEN 1 WHEN odds <= 3 THEN 2 WHEN odds <= 5 THEN 3 WHEN odds <= 10 THEN 4 ELSE 5 END"
FEATURES_CTE = f"""{CANDS}
tl AS (SELECT match_id, played, 'home' AS side, league || '|' || home AS team, CASE WHEN match_id % 6 <> 0 THEN home_goals END AS s, CASE WHEN match_id % 6 <> 0 THEN away_goals END AS c FROM wide UNION ALL SELECT match_id, played, 'away', league || '|' || away, CASE WHEN match_id % 6 <> 0 THEN away_goals END, CASE WHEN match_id % 6 <> 0 THEN home_goals END FROM wide),
tp AS (SELECT match_id, side, list(s) FILTER (s IS NOT NULL) OVER w AS ls, list(c) FILTER (c IS NOT NULL) OVER w AS lc FROM tl WINDOW w AS (PARTITION BY team ORDER BY played, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fm AS (SELECT match_id, list_avg(list_slice(ls, greatest(len(ls) - 4, 1), len(ls))) AS s5, list_avg(list_slice(lc, greatest(len(lc) - 4, 1), len(lc))) AS c5, list_avg(list_slice(ls, greatest(len(ls) - 9, 1), len(ls))) AS s10 FROM tp WHERE side = 'home'),
rk AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY fair DESC, pick) AS rank FROM ca),
w2 AS (SELECT match_id, 1 / sharp[1] AS q0, 1 / sharp[2] AS q1, 1 / sharp[3] AS q2 FROM wide),
ft AS (SELECT r.*, s5, c5, s10, abs(fair - CASE WHEN least(q0, q1, q2) - (q0 + q1 + q2 - 1) / 3 <= 0 THEN [q0, q1, q2][pick + 1] / (q0 + q1 + q2) ELSE [q0, q1, q2][pick + 1] - (q0 + q1 + q2 - 1) / 3 END) AS spread,
  make_date(year(played) + CASE WHEN month(played) <= 7 THEN 0 ELSE 1 END, 6, 30) AS ends, year(played) - CASE WHEN month(played) >= 7 THEN 0 ELSE 1 END AS y1 FROM rk r JOIN fm USING (match_id) JOIN w2 USING (match_id) WHERE edge > 0),
"""
ORACLES = {
    "filter_features": f"""WITH {FEATURES_CTE} z AS (SELECT 1) SELECT match_id, pick::BIGINT AS pick, CASE WHEN pick = 1 THEN 'draw' WHEN fair >= 0.5 THEN 'favourite' ELSE 'underdog' END AS kind, {BAND} AS band, round(edge, 6) AS edge, round(fair, 6) AS fair, round(spread, 6) AS spread, rank,
      round(s5, 6) AS scored_r5, round(c5, 6) AS conceded_r5, round(s10, 6) AS scored_r10, date_diff('day', played, ends) AS days_left, lpad((y1 % 100)::VARCHAR, 2, '0') || lpad(((y1 + 1) % 100)::VARCHAR, 2, '0') AS code, CASE WHEN clv > 0 THEN 1e0 WHEN clv <= 0 THEN 0e0 END AS beat_close FROM ft""",
    "filter_scope": f"""WITH {KEYED_CTE} d AS (SELECT *, DATE '1996-01-01' + CAST(id % 360 AS INTEGER) AS day FROM keyed), k AS (SELECT *, CASE WHEN id % 4 <> 0 THEN day + INTERVAL 1 HOUR * (id % 24) + INTERVAL 30 MINUTE END AS t FROM d)
      SELECT id, CASE league WHEN 'England - Premier League' THEN 'E0' WHEN ' premier  LEAGUE' THEN 'E0' WHEN 'Serie A' THEN 'I1' END AS code, CASE WHEN key = '1x2' THEN '1x2' WHEN key = 'over_under_2_5' THEN 'ou25' END AS scope,
        key IN ('over_under_2_5', 'asian_handicap_-1_5', 'over_under_games_215_5', 'asian_handicap_games_-7_5_games', 'asian_handicap_+2_5_sets', 'over_under_sets_2_5') AS half,
        strftime(CASE WHEN t >= TIMESTAMP '1996-03-31 01:00:00' AND t < TIMESTAMP '1996-10-27 02:00:00' THEN t - INTERVAL 1 HOUR ELSE t END, '%Y-%m-%d %H:%M') AS kickoff FROM k""",
    "feature_quality": f"""WITH {FEATURES_CTE} z AS (SELECT count(*) AS n, [avg(CASE WHEN edge IS NULL THEN 1 ELSE 0 END), avg(CASE WHEN s5 IS NULL THEN 1 ELSE 0 END), avg(CASE WHEN c5 IS NULL THEN 1 ELSE 0 END), avg(CASE WHEN clv IS NULL THEN 1 ELSE 0 END), avg(CASE WHEN close_fair IS NULL THEN 1 ELSE 0 END)] AS r FROM ft)
      SELECT unnest(['edge', 'scored_r5', 'conceded_r5', 'clv', 'close_fair']) AS "column", n, round(unnest(r), 6) AS null_rate FROM z""",
}
