"""Queries of boards and audits: latest picks, performance, evidence strata, self-audit, upserts, alerts, match rates and capture order."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import keys as fk
from fairline.functions import odds as fo
from fairline.operators import capture, reports, resolve, settlement, upserts
from fairline.plans import history
from fairline.plans.desk import KIND, NORM, OUTCOME, PNL
from fairline.sources.bridge import table
from fairline.sources.picks import PICKS_CTE, QUOTES_CTE, picks, quotes

NOW = "TIMESTAMP_NTZ'1997-06-01 00:00:00'"
SETTLED = "TIMESTAMP_NTZ'2100-01-01 00:00:00'"


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled picks with their closing value and what is known of it."""
    p = settlement.settlement_step(picks(spark, sf_dir), F.expr(SETTLED), no_score_days=100_000).where("outcome IS NOT NULL AND outcome <> 'void'")
    p = p.withColumn("clv", fo.clv_log(F.col("odds"), F.col("close_fair")))
    own, close = fo.anchor_type(F.col("anchor_book")), fo.anchor_type(F.col("close_book"))
    p = p.withColumns({
        "anchor": own, "close_anchor": close, "kept": F.when(F.col("version") != 1, settlement.kept_independent(F.col("close_book"), F.col("book"), F.col("pick_fair"), F.col("close_fair"))),
        "bad": settlement.tautological_close(F.col("clv"), F.col("close_fair"), F.col("pick_fair")) | settlement.fabricated_close(F.col("clv"), F.col("odds"), F.col("close_fair")), "asym": settlement.asymmetric_fallback(F.col("mint_fell_back"), F.col("close_fell_back")),
    })
    none = F.lit(False)
    trust = lambda unknown: settlement.trusted_close(F.col("has_close"), F.col("close_anchor"), F.col("kept"), F.col("bad"), F.col("asym"), none, unknown_is_independent=unknown)
    return p.withColumns({"evidence": trust(True), "headline": trust(False), "clean": F.when(~F.col("bad"), F.col("clv")), "score": F.when(F.col("version") > 0, F.least(F.col("pick_fair") + 0.35, F.lit(0.99)))})


def latest_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest picks of the board: premium ones over the least edge and volume ones over theirs, with dimensions, score text, price floor and what the score would give."""
    p = picks(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("league"), "n_regionkey")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("country"))
    edge = F.col("pick_fair") - 1 / F.col("odds")
    shown = p.withColumn("edge", edge).where((F.col("edge") >= F.when(F.col("tier") == "premium", 0.02).otherwise(0.01)) & F.col("kickoff").isNotNull())
    top = shown.orderBy(F.desc("created_at"), F.desc("pick_id")).limit(60)
    outcome = settlement.settle_selection(*(F.col(x) for x in ("family", "selection", "home", "away", "home_score", "away_score")))
    full = top.join(c, "event_id").join(n, "c_nationkey").join(r, "n_regionkey")
    return full.select(
        "pick_id", "league", "country", "home", "away", "tier", F.round("edge", 6).alias("edge"), F.concat_ws("-", F.col("home_score").cast("string"), F.col("away_score").cast("string")).alias("score_text"), outcome.alias("provisional"),
        F.round(fo.min_acceptable_odds(F.col("pick_fair"), 0.01, F.col("book")), 6).alias("floor"),
    )


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline by tier, by sport and in all: outcomes, turnover, profit, stake-weighted clean closing value, and the trusted closes' own; rates are withheld under 20 picks."""
    g = graded(spark, sf_dir)
    won = lambda o: F.count_if(F.col("outcome") == o)
    enough = F.count("*") >= 20
    known = F.col("clean").isNotNull()
    weighted = reports.ratio(F.sum(F.when(known, F.col("stake") * F.col("clean"))), F.sum(F.when(known, F.col("stake"))))
    sharp = F.when(F.col("headline"), F.col("clean"))
    out = g.groupingSets([["tier"], ["sport"], []], "tier", "sport").agg(
        F.count("*").alias("n"), *(won(o).alias(o) for o in ("won", "lost", "push", "half_won", "half_lost")), F.round(F.sum("stake"), 2).alias("turnover"), F.round(F.sum("pnl"), 2).alias("profit"),
        F.when(enough, F.round(reports.ratio(F.sum("pnl"), F.sum("stake")), 6)).alias("roi"), F.when(enough, F.round(weighted, 6)).alias("clv"), F.when(enough, F.round(F.avg((F.col("clean") > 0).cast("int")), 6)).alias("beat"),
        F.count(sharp).alias("sharp_n"), F.round(F.avg(sharp), 6).alias("sharp_clv"),
    )
    return out


def score_bucket(score: Column, cut: float = 0.725) -> Column:
    return F.when(score.isNull(), "unscored").when(score >= cut, "over").otherwise("under")


def evidence_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata by score bucket, tier, anchor, close anchor and sport, one dimension at a time, over all picks and the trusted closes."""
    g = graded(spark, sf_dir).withColumn("bucket", score_bucket(F.col("score")))
    dims = ["bucket", "tier", "anchor", "close_anchor", "sport"]
    rows = g.select("*", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("stratum")) for d in dims))).alias("d")).select("*", "d.*")
    enough = F.count("*") >= 5
    return rows.groupBy("dimension", "stratum").agg(
        F.count("*").alias("n"), F.count("clean").alias("n_clv"), F.when(enough, F.round(F.avg("clean"), 6)).alias("clv"), F.when(enough, F.round(reports.ratio(F.sum("pnl"), F.sum("stake")), 6)).alias("roi"),
        F.count(F.when(F.col("evidence"), F.col("clean"))).alias("n_sharp"), F.when(enough, F.round(F.avg(F.when(F.col("evidence"), F.col("clean"))), 6)).alias("sharp_clv"),
    )


def score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the score foretells a beaten close, by the close's anchor and in all."""
    g = graded(spark, sf_dir).where("score IS NOT NULL AND clean IS NOT NULL").withColumn("y", (F.col("clean") > 0).cast("double")).withColumn("by", F.when(F.col("has_close"), F.col("close_anchor")).otherwise("unknown"))
    b = F.least(F.floor(F.col("score") * 10), F.lit(9))
    loss = -F.when(F.col("y") == 1, F.log("score")).otherwise(F.log(1 - F.col("score")))
    parts = g.withColumn("bin", b).groupingSets([["by", "bin"], ["bin"]], "by", "bin").agg(F.grouping("by").alias("all"), F.count("*").alias("n"), F.sum("score").alias("sp"), F.sum("y").alias("sy"), F.sum(loss).alias("sl"))
    return parts.groupBy(F.when(F.col("all") == 1, "all").otherwise(F.col("by")).alias("by")).agg(F.sum("n").alias("n"), F.round(F.sum("sl") / F.sum("n"), 6).alias("log_loss"), F.round(F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n"), 6).alias("ece"))


def band_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premium picks that were won or lost outright, by price band."""
    g = graded(spark, sf_dir).where("tier = 'premium'")
    binary = F.col("outcome").isin("won", "lost")
    return g.groupBy(fo.odds_band(F.col("odds")).alias("band")).agg(F.count_if(binary).alias("n"), F.count_if(~binary).alias("left_out"), F.round(F.avg(F.when(binary, (F.col("outcome") == "won").cast("int"))), 6).alias("rate"))


def self_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of the picks and quotes as of a time: what waits for settlement too long, and quotes that stopped coming."""
    p = picks(spark, sf_dir).agg(F.count_if((F.col("kickoff") <= F.expr(f"timestampadd(HOUR, -6, {NOW})")) & F.col("home_score").isNull()).alias("awaiting"))
    q = quotes(spark, sf_dir).where(F.col("captured_at") <= F.expr(NOW)).agg(F.max("captured_at").alias("newest"))
    state = p.crossJoin(q).withColumn("now", F.expr(NOW))  # one row each
    return capture.anomalies(state, backlog=10)


def dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which leagues of incoming picks are new to the dimension, and how many rows each brings."""
    incoming = picks(spark, sf_dir).select(F.col("sport").alias("key"), F.concat(F.lit("c"), F.pmod("event_id", F.lit(6))).alias("country"))
    kept = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit("soccer").alias("key"), F.concat(F.lit("c"), F.col("r_regionkey")).alias("country"))
    full = upserts.get_or_create(kept, incoming, ["key", "country"])
    n = incoming.groupBy("key", "country").agg(F.count("*").alias("rows"))
    return full.join(n, ["key", "country"], "left").select("key", "country", F.coalesce("rows", F.lit(0)).alias("rows"), (~F.col("id").between(0, 100)).alias("new"))


def appended_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that are new beside those kept: the first of each observation, only of events that exist."""
    q = quotes(spark, sf_dir)
    kept, incoming = q.where("l_orderkey % 3 = 0"), q.where("l_orderkey % 3 <> 0")
    key = ["event_id", "key", "book_id", "sel_idx", "captured_at"]
    events = q.where("event_id % 10 <> 0").select("event_id").distinct()
    return upserts.appended(kept, upserts.attached(incoming, events, ["event_id"]), key, ["l_orderkey", "l_linenumber", "odds"]).select("event_id", "key", "book_id", "sel_idx", F.date_format("captured_at", "yyyy-MM-dd HH").alias("hour"), "odds", "l_orderkey")


def fresh_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-only quotes, and those whose version is over all before."""
    q = quotes(spark, sf_dir).withColumn("version", F.col("l_orderkey") % 50)
    key, order = ["event_id", "key", "book_id", "sel_idx"], ["captured_at", "l_orderkey", "l_linenumber", "odds"]
    changed = upserts.changed_only(q, key, order, "odds").select("l_orderkey", "l_linenumber", F.lit("price").alias("why"))
    return changed.unionByName(upserts.advanced_only(q, ["event_id", "key"], order, "version").select("l_orderkey", "l_linenumber", F.lit("version").alias("why")))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert keys, the same for the same pick whatever its id, and how many rows share one; the text of the first."""
    p = picks(spark, sf_dir).where("tier = 'premium'").withColumn("edge", F.col("pick_fair") - 1 / F.col("odds"))
    a = p.withColumn("alert", upserts.alert_key(F.col("event_id"), F.col("family"), F.col("selection"), F.col("version"))).groupBy("alert").agg(F.count("*").alias("rows"), F.min_by(F.struct("event_id", "selection", "book", "odds", "edge"), "pick_id").alias("f"))
    return a.select("alert", "rows", upserts.alert_text(F.concat(F.lit("event "), F.col("f.event_id").cast("string")), F.col("f.selection"), F.col("f.book"), F.col("f.odds"), F.col("f.edge")).alias("text"))


def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of fixtures that the second source has under the same canonical names, by league and in all, and how many have a fixture of their day at all."""
    ours, theirs = history.event_sides(spark, sf_dir)
    m = resolve.match_strict(ours, theirs, aliases=history.aliases(spark))
    days = theirs.select(F.to_date("kickoff").alias("day")).distinct().withColumn("any", F.lit(True))
    o = ours.join(m.select(F.col("left_ref").alias("ref"), F.lit(True).alias("hit")), "ref", "left").withColumn("day", F.to_date("kickoff")).join(days, "day", "left")
    g = o.groupingSets([["league"], []], "league").agg(F.count("*").alias("n"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull() & F.col("any")).alias("unmatched_in_window"))
    return g.withColumn("rate", F.round(F.col("matched") / F.nullif(F.col("n"), F.lit(0)), 6))


def revisit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to price again outside the window: those with premium picks first, never tried next, then the longest ago; covered ones and foreign hosts left out, at most 25."""
    p = picks(spark, sf_dir).withColumn("tried", F.when(F.col("pick_id") % 3 != 0, F.col("created_at")))
    url = F.concat(F.when(F.col("event_id") % 7 == 0, "https://evil.example.com/").otherwise("https://www.oddsportal.com/"), F.lit("soccer/"), F.col("event_id").cast("string"))
    covered = picks(spark, sf_dir).where("event_id % 5 = 0").select("event_id").distinct()
    e = p.groupBy("event_id").agg(F.max((F.col("tier") == "premium").cast("int")).alias("premium"), F.min("tried").alias("tried")).withColumn("url", url).where(fk.allowed_url(F.col("url"))).join(covered, "event_id", "left_anti")
    return e.orderBy(F.desc("premium"), F.asc_nulls_first("tried"), "event_id").limit(25).select("event_id", F.col("premium").cast("long").alias("premium"), F.date_format("tried", "yyyy-MM-dd").alias("tried"))


QUERIES = {
    "latest_picks": latest_picks, "performance": performance, "evidence_strata": evidence_strata, "score_calibration": score_calibration, "band_observations": band_observations, "self_audit": self_audit, "dimension_rows": dimension_rows,
    "appended_quotes": appended_quotes, "fresh_quotes": fresh_quotes, "alerts": alerts, "match_rate": match_rate, "revisit_order": revisit_order,
}
GRADED = f"""{PICKS_CTE}
ou AS (SELECT *, {OUTCOME} AS outcome, {NORM.format(c="close_book")} AS cb, {NORM.format(c="book")} AS fb, CASE WHEN close_fair > 0 AND close_fair < 1 THEN ln(odds * close_fair) END AS clv FROM picks WHERE kickoff IS NOT NULL),
pn AS (SELECT *, {PNL.format(o="outcome")} AS pnl, {KIND.format(c=NORM.format(c="anchor_book"))} AS anchor, {KIND.format(c="cb")} AS close_anchor, CASE WHEN version <> 1 THEN (cb IN ('', 'consensus') OR cb <> fb) AND coalesce(abs(close_fair - pick_fair) > 1e-3, false) END AS kept,
  coalesce(clv IS NOT NULL AND (abs(close_fair - pick_fair) <= 1e-3 OR close_fair - 1 / odds > 0.2 OR abs(clv) > 0.5), false) AS bad, coalesce(mint_fell_back <> close_fell_back, false) AS asym FROM ou WHERE outcome IS NOT NULL),
gd AS (SELECT *, has_close AND close_anchor IN ('pinnacle', 'sharp') AND NOT bad AND NOT asym AND coalesce(kept, true) AS evidence, has_close AND close_anchor IN ('pinnacle', 'sharp') AND NOT bad AND NOT asym AND coalesce(kept, false) AS headline,
  CASE WHEN NOT bad THEN clv END AS clean, CASE WHEN version > 0 THEN least(pick_fair + 0.35e0, 0.99e0) END AS score FROM pn),
"""
BAND = "CASE WHEN odds <= 1.5 THEN 0 WHEN odds <= 2 THEN 1 WHEN odds <= 3 THEN 2 WHEN odds <= 5 THEN 3 WHEN odds <= 10 THEN 4 ELSE 5 END"
STRATA = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS stratum, * FROM gd" for d, c in (("bucket", "CASE WHEN score IS NULL THEN 'unscored' WHEN score >= 0.725 THEN 'over' ELSE 'under' END"), ("tier", "tier"), ("anchor", "anchor"), ("close_anchor", "close_anchor"), ("sport", "sport")))
D_NOW = "TIMESTAMP '1997-06-01'"
ORACLES = {
    "latest_picks": f"""WITH {PICKS_CTE} s AS (SELECT *, pick_fair - 1 / odds AS edge, {OUTCOME} AS provisional FROM picks WHERE kickoff IS NOT NULL), t AS (SELECT * FROM s WHERE edge >= CASE tier WHEN 'premium' THEN 0.02 ELSE 0.01 END ORDER BY created_at DESC, pick_id DESC LIMIT 60)
      SELECT pick_id, n_name AS league, r_name AS country, home, away, tier, round(edge, 6) AS edge, concat_ws('-', home_score, away_score) AS score_text, provisional, CASE WHEN pick_fair > 0.01 THEN round(1 + (1 / (pick_fair - 0.01e0) - 1) / CASE WHEN book = 'betfair exchange' THEN 0.95e0 ELSE 1e0 END, 6) END AS floor
      FROM t JOIN customer ON event_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "performance": f"""WITH {GRADED} z AS (SELECT 1) SELECT tier, sport, count(*) AS n, count(*) FILTER (outcome = 'won') AS won, count(*) FILTER (outcome = 'lost') AS lost, count(*) FILTER (outcome = 'push') AS push, count(*) FILTER (outcome = 'half_won') AS half_won, count(*) FILTER (outcome = 'half_lost') AS half_lost, round(sum(stake), 2) AS turnover, round(sum(pnl), 2) AS profit,
      CASE WHEN count(*) >= 20 THEN round(sum(pnl) / sum(stake), 6) END AS roi, CASE WHEN count(*) >= 20 THEN round(sum(stake * clean) / sum(stake) FILTER (clean IS NOT NULL), 6) END AS clv, CASE WHEN count(*) >= 20 THEN round(avg(CASE WHEN clean > 0 THEN 1 WHEN clean <= 0 THEN 0 END), 6) END AS beat,
      count(clean) FILTER (headline) AS sharp_n, round(avg(clean) FILTER (headline), 6) AS sharp_clv FROM gd GROUP BY GROUPING SETS ((tier), (sport), ())""",
    "evidence_strata": f"""WITH {GRADED} u AS ({STRATA}) SELECT dimension, stratum, count(*) AS n, count(clean) AS n_clv, CASE WHEN count(*) >= 5 THEN round(avg(clean), 6) END AS clv, CASE WHEN count(*) >= 5 THEN round(sum(pnl) / sum(stake), 6) END AS roi, count(clean) FILTER (evidence) AS n_sharp,
      CASE WHEN count(*) >= 5 THEN round(avg(clean) FILTER (evidence), 6) END AS sharp_clv FROM u GROUP BY ALL""",
    "score_calibration": f"""WITH {GRADED} o AS (SELECT score AS p, CASE WHEN clean > 0 THEN 1e0 ELSE 0e0 END AS y, CASE WHEN has_close THEN close_anchor ELSE 'unknown' END AS grp FROM gd WHERE score IS NOT NULL AND clean IS NOT NULL), a AS (SELECT * FROM o UNION ALL SELECT p, y, 'all' FROM o),
      b AS (SELECT grp, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS sl FROM a GROUP BY ALL) SELECT grp AS by, CAST(sum(n) AS BIGINT) AS n, round(sum(sl) / sum(n), 6) AS log_loss, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM b GROUP BY grp""",
    "band_observations": f"WITH {GRADED} z AS (SELECT 1) SELECT {BAND} AS band, count(*) FILTER (outcome IN ('won', 'lost')) AS n, count(*) FILTER (outcome NOT IN ('won', 'lost')) AS left_out, round(avg(CASE outcome WHEN 'won' THEN 1 WHEN 'lost' THEN 0 END), 6) AS rate FROM gd WHERE tier = 'premium' GROUP BY 1",
    "self_audit": f"""WITH {PICKS_CTE} {QUOTES_CTE} s AS (SELECT (SELECT count(*) FROM picks WHERE kickoff <= {D_NOW} - INTERVAL 6 HOUR AND home_score IS NULL) AS awaiting, (SELECT max(captured_at) FROM quotes WHERE captured_at <= {D_NOW}) AS newest)
      SELECT 'settlement_backlog' AS code, 'WARN' AS level FROM s WHERE awaiting > 10 UNION ALL SELECT 'stale_odds', 'ERROR' FROM s WHERE newest IS NULL OR epoch({D_NOW}) - epoch(newest) > 7200""",
    "dimension_rows": f"""WITH {PICKS_CTE} i AS (SELECT sport AS key, 'c' || (event_id % 6) AS country, count(*) AS rows FROM picks GROUP BY ALL), k AS (SELECT 'soccer' AS key, 'c' || r_regionkey AS country FROM region)
      SELECT coalesce(i.key, k.key) AS key, coalesce(i.country, k.country) AS country, coalesce(rows, 0) AS rows, k.key IS NULL AS new FROM i FULL JOIN k ON i.key = k.key AND i.country = k.country""",
    "appended_quotes": f"""WITH {QUOTES_CTE} f AS (SELECT *, row_number() OVER (PARTITION BY event_id, key, book_id, sel_idx, captured_at ORDER BY l_orderkey, l_linenumber, odds) AS rn FROM quotes WHERE l_orderkey % 3 <> 0 AND event_id % 10 <> 0)
      SELECT event_id, key, book_id, sel_idx, strftime(captured_at, '%Y-%m-%d %H') AS hour, odds, l_orderkey FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM quotes q WHERE q.l_orderkey % 3 = 0 AND q.event_id = f.event_id AND q.key = f.key AND q.book_id = f.book_id AND q.sel_idx = f.sel_idx AND q.captured_at = f.captured_at)""",
    "fresh_quotes": f"""WITH {QUOTES_CTE} c AS (SELECT l_orderkey, l_linenumber, odds, lag(odds) OVER w AS before, l_orderkey % 50 AS version, max(l_orderkey % 50) OVER (PARTITION BY event_id, key ORDER BY captured_at, l_orderkey, l_linenumber, odds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM quotes WINDOW w AS (PARTITION BY event_id, key, book_id, sel_idx ORDER BY captured_at, l_orderkey, l_linenumber, odds))
      SELECT l_orderkey, l_linenumber, 'price' AS why FROM c WHERE before IS NULL OR before <> odds UNION ALL SELECT l_orderkey, l_linenumber, 'version' FROM c WHERE top IS NULL OR version > top""",
    "alerts": f"""WITH {PICKS_CTE} a AS (SELECT sha256(concat_ws('|', event_id::VARCHAR, family, selection, version::VARCHAR)) AS alert, count(*) AS rows, arg_min(struct_pack(e := event_id, s := selection, b := book, o := odds, g := pick_fair - 1 / odds), pick_id) AS f FROM picks WHERE tier = 'premium' GROUP BY 1)
      SELECT alert, rows, printf('event %d: %s at %.2f (%s), edge %.1f%%', f.e, f.s, f.o, f.b, f.g * 100) AS text FROM a""",
    "match_rate": f"""WITH {history.SIDES_CTE} al AS (SELECT unnest(['the rovers', 'bexley town', 'cor united']) AS alias, unnest(['arkham rovers', 'bexham town', 'corham united']) AS canon),
      l AS (SELECT ref, kickoff, coalesce(x.canon, home) AS home, coalesce(y.canon, away) AS away FROM ours LEFT JOIN al x ON home = x.alias LEFT JOIN al y ON away = y.alias), r AS (SELECT ref, kickoff, coalesce(x.canon, home) AS home, coalesce(y.canon, away) AS away FROM theirs LEFT JOIN al x ON home = x.alias LEFT JOIN al y ON away = y.alias),
      o AS (SELECT ref, 'Division ' || ((ref // 4) % {history.DIVISIONS}) AS league, EXISTS (SELECT 1 FROM r WHERE r.home = l.home AND r.away = l.away AND abs(date_diff('day', l.kickoff::DATE, r.kickoff::DATE)) <= 1) AND home <> away AS hit, l.kickoff::DATE IN (SELECT kickoff::DATE FROM theirs) AS seen FROM l)
      SELECT league, count(*) AS n, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit AND seen) AS unmatched_in_window, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM o GROUP BY GROUPING SETS ((league), ())""",
    "revisit_order": f"""WITH {PICKS_CTE} e AS (SELECT event_id, max(CASE WHEN tier = 'premium' THEN 1 ELSE 0 END) AS premium, min(created_at) FILTER (pick_id % 3 <> 0) AS tried FROM picks GROUP BY event_id)
      SELECT event_id, premium::BIGINT AS premium, strftime(tried, '%Y-%m-%d') AS tried FROM e WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 ORDER BY e.premium DESC, e.tried NULLS FIRST, event_id LIMIT 25""",
}
