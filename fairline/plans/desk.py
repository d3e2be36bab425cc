"""Queries of the desk: market keys, policy look-ups, ratings, settlement, closing evidence and pick upserts, over a pick an order."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import keys as fk
from fairline.functions import odds as fo
from fairline.operators import settlement, upserts
from fairline.operators.reports import wilson
from fairline.plans.value import rounded
from fairline.sources.bridge import table
from fairline.sources.picks import KEYED_CTE, PICKS_CTE, keyed, picks

NOW = "TIMESTAMP_NTZ'1997-06-01 00:00:00'"
MIN_EDGE, DEVIG, FEWEST = {"over_under_2_5": 0.02, "spreads": 0.05}, {"h2h": "shin", "btts": "power"}, {"1x2": 4, "totals": 6}
MAJORS = ("Premier League", "Serie A")
SHOWN_ONLY = ("soccer:asian_handicap", "btts", "basketball:totals")
BANDS = ((1.5, 3.0), (4.0, 6.0))


def market_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider keys: family, stored form and back, line, labels, and the keys that a pick of the first label needs."""
    k, key = keyed(spark, sf_dir), F.col("key")
    labels = fk.labels_of_key(key, F.col("home"), F.col("away"))
    first = F.try_element_at(labels, F.lit(1))["selection"]
    stored = fk.stored_key(fk.family_of(key), F.when(~key.isin("btts", "dnb"), key))
    return k.select(
        "id", fk.family_of(key).alias("family"), stored.alias("stored"), fk.read_key(stored)["family"].alias("read_family"), fk.read_key(stored)["detail"].alias("read_detail"), fk.line_of_key(key).alias("line"),
        F.size(labels).alias("n_labels"), F.concat_ws("|", F.transform(labels, lambda x: F.concat_ws("=", x["label"], x["selection"]))).alias("labels"),
        F.concat_ws("|", fk.keys_of_pick(F.col("sport"), fk.family_of(key), first)).alias("pick_keys"), fk.line_of_selection(first).alias("selection_line"),
    )


def needed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sport, the keys that all its picks need; null if one of them has no mapping. Picks of one kind of market in ten are left out, so that some sports have all mapped."""
    k = keyed(spark, sf_dir).withColumn("family", fk.family_of(F.col("key")))
    first = F.try_element_at(fk.labels_of_key(F.col("key"), F.col("home"), F.col("away")), F.lit(1))["selection"]
    rows = k.where("family IS NOT NULL OR sport = 'soccer'").withColumn("needs", fk.keys_of_pick(F.col("sport"), F.col("family"), first))
    return rows.groupBy("sport").agg(F.concat_ws("|", fk.keys_of_picks(F.col("needs"))).alias("needs"), F.count_if(F.col("needs").isNull()).alias("unmapped"))


def policy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides by market, league and sport gates, price bands, handicap sanity and the market's visibility for every key."""
    k = keyed(spark, sf_dir).withColumn("family", F.coalesce(fk.family_of(F.col("key")), F.lit("other")))
    family, detail = F.col("family"), F.col("key")
    return k.select(
        "id", F.concat_ws("|", fk.lookup_keys(family, detail)).alias("tried"), fk.policy_value(MIN_EDGE, family, detail, 0.03).alias("min_edge"), fk.policy_value({"h2h": 0.2}, family, detail, 0.3).alias("max_edge"),
        fk.policy_value(DEVIG, family, detail, "multiplicative").alias("method"), fk.policy_value(FEWEST, family, detail, 0).alias("fewest"), fk.league_name(F.col("league")).alias("league"),
        fk.major_league(MAJORS, F.col("league")).alias("major"), fk.visibility_only(SHOWN_ONLY, family, detail, F.col("sport")).alias("shown_only"), fk.in_bands(F.col("odds"), BANDS).alias("in_bands"),
        fk.asian_handicap(detail).alias("asian"), fk.plausible_handicap(F.col("odds"), F.col("fair"), 1 / F.col("odds")).alias("plausible"), fk.unvalidated_sport(F.col("sport")).alias("unvalidated"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars, label, bands, anchor kinds, ticks and money stakes of every pick."""
    p = picks(spark, sf_dir)
    edge, score = F.col("pick_fair") - 1 / F.col("odds"), F.when(F.col("version") > 0, F.col("pick_fair") + 0.2)
    kind = fo.anchor_type(F.col("anchor_book"))
    r = fo.confidence_rating(edge, 0.03, kind, score)
    stake = fo.recommended_stake(F.col("pick_fair"), F.col("odds"), max_drawdown=0.2, probability=0.1, variance=edge * edge, coefficient=10.0, legs=F.col("version"), rho=0.25)
    return p.select(
        "pick_id", kind.alias("anchor_kind"), fo.sharp_anchored(F.col("anchor_book")).alias("sharp"), r["level"].alias("level"), r["label"].alias("label"), r["score"].alias("score"), F.concat_ws("; ", r["reasons"]).alias("reasons"),
        fo.within_one_tick(F.col("odds"), F.col("odds") + 0.04).alias("one_tick"), fo.ceil_odds(F.col("odds") * 1.0137).alias("ceiled"), F.round(stake["final"], 8).alias("final"),
        fo.stake_amount(F.round(stake["final"], 8), 1000.0).cast("double").alias("money"), F.round(fo.implied(F.col("odds")), 8).alias("implied"), F.round(fo.overround(F.array("odds", F.lit(1.5))), 8).alias("overround"),
    )


def settle_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pick after one settlement cycle: outcome by its market, void where nothing can settle it, profit and return; what its score alone would give."""
    p = settlement.settlement_step(picks(spark, sf_dir), F.expr(NOW))
    early = settlement.settle_selection(*(F.col(c) for c in ("family", "selection", "home", "away", "home_score", "away_score")))
    impossible = fk.implausible_final(F.col("sport"), F.col("home_score"), F.col("away_score"))
    return p.select("pick_id", "outcome", "pnl", F.round("roi", 6).alias("roi"), early.alias("provisional"), F.when(early.isNotNull(), settlement.pick_pnl(early, F.col("stake"), F.col("odds"))).alias("provisional_pnl"), F.coalesce(impossible, F.lit(False)).alias("impossible"))


def close_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known about every pick's close, and whether evidence and headline may rest on it."""
    p = picks(spark, sf_dir).withColumn("clv", fo.clv_log(F.col("odds"), F.col("close_fair")))
    pick_type, close_type = fo.anchor_type(F.col("anchor_book")), fo.anchor_type(F.col("close_book"))
    independent = settlement.independent_close(F.col("close_book"), F.col("book"), pick_type, close_type, F.col("anchor_book"))
    kept = F.when(F.col("version") != 1, settlement.kept_independent(F.col("close_book"), F.col("book"), F.col("pick_fair"), F.col("close_fair")))
    flags = {
        "independent": independent, "moved": settlement.close_moved(F.col("pick_fair"), F.col("close_fair")), "kept": kept,
        "tautological": settlement.tautological_close(F.col("clv"), F.col("close_fair"), F.col("pick_fair")), "fabricated": settlement.fabricated_close(F.col("clv"), F.col("odds"), F.col("close_fair")),
        "asymmetric": settlement.asymmetric_fallback(F.col("mint_fell_back"), F.col("close_fell_back")),
    }
    p = p.withColumns(flags)
    trust = lambda unknown: settlement.trusted_close(F.col("has_close"), close_type, F.col("kept"), F.col("tautological"), F.col("asymmetric"), F.col("fabricated"), unknown_is_independent=unknown)
    return rounded(p, "clv").select("pick_id", "clv", *flags, trust(True).alias("evidence"), trust(False).alias("headline"), F.round(settlement.current_edge(F.col("close_fair"), F.col("book"), F.col("odds")), 6).alias("edge_now"))


def clv_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sport and market, whether trusted closes prove their worth."""
    p = picks(spark, sf_dir).withColumn("clv", fo.clv_log(F.col("odds"), F.col("close_fair"))).where("clv IS NOT NULL")
    n, k = F.count("clv"), F.sum(F.when(F.col("clv") > 0, 1).otherwise(0))
    g = p.groupBy("sport", "family").agg(n.alias("n"), F.avg("clv").alias("mean"), (F.stddev_samp("clv") / F.sqrt(n)).alias("se"), wilson(k, n)[0].alias("low"))
    return rounded(g.withColumn("ready", settlement.clv_ready(F.col("n"), F.col("mean"), F.col("se"), F.col("low"), least=5, beat=0.3, sigmas=0.5)), "mean", "se", "low")


def pick_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming picks merged with those kept: inserted, upgraded from volume to premium without the old price's close, or duplicates; older versions superseded."""
    status = F.when(F.col("pick_id") % 11 == 0, "settled").otherwise("alerted").alias("status")
    p = picks(spark, sf_dir).select("event_id", "family", "selection", "version", "tier", "stake", "odds", F.col("pick_id").alias("seq"), "created_at", status, "close_book", "close_fair")
    kept, incoming = p.where("seq % 2 = 0"), p.where("seq % 2 = 1")
    return upserts.merged_picks(kept, incoming, ("event_id", "family", "selection"), closing=("close_book", "close_fair")).select("event_id", "family", "selection", "version", "tier", "stake", "close_book", F.round("close_fair", 6).alias("close_fair"), "outcome", "superseded")


def kickoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kickoffs by event: the kept one unless a better one comes in."""
    p = picks(spark, sf_dir).withColumn("seen", F.when(F.col("pick_id") % 4 == 0, F.date_trunc("day", "kickoff")).otherwise(F.col("kickoff")))
    old = p.where("pick_id % 2 = 0").groupBy("event_id").agg(F.min("seen").alias("old"))
    new = p.where("pick_id % 2 = 1").groupBy("event_id").agg(F.max("seen").alias("new"))
    both = old.join(new, "event_id", "full")
    return both.select("event_id", F.date_format(fk.preferred_kickoff(F.col("old"), F.col("new")), "yyyy-MM-dd HH:mm").alias("kickoff"), F.coalesce(fk.date_only(F.col("old")), F.lit(False)).alias("old_date_only"))


def allowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which urls of pages may be fetched, for hosts of the test tables and odd forms of each url."""
    u = F.col("url")
    forms = F.array(u, F.replace(u, F.lit("://"), F.lit("://user@")), F.concat(F.regexp_replace(u, r"^(https?://[^/?#]*).*", "$1"), F.lit(":443/x")), F.concat(u, F.lit("\\x")), F.upper(u))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "url"))
    return rows.select("page_id", F.col("form").cast("long").alias("form"), fk.allowed_url(F.col("url"), ("spam-farm.example.org", "www.example.com", "blog.example.net")).alias("allowed"))


QUERIES = {
    "market_keys": market_keys, "needed_keys": needed_keys, "policy_lookup": policy_lookup, "ratings": ratings, "settle_cycle": settle_cycle, "close_flags": close_flags, "clv_gates": clv_gates,
    "pick_ratchet": pick_ratchet, "kickoffs": kickoffs, "allowed_pages": allowed_pages,
}
NUMBER = "CASE WHEN {x} = trunc({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
SIGNED = "CASE WHEN {x} >= 0 THEN '+' ELSE '' END || (" + NUMBER + ")"
#: Family and line of keys, labels as name=selection, and the keys of a pick of the first label.
KEYS_CTE = KEYED_CTE + f"""
fam AS (SELECT *, CASE WHEN key IN ('1x2', 'home_away', 'match_winner') THEN 'h2h' WHEN key IN ('btts', 'dnb', 'double_chance') THEN key WHEN key LIKE 'over\\_under\\_%' ESCAPE '\\' THEN 'totals' WHEN key LIKE 'asian\\_%' ESCAPE '\\' OR key LIKE 'european\\_%' ESCAPE '\\' THEN 'spreads' END AS family,
        CASE key WHEN 'over_under_2_5' THEN 2.5e0 WHEN 'asian_handicap_-1_5' THEN -1.5e0 WHEN 'european_handicap_+1' THEN 1e0 WHEN 'over_under_games_215_5' THEN 215.5e0 WHEN 'asian_handicap_games_-7_5_games' THEN -7.5e0 WHEN 'asian_handicap_+2_5_sets' THEN 2.5e0 WHEN 'over_under_sets_2_5' THEN 2.5e0 WHEN 'asian_handicap_-0_25' THEN -0.25e0 END AS line FROM keyed),
txt AS (SELECT *, {NUMBER.format(x="line")} AS num, {SIGNED.format(x="line")} AS pos, {SIGNED.format(x="(-line)")} AS neg FROM fam),
lab AS (SELECT *, CASE WHEN key = '1x2' THEN ['1=' || home, 'X=Draw', '2=' || away] WHEN key = 'home_away' THEN ['1=' || home, '2=' || away] WHEN key = 'match_winner' THEN ['player_1=' || home, 'player_2=' || away] WHEN key = 'dnb' THEN ['dnb_team1=' || home, 'dnb_team2=' || away]
        WHEN key = 'btts' THEN ['btts_yes=BTTS Yes', 'btts_no=BTTS No'] WHEN key = 'double_chance' THEN ['1X=' || home || ' or Draw', '12=' || home || ' or ' || away, 'X2=Draw or ' || away] WHEN family = 'totals' THEN ['odds_over=Over ' || num, 'odds_under=Under ' || num]
        WHEN key LIKE 'european%' THEN ['team1_handicap=' || home || ' ' || pos, 'draw_handicap=Draw (' || pos || ')', 'team2_handicap=' || away || ' ' || neg]
        WHEN key LIKE 'asian%' THEN [CASE WHEN key LIKE '%games%' THEN 'handicap_team_1' WHEN key LIKE '%sets' THEN 'sets_handicap_player_1' ELSE 'team1_handicap' END || '=' || home || ' ' || pos,
                                     CASE WHEN key LIKE '%games%' THEN 'handicap_team_2' WHEN key LIKE '%sets' THEN 'sets_handicap_player_2' ELSE 'team2_handicap' END || '=' || away || ' ' || neg] ELSE [] END AS labels FROM txt),
nee AS (SELECT *, replace(CASE WHEN pos LIKE '-%' THEN pos ELSE neg END, '.', '_') AS low, replace(CASE WHEN pos LIKE '-%' THEN neg ELSE pos END, '.', '_') AS high FROM lab),
needs AS (SELECT *, CASE WHEN family = 'h2h' THEN [CASE WHEN sport = 'basketball' THEN 'home_away' ELSE '1x2' END] WHEN family IN ('btts', 'dnb') THEN [family] WHEN family = 'double_chance' THEN ['double_chance', '1x2']
        WHEN family = 'totals' THEN [CASE WHEN sport = 'basketball' THEN 'over_under_games_' ELSE 'over_under_' END || replace(num, '.', '_')]
        WHEN family = 'spreads' AND sport = 'basketball' THEN ['asian_handicap_games_' || low || '_games', 'asian_handicap_games_' || high || '_games'] WHEN family = 'spreads' AND line = trunc(line) THEN ['european_handicap_' || low, 'european_handicap_' || high]
        WHEN family = 'spreads' THEN ['asian_handicap_' || low, 'asian_handicap_' || high] END AS needs FROM nee),
"""
OUTCOME = """CASE WHEN home_score IS NULL THEN NULL WHEN family = 'h2h' THEN CASE WHEN selection = home THEN won(home_score > away_score) WHEN selection = away THEN won(away_score > home_score) WHEN selection = 'Draw' THEN won(home_score = away_score) END
  WHEN family = 'totals' THEN CASE selection WHEN 'Over 2.5' THEN won(home_score + away_score > 2) WHEN 'Under 2.5' THEN won(home_score + away_score < 3) WHEN 'Over 3' THEN CASE WHEN home_score + away_score = 3 THEN 'push' ELSE won(home_score + away_score > 3) END END
  WHEN family = 'btts' THEN CASE selection WHEN 'BTTS Yes' THEN won(home_score > 0 AND away_score > 0) WHEN 'BTTS No' THEN won(home_score = 0 OR away_score = 0) END
  WHEN family = 'dnb' THEN CASE WHEN selection NOT IN (home, away) THEN NULL WHEN home_score = away_score THEN 'push' WHEN selection = home THEN won(home_score > away_score) ELSE won(away_score > home_score) END
  WHEN family = 'double_chance' THEN CASE WHEN selection = home || ' or Draw' THEN won(home_score >= away_score) WHEN selection = home || ' or ' || away THEN won(home_score <> away_score) WHEN selection = 'Draw or ' || away THEN won(away_score >= home_score) END
  WHEN family = 'spreads' THEN CASE WHEN selection = home || ' -1.5' THEN won(home_score - away_score > 1) WHEN selection = home || ' -1' THEN won(home_score - away_score > 1) WHEN selection = 'Draw (+1)' THEN won(home_score + 1 = away_score)
    WHEN selection = away || ' +0.25' THEN CASE WHEN away_score > home_score THEN 'won' WHEN away_score = home_score THEN 'half_won' ELSE 'lost' END END END"""
OUTCOME = re.sub(r"won\(([^()]*)\)", r"CASE WHEN \1 THEN 'won' ELSE 'lost' END", OUTCOME)
PNL = """CASE {o} WHEN 'won' THEN stake * (odds - 1) WHEN 'lost' THEN -stake WHEN 'half_won' THEN stake * (odds - 1) / 2 WHEN 'half_lost' THEN -stake / 2 WHEN 'push' THEN 0 WHEN 'void' THEN 0 END"""
PNL = f"round_even(CAST(({PNL}) AS DECIMAL(18, 6)), 2)::DOUBLE"
NORM = "lower(trim(coalesce({c}, '')))"
KIND = "CASE WHEN {c} LIKE '%pinnacle%' THEN 'pinnacle' WHEN {c} IN ('betfair exchange', 'smarkets') THEN 'sharp' ELSE 'consensus' END"
DUCK_NOW = "TIMESTAMP '1997-06-01'"
ORACLES = {
    "market_keys": f"""WITH {KEYS_CTE} s AS (SELECT *, CASE WHEN key IN ('btts', 'dnb') THEN family ELSE key END AS stored FROM needs)
      SELECT id, family, stored, CASE WHEN stored IN ('h2h', 'btts', 'dnb', 'double_chance') THEN stored ELSE family END AS read_family, CASE WHEN family IS NOT NULL AND stored NOT IN ('btts', 'dnb', 'double_chance') THEN stored END AS read_detail, line, CAST(len(labels) AS INTEGER) AS n_labels,
        coalesce(array_to_string(labels, '|'), '') AS labels, coalesce(array_to_string(needs, '|'), '') AS pick_keys, line AS selection_line FROM s""",
    "needed_keys": f"""WITH {KEYS_CTE} r AS (SELECT * FROM needs WHERE family IS NOT NULL OR sport = 'soccer'), n AS (SELECT sport, count(*) FILTER (needs IS NULL) AS unmapped FROM r GROUP BY sport),
      e AS (SELECT sport, list_sort(list_distinct(flatten(list(needs)))) AS l FROM r GROUP BY sport) SELECT n.sport, CASE WHEN unmapped > 0 THEN '' ELSE array_to_string(l, '|') END AS needs, unmapped FROM n JOIN e ON n.sport = e.sport""",
    "policy_lookup": f"""WITH {KEYS_CTE} f AS (SELECT id, key, sport, league, odds, fair, coalesce(family, 'other') AS family FROM fam)
      SELECT id, CASE WHEN key = family THEN key ELSE key || '|' || family END AS tried, CASE WHEN key = 'over_under_2_5' THEN 0.02e0 WHEN family = 'spreads' THEN 0.05e0 ELSE 0.03e0 END AS min_edge, CASE WHEN family = 'h2h' OR key = 'h2h' THEN 0.2e0 ELSE 0.3e0 END AS max_edge,
        CASE WHEN family = 'h2h' OR key = 'h2h' THEN 'shin' WHEN family = 'btts' THEN 'power' ELSE 'multiplicative' END AS method, CASE WHEN key = '1x2' THEN 4 WHEN family = 'totals' THEN 6 ELSE 0 END AS fewest,
        trim(regexp_replace(lower(strip_accents(league)), '[^a-z0-9]+', ' ', 'g')) AS league, trim(regexp_replace(lower(strip_accents(league)), '[^a-z0-9]+', ' ', 'g')) IN ('premier league', 'serie a') AS major,
        (sport LIKE 'soccer%' AND key LIKE 'asian%') OR family = 'btts' OR (sport = 'basketball' AND family = 'totals') AS shown_only, odds BETWEEN 1.5 AND 3 OR odds BETWEEN 4 AND 6 AS in_bands, key LIKE 'asian%' AS asian,
        odds <= 6 AND fair <= 1.5e0 * (1 / odds) AS plausible, sport NOT LIKE 'soccer%' AS unvalidated FROM f""",
    "ratings": f"""WITH {PICKS_CTE} b AS (SELECT *, {KIND.format(c="anchor_book")} AS kind, pick_fair - 1 / odds AS edge, CASE WHEN version > 0 THEN pick_fair + 0.2e0 END AS ml FROM picks),
      s AS (SELECT *, CASE WHEN edge >= 0.06 THEN 2 WHEN edge >= 0.03 THEN 1 ELSE 0 END AS e, CASE kind WHEN 'pinnacle' THEN 2 WHEN 'sharp' THEN 1 ELSE 0 END AS a, CASE WHEN ml >= 0.725 THEN 1 WHEN ml < 0.6 THEN -1 ELSE 0 END AS k FROM b),
      t AS (SELECT *, greatest(1, least(5, 1 + e + a + k)) AS level, least(greatest(((odds - 1) * pick_fair - (1 - pick_fair)) / (odds - 1), 0) * ({min(0.25, fo.drawdown_multiplier(0.2, 0.1))!r} / (1 + 10 * edge * edge)), 0.02e0) / CASE WHEN version <= 1 THEN 1e0 ELSE sqrt(1 + (version - 1) * 0.25e0) END AS final FROM s)
      SELECT pick_id, kind AS anchor_kind, kind <> 'consensus' AS sharp, level, ['minimal', 'low', 'moderate', 'high', 'very high'][level] AS label, e + a + k AS score,
        concat_ws('; ', CASE e WHEN 2 THEN 'edge 2x floor' WHEN 1 THEN 'edge at floor' ELSE 'edge below floor' END, kind || ' anchor +' || a, CASE WHEN ml >= 0.725 THEN 'score high' WHEN ml >= 0.6 THEN 'score middle' WHEN ml < 0.6 THEN 'score weak' END) AS reasons,
        0.04e0 <= CASE WHEN odds + 0.04e0 < 2 THEN 0.01 WHEN odds + 0.04e0 < 3 THEN 0.02 WHEN odds + 0.04e0 < 4 THEN 0.05 ELSE 0.1 END + 1e-9 AS one_tick, ceil(round(odds * 1.0137e0, 6) * 100) / 100 AS ceiled, round(final, 8) AS final,
        CAST(round(CAST(round(final, 8) * 1000e0 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS money, round(1 / odds, 8) AS implied, round(1 / odds + 1 / 1.5e0 - 1, 8) AS overround FROM t""",
    "settle_cycle": f"""WITH {PICKS_CTE} o AS (SELECT *, {OUTCOME} AS provisional FROM picks),
      d AS (SELECT *, CASE WHEN kickoff <= {DUCK_NOW} - INTERVAL 2 HOUR AND provisional IS NOT NULL THEN provisional WHEN (kickoff IS NULL AND created_at <= {DUCK_NOW} - INTERVAL 14 DAY) OR kickoff <= {DUCK_NOW} - INTERVAL 15 DAY THEN 'void' END AS outcome FROM o),
      p AS (SELECT *, {PNL.format(o="outcome")} AS pnl, {PNL.format(o="provisional")} AS provisional_pnl FROM d)
      SELECT pick_id, outcome, pnl, round(pnl / stake, 6) AS roi, provisional, provisional_pnl, coalesce(sport = 'basketball' AND (home_score = away_score OR home_score + away_score < 100), false) AS impossible FROM p""",
    "close_flags": f"""WITH {PICKS_CTE} c AS (SELECT *, {NORM.format(c="close_book")} AS cb, {NORM.format(c="book")} AS fb, {NORM.format(c="anchor_book")} AS ab, CASE WHEN close_fair > 0 AND close_fair < 1 THEN ln(odds * close_fair) END AS clv FROM picks),
      f AS (SELECT *, CASE WHEN cb IN ('', 'consensus') THEN true WHEN cb = fb THEN false WHEN ab NOT IN ('', 'consensus') THEN ab <> cb ELSE {KIND.format(c="ab")} <> {KIND.format(c="cb")} END AS independent, coalesce(abs(close_fair - pick_fair) > 1e-3, false) AS moved,
        (cb IN ('', 'consensus') OR cb <> fb) AND coalesce(abs(close_fair - pick_fair) > 1e-3, false) AS kept0, clv IS NOT NULL AND abs(close_fair - pick_fair) <= 1e-3 AS tautological, clv IS NOT NULL AND (close_fair - 1 / odds > 0.2 OR abs(clv) > 0.5) AS fabricated,
        coalesce(mint_fell_back <> close_fell_back, false) AS "asymmetric", has_close AND cb IN ('pinnacle', 'smarkets') AS sharp FROM c), g AS (SELECT *, CASE WHEN version <> 1 THEN kept0 END AS kept, sharp AND NOT tautological AND NOT "asymmetric" AND NOT fabricated AS ok FROM f)
      SELECT pick_id, round(clv, 6) AS clv, independent, moved, kept, tautological, fabricated, "asymmetric", ok AND coalesce(kept, true) AS evidence, ok AND coalesce(kept, false) AS headline,
        round(close_fair - 1 / (1 + (odds - 1) * CASE WHEN fb = 'betfair exchange' THEN 0.95e0 ELSE 1e0 END), 6) AS edge_now FROM g""",
    "clv_gates": f"""WITH {PICKS_CTE} c AS (SELECT sport, family, ln(odds * close_fair) AS clv FROM picks WHERE close_fair > 0 AND close_fair < 1), g AS (SELECT sport, family, count(*) AS n, avg(clv) AS mean, stddev_samp(clv) / sqrt(count(*)) AS se, count(*) FILTER (clv > 0) / count(*) AS p FROM c GROUP BY ALL),
      w AS (SELECT *, greatest(0e0, (p + 1.959963984540054e0 * 1.959963984540054e0 / (2 * n)) / (1 + 1.959963984540054e0 * 1.959963984540054e0 / n) - 1.959963984540054e0 / (1 + 1.959963984540054e0 * 1.959963984540054e0 / n) * sqrt(p * (1 - p) / n + 1.959963984540054e0 * 1.959963984540054e0 / (4e0 * n * n))) AS low FROM g)
      SELECT sport, family, n, round(mean, 6) AS mean, round(se, 6) AS se, round(low, 6) AS low, coalesce(n >= 5 AND se > 0 AND mean > 0.5 * se AND low > 0.3, false) AS ready FROM w""",
    "pick_ratchet": f"""WITH {PICKS_CTE} e AS (SELECT event_id, family, selection, version, CASE tier WHEN 'premium' THEN 1 ELSE 0 END AS t, stake, pick_id AS seq, pick_id % 2 AS side, pick_id % 11 <> 0 AS alerted, {{'b': close_book, 'f': close_fair}} AS c FROM picks),
      f AS (SELECT event_id, family, selection, version, arg_max(stake, t * 1000000000000 - seq) FILTER (side = 0) AS os, arg_max(alerted, t * 1000000000000 - seq) FILTER (side = 0) AS oa, arg_max(c, t * 1000000000000 - seq) FILTER (side = 0) AS oc, max(t) FILTER (side = 0) AS ot, arg_max(stake, t * 1000000000000 - seq) FILTER (side = 1) AS ns, max(t) FILTER (side = 1) AS nt FROM e GROUP BY ALL),
      o AS (SELECT *, CASE WHEN ot IS NULL THEN 'inserted' WHEN nt IS NULL THEN 'kept' WHEN nt > ot AND oa THEN 'upgraded' ELSE 'duplicate' END AS outcome FROM f), m AS (SELECT *, CASE WHEN outcome IN ('inserted', 'upgraded') THEN nt ELSE ot END AS t FROM o)
      SELECT event_id, family, selection, version, CASE t WHEN 1 THEN 'premium' ELSE 'volume' END AS tier, CASE WHEN outcome IN ('inserted', 'upgraded') THEN ns ELSE os END AS stake, CASE WHEN outcome IN ('kept', 'duplicate') THEN oc.b END AS close_book, CASE WHEN outcome IN ('kept', 'duplicate') THEN round(oc.f, 6) END AS close_fair, outcome,
        coalesce(max(version) OVER (PARTITION BY event_id, family, selection) > version AND (t = 0 OR max(CASE WHEN t = 1 THEN version END) OVER (PARTITION BY event_id, family, selection) > version), false) AS superseded FROM m""",
    "kickoffs": f"""WITH {PICKS_CTE} s AS (SELECT event_id, pick_id, CASE WHEN pick_id % 4 = 0 THEN date_trunc('day', kickoff) ELSE kickoff END AS seen FROM picks), g AS (SELECT event_id, min(seen) FILTER (pick_id % 2 = 0) AS o, max(seen) FILTER (pick_id % 2 = 1) AS n FROM s GROUP BY event_id)
      SELECT event_id, strftime(CASE WHEN n IS NULL OR (n = date_trunc('day', n) AND o IS NOT NULL AND o <> date_trunc('day', o)) THEN o ELSE n END, '%Y-%m-%d %H:%M') AS kickoff, coalesce(o = date_trunc('day', o), false) AS old_date_only FROM g""",
    "allowed_pages": r"""WITH h AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/?#]*)', ['scheme', 'host']) AS r FROM pages), ok AS (SELECT page_id, url, lower(r.scheme) = 'https' AND lower(r.host) IN ('spam-farm.example.org', 'www.example.com', 'blog.example.net') AND NOT regexp_matches(url, '\s') AS fine FROM h)
      SELECT page_id, form, coalesce(CASE WHEN form IN (1, 3) THEN false ELSE fine END, false) AS allowed FROM ok, (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS form)""",
}
