"""Queries over quotes of several markets: anchors of any width, the scan with its gates, movement, timing, capture reports and grading."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import keys as fk
from fairline.functions import odds as fo
from fairline.functions.odds import SHARP
from fairline.operators import capture, closes, market, models, movement, settlement
from fairline.plans.value import rounded
from fairline.sources.picks import QUOTES_CTE, quotes

KEYS = ("event_id", "key")
NOW, EARLY = "timestampadd(HOUR, -1, kickoff)", "timestampadd(HOUR, -24, kickoff)"
MIN_EDGE, FEWEST = {"spreads": 0.01, "over_under_2_5": 0.012}, {"1x2": 3, "totals": 2}
#: End of each bucket of time before the start, in hours, and its name.
BUCKETS = ((48, ">48h"), (24, "24-48h"), (5, "5-24h"), (1, "1-5h"), (0, "<1h"))
HORIZON = ("TIMESTAMP_NTZ'1996-01-02 00:00:00'", "TIMESTAMP_NTZ'1996-02-10 00:00:00'")


def rows(spark: SparkSession, sf_dir: str, **cutoffs: str) -> DataFrame:
    """One row a market with its books at each cutoff."""
    return market.market_rows(quotes(spark, sf_dir), {n: F.expr(c) for n, c in cutoffs.items()}, KEYS)


def market_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor, fair chance and swap guard of every selection of every market at its start; every seventh event's anchor is turned round for the guard."""
    m = market.with_anchor(rows(spark, sf_dir, close="kickoff"), method="multiplicative").where("fair IS NOT NULL")
    turned = F.when(F.col("event_id") % 7 == 0, F.reverse("fair")).otherwise(F.col("fair"))
    m = m.withColumn("guarded", market.swapped(F.col("full"), F.col("sels"), turned)).withColumn("books", market.book_count(F.col("close")))
    legs = m.select("event_id", "key", "anchor_book", "anchor_type", "guarded", "books", F.explode(F.arrays_zip(F.col("sels").alias("sel_idx"), F.col("fair").alias("fair"))).alias("l"))
    return rounded(legs.select("event_id", "key", "anchor_book", "anchor_type", "guarded", "books", "l.sel_idx", "l.fair"), "fair")


def derived_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double chances of three-way markets alone, from their fair chances."""
    m = market.with_anchor(rows(spark, sf_dir, close="kickoff"), method="multiplicative")
    return rounded(m.select("event_id", "key", F.explode(market.double_chance(F.col("fair"))).alias("l")).select("event_id", "key", "l.*"), "fair")


def own_fairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole book's own chances, market by market."""
    m = market.with_anchor(rows(spark, sf_dir, close="kickoff"), method="multiplicative")
    book = m.select("event_id", "key", F.explode("full").alias("b")).select("event_id", "key", "b.book", F.posexplode(market.devig(F.col("b.gross"), "additive")["fair"]).alias("at", "p"))
    return rounded(book.withColumn("at", F.col("at").cast("long")), "p")


def scanned(spark: SparkSession, sf_dir: str, cutoff: str = NOW) -> DataFrame:
    """Candidates before the gates: their market's family, floors by policy, and enough soft books."""
    m = market.with_anchor(rows(spark, sf_dir, close=cutoff), method="multiplicative")
    family = fk.family_of(F.col("key"))
    m = m.withColumn("family", family).where(market.book_count(F.col("close")) >= fk.policy_value(FEWEST, family, F.col("key"), 0))
    return market.value_scan(m, min_edge=fk.policy_value(MIN_EDGE, family, F.col("key"), 0.015), max_edge=fk.policy_value({"h2h": 0.25}, family, F.col("key"), 0.30))


def market_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over all markets: candidates through handicap sanity, freshness, price bands and the demotions in their order."""
    c = scanned(spark, sf_dir)
    asian = fk.asian_handicap(F.col("key"))
    c = c.where(~asian | fk.plausible_handicap(F.col("odds"), F.col("fair"), 1 / F.col("net"), max_odds=3.0)).where(fk.in_bands(F.col("odds"), ((1.2, 2.6), (2.7, 9.0))))
    age = F.array_max(F.transform(F.filter("close", lambda b: b["book"] == F.col("book")), lambda b: b["at"]))
    c = c.withColumn("age", fo.price_age(F.expr(f"unix_seconds(CAST({NOW} AS TIMESTAMP))"), F.unix_seconds(age.cast("timestamp"))) / 3600).where("age <= 48")
    sport = F.when(F.col("event_id") % 4 == 0, "basketball").otherwise("soccer")
    reason = (
        F.when(fk.visibility_only(("soccer:asian_handicap",), F.col("family"), F.col("key"), sport), "shown only").when((F.col("family") == "h2h") & (F.col("odds") > 3.2), "long price")
        .when(F.col("event_id") % 5 == 0, "minor league").when(F.col("anchor_type") == "consensus", "no sharp anchor").when(fk.unvalidated_sport(sport), "unproven sport")
    )
    c = c.withColumn("demoted", F.when(F.col("tier") == "premium", reason)).withColumn("tier", F.when(F.col("demoted").isNotNull(), "volume").otherwise(F.col("tier")))
    top = market.top_pick(c, KEYS)
    return rounded(top, "fair", "net", "edge", "ev").select("event_id", "key", "selection", "book", "odds", "net", "anchor_book", "fair", "edge", "ev", "tier", "demoted", F.col("age").cast("long").alias("age"))


def market_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of a day before the start against the close of the same market: closing value, and what its evidence is worth; both from one pass."""
    both = market.with_anchor(rows(spark, sf_dir, early=EARLY, close="kickoff"), "close", method="multiplicative", prefix="close_")
    picks = market.value_scan(market.with_anchor(both, "early", method="multiplicative"), "early")
    p = picks.withColumn("close_fair", F.get("close_fair", F.array_position("close_sels", F.col("sel_idx")).cast("int") - 1)).withColumn("clv", fo.clv_log(F.col("net"), F.col("close_fair")))
    independent = settlement.independent_close(F.col("close_anchor_book"), F.col("book"), F.col("anchor_type"), F.col("close_anchor_type"), F.col("anchor_book"))
    flags = {"independent": independent, "moved": settlement.close_moved(F.col("fair"), F.col("close_fair")), "fabricated": settlement.fabricated_close(F.col("clv"), F.col("odds"), F.col("close_fair"))}
    now = market.best_soft(F.col("close"), F.col("sel_idx"))
    p = p.withColumns(flags).withColumn("now", now).withColumn("edge_now", settlement.current_edge(F.col("close_fair"), F.col("now.book"), F.col("now.odds")))
    return rounded(p, "clv", "fair", "close_fair", "edge_now").select("event_id", "key", "selection", "book", "fair", "close_fair", "clv", *flags, "edge_now")


def closing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each market has a close at all: its soft or its sharp quotes end within four hours of the start; the set that does not is left out."""
    m = rows(spark, sf_dir, close="kickoff")
    last = lambda keep: F.array_max(F.transform(F.filter("close", keep), lambda b: b["at"]))
    fresh = lambda at: F.coalesce(at >= F.expr("timestampadd(HOUR, -4, kickoff)"), F.lit(False))
    soft, sharp = fresh(last(lambda b: ~b["norm"].isin(*SHARP))), fresh(last(lambda b: b["norm"].isin(*SHARP)))
    kept = F.filter("close", lambda b: F.when(b["norm"].isin(*SHARP), sharp).otherwise(soft))
    return m.select("event_id", "key", soft.alias("soft_fresh"), sharp.alias("sharp_fresh"), F.size(kept).alias("books_left"))


def steam_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement of the fill book's and the anchor's prices in the day before the start: whether the anchor is stale, the price comes to it or runs away."""
    t = movement.trajectories(quotes(spark, sf_dir), F.col("kickoff"), hours=24, keys=KEYS)
    v = movement.verdicts(t, "bet365", "pinnacle", F.col("kickoff"), keys=KEYS, stale_seconds=7200, steam=0.01, close_fraction=0.5, least_gap=0.002)
    return rounded(v, "closed_fraction", "soft_move").select("event_id", "key", "sel_idx", "stale", "toward", "steamed", "tripped", "closed_fraction", F.col("anchor_age").cast("long").alias("anchor_age"), "soft_move")


def timed_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift to the close by time before the start, of events that are quoted at two times at least and to within four hours of it."""
    return movement.drift_by_bucket(movement.qualified(quotes(spark, sf_dir), keys=KEYS), keys=KEYS)


def edge_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan replayed at the end of each bucket of time and graded by the close; means are withheld under thirty picks."""
    cutoffs = {f"b{h}": f"timestampadd(HOUR, -{h}, kickoff)" for h, _ in BUCKETS}
    m = market.with_anchor(rows(spark, sf_dir, **cutoffs), "b0", method="multiplicative", prefix="close_")
    turns = F.explode(F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"b{hours}").alias("books")) for hours, name in BUCKETS)))
    m = m.withColumn("s", turns).select("*", "s.bucket", "s.books").drop("s", *cutoffs)
    legs = market.value_scan(market.with_anchor(m, "books", method="multiplicative"), "books", guard=False)
    every = legs.select("bucket", "edge", fo.clv_log(F.col("net"), F.get("close_fair", F.array_position("close_sels", F.col("sel_idx")).cast("int") - 1)).alias("clv"))
    n = F.count("*")
    enough = lambda c: F.when(n >= 30, F.round(c, 6))
    return every.groupBy("bucket").agg(n.alias("n"), enough(F.avg("edge")).alias("mean_edge"), enough(F.avg("clv")).alias("mean_clv"), enough(F.avg((F.col("clv") > 0).cast("int"))).alias("beat"))


def model_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of the goals model: its chances of every event against each book's own at the start, gated and sized."""
    m = market.with_anchor(rows(spark, sf_dir, close="kickoff"), method="multiplicative")
    events = quotes(spark, sf_dir).select("event_id").distinct()
    expectancies = events.select("event_id", (0.9 + (F.col("event_id") % 8) / 6.0).alias("home_exp"), (0.6 + (F.col("event_id") % 5) / 5.0).alias("away_exp"), (0.5 + (F.col("event_id") % 4) / 10.0).alias("confidence"))
    c = models.model_candidates(models.grid_model(expectancies), m).join(m.select("event_id", "key", "kickoff"), ["event_id", "key"])
    age = (F.unix_seconds(F.col("kickoff").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))) / 3600
    return rounded(models.model_picks(c, age), "probability", "book_fair", "edge", "ev", "fraction").select("event_id", "key", F.col("sel_idx").cast("long").alias("sel_idx"), "book", "odds", "probability", "book_fair", "edge", "ev", "fraction", "stake", "tier")


def trusted_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's bet365 price of a day before graded by the best close that can be trusted: the sharp book's archive, where half of the events have it, then its prices on the event, then the exchange, then a soft book."""
    q = quotes(spark, sf_dir)
    book = F.lower(F.trim("book"))
    apart = (book == "pinnacle") & (F.col("event_id") % 2 == 1)
    archive = q.where(apart).withColumn("ref", F.concat(F.lit("pinnacle:"), (F.col("event_id") * 10).cast("string"))).drop("event_id")
    own = q.where(~apart)
    known = own.select("event_id").distinct().withColumn("ref", F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 10))
    sources = {"pinnacle": book == "pinnacle", "betfair exchange": book.startswith("betfair"), "soft": book.isin("bwin", "unibet")}
    found = [closes.source_closes(closes.archived(archive, known, prefix="pinnacle:"), {"archive": book == "pinnacle"}), closes.source_closes(own, sources)]
    fills = own.where((book == "bet365") & F.expr(f"captured_at <= {EARLY}")).groupBy("event_id", "key", "sel_idx").agg(F.max_by("odds", F.struct(*market.TIME)).alias("odds")).withColumn("book", F.lit("bet365"))
    g = closes.graded_by_close(fills, found, ["archive", *sources])
    return rounded(g, "close_fair", "clv").select("event_id", "key", F.col("sel_idx").cast("long").alias("sel_idx"), "odds", "close_source", "close_fair", F.date_format("close_at", "yyyy-MM-dd HH").alias("close_at"), "clv", F.array_join("tried", ",").alias("tried"))


def with_sport(q: DataFrame) -> DataFrame:
    return q.withColumn("sport", F.when(F.col("event_id") % 4 == 0, "basketball").when(F.col("event_id") % 4 == 1, "tennis").otherwise("soccer"))


def capture_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the events that start within the horizon, by sport and in all: how many have the sharp book, and the exchange with a whole money line."""
    return capture.coverage(with_sport(quotes(spark, sf_dir)), *map(F.expr, HORIZON)).drop("headline")


def available_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event: its markets and books, first and last capture and how many quotes."""
    g = capture.available(with_sport(quotes(spark, sf_dir)))
    return g.select("event_id", "sport", F.array_join("markets", ",").alias("markets"), F.array_join("books", ",").alias("books"), F.date_format("first", "yyyy-MM-dd HH").alias("first"), F.date_format("last", "yyyy-MM-dd HH").alias("last"), "n")


def capture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next events for the exchange's capture: priced by another book, starting within the horizon, those never captured first, then the longest ago."""
    t = capture.targets(quotes(spark, sf_dir), *map(F.expr, HORIZON), limit=40)
    return t.select("event_id", F.date_format("captured", "yyyy-MM-dd HH").alias("captured"))


def poll_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes by day and market against the day before, and whether a day's capture fell short or lacks a market."""
    return capture.completeness(quotes(spark, sf_dir).withColumn("cycle", F.to_date("captured_at")), ("1x2", "over_under", "asian_handicap", "home_away"), floor=0.5).withColumn("cycle", F.date_format("cycle", "yyyy-MM-dd"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a market and selection: the soft books' first prices as a consensus, the best of them, and the sharp book's own fair close, in one pass."""
    q = quotes(spark, sf_dir).where("captured_at <= kickoff").withColumn("norm", fo.normal_book(F.col("book")))
    at = F.struct(*market.TIME)
    ends = q.groupBy(*KEYS, "sel_idx", "norm").agg(F.min_by("odds", at).alias("first"), F.max_by("odds", at).alias("last"))
    soft = F.when(~F.col("norm").isin(*SHARP), F.col("first"))
    side = ends.groupBy(*KEYS, "sel_idx").agg(F.median(soft).alias("consensus"), F.count(soft).alias("books"), F.max(soft).alias("best"), F.max(F.when(F.col("norm") == "pinnacle", F.col("last"))).alias("close"))
    m = side.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("sel_idx", "consensus", "books", "best", "close"))).alias("s"))
    wanted = F.when(F.col("key") == "1x2", 3).otherwise(2)
    whole = lambda c: F.when((F.size("s") == wanted) & ~F.exists("s", lambda x: x[c].isNull()), market.devig(F.transform("s", lambda x: x[c]), "multiplicative")["fair"])
    return m.withColumns({"fair": whole("consensus"), "close_fair": whole("close"), "thin": F.exists("s", lambda x: x["books"] < 2)})


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By market: how many events reach each step from a signal to a graded bet, and the bets' closing value."""
    m = signals(spark, sf_dir)
    legs = F.transform(F.arrays_zip(F.col("s").alias("s"), F.col("fair").alias("fair"), F.coalesce("close_fair", F.transform("s", lambda x: F.lit(None).cast("double"))).alias("cf")), lambda x: F.struct((x["fair"] - 1 / x["s"]["best"]).alias("edge"), (-x["s"]["sel_idx"]).alias("turn"), x["s"]["best"].alias("odds"), x["cf"].alias("close_fair")))
    usable = F.col("fair").isNotNull() & ~F.col("thin")
    best = m.withColumn("bet", F.when(usable, F.array_max(legs))).withColumn("bet", F.when(F.col("bet.edge") >= 0.02, F.col("bet")))
    clv = fo.clv_log(F.col("bet.odds"), F.col("bet.close_fair"))
    return best.groupBy("key").agg(
        F.count("*").alias("events"), F.count("fair").alias("with_signal"), F.count_if(usable).alias("thick"), F.count("close_fair").alias("with_close"), F.count("bet").alias("bets"), F.count(clv).alias("graded"), F.round(F.avg(clv), 6).alias("clv"), F.round(F.stddev_pop(clv) / F.sqrt(F.count(clv)), 6).alias("se"),
    )


QUERIES = {
    "readiness": readiness, "market_anchors": market_anchors, "derived_chances": derived_chances, "own_fairs": own_fairs, "trusted_closes": trusted_closes, "model_picks": model_picks, "market_scan": market_scan, "market_grades": market_grades, "closing_evidence": closing_evidence, "steam_verdicts": steam_verdicts,
    "timed_drift": timed_drift, "edge_by_bucket": edge_by_bucket, "capture_coverage": capture_coverage, "available_games": available_games, "capture_targets": capture_targets, "poll_report": poll_report,
}


def at(hours: float, n: str) -> str:
    """Oracle tables of the state some hours before the start, named by n: state, whole books, medians, anchor odds, fair chances, best soft price, candidates."""
    return f"""
st{n} AS (SELECT *, lower(trim(book)) AS norm, 1 + (odds - 1) * (1 - CASE lower(trim(book)) WHEN 'betfair exchange' THEN 0.05e0 WHEN 'matchbook' THEN 0.02e0 ELSE 0e0 END) AS net
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id, key, book_id, sel_idx ORDER BY captured_at DESC, l_orderkey DESC, l_linenumber DESC, odds DESC) AS rn FROM quotes WHERE captured_at <= kickoff - INTERVAL 1 HOUR * {hours}) WHERE rn = 1),
wd{n} AS (SELECT event_id, key, count(DISTINCT sel_idx) AS width, count(DISTINCT norm) FILTER (norm NOT IN ('pinnacle', 'betfair exchange')) AS soft FROM st{n} GROUP BY ALL),
fb{n} AS (SELECT s.* FROM st{n} s JOIN wd{n} w USING (event_id, key) QUALIFY count(*) OVER (PARTITION BY event_id, key, book_id) = w.width),
sh{n} AS (SELECT event_id, key, arg_min(book_id, book_id) AS book_id FROM (SELECT event_id, key, book_id FROM fb{n} WHERE norm IN ('pinnacle', 'betfair exchange') GROUP BY ALL HAVING sum(1 / net) - 1 BETWEEN 0 AND 0.12) GROUP BY ALL),
md{n} AS (SELECT event_id, key, sel_idx, median(net) AS o, median(1 / net) AS q, count(*) AS n FROM fb{n} GROUP BY ALL),
mo{n} AS (SELECT event_id, key FROM md{n} GROUP BY ALL HAVING sum(1 / o) - 1 BETWEEN 0 AND 0.12 AND min(n) >= 3),
ao{n} AS (SELECT f.event_id, f.key, f.sel_idx, f.odds AS o, f.book AS anchor_book FROM fb{n} f JOIN sh{n} USING (event_id, key, book_id) UNION ALL
  SELECT event_id, key, sel_idx, o, 'consensus' FROM md{n} SEMI JOIN mo{n} USING (event_id, key) ANTI JOIN sh{n} USING (event_id, key)),
fr{n} AS (SELECT event_id, key, sel_idx, anchor_book, CASE anchor_book WHEN 'Pinnacle' THEN 'pinnacle' WHEN 'betfair exchange' THEN 'sharp' ELSE 'consensus' END AS anchor_type, (1 / o) / sum(1 / o) OVER (PARTITION BY event_id, key) AS fair FROM ao{n} JOIN wd{n} USING (event_id, key) WHERE width >= 2),
be{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, key, sel_idx ORDER BY net DESC, book_id) AS rk FROM st{n} WHERE norm NOT IN ('pinnacle', 'betfair exchange')) WHERE rk = 1),
sw{n} AS (SELECT DISTINCT event_id, key FROM (SELECT m.event_id, m.key, q / sum(q) OVER (PARTITION BY m.event_id, m.key) AS q, fair, n FROM md{n} m JOIN fr{n} USING (event_id, key, sel_idx)) x JOIN (SELECT m.event_id, m.key, q / sum(q) OVER (PARTITION BY m.event_id, m.key) AS q2, fair AS fair2 FROM md{n} m JOIN fr{n} USING (event_id, key, sel_idx)) y USING (event_id, key) WHERE n >= 3 AND q - q2 > 0.10 AND fair <= fair2),
ca{n} AS (SELECT b.*, f.anchor_book, f.anchor_type, f.fair, fair - 1 / net AS edge, fair * (net - 1) - (1 - fair) AS ev, CASE WHEN key LIKE '%handicap%' THEN 'spreads' WHEN key LIKE 'over%' THEN 'totals' ELSE 'h2h' END AS family, w.soft
  FROM be{n} b JOIN fr{n} f USING (event_id, key, sel_idx) JOIN wd{n} w USING (event_id, key) WHERE net >= 1.2),
"""


STATE = QUOTES_CTE + at(0, "")
SPORT = "CASE event_id % 4 WHEN 0 THEN 'basketball' WHEN 1 THEN 'tennis' ELSE 'soccer' END"
UP = "kickoff > TIMESTAMP '1996-01-02' AND kickoff <= TIMESTAMP '1996-02-10'"
BUCKET_SQL = " UNION ALL ".join(f"SELECT '{name}' AS bucket, c.edge, CASE WHEN z.fair > 0 AND z.fair < 1 THEN ln(c.net * z.fair) END AS clv FROM ca{h} c LEFT JOIN fr0 z USING (event_id, key, sel_idx) WHERE c.edge BETWEEN 0.015 AND 0.30" for h, name in BUCKETS)
SERIES = "PARTITION BY event_id, key, book_id, sel_idx ORDER BY captured_at, l_orderkey, l_linenumber, odds"
HOURS_LEFT = "date_diff('hour', captured_at, kickoff)"
ORACLES = {
    "readiness": f"""WITH {QUOTES_CTE} e AS (SELECT event_id, key, sel_idx, lower(trim(book)) AS norm, min(struct_pack(t := captured_at, a := l_orderkey, b := l_linenumber, o := odds)).o AS first, max(struct_pack(t := captured_at, a := l_orderkey, b := l_linenumber, o := odds)).o AS last FROM quotes WHERE captured_at <= kickoff GROUP BY ALL),
      s AS (SELECT event_id, key, sel_idx, median(first) FILTER (norm NOT IN ('pinnacle', 'betfair exchange')) AS c, count(first) FILTER (norm NOT IN ('pinnacle', 'betfair exchange')) AS books, max(first) FILTER (norm NOT IN ('pinnacle', 'betfair exchange')) AS best, max(last) FILTER (norm = 'pinnacle') AS close FROM e GROUP BY ALL),
      m AS (SELECT *, count(*) OVER w = CASE key WHEN '1x2' THEN 3 ELSE 2 END AS whole, count(c) OVER w = count(*) OVER w AS all_c, count(close) OVER w = count(*) OVER w AS all_k, min(books) OVER w < 2 AS thin, sum(1 / c) OVER w AS bc, sum(1 / close) OVER w AS bk FROM s WINDOW w AS (PARTITION BY event_id, key)),
      f AS (SELECT *, CASE WHEN whole AND all_c THEN 1 / c / bc END AS fair, CASE WHEN whole AND all_k THEN 1 / close / bk END AS cf FROM m),
      b AS (SELECT *, row_number() OVER (PARTITION BY event_id, key ORDER BY fair - 1 / best DESC, sel_idx) AS rk FROM f WHERE fair IS NOT NULL AND NOT thin AND fair - 1 / best >= 0.02),
      g AS (SELECT key, count(*) AS bets, count(cf) AS graded, avg(ln(best * cf)) AS clv, stddev_pop(ln(best * cf)) / sqrt(count(cf)) AS se FROM b WHERE rk = 1 GROUP BY key),
      v AS (SELECT event_id, key, max(fair) AS fair, max(cf) AS cf, bool_or(thin) AS thin FROM f GROUP BY ALL), t AS (SELECT key, count(*) AS events, count(fair) AS with_signal, count(*) FILTER (fair IS NOT NULL AND NOT thin) AS thick, count(cf) AS with_close FROM v GROUP BY key)
      SELECT t.*, coalesce(bets, 0) AS bets, coalesce(graded, 0) AS graded, round(clv, 6) AS clv, round(se, 6) AS se FROM t LEFT JOIN g ON t.key = g.key""",
    "market_anchors": f"""WITH {STATE} tu AS (SELECT event_id, key, sel_idx, list(fair) OVER w AS l, row_number() OVER (PARTITION BY event_id, key ORDER BY sel_idx) AS i FROM fr WINDOW w AS (PARTITION BY event_id, key ORDER BY sel_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
      tf AS (SELECT event_id, key, sel_idx, CASE WHEN event_id % 7 = 0 THEN l[len(l) + 1 - i] ELSE l[i] END AS fair FROM tu), mq AS (SELECT event_id, key, sel_idx, q / sum(q) OVER (PARTITION BY event_id, key) AS q, n, fair FROM md JOIN tf USING (event_id, key, sel_idx)),
      gu AS (SELECT DISTINCT a.event_id, a.key FROM mq a JOIN mq b USING (event_id, key) WHERE a.n >= 3 AND a.q - b.q > 0.10 AND a.fair <= b.fair)
      SELECT event_id, key, anchor_book, anchor_type, (event_id, key) IN (SELECT (event_id, key) FROM gu) AS guarded, CAST(soft AS INTEGER) AS books, sel_idx, round(fair, 6) AS fair FROM fr JOIN wd USING (event_id, key)""",
    "derived_chances": f"""WITH {STATE} t AS (SELECT event_id, key, max(fair) FILTER (sel_idx = 0) AS a, max(fair) FILTER (sel_idx = 1) AS b, max(fair) FILTER (sel_idx = 2) AS c FROM fr GROUP BY ALL HAVING count(*) = 3)
      SELECT event_id, key, unnest(['1X', 'X2', '12']) AS selection, round(unnest([a + b, b + c, a + c]), 6) AS fair FROM t""",
    "own_fairs": f"""WITH {STATE} o AS (SELECT event_id, key, book, sel_idx, 1 / odds AS q, sum(1 / odds) OVER w AS b, count(*) OVER w AS n, row_number() OVER (PARTITION BY event_id, key, book_id ORDER BY sel_idx) - 1 AS "at" FROM fb WINDOW w AS (PARTITION BY event_id, key, book_id)),
      r AS (SELECT *, q - (b - 1) / n AS r FROM o), j AS (SELECT *, min(r) OVER w AS lo, max(r) OVER w AS hi, sum(r) OVER w AS t FROM r WINDOW w AS (PARTITION BY event_id, key, book)) SELECT event_id, key, book, "at", round(CASE WHEN lo <= 0 OR hi >= 1 THEN q / b ELSE r / t END, 6) AS p FROM j WHERE n >= 2""",
    "trusted_closes": f"""WITH {QUOTES_CTE} a AS (SELECT *, lower(trim(book)) AS norm, lower(trim(book)) = 'pinnacle' AND event_id % 2 = 1 AS apart FROM quotes),
      l AS (SELECT apart, event_id, key, norm, sel_idx, max({{'t': captured_at, 'a': l_orderkey, 'b': l_linenumber, 'o': odds}}).o AS odds, max(captured_at) AS seen, max(kickoff) AS kickoff FROM a WHERE captured_at <= kickoff GROUP BY ALL),
      w AS (SELECT apart, event_id, key, count(DISTINCT sel_idx) AS width FROM l GROUP BY ALL),
      b AS (SELECT l.*, width, count(*) OVER v AS n, max(seen) OVER v AS last, sum(1 / odds) OVER v AS s, min(odds) OVER v AS low FROM l JOIN w USING (apart, event_id, key) WINDOW v AS (PARTITION BY apart, event_id, key, norm)),
      f AS (SELECT *, CASE WHEN apart THEN 'archive' WHEN norm = 'pinnacle' THEN 'pinnacle' WHEN norm LIKE 'betfair%' THEN 'betfair exchange' WHEN norm IN ('bwin', 'unibet') THEN 'soft' END AS source, 1 / odds / s AS fair FROM b WHERE n = width AND n >= 2 AND epoch(kickoff) - epoch(last) <= 4 * 3600 AND low > 1),
      c AS (SELECT event_id, key, sel_idx, source, fair, last FROM (SELECT *, dense_rank() OVER (PARTITION BY apart, event_id, key, source ORDER BY norm) AS rk FROM f WHERE source IS NOT NULL AND NOT (apart AND event_id % 5 = 0)) WHERE rk = 1 AND (source <> 'archive' OR event_id IN (SELECT event_id FROM a WHERE NOT apart))),
      p AS (SELECT event_id, key, sel_idx, max({{'t': captured_at, 'a': l_orderkey, 'b': l_linenumber, 'o': odds}}).o AS odds FROM a WHERE NOT apart AND norm = 'bet365' AND captured_at <= kickoff - INTERVAL 24 HOUR GROUP BY ALL),
      r AS (SELECT p.event_id, p.key, p.sel_idx, p.odds, source, fair, last, list_position(['archive', 'pinnacle', 'betfair exchange', 'soft'], source) AS rank FROM p LEFT JOIN c USING (event_id, key, sel_idx)),
      g AS (SELECT event_id, key, sel_idx, odds, arg_min({{'s': source, 'f': fair, 'l': last}}, rank) AS c, array_to_string(list_sort(list(source) FILTER (source IS NOT NULL)), ',') AS tried FROM r GROUP BY ALL)
      SELECT event_id, key, sel_idx::BIGINT AS sel_idx, odds, c.s AS close_source, round(c.f, 6) AS close_fair, strftime(c.l, '%Y-%m-%d %H') AS close_at, round(CASE WHEN c.f > 0 AND c.f < 1 THEN ln(odds * c.f) END, 6) AS clv, tried FROM g""",
    "model_picks": f"""WITH {STATE} ex AS (SELECT DISTINCT event_id, 0.9e0 + (event_id % 8) / 6e0 AS h, 0.6e0 + (event_id % 5) / 5e0 AS a, 0.5e0 + (event_id % 4) / 10e0 AS confidence FROM quotes),
      hs AS (SELECT DISTINCT h, a FROM ex), gl AS (SELECT unnest(range(0, 16)) AS g),
      ce AS (SELECT h, a, x.g AS i, y.g AS j, exp(x.g * ln(h) - h) / factorial(x.g::INTEGER) * exp(y.g * ln(a) - a) / factorial(y.g::INTEGER) * CASE WHEN x.g = 0 AND y.g = 0 THEN 1 + h * a * 0.06e0 WHEN x.g = 0 AND y.g = 1 THEN 1 - h * 0.06e0 WHEN x.g = 1 AND y.g = 0 THEN 1 - a * 0.06e0 WHEN x.g = 1 AND y.g = 1 THEN 1.06e0 ELSE 1e0 END AS p FROM hs, gl x, gl y),
      gr AS (SELECT h, a, i, j, p / sum(p) OVER (PARTITION BY h, a) AS p FROM ce),
      pr AS (SELECT h, a, unnest(['1x2', '1x2', '1x2', 'over_under_2_5', 'over_under_2_5']) AS key, unnest([0, 1, 2, 0, 1]) AS sel_idx, unnest([sum(p) FILTER (i > j), sum(p) FILTER (i = j), sum(p) FILTER (i < j), sum(p) FILTER (i + j > 2), sum(p) FILTER (i + j < 3)]) AS probability FROM gr GROUP BY h, a),
      ow AS (SELECT event_id, key, book, book_id, sel_idx, odds, 1 / odds / sum(1 / odds) OVER w AS book_fair, count(*) OVER w AS n FROM fb WINDOW w AS (PARTITION BY event_id, key, book_id)),
      la AS (SELECT event_id, key, lower(trim(book)) AS norm, max(captured_at) AS at, max(kickoff) AS kickoff FROM quotes WHERE captured_at <= kickoff GROUP BY ALL),
      j AS (SELECT o.event_id, o.key, o.sel_idx, o.book, odds, probability, book_fair, probability - book_fair AS edge, probability * (odds - 1) - (1 - probability) AS ev, confidence, (epoch(la.kickoff) - epoch(la.at)) / 3600 AS age
            FROM ow o JOIN ex USING (event_id) JOIN pr ON pr.h = ex.h AND pr.a = ex.a AND pr.key = o.key AND pr.sel_idx = o.sel_idx JOIN la ON la.event_id = o.event_id AND la.key = o.key AND la.norm = lower(trim(o.book)) WHERE n >= 2),
      k AS (SELECT *, least(greatest(((odds - 1) * probability - (1 - probability)) / (odds - 1), 0) * 0.25e0, 0.02e0) AS fraction FROM j WHERE edge >= 0.02 AND ev > 0 AND probability >= 0.1 AND odds <= 8 AND confidence >= 0.6e0 AND age <= 48)
      SELECT event_id, key, sel_idx::BIGINT AS sel_idx, book, odds, round(probability, 6) AS probability, round(book_fair, 6) AS book_fair, round(edge, 6) AS edge, round(ev, 6) AS ev, round(fraction, 6) AS fraction, round((fraction * 1000)::DECIMAL(18,6), 2)::DOUBLE AS stake, 'premium' AS tier FROM k""",
    "market_scan": f"""WITH {QUOTES_CTE} {at(1, "")} fl AS (SELECT *, CASE WHEN key = 'over_under_2_5' THEN 0.012e0 WHEN family = 'spreads' THEN 0.01e0 ELSE 0.015e0 END AS floor_edge, CASE family WHEN 'h2h' THEN 0.25e0 ELSE 0.30e0 END AS top_edge, CASE WHEN key = '1x2' THEN 3 WHEN family = 'totals' THEN 2 ELSE 0 END AS fewest FROM ca ANTI JOIN sw USING (event_id, key)),
      ok AS (SELECT *, (epoch(kickoff - INTERVAL 1 HOUR) - epoch(max_at)) / 3600 AS age FROM (SELECT f.*, m.max_at FROM fl f JOIN (SELECT event_id, key, book_id, max(captured_at) AS max_at FROM st GROUP BY ALL) m USING (event_id, key, book_id)) WHERE soft >= fewest AND edge BETWEEN floor_edge AND top_edge AND (key NOT LIKE 'asian%' OR (odds <= 3 AND fair <= 1.5e0 / net)) AND (odds BETWEEN 1.2 AND 2.6 OR odds BETWEEN 2.7 AND 9)),
      de AS (SELECT *, CASE WHEN edge >= 0.03 THEN CASE WHEN event_id % 4 <> 0 AND key LIKE 'asian%' THEN 'shown only' WHEN family = 'h2h' AND odds > 3.2 THEN 'long price' WHEN event_id % 5 = 0 THEN 'minor league' WHEN anchor_type = 'consensus' THEN 'no sharp anchor' WHEN event_id % 4 = 0 THEN 'unproven sport' END END AS demoted FROM ok WHERE greatest(age, 0) <= 48),
      tp AS (SELECT *, row_number() OVER (PARTITION BY event_id, key ORDER BY edge DESC, sel_idx) AS r2 FROM de)
      SELECT event_id, key, selection, book, odds, round(net, 6) AS net, anchor_book, round(fair, 6) AS fair, round(edge, 6) AS edge, round(ev, 6) AS ev, CASE WHEN demoted IS NULL AND edge >= 0.03 THEN 'premium' WHEN demoted IS NOT NULL OR edge >= 0.015 THEN 'volume' END AS tier, demoted, CAST(greatest(age, 0) AS BIGINT) AS age FROM tp WHERE r2 = 1""",
    "market_grades": f"""WITH {QUOTES_CTE} {at(24, "e")} {at(0, "c")} p AS (SELECT e.*, c.fair AS close_fair, lower(coalesce(c.anchor_book, '')) AS cb, c.anchor_type AS ct, b.odds AS now_odds, b.net AS now_net, CASE WHEN c.fair > 0 AND c.fair < 1 THEN ln(e.net * c.fair) END AS clv
        FROM cae e ANTI JOIN swe USING (event_id, key) LEFT JOIN frc c USING (event_id, key, sel_idx) LEFT JOIN bec b USING (event_id, key, sel_idx) WHERE e.edge BETWEEN 0.015 AND 0.30)
      SELECT event_id, key, selection, book, round(fair, 6) AS fair, round(close_fair, 6) AS close_fair, round(clv, 6) AS clv, CASE WHEN cb IN ('', 'consensus') THEN true WHEN cb = norm THEN false WHEN anchor_book <> 'consensus' THEN lower(anchor_book) <> cb ELSE anchor_type <> ct END AS independent,
        coalesce(abs(close_fair - fair) > 1e-3, false) AS moved, coalesce(close_fair - 1 / odds > 0.2 OR abs(clv) > 0.5, false) AS fabricated, round(close_fair - 1 / now_net, 6) AS edge_now FROM p""",
    "closing_evidence": f"""WITH {STATE} m AS (SELECT event_id, key, coalesce(max(captured_at) FILTER (norm NOT IN ('pinnacle', 'betfair exchange')) >= any_value(kickoff) - INTERVAL 4 HOUR, false) AS soft_fresh, coalesce(max(captured_at) FILTER (norm IN ('pinnacle', 'betfair exchange')) >= any_value(kickoff) - INTERVAL 4 HOUR, false) AS sharp_fresh,
        count(DISTINCT norm) FILTER (norm NOT IN ('pinnacle', 'betfair exchange')) AS s, count(DISTINCT norm) FILTER (norm IN ('pinnacle', 'betfair exchange')) AS h FROM st GROUP BY ALL)
      SELECT event_id, key, soft_fresh, sharp_fresh, CAST(CASE WHEN soft_fresh THEN s ELSE 0 END + CASE WHEN sharp_fresh THEN h ELSE 0 END AS INTEGER) AS books_left FROM m""",
    "steam_verdicts": f"""WITH {QUOTES_CTE} t AS (SELECT *, lower(trim(book)) AS norm FROM quotes WHERE captured_at <= kickoff AND captured_at >= kickoff - INTERVAL 24 HOUR AND odds > 1),
      s AS (SELECT event_id, key, sel_idx, norm, 1 / min(struct_pack(t := captured_at, a := l_orderkey, b := l_linenumber, o := odds)).o AS first, 1 / max(struct_pack(t := captured_at, a := l_orderkey, b := l_linenumber, o := odds)).o AS last, count(*) AS n, max(captured_at) AS at, any_value(kickoff) AS kickoff FROM t WHERE norm IN ('bet365', 'pinnacle') GROUP BY ALL),
      j AS (SELECT f.*, f.last - f.first AS move, a.first AS af, a.last AS al, epoch(f.kickoff) - epoch(a.at) AS age FROM (SELECT * FROM s WHERE norm = 'bet365') f LEFT JOIN (SELECT * FROM s WHERE norm = 'pinnacle') a USING (event_id, key, sel_idx)),
      g AS (SELECT *, CASE WHEN n >= 2 AND af - first >= 0.002 THEN ((af - first) - (al - last)) / (af - first) END AS closed, age IS NULL OR age > 7200 AS stale, n >= 2 AND -move >= 0.01 AS steamed FROM j)
      SELECT event_id, key, sel_idx, stale, coalesce(closed >= 0.5 AND al - last < af - first, false) AS toward, steamed, stale OR coalesce(closed >= 0.5 AND al - last < af - first, false) AS tripped, round(closed, 6) AS closed_fraction, CAST(age AS BIGINT) AS anchor_age, CASE WHEN n >= 2 THEN round(move, 6) END AS soft_move FROM g""",
    "timed_drift": f"""WITH {QUOTES_CTE} q AS (SELECT event_id, key FROM quotes WHERE captured_at <= kickoff GROUP BY ALL HAVING count(DISTINCT captured_at) >= 2 AND max(captured_at) >= any_value(kickoff) - INTERVAL 4 HOUR),
      c AS (SELECT *, last_value(odds) OVER w AS close, row_number() OVER (PARTITION BY event_id, key, book_id, sel_idx ORDER BY captured_at DESC, l_orderkey DESC, l_linenumber DESC, odds DESC) AS back FROM quotes SEMI JOIN q USING (event_id, key) WHERE captured_at <= kickoff WINDOW w AS ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      SELECT CASE WHEN {HOURS_LEFT} < 1 THEN '<1h' WHEN {HOURS_LEFT} < 5 THEN '1-5h' WHEN {HOURS_LEFT} < 24 THEN '5-24h' WHEN {HOURS_LEFT} < 48 THEN '24-48h' ELSE '>48h' END AS bucket, count(*) AS n, round(avg(ln(close / odds)), 6) AS drift FROM c WHERE back > 1 GROUP BY 1""",
    "edge_by_bucket": f"WITH {QUOTES_CTE} {''.join(at(h, str(h)) for h, _ in BUCKETS)} e AS ({BUCKET_SQL}) SELECT bucket, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(avg(edge), 6) END AS mean_edge, CASE WHEN count(*) >= 30 THEN round(avg(clv), 6) END AS mean_clv, CASE WHEN count(*) >= 30 THEN round(avg(CASE WHEN clv > 0 THEN 1 WHEN clv <= 0 THEN 0 END), 6) END AS beat FROM e GROUP BY bucket",
    "capture_coverage": f"""WITH {QUOTES_CTE} e AS (SELECT event_id, {SPORT} AS sport, bool_or(lower(trim(book)) = 'pinnacle') AS sharp, count(DISTINCT CASE WHEN book = 'betfair exchange' AND key IN ('1x2', 'home_away') THEN key || sel_idx END) AS legs, max(CASE key WHEN '1x2' THEN 3 ELSE 2 END) AS width FROM quotes WHERE {UP} GROUP BY ALL)
      SELECT sport, count(*) AS events, count(*) FILTER (sharp) AS with_sharp, count(*) FILTER (legs >= CASE WHEN sport = 'soccer' THEN 3 ELSE 2 END) AS with_exchange, round(count(*) FILTER (sharp) / count(*), 6) AS sharp_rate, round(count(*) FILTER (legs >= CASE WHEN sport = 'soccer' THEN 3 ELSE 2 END) / count(*), 6) AS exchange_rate FROM e GROUP BY GROUPING SETS ((sport), ())""",
    "available_games": f"""WITH {QUOTES_CTE} z AS (SELECT 1) SELECT event_id, {SPORT} AS sport, array_to_string(list_sort(list_distinct(list(key))), ',') AS markets, array_to_string(list_sort(list_distinct(list(lower(trim(book))))), ',') AS books, strftime(min(captured_at), '%Y-%m-%d %H') AS first, strftime(max(captured_at), '%Y-%m-%d %H') AS last, count(*) AS n FROM quotes GROUP BY ALL""",
    "capture_targets": f"""WITH {QUOTES_CTE} e AS (SELECT event_id, max(captured_at) FILTER (lower(trim(book)) LIKE 'betfair%') AS captured, any_value(kickoff) AS kickoff FROM quotes WHERE {UP} GROUP BY event_id HAVING count(*) FILTER (lower(trim(book)) NOT LIKE 'betfair%') > 0)
      SELECT event_id, strftime(captured, '%Y-%m-%d %H') AS captured FROM e ORDER BY e.captured NULLS FIRST, kickoff, event_id LIMIT 40""",
    "poll_report": f"""WITH {QUOTES_CTE} c AS (SELECT captured_at::DATE AS cycle, count(*) AS n, count(*) FILTER (key = '1x2') AS a, count(*) FILTER (key LIKE 'over%') AS b, count(*) FILTER (key LIKE 'asian%') AS d, count(*) FILTER (key = 'home_away') AS e FROM quotes GROUP BY 1), p AS (SELECT *, lag(n) OVER (ORDER BY cycle) AS prev FROM c)
      SELECT strftime(cycle, '%Y-%m-%d') AS cycle, n, prev, coalesce(n < 0.5 * prev, false) AS collapsed, concat_ws(',', CASE WHEN a = 0 THEN '1x2' END, CASE WHEN b = 0 THEN 'over_under' END, CASE WHEN d = 0 THEN 'asian_handicap' END, CASE WHEN e = 0 THEN 'home_away' END) AS missing FROM p""",
}
