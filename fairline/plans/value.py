"""Queries of the live path: margins, anchors, scans, gates and sizing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import odds as fo
from fairline.functions.devig import devig
from fairline.operators import market
from fairline.sources.bridge import BOOK_CTE, odds_book

#: Full markets gross and net, the named sharp anchor and the consensus, with multiplicative margins.
MARKET_CTE = BOOK_CTE + """
full_books AS (SELECT event_id, book_id, book, max(odds) FILTER (sel_idx = 0) AS o0, max(odds) FILTER (sel_idx = 1) AS o1, max(odds) FILTER (sel_idx = 2) AS o2 FROM state GROUP BY ALL HAVING count(*) = 3),
net_books AS (SELECT *, 1 + (o0 - 1) * (1 - c) AS n0, 1 + (o1 - 1) * (1 - c) AS n1, 1 + (o2 - 1) * (1 - c) AS n2
        FROM (SELECT *, CASE book WHEN 'betfair exchange' THEN 0.05e0 WHEN 'matchbook' THEN 0.02e0 ELSE 0e0 END AS c FROM full_books)),
sharp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY book_id) AS rk FROM net_books
        WHERE book IN ('pinnacle', 'betfair exchange') AND 1/n0 + 1/n1 + 1/n2 - 1 BETWEEN 0 AND 0.12) WHERE rk = 1),
medians AS (SELECT event_id, median(n0) AS o0, median(n1) AS o1, median(n2) AS o2 FROM net_books GROUP BY event_id HAVING count(*) >= 3),
anchors AS (
  SELECT event_id, book AS anchor_book, CASE WHEN book = 'pinnacle' THEN 'pinnacle' ELSE 'sharp' END AS anchor_type, o0, o1, o2 FROM sharp
  UNION ALL SELECT event_id, 'consensus', 'consensus', o0, o1, o2 FROM medians WHERE 1/o0 + 1/o1 + 1/o2 - 1 BETWEEN 0 AND 0.12 AND event_id NOT IN (SELECT event_id FROM sharp)),
fair AS (SELECT event_id, anchor_book, anchor_type, i AS sel_idx, (1 / [o0, o1, o2][i + 1]) / (1/o0 + 1/o1 + 1/o2) AS fair FROM anchors, (SELECT unnest([0, 1, 2]) AS i)),
soft AS (SELECT *, 1 + (odds - 1) * (1 - CASE book WHEN 'matchbook' THEN 0.02e0 ELSE 0e0 END) AS net FROM state WHERE book NOT IN ('pinnacle', 'betfair exchange')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, sel_idx ORDER BY net DESC, book_id) AS rk FROM soft) WHERE rk = 1),
scan AS (SELECT b.event_id, b.sel_idx, b.selection, b.book, b.odds, b.net, f.anchor_book, f.anchor_type, f.fair, f.fair - 1 / b.net AS edge, f.fair * (b.net - 1) - (1 - f.fair) AS ev
         FROM best b JOIN fair f ON b.event_id = f.event_id AND b.sel_idx = f.sel_idx WHERE f.fair - 1 / b.net BETWEEN 0.015 AND 0.30 AND b.net >= 1.2),
top AS (SELECT *, CASE WHEN edge >= 0.03 THEN 'premium' ELSE 'volume' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY edge DESC, sel_idx) AS rk2 FROM scan) WHERE rk2 = 1),
"""


def anchored(spark: SparkSession, sf_dir: str, cutoffs: dict | None = None, books: str = "close", method: str = "multiplicative", **options) -> DataFrame:
    """Every three-way market of the odds book with its anchor, in one pass over the observations."""
    rows = market.market_rows(odds_book(spark, sf_dir), cutoffs or {"close": F.col("kickoff")})
    return market.with_anchor(rows, books, method=method, **options).where("size(sels) = 3")


def scan(spark: SparkSession, sf_dir: str, method: str = "multiplicative") -> DataFrame:
    return market.value_scan(anchored(spark, sf_dir, method=method), guard=False)


def exploded(df: DataFrame, fair: str = "fair") -> DataFrame:
    """One row a selection of a market's array of probabilities."""
    return df.where(F.col(fair).isNotNull()).select(*[c for c in df.columns if c != fair], F.explode(F.arrays_zip(F.col("sels").alias("sel_idx"), F.col(fair).alias("fair"))).alias("leg")).select("*", "leg.sel_idx", "leg.fair").drop("leg")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def value_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: state at kickoff, anchor, fair price, best soft price, one pick a market."""
    return rounded(market.top_pick(scan(spark, sf_dir)), "fair", "edge", "ev").select("event_id", "selection", "book", "odds", "anchor_book", "anchor_type", "fair", "edge", "ev", "tier")


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every selection with an edge in bounds."""
    return rounded(scan(spark, sf_dir), "net", "fair", "edge", "ev").select("event_id", "selection", "book", "net", "fair", "edge", "ev")


def state_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of close: the last price of each (event, book, selection) at kickoff."""
    return market.state_at(odds_book(spark, sf_dir)).select("event_id", "book", "selection", "odds", "l_orderkey", "l_linenumber")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named sharp anchor, else consensus, with its fair probabilities."""
    return rounded(exploded(anchored(spark, sf_dir)), "fair").select("event_id", "anchor_book", "anchor_type", F.col("sel_idx").cast("long").alias("sel_idx"), "fair")


def logit_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus by averaged logits of each book's own fair prices."""
    m = anchored(spark, sf_dir).withColumn("fair", market.logit_pool(F.col("full"), F.col("sels"), max_overround=9.0)).withColumn("books", F.size("full").cast("long"))
    return rounded(exploded(m), "fair").select("event_id", F.col("sel_idx").cast("long").alias("sel_idx"), "fair", "books")


def swap_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose anchor ranks selections against a clear consensus; anchors are turned round for every seventh event."""
    m = anchored(spark, sf_dir).where("fair IS NOT NULL").withColumn("fair", F.when(F.col("event_id") % 7 == 0, F.reverse("fair")).otherwise(F.col("fair")))
    return m.where(market.swapped(F.col("full"), F.col("sels"), F.col("fair"))).select("event_id")


def double_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = anchored(spark, sf_dir).select("event_id", F.explode(market.double_chance(F.col("fair"))).alias("l"))
    return rounded(legs.select("event_id", "l.*"), "fair")


def full_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, book, odds) of every book that prices a whole market."""
    return anchored(spark, sf_dir).select("event_id", F.explode("full").alias("b")).select("event_id", "b.book", F.col("b.gross").alias("odds"))


def devigged(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = full_prices(spark, sf_dir).withColumn("d", devig(F.col("odds"), method))
        f = F.col("d.fair")
        return d.select("event_id", "book", *(F.round(f[i], 6).alias(f"p{i}") for i in range(3)), F.col("d.fell_back").alias("fell_back"))

    query.__doc__ = f"Fair probabilities of every full market by the {method} method."
    return query


def root_sql(at: str, lo: str, hi: str) -> str:
    """An oracle by bisection: 60 halvings for every market at once. at: the probability of price o under parameter k."""
    p = [at.replace("{o}", f"o{i}").replace("{k}", "(lo + hi) / 2") for i in range(3)]
    return f"""WITH RECURSIVE {MARKET_CTE}
halved AS (SELECT event_id, book, o0, o1, o2, 1/o0 + 1/o1 + 1/o2 AS b, CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, 0 AS step FROM full_books
  UNION ALL SELECT event_id, book, o0, o1, o2, b, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END, step + 1
  FROM (SELECT *, {' + '.join(p)} - 1 > 0 AS up FROM halved WHERE step < 60)),
solved AS (SELECT event_id, book, o0, o1, o2, b, {', '.join(f'{x} AS r{i}' for i, x in enumerate(p))} FROM halved WHERE step = 60),
judged AS (SELECT *, CASE WHEN least(r0, r1, r2) <= 0 OR greatest(r0, r1, r2) >= 1 BAD THEN true ELSE false END AS bad FROM solved)
SELECT event_id, book, {', '.join(f'round(CASE WHEN bad THEN 1 / o{i} / b ELSE r{i} / (r0 + r1 + r2) END, 6) AS p{i}' for i in range(3))}, bad AS fell_back FROM judged"""


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with all its reasons for rejection, and whether it is accepted."""
    s = scan(spark, sf_dir)
    reasons = F.filter(F.array(F.when(F.col("edge") < 0.02, "low_edge"), F.when(F.col("ev") <= 0.05, "low_ev"), F.when(F.col("odds") > 6, "long_odds"), F.when(F.col("fair") < 0.2, "low_probability"), F.when(F.col("anchor_type") == "consensus", "no_sharp_anchor")), lambda r: r.isNotNull())
    return s.select("event_id", "selection", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


def sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kelly, caps, haircuts, money stake, confidence and price floors of every candidate."""
    s = scan(spark, sf_dir)
    stake = fo.recommended_stake(F.col("fair"), F.col("net"))
    return s.select(
        "event_id", "selection", F.round(stake["raw"], 6).alias("raw"), F.round(stake["fractional"], 6).alias("fractional"), F.round(stake["final"], 6).alias("final"),
        F.round(stake["final"] * fo.correlation_haircut(F.lit(3), 0.25) * fo.drawdown_multiplier(0.2, 0.1), 6).alias("cut"),
        F.round(fo.uncertainty_multiplier(F.lit(0.25), F.col("edge") * F.col("edge"), 10.0), 6).alias("multiplier"),
        fo.confidence(F.col("edge"), 0.03, F.col("anchor_type"), F.col("fair")).alias("confidence"),
        F.round(fo.min_acceptable_odds(F.col("fair"), 0.01, F.col("book")), 6).alias("floor"), fo.odds_band(F.col("odds")).alias("band"),
        F.round(fo.tick_size(F.col("odds")), 2).alias("tick"),
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: books, full-market books, rows without liquidity, first and last capture day before kickoff."""
    s = odds_book(spark, sf_dir).where("captured_at <= kickoff")
    n = s.groupBy("event_id").agg(F.countDistinct("book_id").alias("books"), F.count("*").alias("observations"), F.count_if(F.col("liquidity").isNull()).alias("no_liquidity"), F.date_format(F.min("captured_at"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("captured_at"), "yyyy-MM-dd").alias("last_day"))
    full = anchored(spark, sf_dir).select("event_id", F.size("full").cast("long").alias("full_books"))
    return n.join(full, "event_id", "left").withColumn("full_books", F.coalesce("full_books", F.lit(0)))


def bands_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets: prices by book and band, with subtotals."""
    s = market.state_at(odds_book(spark, sf_dir)).withColumn("band", fo.odds_band(F.col("odds")))
    return s.rollup("book", "band").agg(F.count("*").alias("n"), F.round(F.avg(fo.implied(F.col("odds"))), 6).alias("mean_implied"))


QUERIES = {
    "value_scan": value_scan, "all_edges": all_edges, "state_close": state_close, "anchors": anchors, "logit_pool": logit_pool, "swap_guard": swap_guard, "double_chance": double_chance,
    **{f"devig_{m}": devigged(m) for m in ("multiplicative", "additive", "power", "logarithmic", "shin", "probit")},
    "gates": gates, "sizing": sizing, "coverage": coverage, "bands_by_book": bands_by_book,
}
BAND = "CASE WHEN odds <= 1.5 THEN 0 WHEN odds <= 2 THEN 1 WHEN odds <= 3 THEN 2 WHEN odds <= 5 THEN 3 WHEN odds <= 10 THEN 4 ELSE 5 END"
ORACLES = {
    "value_scan": f"WITH {MARKET_CTE} done AS (SELECT 1) SELECT event_id, selection, book, odds, anchor_book, anchor_type, round(fair, 6) AS fair, round(edge, 6) AS edge, round(ev, 6) AS ev, tier FROM top",
    "all_edges": f"WITH {MARKET_CTE} done AS (SELECT 1) SELECT event_id, selection, book, round(net, 6) AS net, round(fair, 6) AS fair, round(edge, 6) AS edge, round(ev, 6) AS ev FROM scan",
    "state_close": f"WITH {BOOK_CTE} done AS (SELECT 1) SELECT event_id, book, selection, odds, l_orderkey, l_linenumber FROM state",
    "anchors": f"WITH {MARKET_CTE} done AS (SELECT 1) SELECT event_id, anchor_book, anchor_type, CAST(sel_idx AS BIGINT) AS sel_idx, round(fair, 6) AS fair FROM fair",
    "logit_pool": f"""WITH {MARKET_CTE} legs AS (SELECT event_id, i AS sel_idx, (1 / [n0, n1, n2][i + 1]) / (1/n0 + 1/n1 + 1/n2) AS p FROM net_books, (SELECT unnest([0, 1, 2]) AS i)),
      pooled AS (SELECT event_id, sel_idx, 1 / (1 + exp(-avg(ln(p / (1 - p))))) AS p, count(*) AS books FROM legs GROUP BY ALL HAVING count(*) >= 3)
      SELECT event_id, CAST(sel_idx AS BIGINT) AS sel_idx, round(p / sum(p) OVER (PARTITION BY event_id), 6) AS fair, books FROM pooled""",
    "swap_guard": f"""WITH {MARKET_CTE} q AS (SELECT event_id, i AS sel_idx, median(1 / [n0, n1, n2][i + 1]) AS q FROM net_books, (SELECT unnest([0, 1, 2]) AS i) GROUP BY ALL HAVING count(*) >= 3),
      f AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 2 - sel_idx ELSE sel_idx END AS sel_idx, fair FROM fair), j AS (SELECT q.*, f.fair, sum(q) OVER (PARTITION BY q.event_id) AS t FROM q JOIN f ON q.event_id = f.event_id AND q.sel_idx = f.sel_idx)
      SELECT DISTINCT a.event_id FROM j a JOIN j b ON a.event_id = b.event_id WHERE (a.q - b.q) / a.t > 0.10 AND a.fair <= b.fair""",
    "double_chance": f"WITH {MARKET_CTE} w AS (SELECT event_id, max(fair) FILTER (sel_idx = 0) AS a, max(fair) FILTER (sel_idx = 1) AS b, max(fair) FILTER (sel_idx = 2) AS c FROM fair GROUP BY event_id) SELECT event_id, '1X' AS selection, round(a + b, 6) AS fair FROM w UNION ALL SELECT event_id, 'X2', round(b + c, 6) FROM w UNION ALL SELECT event_id, '12', round(a + c, 6) FROM w",
    "devig_multiplicative": f"WITH {MARKET_CTE} done AS (SELECT 1) SELECT event_id, book, " + ", ".join(f"round(1 / o{i} / (1/o0 + 1/o1 + 1/o2), 6) AS p{i}" for i in range(3)) + ", false AS fell_back FROM full_books",
    "devig_additive": f"""WITH {MARKET_CTE} a AS (SELECT *, 1/o0 + 1/o1 + 1/o2 AS b, 1/o0 - (1/o0 + 1/o1 + 1/o2 - 1) / 3 AS r0, 1/o1 - (1/o0 + 1/o1 + 1/o2 - 1) / 3 AS r1, 1/o2 - (1/o0 + 1/o1 + 1/o2 - 1) / 3 AS r2 FROM full_books),
      j AS (SELECT *, least(r0, r1, r2) <= 0 OR greatest(r0, r1, r2) >= 1 AS bad FROM a) SELECT event_id, book, """ + ", ".join(f"round(CASE WHEN bad THEN 1 / o{i} / b ELSE r{i} / (r0 + r1 + r2) END, 6) AS p{i}" for i in range(3)) + ", bad AS fell_back FROM j",
    "devig_power": root_sql("pow(1 / {o}, {k})", "0.001", "1024").replace("BAD", ""),
    "devig_logarithmic": root_sql("1 / (1 + exp({k} - ln((1 / {o}) / (1 - 1 / {o}))))", "-20", "20").replace("BAD", ""),
    "devig_shin": root_sql("(sqrt({k} * {k} + 4 * (1 - {k}) / {o} / {o} / b) - {k}) / (2 * (1 - {k}))", "0", "0.999").replace("BAD", "OR b < 1"),
    "gates": f"""WITH {MARKET_CTE} r AS (SELECT *, list_filter([CASE WHEN edge < 0.02 THEN 'low_edge' END, CASE WHEN ev <= 0.05 THEN 'low_ev' END, CASE WHEN odds > 6 THEN 'long_odds' END, CASE WHEN fair < 0.2 THEN 'low_probability' END, CASE WHEN anchor_type = 'consensus' THEN 'no_sharp_anchor' END], lambda x: x IS NOT NULL) AS l FROM scan)
      SELECT event_id, selection, coalesce(array_to_string(l, ','), '') AS reasons, len(l) = 0 AS accepted FROM r""",
    "sizing": f"""WITH {MARKET_CTE} k AS (SELECT *, greatest(((net - 1) * fair - (1 - fair)) / (net - 1), 0) AS raw FROM scan), s AS (SELECT *, least(raw * 0.25e0, 0.02e0) AS final FROM k)
      SELECT event_id, selection, round(raw, 6) AS raw, round(raw * 0.25e0, 6) AS fractional, round(final, 6) AS final, round(final * (1 / sqrt(1 + 2 * 0.25e0)) * {fo.drawdown_multiplier(0.2, 0.1)!r}, 6) AS cut,
        round(0.25e0 / (1 + 10 * edge * edge), 6) AS multiplier, CAST(greatest(1, least(5, 1 + CASE WHEN edge >= 0.06 THEN 2 WHEN edge >= 0.03 THEN 1 ELSE 0 END + CASE anchor_type WHEN 'pinnacle' THEN 2 WHEN 'sharp' THEN 1 ELSE 0 END + CASE WHEN fair >= 0.725 THEN 1 WHEN fair < 0.60 THEN -1 ELSE 0 END)) AS INTEGER) AS confidence,
        CASE WHEN fair > 0.01 THEN round(1 + (1 / (fair - 0.01e0) - 1) / (1 - CASE book WHEN 'matchbook' THEN 0.02e0 ELSE 0e0 END), 6) END AS floor, {BAND} AS band,
        CASE WHEN odds < 2 THEN 0.01e0 WHEN odds < 3 THEN 0.02e0 WHEN odds < 4 THEN 0.05e0 WHEN odds < 6 THEN 0.1e0 WHEN odds < 10 THEN 0.2e0 WHEN odds < 20 THEN 0.5e0 ELSE 1e0 END AS tick FROM s""",
    "coverage": f"""WITH {MARKET_CTE} n AS (SELECT event_id, count(DISTINCT book_id) AS books, count(*) AS observations, count(*) FILTER (liquidity IS NULL) AS no_liquidity, strftime(min(captured_at), '%Y-%m-%d') AS first_day, strftime(max(captured_at), '%Y-%m-%d') AS last_day FROM book WHERE captured_at <= kickoff GROUP BY event_id)
      SELECT n.*, coalesce(f.full_books, 0) AS full_books FROM n LEFT JOIN (SELECT event_id, count(*) AS full_books FROM full_books GROUP BY event_id) f ON n.event_id = f.event_id""",
    "bands_by_book": f"WITH {BOOK_CTE} b AS (SELECT *, {BAND} AS band FROM state) SELECT book, band, count(*) AS n, round(avg(1 / odds), 6) AS mean_implied FROM b GROUP BY ROLLUP (book, band)",
}
