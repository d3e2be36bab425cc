"""Picks, market keys and quotes derived from the driver's tables, the same in Spark and SQL."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.sources.bridge import table

#: Fixed values of the test bridge: provider keys, and books of quotes by number.
KEYS = ("1x2", "over_under_2_5", "asian_handicap_-1_5", "european_handicap_+1", "btts", "dnb", "double_chance", "home_away", "match_winner", "over_under_games_215_5", "asian_handicap_games_-7_5_games", "asian_handicap_+2_5_sets", "over_under_sets_2_5", "asian_handicap_-0_25", "half_time_1x2", "h2h")
SPORTS = ("soccer", "soccer_epl", "basketball", "tennis_atp")
QUOTE_BOOKS = ("Pinnacle", "bet365", " Unibet", "betfair exchange", "bwin", "Matchbook")
QUOTE_KEYS = (("1x2", 3), ("over_under_2_5", 2), ("asian_handicap_-0_5", 2), ("home_away", 2))


def listed(values, index: str) -> str:
    """An array of texts indexed from 0, in either SQL's own words."""
    return f"array({', '.join(repr(v) for v in values)})[{index}]"


def duck(sql: str) -> str:
    """DuckDB's words for a select that both engines share."""
    for spark_word, duck_word in (("array(", "list_value("), ("timestampadd(HOUR, ", "add_hours("), ("TIMESTAMP_NTZ'", "TIMESTAMP '"), (" div ", " // ")):
        sql = sql.replace(spark_word, duck_word)
    return sql


#: Selections by market and side; some can't be read on purpose.
SELECTION = """CASE m WHEN 0 THEN array(home, 'Draw', away, 'Nobody')[v % 4] WHEN 1 THEN array('Over 2.5', 'Under 2.5', 'Over 3', 'Under three')[v % 4]
  WHEN 2 THEN array(concat(home, ' -1.5'), concat(away, ' +0.25'), concat(home, ' -1'), 'Draw (+1)')[v % 4] WHEN 3 THEN array('BTTS Yes', 'BTTS No', 'Both', 'BTTS Yes')[v % 4]
  WHEN 4 THEN array(home, away, 'Draw', home)[v % 4] WHEN 5 THEN array(concat(home, ' or Draw'), concat(home, ' or ', away), concat('Draw or ', away), home)[v % 4] ELSE 'Outright' END"""
PICKS_SQL = f"""
SELECT pick_id, array('h2h', 'totals', 'spreads', 'btts', 'dnb', 'double_chance', 'winner')[m] AS family, {SELECTION} AS selection, home, away, home_score, away_score, created_at, kickoff,
       stake, odds, sport, book, anchor_book, close_book, tier, pick_fair, close_fair, mint_fell_back, close_fell_back, has_close, version, event_id
FROM (
  SELECT o_orderkey AS pick_id, o_orderkey % 7 AS m, (o_custkey + o_orderkey) div 7 AS v, concat('Team ', CAST(o_custkey % 40 AS STRING)) AS home, concat('Side ', CAST((o_custkey * 7 + o_orderkey) % 40 AS STRING)) AS away,
         CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_orderkey % 5 AS INT) END AS home_score, CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 4 AS INT) END AS away_score,
         o_orderdate AS created_at, CASE WHEN o_orderkey % 23 <> 0 THEN timestampadd(HOUR, CAST(o_orderkey % 73 AS INT), o_orderdate) END AS kickoff,
         CAST(5 + o_custkey % 20 AS DOUBLE) AS stake, CAST(round(1.25e0 + (o_orderkey % 37) / 10e0, 4) AS DOUBLE) AS odds, {listed(SPORTS, "o_custkey % 4")} AS sport,
         array('bet365', 'bwin', 'Pinnacle', 'betfair exchange')[o_orderkey % 4] AS book, array('pinnacle', 'betfair exchange', 'consensus', 'bet365', '')[o_custkey % 5] AS anchor_book,
         array('pinnacle', 'consensus', 'smarkets', 'bwin', '')[(o_custkey + o_orderkey) % 5] AS close_book, CASE WHEN o_orderkey % 3 = 0 THEN 'premium' ELSE 'volume' END AS tier,
         CAST(1 / (1.25e0 + (o_orderkey % 37) / 10e0) + (o_custkey % 9) / 200e0 AS DOUBLE) AS pick_fair,
         CASE WHEN o_orderkey % 11 <> 0 THEN CAST(1 / (1.25e0 + (o_orderkey % 37) / 10e0) + CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 9) / 200e0 ELSE (o_orderkey % 50) / 150e0 - 0.08e0 END AS DOUBLE) END AS close_fair,
         CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mint_fell_back, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS close_fell_back, o_orderkey % 6 <> 0 AS has_close,
         CAST(o_orderkey % 3 AS INT) AS version, o_custkey AS event_id
  FROM {{orders}})
"""
QUOTES_SQL = f"""
SELECT event_id, m, {listed([k for k, _ in QUOTE_KEYS], "m")} AS key, book_id, {listed(QUOTE_BOOKS, "book_id")} AS book, sel_idx, array('home', 'draw', 'away', 'over', 'under', '-', 'ah home', 'ah away', '-', 'one', 'two')[3 * m + sel_idx] AS selection,
       CAST(round(1e0 / (p * (1.01e0 + 0.012e0 * book_id)) * (1e0 + (noise - 20) / 300e0), 4) AS DOUBLE) AS odds, kickoff, timestampadd(HOUR, CAST(2 - ago AS INT), kickoff) AS captured_at, l_orderkey, l_linenumber
FROM (
  SELECT *, CASE WHEN m > 0 THEN CASE sel_idx WHEN 0 THEN q ELSE 1e0 - q END WHEN sel_idx = 0 THEN 0.75e0 * q WHEN sel_idx = 1 THEN 0.27e0 ELSE 0.73e0 - 0.75e0 * q END AS p, timestampadd(HOUR, CAST(5 * event_id AS INT), TIMESTAMP_NTZ'1996-01-01 00:00:00') AS kickoff
  FROM (
    SELECT l_partkey div 8 AS event_id, CAST(l_partkey % 4 AS INT) AS m, CAST(l_orderkey % 6 AS INT) AS book_id, CAST(l_linenumber % CASE WHEN l_partkey % 4 = 0 THEN 3 ELSE 2 END AS INT) AS sel_idx, 0.42e0 + 0.16e0 * ((l_partkey div 8 * 37) % 50) / 50e0 AS q,
           (7 * l_partkey + l_orderkey) % 41 AS noise, (l_orderkey * 7 + l_linenumber * 13) % 75 AS ago, l_orderkey, l_linenumber FROM {{lineitem}}))
"""


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pick an order: its market, selection, score, times, prices, anchors and flags."""
    return spark.sql(PICKS_SQL, orders=table(spark, sf_dir, "orders"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote an order line: events of several markets, of two and three selections, whose number grows with the parts; kickoffs hours after the captures."""
    return spark.sql(QUOTES_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's key, a family without its line, a sport, a league and teams an order."""
    return spark.sql(KEYED_SQL, orders=table(spark, sf_dir, "orders"))


KEYED_SQL = f"""
SELECT o_orderkey AS id, {listed(KEYS, "o_orderkey % 16")} AS key, {listed(SPORTS, "o_custkey % 4")} AS sport, concat('H', CAST(o_custkey % 9 AS STRING)) AS home, concat('A', CAST(o_custkey % 7 AS STRING)) AS away,
       array('England - Premier League', ' premier  LEAGUE', 'Serie A', 'Copa', '')[o_custkey % 5] AS league, CAST(1.2e0 + (o_orderkey % 90) / 10e0 AS DOUBLE) AS odds, CAST((o_custkey % 60) / 60e0 AS DOUBLE) AS fair FROM {{orders}}
"""
#: Common table expressions that the oracles begin with. A list is indexed from 1 in DuckDB, from 0 here.


def cte(name: str, sql: str) -> str:
    """A table expression for DuckDB: indexes from 1, hours added by intervals."""
    text = duck(sql).format(orders="orders", lineitem="lineitem")
    text = re.sub(r"add_hours\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*?), ([^,()]+(?:'[^']*')?)\)", r"(\2 + INTERVAL 1 HOUR * (\1))", text)
    text = re.sub(r"\)\[((?:[^\[\]])+)\]", r")[1 + \1]", text)
    return f"{name} AS ({text}),"


PICKS_CTE, QUOTES_CTE, KEYED_CTE = cte("picks", PICKS_SQL), cte("quotes", QUOTES_SQL), cte("keyed", KEYED_SQL)
