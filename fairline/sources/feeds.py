"""JSON feeds as quotes: fixture bundles, bookmaker lists, matchups with their markets, page feeds and scoreboards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.keys import family_of, labels_of_key, looked_up
from fairline.functions.odds import american_to_decimal, parsed_odds
from fairline.functions.text import plain_number
from fairline.sources.exchange import utc_time

#: Names of a bookmaker list's books and markets.
CANONICAL = {"betfair_ex_eu": "betfair exchange", "betfair_ex_uk": "betfair exchange", "williamhill": "william hill"}
MARKETS = {"h2h": "h2h", "totals": "totals", "spreads": "spreads", "btts": "btts"}
ENTRY = "struct<createdAt: string, price: double, active: boolean>"
BUNDLE = f"struct<fixtureId: string, startTime: string, home_team: string, away_team: string, result: string, home_score: double, away_score: double, moneyline: struct<marketId: string, home_outcomeId: string, away_outcomeId: string>, historical_odds: struct<bookmakers: map<string, struct<markets: map<string, struct<outcomes: map<string, struct<players: map<string, array<{ENTRY}>>>>>>>>>>"
LISTED = "struct<id: string, bookmakers: array<struct<key: string, last_update: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double, point: double>>>>>>>"
MATCHUP = "struct<id: string, type: string, parent: string, parentId: string, startTime: string, cutoffAt: string, league: struct<name: string>, participants: array<struct<name: string, alignment: string>>>"
MARKET = "struct<key: string, type: string, period: int, status: string, isAlternate: boolean, matchupId: string, version: bigint, prices: array<struct<designation: string, price: int, points: double>>>"
SIDE = "struct<homeAway: string, score: string, team: struct<displayName: string>, athlete: struct<displayName: string>, linescores: array<struct<value: double>>>"
COMPETITION = f"struct<date: string, status: struct<type: struct<name: string, completed: boolean>>, competitors: array<{SIDE}>>"
BOARD = f"struct<events: array<struct<date: string, competitions: array<{COMPETITION}>, groupings: array<struct<competitions: array<{COMPETITION}>>>>>>"


def ends_of(node: Column, market: Column, outcome: Column) -> Column:
    """(open, close): the first and last active price over 1 of a bookmaker's outcome, over all its players; null at any missing level."""
    entries = F.flatten(F.map_values(F.try_element_at(F.try_element_at(node["markets"], market)["outcomes"], outcome)["players"]))
    good = F.array_sort(F.transform(F.filter(entries, lambda e: F.coalesce(e["active"], F.lit(False)) & (e["price"] > 1)), lambda e: F.struct(e["createdAt"].alias("at"), e["price"].alias("price"))))
    return F.struct(F.get(good, 0)["price"].alias("open"), F.try_element_at(good, F.lit(-1))["price"].alias("close"))


def fixture_bundles(payloads: DataFrame, soft: tuple[str, ...], *, sharp: str = "pinnacle") -> DataFrame:
    """A game a bundle: the sharp book's first and last price of both sides, the best soft ones, and the result; without any sharp price there is none. payloads: value."""
    b = payloads.select(F.from_json("value", BUNDLE).alias("b")).select("b.*").where("moneyline IS NOT NULL AND historical_odds.bookmakers IS NOT NULL")
    book = lambda name: F.try_element_at("historical_odds.bookmakers", F.lit(name))
    prices = {}
    for side in ("home", "away"):
        own = [ends_of(book(n), F.col("moneyline.marketId"), F.col(f"moneyline.{side}_outcomeId")) for n in (sharp, *soft)]
        for end in ("open", "close"):
            prices[f"{side}_sharp_{end}"] = own[0][end]
            prices[f"{side}_soft_{end}"] = F.array_max(F.array(*(o[end] for o in own[1:]))) if soft else F.lit(None).cast("double")
    result = F.when(F.col("result").isin("H", "A"), F.col("result")).when(F.col("home_score") > F.col("away_score"), "H").when(F.col("home_score") < F.col("away_score"), "A")
    games = b.select(F.col("fixtureId").alias("fixture_id"), utc_time(F.col("startTime")).alias("kickoff"), F.trim("home_team").alias("home"), F.trim("away_team").alias("away"), result.alias("result"), *(c.alias(n) for n, c in prices.items()))
    return games.where("coalesce(home_sharp_open, home_sharp_close, away_sharp_open, away_sharp_close) IS NOT NULL")


def sharp_soft_rows(games: DataFrame) -> DataFrame:
    """Bundles as backtest rows: the sharp open is the anchor, the best soft open the price, else the sharp one; closes where both are known."""
    pair = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.array(a, b))
    best = F.array(F.coalesce("home_soft_open", "home_sharp_open"), F.coalesce("away_soft_open", "away_sharp_open"))
    rows = games.select(F.col("fixture_id").alias("match_id"), "kickoff", pair("home_sharp_open", "away_sharp_open").alias("sharp"), best.alias("best"), pair("home_sharp_close", "away_sharp_close").alias("close"), F.when(F.col("result") == "H", 0).when(F.col("result") == "A", 1).alias("result"))
    return rows.where("sharp IS NOT NULL AND result IS NOT NULL")


def listed_quotes(payloads: DataFrame, now: Column) -> DataFrame:
    """Quotes of bookmaker lists (a JSON array of events a row, value): a line's two sides share the home side's line, other markets have none."""
    e = payloads.select(F.explode(F.from_json("value", f"array<{LISTED}>")).alias("e")).where("coalesce(e.id, '') <> ''").select("e.id", F.explode("e.bookmakers").alias("b"))
    m = e.select(F.col("id").alias("event_id"), F.coalesce(looked_up(CANONICAL, F.col("b.key")), F.col("b.key")).alias("book"), F.coalesce(utc_time(F.col("b.last_update")), now).alias("captured_at"), F.explode("b.markets").alias("m"))
    o = m.withColumn("family", looked_up(MARKETS, F.col("m.key"))).where("family IS NOT NULL").select("event_id", "book", "captured_at", "family", F.get(F.col("m.outcomes.point"), 0).alias("first"), F.explode("m.outcomes").alias("o"))
    point = F.col("o.point")
    line = F.when(F.col("family") == "spreads", F.col("first")).otherwise(point)
    return o.where("o.price > 1").select("event_id", "book", "family", line.alias("line"), F.when(point.isNull(), F.col("o.name")).otherwise(F.concat_ws(" ", "o.name", point.cast("string"))).alias("selection"), F.col("o.price").alias("odds"), "captured_at")


def matchups(payloads: DataFrame, now: Column, until: Column) -> DataFrame:
    """Coming matches of a list: of their own, with both sides, starting within the horizon; the cutoff of betting counts before the start. payloads: value, a JSON array."""
    m = payloads.select(F.explode(F.from_json("value", f"array<{MATCHUP}>")).alias("m")).select("m.*").where("type = 'matchup' AND parent IS NULL AND parentId IS NULL")
    side = lambda s: F.get(F.filter("participants", lambda p: p["alignment"] == s), 0)["name"]
    out = m.select(F.col("id").alias("event_id"), side("home").alias("home"), side("away").alias("away"), F.coalesce("league.name", F.lit("")).alias("league"), F.coalesce(utc_time(F.col("cutoffAt")), utc_time(F.col("startTime"))).alias("kickoff"))
    return out.where((F.coalesce("home", F.lit("")) != "") & (F.coalesce("away", F.lit("")) != "") & (F.col("kickoff") > now) & (F.col("kickoff") <= until))


def matchup_quotes(events: DataFrame, payloads: DataFrame, *, games: bool = False) -> DataFrame:
    """Quotes of the open main markets of whole matches: money lines, totals and handicaps, the latter by the home line.

    events: matchups(); payloads: value, a JSON array of markets; games: the sport's keys name their axis.
    """
    m = payloads.select(F.explode(F.from_json("value", f"array<{MARKET}>")).alias("m")).select("m.*").where("period = 0 AND status = 'open'")
    money = (F.col("key") == "s;0;m") & (F.col("type") == "moneyline")
    main = ~F.coalesce("isAlternate", F.lit(False))
    total, spread = F.col("key").startswith("s;0;ou") & (F.col("type") == "total") & main, F.col("key").startswith("s;0;s") & (F.col("type") == "spread") & main
    family = F.when(money, "h2h").when(total, "totals").when(spread, "spreads")
    home_line = F.get(F.filter("prices", lambda p: (p["designation"] == "home") & p["points"].isNotNull()), 0)["points"]
    m = m.withColumn("family", family).withColumn("home_line", home_line).where("family IS NOT NULL AND (family <> 'spreads' OR home_line IS NOT NULL)")
    p = m.join(events, m["matchupId"] == events["event_id"]).select("event_id", "home", "away", "family", "home_line", "version", F.explode("prices").alias("p"))
    d, points = F.col("p.designation"), F.col("p.points")
    token = lambda x, signed: F.replace(plain_number(x, signed), F.lit("."), F.lit("_"))
    axis = "games_" if games else ""
    key = F.when(F.col("family") == "totals", F.concat(F.lit(f"over_under_{axis}"), token(points, False))).when(F.col("family") == "spreads", F.concat(F.lit(f"asian_handicap_{axis}"), token(F.col("home_line"), not games)))
    team = F.when(d == "home", F.col("home")).when(d == "away", F.col("away"))
    selection = (
        F.when(F.col("family") == "h2h", F.coalesce(team, F.when(d == "draw", "Draw"))).when((F.col("family") == "totals") & d.isin("over", "under") & points.isNotNull(), F.concat_ws(" ", F.initcap(d), plain_number(points)))
        .when((F.col("family") == "spreads") & team.isNotNull() & points.isNotNull(), F.concat_ws(" ", team, plain_number(points, signed=True)))
    )
    out = p.select("event_id", "family", key.alias("key"), selection.alias("selection"), american_to_decimal(F.col("p.price")).alias("odds"), "version")
    return out.where("selection IS NOT NULL AND odds > 1")


def feed_quotes(payloads: DataFrame, books: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Quotes of page feeds. payloads: event_id, home, away, value; books: id, book; wanted: key, feed_key, labels (array, by position).

    A book's outcomes are a list or a map by position; unknown books are skipped, a book that comes twice
    counts once, prices of 1 or less are none. The feed's own time counts, else now.
    """
    block = "map<string, struct<odds: map<string, string>>>"
    p = payloads.select("event_id", "home", "away", F.coalesce(F.timestamp_seconds(F.get_json_object("value", "$.d.time-base").try_cast("double")), now).alias("captured_at"), F.from_json(F.get_json_object("value", "$.d.oddsdata.back"), block).alias("back"))
    b = p.select("event_id", "home", "away", "captured_at", F.explode("back").alias("feed_key", "block")).join(F.broadcast(wanted), "feed_key")  # a few dozen markets
    o = b.select("event_id", "home", "away", "captured_at", "key", "labels", F.explode("block.odds").alias("id", "outcomes")).join(books, "id")
    once = o.groupBy("event_id", "key", "book").agg(F.min_by(F.struct("home", "away", "captured_at", "labels", "outcomes"), "id").alias("r")).select("event_id", "key", "book", "r.*")
    at = lambda i: F.coalesce(F.get_json_object("outcomes", f"$[{i}]"), F.get_json_object("outcomes", f"$.{i}"))
    cells = F.arrays_zip("labels", F.array(*(parsed_odds(at(i)) for i in range(3))).alias("odds"))
    q = once.select("event_id", "key", "book", "home", "away", "captured_at", F.explode(cells).alias("c")).where("c.labels IS NOT NULL AND c.odds IS NOT NULL")
    named = F.get(F.filter(labels_of_key(F.col("key"), F.col("home"), F.col("away")), lambda x: x["label"] == F.col("c.labels")), 0)["selection"]
    return q.select("event_id", "key", family_of(F.col("key")).alias("family"), "book", named.alias("selection"), F.col("c.odds").alias("odds"), "captured_at").where("selection IS NOT NULL AND family IS NOT NULL")


def exchange_quotes(quotes: DataFrame, floor: float) -> DataFrame:
    """The exchange's prices with enough matched money; unknown money is not enough."""
    return quotes.where(F.col("liquidity") >= floor)


def scoreboard(payloads: DataFrame) -> DataFrame:
    """Final scores of team boards: both sides with a name and a whole score. payloads: value."""
    c = payloads.select(F.explode(F.from_json("value", BOARD)["events"]).alias("e")).select("e.date", F.explode("e.competitions").alias("c"))
    return sides_of(c, lambda s: s["team"]["displayName"], lambda s: F.when(s["score"].rlike(r"^\d+$"), s["score"].try_cast("int")))


def tennis_scoreboard(payloads: DataFrame) -> DataFrame:
    """Sets won by both players of finished matches; a match without a finished set is none."""
    g = payloads.select(F.explode(F.from_json("value", BOARD)["events"]).alias("e")).select("e.date", F.explode("e.groupings").alias("g"))
    c = g.select("date", F.explode("g.competitions").alias("c")).where("c.status.type.completed")
    lines = lambda s: F.array_compact(F.transform(F.coalesce(s["linescores"], F.array().cast("array<struct<value:double>>")), lambda x: x["value"]))
    side = lambda s: F.get(F.filter("c.competitors", lambda x: (x["homeAway"] == s) & (F.coalesce(x["athlete"]["displayName"], F.lit("")) != "")), 0)
    p = c.select(F.coalesce("c.date", "date").alias("at"), side("home").alias("h"), side("away").alias("a")).where("h IS NOT NULL AND a IS NOT NULL")
    won = sets_won(lines(F.col("h")), lines(F.col("a")))
    out = p.select(F.col("h.athlete.displayName").alias("home"), F.col("a.athlete.displayName").alias("away"), F.to_date(F.left("at", F.lit(10)).try_cast("date")).alias("played"), won.alias("w"))
    return out.where("played IS NOT NULL AND w.home + w.away > 0").select("home", "away", "played", F.col("w.home").alias("home_score"), F.col("w.away").alias("away_score"))


def sets_won(home: Column, away: Column) -> Column:
    """Sets that either side has more games in; a set that one side lacks does not count."""
    both = F.arrays_zip(home.alias("h"), away.alias("a"))
    count = lambda f: F.size(F.filter(both, lambda s: F.coalesce(f(s), F.lit(False))))
    return F.struct(count(lambda s: s["h"] > s["a"]).alias("home"), count(lambda s: s["a"] > s["h"]).alias("away"))


def sides_of(competitions: DataFrame, name, score) -> DataFrame:
    """(home, away, played, home_score, away_score) of finished competitions (date, c)."""
    good = lambda s: F.get(F.filter("c.competitors", lambda x: (x["homeAway"] == s) & (F.coalesce(name(x), F.lit("")) != "") & score(x).isNotNull()), 0)
    p = competitions.where("c.status.type.completed").select(F.coalesce("c.date", "date").alias("at"), good("home").alias("h"), good("away").alias("a")).where("h IS NOT NULL AND a IS NOT NULL")
    out = p.select(name(F.col("h")).alias("home"), name(F.col("a")).alias("away"), F.left("at", F.lit(10)).try_cast("date").alias("played"), score(F.col("h")).alias("home_score"), score(F.col("a")).alias("away_score"))
    return out.where("played IS NOT NULL")
