"""Queries over price histories, event streams, matches and names."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import text
from fairline.operators import resolve, timeline
from fairline.plans.value import rounded
from fairline.sources.bridge import BOOK_CTE, odds_book, table

#: Fixed values of the test bridge: DIVISIONS of 20 clubs, each named by a start and an end of its place and a kind.
DIVISIONS = 50
STARTS = (
    "Ark", "Bex", "Cor", "Drum", "Elm", "Fen", "Gar", "Hol", "Ing", "Jar", "Kel", "Lud", "Mor", "Nor", "Ott", "Pem", "Quor", "Rad", "Sel", "Tor",
    "Ul", "Var", "Wex", "Yar", "Zen", "Ash", "Brim", "Clun", "Dov", "Ever", "Frod", "Glos", "Hax", "Ilk", "Kirk", "Lym", "Mal", "Thur", "Stav", "Prest",
)
ENDS = ("ham", "ley", "vale", "gate", "stead", "wick", "row", "lin", "mouth", "burgh", "combe", "ditch", "field", "grove", "hurst", "jay", "kirk", "minster", "ness", "over", "port", "quay", "sop", "thorpe", "yarth")
KINDS = ("Rovers", "Town", "United", "City", "Athletic", "Albion", "Wanderers", "Vale")


def club(number: Column) -> Column:
    """Name of one of the 1,000 clubs."""
    pick = lambda words, at: F.array(*map(F.lit, words))[at.cast("int")]
    return F.concat(pick(STARTS, number % 40), pick(ENDS, F.floor(number / 40) % 25), F.lit(" "), pick(KINDS, number % 8))


def spelled(number: Column) -> Column:
    """The name as a second source writes it, by one of eight habits; one is another team of the club, one a typing error in the first letters."""
    name, habit = club(number), F.floor(number / 8) % 8
    return (
        F.when(habit == 0, F.concat(F.upper(name), F.lit(" FC")))
        .when(habit == 1, F.concat(F.lit("AFC "), F.replace(name, F.lit(" "), F.lit("  "))))
        .when(habit == 2, F.translate(name, "aeo", "áéö"))
        .when(habit == 3, F.concat(name, F.lit(" C.F.")))
        .when(habit == 4, name)
        .when(habit == 5, F.concat(name, F.lit(" Women")))
        .when(habit == 6, F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substring(name, 3, 99)))
        .otherwise(F.concat(F.translate(name, " ", "-"), F.lit(" SC")))
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations whose price differs from the one before."""
    return timeline.price_changes(odds_book(spark, sf_dir)).select("event_id", "book", "selection", "l_orderkey", "l_linenumber", "odds")


def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, close, low, high and count of every series."""
    return timeline.movement(odds_book(spark, sf_dir)).select("event_id", "book_id", F.col("sel_idx").cast("long").alias("sel_idx"), "open", "close", "low", "high", "prices")


def steam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of implied probability within a year before kickoff."""
    s = timeline.steam(odds_book(spark, sf_dir), lookback_days=365)
    return rounded(s, "move").select("event_id", "book_id", F.col("sel_idx").cast("long").alias("sel_idx"), "first", "last", "points", "move")


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.drift_by_bucket(odds_book(spark, sf_dir))


def series_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with at least two capture times and the last of a book's within 60 days of kickoff."""
    s = odds_book(spark, sf_dir).where("captured_at <= kickoff").groupBy("event_id", "book").agg(F.countDistinct("captured_at").alias("times"), F.max("captured_at").alias("last"), F.first("kickoff").alias("kickoff"))
    return s.where("times >= 2 AND last >= timestampadd(DAY, -60, kickoff)").select("event_id", "book", "times")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over a value by event type and hour, as batches of a source."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count_if(F.col("value") > 25).alias("fresh"))
    return e.select("source", F.date_format("hour", "yyyy-MM-dd HH").alias("batch"), "fresh")


def dead_man(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of batches without fresh rows; fires once a run, at the third."""
    return timeline.dead_man(batches(spark, sf_dir), 3).select("source", "batch", "fresh", "streak", "fires")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches from orders: sides and goals by small moduli of the keys."""
    o = table(spark, sf_dir, "orders")
    home, away = F.col("o_custkey") % 20, (F.col("o_custkey") + 1 + F.col("o_orderkey") % 19) % 20
    return o.select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("played"), home.alias("home"), away.alias("away"), (F.col("o_orderkey") % 5).alias("home_goals"), (F.col("o_custkey") % 4).alias("away_goals"))


def form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of goals over the last 5 and 10 matches strictly before each."""
    f = timeline.rolling_form(matches(spark, sf_dir))
    return rounded(f, "scored_r5", "conceded_r5", "scored_r10", "conceded_r10").select("match_id", "side", "team", "scored_r5", "conceded_r5", "scored_r10", "conceded_r10")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append without conflict: the first row of each (event, book, selection, capture time)."""
    key = ["event_id", "book", "selection", "captured_at"]
    first = odds_book(spark, sf_dir).groupBy(*key).agg(F.min(F.struct("l_orderkey", "l_linenumber", "odds")).alias("r"), F.count("*").alias("seen"))
    return first.select("event_id", "book", "selection", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "r.l_orderkey", "r.l_linenumber", "r.odds", "seen")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON read with a schema, summed by type; a missing or wrong number counts as none."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("with_k"), F.sum("p.k").alias("sum_k"), F.max("p.k").alias("max_k"))


def event_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every match as two sources have it: the same sides of a division, other spellings, kickoffs up to eight hours apart; a third of the second's leagues unknown."""
    first = F.floor(F.col("match_id") / 4) % DIVISIONS
    f = matches(spark, sf_dir).select(
        F.col("match_id").alias("ref"), F.expr("timestampadd(HOUR, CAST(match_id % 20 AS INT), played)").alias("kickoff"), (first * 20 + F.col("home")).alias("h"), (first * 20 + F.col("away")).alias("a"), F.concat(F.lit("Division "), first.cast("string")).alias("league")
    )
    numbers = f.select(F.explode(F.array("h", "a")).alias("number")).groupBy("number").agg(F.max("number").alias("one"))  # a thousand clubs; names are worked out once a club, of an aggregate, as filters on it stay behind it

    def named(names) -> DataFrame:
        clubs = numbers.withColumn("name", names(F.col("one"))).withColumn("normal", resolve.normalized(F.col("name")))
        side = lambda c, n: F.broadcast(clubs.select(F.col("number").alias(c), F.col("name").alias(f"{n}_name"), F.col("normal").alias(n)))
        return f.join(side("h", "home"), "h").join(side("a", "away"), "a").select("ref", "kickoff", "league", "home_name", "away_name", "home", "away")

    ours, theirs = named(club), named(spelled)
    return ours, theirs.withColumn("league", F.when(F.col("ref") % 3 != 0, F.upper("league"))).withColumn("kickoff", F.expr("timestampadd(HOUR, CAST(ref % 9 AS INT), kickoff)"))


def matched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures of two sources matched by likeness of names, markers, leagues and kickoffs; a women's team is not its club's first team."""
    return resolve.match_hardened(*event_sides(spark, sf_dir), days=1)


def laddered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sources' fixtures; every fourth of the first has a page whose address has the second's names."""
    ours, theirs = event_sides(spark, sf_dir)
    page = theirs.where("ref % 4 = 0").select("ref", F.col("home").alias("slug_home"), F.col("away").alias("slug_away"))
    return ours.join(page, "ref", "left"), theirs


def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fixture with the step that matched it, or its nearest miss and the reason."""
    return resolve.match_ladder(*laddered(spark, sf_dir), aliases=aliases(spark))


def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all fixtures and of each league's: how many match, how many have no candidate, and how many have some but no match."""
    ours, theirs = laddered(spark, sf_dir)
    found = resolve.match_ladder(ours, theirs, aliases=aliases(spark)).join(ours.select(F.col("ref").alias("left_ref"), "league"), "left_ref")
    missed = F.col("right_ref").isNull()
    return found.rollup("league").agg(F.count("*").alias("total"), F.count("right_ref").alias("matched"), F.count_if(missed & (F.col("candidates") == 0)).alias("no_candidates"), F.count_if(missed & (F.col("candidates") > 0)).alias("unmatched"))


def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that may be one club's, from nearest events whose other club agrees."""
    return resolve.alias_candidates(*event_sides(spark, sf_dir))


def alias_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that an import of clubs with other spellings adds to the seed, and the claims that came too late; some clubs claim another's name."""
    n = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("n")).distinct()
    groups = n.select(club(F.col("n")).alias("canonical"), F.array(spelled(F.col("n")), F.concat(club(F.col("n")), F.lit(" FC")), F.when(F.col("n") % 9 == 0, club(F.col("n") + 40)), F.when(F.col("n") % 7 == 0, F.concat(club(F.col("n") % 50), F.lit(" 1900"))), F.concat(F.lit("FC "), F.substring(club(F.col("n")), 1, 6), F.lit(" "), (F.col("n") % 3).cast("string"))).alias("aliases"))
    seed = spark.createDataFrame([(a, [b]) for a, b in NICKNAMES], "canonical string, aliases array<string>")
    new, late = resolve.imported_aliases(groups, seed)
    return new.select("alias", "canonical", F.lit(None).cast("string").alias("blocking")).unionByName(late)


#: Fixed values of the test bridge: what a club is also called.
NICKNAMES = (("Arkham Rovers", "The Rovers"), ("Bexham Town", "Bexley Town FC"), ("Corham United", "Cor United"))


def aliases(spark: SparkSession) -> DataFrame:
    return resolve.alias_table(spark.createDataFrame([(b, a) for a, b in NICKNAMES] + [("", "x"), ("FC", "y")], "alias string, canonical string"))


def strict_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures of two sources with the same canonical names within a day, the nearest kickoff, then the first ref."""
    return resolve.match_strict(*event_sides(spark, sf_dir), aliases=aliases(spark), days=1)


def unordered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where either side may stand first, as with two players."""
    ours, theirs = event_sides(spark, sf_dir)
    turned = theirs.select("ref", "kickoff", F.col("away").alias("home"), F.col("home").alias("away"))
    return resolve.match_strict(ours, turned, days=0, ordered=False)


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, markers and base of what sources call a thousand clubs and their other teams."""
    n = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("n")).distinct()
    forms = F.array(spelled(F.col("n")), F.concat(club(F.col("n")), F.lit(" B")), F.concat(club(F.col("n")), F.lit(" U19")), F.concat(club(F.col("n")), F.lit(" ladies ii")), F.lit("Boca Juniors"), F.lit("FC"))
    rows = n.select("n", F.posexplode(forms).alias("form", "name")).withColumn("normal", resolve.normalized(F.col("name")))
    return rows.select("n", F.col("form").cast("long").alias("form"), "normal", F.concat_ws(",", resolve.markers(F.col("normal"))).alias("marks"), resolve.base_name(F.col("normal")).alias("base"))


def player_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players by surname and initial, whichever way round a source writes them."""
    n = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    surname, given = club(key % 1000), F.substring(F.array(*map(F.lit, STARTS))[(key % 40).cast("int")], 1, 9)
    last = F.element_at(F.split(surname, " "), 1)
    forms = F.array(F.concat_ws(" ", given, last), F.concat(last, F.lit(" "), F.left(given, F.lit(1)), F.lit(".")), F.concat(F.left(given, F.lit(1)), F.lit(". "), last), last, F.lit(" , "), F.concat(last, F.lit(", "), F.left(given, F.lit(1))))
    rows = n.select("c_custkey", F.posexplode(forms).alias("form", "name")).select("c_custkey", F.col("form").cast("long").alias("form"), "name")
    return resolve.formed(rows, ["name"], player=text.canonical_player).select("c_custkey", "form", F.col("player_name").alias("player"))


def slug_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides out of match pages' addresses, for addresses made of the fixtures' names."""
    f = event_sides(spark, sf_dir)[0]
    slug = lambda c: F.concat(F.lower(F.replace(F.col(c), F.lit(" "), F.lit("-"))), F.lit("-AbCd1234"))
    url = F.when(F.col("ref") % 10 == 0, F.concat(F.lit("https://www.example.com/h2h/"), slug("home"), F.lit("/x"))).otherwise(F.concat(F.lit("https://www.oddsportal.com/h2h/"), slug("home"), F.lit("/"), slug("away"), F.lit("/#id")))
    return f.select("ref", resolve.slug_names(url).alias("s")).select("ref", "s.home", "s.away")


def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of fixtures by names on the day or a day off, or by the only name that contains ours."""
    ours, theirs = event_sides(spark, sf_dir)
    fixtures = ours.select("ref", text.plain(F.col("home_name")).alias("home"), text.plain(F.col("away_name")).alias("away"), "kickoff")
    played = F.date_add(F.to_date("kickoff"), (F.col("ref") % 3 - 1).cast("int"))
    rows = theirs.select(text.plain(F.col("home_name")).alias("home"), text.plain(F.col("away_name")).alias("away"), played.alias("played"), "ref")
    scores = rows.groupBy("home", "away", "played").agg((F.min("ref") % 5).alias("home_score"), (F.min("ref") % 4).alias("away_score"))
    return resolve.score_of(fixtures, scores).select("ref", "home_score", "away_score")


QUERIES = {
    "price_changes": changes, "movement": movement, "steam": steam, "drift_by_bucket": drift, "series_coverage": series_coverage, "dead_man": dead_man, "rolling_form": form,
    "observations": observations, "json_props": json_props, "matched_events": matched_events,
    "strict_matches": strict_matches, "unordered_matches": unordered_matches, "name_forms": name_forms, "player_names": player_names, "slug_pairs": slug_pairs, "score_lookup": score_lookup, "match_ladder": match_ladder, "match_rates": match_rates, "alias_candidates": alias_candidates, "alias_import": alias_import,
}
SQL_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
CLUB = f"{SQL_LIST(STARTS)}[1 + {{n}} % 40] || {SQL_LIST(ENDS)}[1 + ({{n}} // 40) % 25] || ' ' || {SQL_LIST(KINDS)}[1 + {{n}} % 8]"
SPELLED = """CASE ({n} // 8) % 8 WHEN 0 THEN upper({c}) || ' FC' WHEN 1 THEN 'AFC ' || replace({c}, ' ', '  ') WHEN 2 THEN translate({c}, 'aeo', 'áéö') WHEN 3 THEN {c} || ' C.F.' WHEN 4 THEN {c} WHEN 5 THEN {c} || ' Women'
  WHEN 6 THEN substr({c}, 2, 1) || substr({c}, 1, 1) || substr({c}, 3) ELSE translate({c}, ' ', '-') || ' SC' END"""
PLAIN = "trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"
NORMAL = f"array_to_string(list_filter(string_split({PLAIN}, ' '), lambda w: w NOT IN {tuple(resolve.CLUB_WORDS)!r}), ' ')"
#: Every match as both sources have it, names as written, plain and normal.
SIDES_CTE = f"""
fx AS (SELECT o_orderkey AS ref, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 20) AS kickoff, (o_orderkey // 4) % {DIVISIONS} * 20 + o_custkey % 20 AS h, (o_orderkey // 4) % {DIVISIONS} * 20 + (o_custkey + 1 + o_orderkey % 19) % 20 AS a FROM orders),
nm AS (SELECT n, {CLUB.format(n="n")} AS c FROM (SELECT unnest(range(0, 1000)) AS n)),
sp AS (SELECT n, c, {SPELLED.format(n="n", c="c")} AS s FROM nm),
fo AS (SELECT n, {PLAIN.format(x="c")} AS cp, {NORMAL.format(x="c")} AS cn, {PLAIN.format(x="s")} AS sp, {NORMAL.format(x="s")} AS sn FROM sp),
ours AS (SELECT ref, kickoff, x.cp AS hp, y.cp AS ap, x.cn AS home, y.cn AS away FROM fx JOIN fo x ON h = x.n JOIN fo y ON a = y.n),
theirs AS (SELECT ref, kickoff + INTERVAL 1 HOUR * (ref % 9) AS kickoff, x.sp AS hp, y.sp AS ap, x.sn AS home, y.sn AS away FROM fx JOIN fo x ON h = x.n JOIN fo y ON a = y.n),
"""
MARKS = "concat_ws(',', CASE WHEN list_has_any(w, ['ii', 'iii', 'reserve', 'reserves']) OR (len(w) >= 2 AND w[-1] IN ('2', '3', 'b')) THEN 'reserve' END, CASE WHEN list_has_any(w, ['w', 'women', 'ladies']) THEN 'women' END, CASE WHEN list_has_any(w, ['u19', 'youth']) THEN 'youth' END)"
SERIES = "PARTITION BY event_id, book_id, sel_idx ORDER BY captured_at, l_orderkey, l_linenumber"
FIRST_LAST = "first_value(odds) OVER w AS first, last_value(odds) OVER w AS last"
HOURS = "date_diff('hour', captured_at, kickoff)"
FORM = ", ".join(f"round(avg({c}) OVER (PARTITION BY team ORDER BY played, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS {c}_r{n}" for n in (5, 10) for c in ("scored", "conceded"))
ORACLES = {
    "price_changes": f"WITH {BOOK_CTE} c AS (SELECT *, lag(odds) OVER ({SERIES}) AS before FROM book) SELECT event_id, book, selection, l_orderkey, l_linenumber, odds FROM c WHERE before IS NULL OR before <> odds",
    "movement": f"""WITH {BOOK_CTE} c AS (SELECT *, {FIRST_LAST} FROM book WHERE captured_at <= kickoff WINDOW w AS ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      SELECT event_id, book_id, sel_idx, min(first) AS open, min(last) AS close, min(odds) AS low, max(odds) AS high, count(*) AS prices FROM c GROUP BY event_id, book_id, sel_idx""",
    "steam": f"""WITH {BOOK_CTE} c AS (SELECT *, {FIRST_LAST} FROM book WHERE captured_at <= kickoff AND captured_at >= kickoff - INTERVAL 365 DAY AND odds > 1 WINDOW w AS ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      SELECT event_id, book_id, sel_idx, min(first) AS first, min(last) AS last, count(*) AS points, round(1 / min(last) - 1 / min(first), 6) AS move FROM c GROUP BY event_id, book_id, sel_idx HAVING count(*) >= 2""",
    "drift_by_bucket": f"""WITH {BOOK_CTE} c AS (SELECT *, last_value(odds) OVER w AS close, row_number() OVER w2 AS back FROM book WHERE captured_at <= kickoff
        WINDOW w AS ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), w2 AS (PARTITION BY event_id, book_id, sel_idx ORDER BY captured_at DESC, l_orderkey DESC, l_linenumber DESC))
      SELECT CASE WHEN {HOURS} < 1 THEN '<1h' WHEN {HOURS} < 5 THEN '1-5h' WHEN {HOURS} < 24 THEN '5-24h' WHEN {HOURS} < 48 THEN '24-48h' ELSE '>48h' END AS bucket, count(*) AS n, round(avg(ln(close / odds)), 6) AS drift FROM c WHERE back > 1 GROUP BY 1""",
    "series_coverage": f"""WITH {BOOK_CTE} s AS (SELECT event_id, book, count(DISTINCT captured_at) AS times, max(captured_at) AS last, min(kickoff) AS kickoff FROM book WHERE captured_at <= kickoff GROUP BY event_id, book)
      SELECT event_id, book, times FROM s WHERE times >= 2 AND last >= kickoff - INTERVAL 60 DAY""",
    "dead_man": """WITH b AS (SELECT event_type AS source, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS batch, count(*) FILTER (value > 25) AS fresh FROM events GROUP BY ALL),
      r AS (SELECT *, sum(CASE WHEN fresh > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY batch) AS run FROM b),
      s AS (SELECT *, CASE WHEN fresh > 0 THEN 0 ELSE sum(CASE WHEN fresh > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source, run ORDER BY batch) END AS streak FROM r)
      SELECT source, batch, fresh, CAST(streak AS BIGINT) AS streak, streak = 3 AS fires FROM s""",
    "rolling_form": f"""WITH m AS (SELECT o_orderkey AS match_id, o_orderdate AS played, o_custkey % 20 AS home, (o_custkey + 1 + o_orderkey % 19) % 20 AS away, o_orderkey % 5 AS hg, o_custkey % 4 AS ag FROM orders),
      l AS (SELECT match_id, played, 'home' AS side, home AS team, hg AS scored, ag AS conceded FROM m UNION ALL SELECT match_id, played, 'away', away, ag, hg FROM m) SELECT match_id, side, team, {FORM} FROM l""",
    "observations": f"""WITH {BOOK_CTE} n AS (SELECT *, row_number() OVER (PARTITION BY event_id, book, selection, captured_at ORDER BY l_orderkey, l_linenumber) AS rk, count(*) OVER (PARTITION BY event_id, book, selection, captured_at) AS seen FROM book)
      SELECT event_id, book, selection, strftime(captured_at, '%Y-%m-%d') AS day, l_orderkey, l_linenumber, odds, seen FROM n WHERE rk = 1""",
    "json_props": "SELECT event_type, count(*) AS n, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM (SELECT event_type, try_cast(props ->> '$.k' AS INTEGER) AS k FROM events) GROUP BY event_type",
    "strict_matches": f"""WITH {SIDES_CTE} al AS (SELECT unnest(['the rovers', 'bexley town', 'cor united']) AS alias, unnest(['arkham rovers', 'bexham town', 'corham united']) AS canon),
      l AS (SELECT ref, kickoff, coalesce(x.canon, home) AS home, coalesce(y.canon, away) AS away FROM ours LEFT JOIN al x ON home = x.alias LEFT JOIN al y ON away = y.alias), r AS (SELECT ref, kickoff, coalesce(x.canon, home) AS home, coalesce(y.canon, away) AS away FROM theirs LEFT JOIN al x ON home = x.alias LEFT JOIN al y ON away = y.alias)
      SELECT left_ref, right_ref FROM (SELECT l.ref AS left_ref, r.ref AS right_ref, row_number() OVER (PARTITION BY l.ref ORDER BY abs(epoch_us(l.kickoff) - epoch_us(r.kickoff)), r.ref) AS rk FROM l JOIN r ON l.home = r.home AND l.away = r.away AND abs(date_diff('day', l.kickoff::DATE, r.kickoff::DATE)) <= 1 WHERE l.home <> l.away AND l.home <> '' AND l.away <> '') WHERE rk = 1""",
    "unordered_matches": f"""WITH {SIDES_CTE} l AS (SELECT ref, kickoff, least(home, away) AS x, greatest(home, away) AS y FROM ours WHERE home <> away), r AS (SELECT ref, kickoff, least(home, away) AS x, greatest(home, away) AS y FROM theirs WHERE home <> away)
      SELECT left_ref, right_ref FROM (SELECT l.ref AS left_ref, r.ref AS right_ref, row_number() OVER (PARTITION BY l.ref ORDER BY abs(epoch_us(l.kickoff) - epoch_us(r.kickoff)), r.ref) AS rk FROM l JOIN r ON l.x = r.x AND l.y = r.y AND l.kickoff::DATE = r.kickoff::DATE) WHERE rk = 1""",
    "name_forms": f"""WITH {SIDES_CTE} k AS (SELECT DISTINCT o_orderkey % 1000 AS n FROM orders), f AS (SELECT k.n, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS form, unnest([s, c || ' B', c || ' U19', c || ' ladies ii', 'Boca Juniors', 'FC']) AS name FROM k JOIN sp ON k.n = sp.n),
      m AS (SELECT n, form, {NORMAL.format(x="name")} AS normal FROM f), v AS (SELECT *, list_filter(string_split(normal, ' '), lambda x: x <> '') AS w FROM m)
      SELECT n, form, normal, {MARKS} AS marks, CASE WHEN normal = 'boca juniors' THEN normal ELSE coalesce(nullif(array_to_string(list_filter(CASE WHEN len(w) >= 2 AND w[-1] IN ('2', '3', 'b') THEN w[:-2] ELSE w END, lambda x: x NOT IN ('ii', 'iii', 'reserve', 'reserves', 'w', 'women', 'ladies', 'u19', 'youth')), ' '), ''), normal) END AS base FROM v""",
    "player_names": f"""WITH c AS (SELECT c_custkey, lower({SQL_LIST(STARTS)}[1 + c_custkey % 40] || {SQL_LIST(ENDS)}[1 + (c_custkey // 40) % 25]) AS last, lower({SQL_LIST(STARTS)}[1 + c_custkey % 40][1:1]) AS i FROM (SELECT c_custkey FROM customer)),
      d AS (SELECT c_custkey, i, lower({SQL_LIST(STARTS)}[1 + (c_custkey % 1000) % 40] || {SQL_LIST(ENDS)}[1 + ((c_custkey % 1000) // 40) % 25]) AS last FROM c)
      SELECT c_custkey, form, CASE form WHEN 3 THEN last WHEN 4 THEN '' ELSE last || ' ' || i END AS player FROM d, (SELECT unnest([0, 1, 2, 3, 4, 5])::BIGINT AS form)""",
    "slug_pairs": f"WITH {SIDES_CTE} done AS (SELECT 1) SELECT ref, CASE WHEN ref % 10 <> 0 THEN home END AS home, CASE WHEN ref % 10 <> 0 THEN away END AS away FROM ours",
    "score_lookup": f"""WITH {SIDES_CTE} r AS (SELECT hp, ap, home, away, kickoff::DATE + CAST(ref % 3 - 1 AS INTEGER) AS played, min(ref) AS ref FROM theirs GROUP BY ALL), sc AS (SELECT *, ref % 5 AS home_score, ref % 4 AS away_score FROM r),
      p AS (SELECT o.ref, s.home_score, s.away_score, o.hp = s.hp AND o.ap = s.ap AS exact, CASE date_diff('day', o.kickoff::DATE, s.played) WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS turn,
              list_has_any(string_split(s.home, ' '), ['women']) = list_has_any(string_split(o.home, ' '), ['women']) AND list_has_any(string_split(s.away, ' '), ['women']) = list_has_any(string_split(o.away, ' '), ['women']) AS marked
            FROM ours o JOIN sc s ON s.played BETWEEN o.kickoff::DATE - 1 AND o.kickoff::DATE + 1 AND (contains(o.hp, s.hp) OR contains(s.hp, o.hp)) AND (contains(o.ap, s.ap) OR contains(s.ap, o.ap))),
      e AS (SELECT ref, arg_min({{'h': home_score, 'a': away_score}}, turn) AS s FROM p WHERE exact GROUP BY ref), n AS (SELECT ref, any_value({{'h': home_score, 'a': away_score}}) AS s FROM p WHERE marked AND ref NOT IN (SELECT ref FROM e) GROUP BY ref HAVING count(*) = 1)
      SELECT o.ref, coalesce(e.s, n.s).h AS home_score, coalesce(e.s, n.s).a AS away_score FROM ours o LEFT JOIN e ON o.ref = e.ref LEFT JOIN n ON o.ref = n.ref""",
}
