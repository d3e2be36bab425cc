"""Season tables, grids and series of other sources as DataFrames. A reader takes a path; what parses takes rows, so files, streams and tests share it."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.functions.odds import parsed_odds
from fairline.sources.parsers import HOURS, american, played_on, whole

#: Columns of a new-league table and of a tennis table, and of a headerless football table; bookmakers of an odds matrix.
NEW_LEAGUE = {"sharp_close": "PSC", "best_close": "MaxC", "mean_close": "AvgC"}
TENNIS = {"sharp": "PS", "best": "Max", "mean": "Avg"}
HEADERLESS = ("source", "country", "league", "home", "away", "h1", "a1", "half", "home_score", "away_score", "played", "sharp_h", "sharp_d", "sharp_a")
BOOKS = 32


def given(df: DataFrame, name: str) -> Column:
    """A column, or nulls where the file has none."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def named(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def result_of(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def new_league_matches(raw: DataFrame) -> DataFrame:
    """Matches of leagues whose tables have closing prices alone: the early price is null."""
    rows = raw.select(
        played_on(given(raw, "Date")).alias("played"), named(given(raw, "Home")).alias("home"), named(given(raw, "Away")).alias("away"), whole(given(raw, "HG")).alias("home_goals"), whole(given(raw, "AG")).alias("away_goals"), given(raw, "Res").alias("result"),
        *(parsed_odds(given(raw, theirs + s)).alias(f"{ours}_{s.lower()}") for ours, theirs in NEW_LEAGUE.items() for s in "HDA"), *(F.lit(None).cast("double").alias(f"soft_{s}") for s in "hda"),
    )
    return rows.dropna(subset=["played", "home", "away", "home_goals", "away_goals"])


def average_matches(raw: DataFrame) -> DataFrame:
    """Matches with mean and best closing prices of all three results; incomplete ones are left out."""
    price = lambda kind, side: parsed_odds(given(raw, f"{kind}_odds_{side}"))
    rows = raw.select(
        given(raw, "league").alias("league"), F.to_date(given(raw, "match_date").try_cast("timestamp")).alias("played"), given(raw, "home_score").try_cast("double").cast("int").alias("home_goals"), given(raw, "away_score").try_cast("double").cast("int").alias("away_goals"),
        *(price(k, side).alias(f"{k}_{s}") for k in ("avg", "max") for s, side in (("h", "home_win"), ("d", "draw"), ("a", "away_win"))),
    )
    return rows.dropna().withColumn("result", result_of(F.col("home_goals"), F.col("away_goals")))


def tennis_matches(raw: DataFrame) -> DataFrame:
    """Winner and loser with prices; without a player or a date there is no match. completed: neither retired nor walked over."""
    rows = raw.select(
        F.coalesce(played_on(given(raw, "Date")), F.to_date(given(raw, "Date").try_cast("timestamp"))).alias("played"), *(named(given(raw, c)).alias(c.lower()) for c in ("Tournament", "Surface", "Round", "Winner", "Loser")),
        (F.lower(F.trim(F.coalesce(given(raw, "Comment"), F.lit("")))) == "completed").alias("completed"), *(parsed_odds(given(raw, theirs + s)).alias(f"{ours}_{s.lower()}") for ours, theirs in TENNIS.items() for s in "WL"),
    )
    return rows.dropna(subset=["winner", "loser", "played"])


def two_sided(matches: DataFrame, seed: int = 7) -> DataFrame:
    """Tennis matches with sides in an order that does not give the winner away: a coin that follows from the match. result: the winner's side, 0 or 1."""
    swap = F.pmod(F.xxhash64("played", F.least("winner", "loser"), F.greatest("winner", "loser"), F.lit(seed)), F.lit(2)) == 1
    pair = lambda w, l: F.when(swap, F.array(l, w)).otherwise(F.array(w, l))  # noqa: E731, E741
    priced = matches.where("completed AND sharp_w IS NOT NULL AND sharp_l IS NOT NULL AND best_w IS NOT NULL AND best_l IS NOT NULL")
    return priced.select("played", pair(F.col("winner"), F.col("loser")).alias("players"), pair(F.col("sharp_w"), F.col("sharp_l")).alias("sharp"), pair(F.col("best_w"), F.col("best_l")).alias("best"), F.when(swap, 1).otherwise(0).alias("result"))


def international(raw: DataFrame) -> DataFrame:
    """Internationals, played or not: scores are null until they are numbers."""
    text = lambda c: F.trim(F.coalesce(given(raw, c), F.lit("")))
    goals = lambda c: F.when(text(c).rlike(r"^\d+$"), text(c).try_cast("int"))
    return raw.select(
        F.to_date(F.try_to_timestamp(text("date"), F.lit("yyyy-MM-dd"))).alias("played"), text("home_team").alias("home"), text("away_team").alias("away"), goals("home_score").alias("home_goals"), goals("away_score").alias("away_goals"),
        text("tournament").alias("tournament"), (F.upper(text("neutral")) == "TRUE").alias("neutral"), text("home_score").isin("", "NA").alias("open"),
    )


def international_results(raw: DataFrame) -> DataFrame:
    """Completed matches with their result; friendly rows of other sources have no prices."""
    m = international(raw).where("played IS NOT NULL AND home_goals IS NOT NULL AND away_goals IS NOT NULL")
    return m.withColumn("result", result_of(F.col("home_goals"), F.col("away_goals"))).drop("open")


def international_fixtures(raw: DataFrame, tournament: str, since: Column | None = None) -> DataFrame:
    """Matches of a tournament that are not played yet."""
    m = international(raw).where((F.col("tournament") == tournament) & F.col("open") & F.col("played").isNotNull() & (F.col("home") != "") & (F.col("away") != ""))
    return (m if since is None else m.where(F.col("played") >= since)).select("played", "home", "away", "tournament", "neutral")


def gridiron_games(raw: DataFrame) -> DataFrame:
    """Scheduled games with their kickoff from the day and the time in New York; those without a kickoff are left out."""
    local = F.try_to_timestamp(F.concat_ws(" ", given(raw, "gameday"), given(raw, "gametime")), F.lit("yyyy-MM-dd HH:mm"))
    number = lambda c, t: F.nanvl(given(raw, c).try_cast("double"), F.lit(None).cast("double")).cast(t).alias(c)
    rows = raw.select(
        given(raw, "game_id").alias("game_id"), given(raw, "season").try_cast("int").alias("season"), given(raw, "week").try_cast("int").alias("week"), F.to_utc_timestamp(local, "America/New_York").alias("kickoff"), given(raw, "home_team").alias("home"), given(raw, "away_team").alias("away"),
        *(number(c, t) for c, t in (("home_score", "int"), ("away_score", "int"), ("spread_line", "double"), ("total_line", "double"), ("home_moneyline", "int"), ("away_moneyline", "int"))),
    )
    return rows.where("kickoff IS NOT NULL")


def headerless_matches(raw: DataFrame) -> DataFrame:
    """Matches of a table without a header, by position; they need the sharp prices, scores and a date."""
    cells = [F.nullif(F.col(c), F.lit("NULL")) for c in raw.columns[: len(HEADERLESS)]]
    if len(cells) < len(HEADERLESS):
        return raw.sparkSession.createDataFrame([], "country string, league string, home string, away string, home_score int, away_score int, played date, sharp_h double, sharp_d double, sharp_a double")
    rows = raw.select(*(c.alias(n) for c, n in zip(cells, HEADERLESS, strict=True)))
    number = lambda c: F.col(c).try_cast("double")
    return rows.select("country", "league", "home", "away", number("home_score").cast("int").alias("home_score"), number("away_score").cast("int").alias("away_score"), F.to_date(F.try_to_timestamp("played", F.lit("yyyy-MM-dd"))).alias("played"), *(number(f"sharp_{s}").alias(f"sharp_{s}") for s in "hda")).dropna()


def match_file(name: Column) -> Column:
    """(match_id, kickoff, home_score, away_score) of a series file's name, null for any other."""
    p = r"match_(\d+)_(\d+_\d+_\d+_\d+_\d+_\d+)_(\d+)_(\d+)\.txt$"
    part = lambda i: F.regexp_extract(name, p, i)
    kickoff = F.try_to_timestamp(part(2), F.lit("y_M_d_H_m_s"))
    return F.when(kickoff.isNotNull(), F.struct(part(1).try_cast("long").alias("match_id"), kickoff.alias("kickoff"), part(3).try_cast("int").alias("home_score"), part(4).try_cast("int").alias("away_score")))


def matrix_cells(texts: DataFrame) -> DataFrame:
    """(match_id, book, prices): the first BOOKS filled lines of a matrix, each with the prices of home, then draw, then away by hour; what is no price over 1 is null, short lines end in nulls."""
    filled = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    lines = texts.select("match_id", F.posexplode(F.slice(filled, 1, BOOKS)).alias("book", "line")).withColumn("c", F.split("line", ","))
    price = lambda i: parsed_odds(F.trim(F.get("c", i)))
    return lines.select("match_id", "book", F.transform(F.sequence(F.lit(0), F.lit(3 * HOURS - 1)), price).alias("prices"))


def series_matches(texts: DataFrame) -> DataFrame:
    """Per match the mean and best price of each result at every book's first and last hour with all three, and how many books; a match without any has no row. texts: match_id, text."""
    cells = matrix_cells(texts)
    triple = lambda h: F.array(*(F.get("prices", h + i * HOURS) for i in range(3)))
    whole_hours = F.filter(F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), triple), lambda t: ~F.exists(t, lambda x: x.isNull()))
    ends = cells.withColumn("q", whole_hours).where(F.size("q") > 0).select("match_id", F.get("q", 0).alias("open"), F.element_at("q", -1).alias("close"))
    stats = [f(F.get(end, i)).alias(f"{end}_{n}_{s}") for end in ("open", "close") for n, f in (("mean", F.avg), ("best", F.max)) for i, s in enumerate("hda")]
    return ends.groupBy("match_id").agg(*stats, F.count("*").alias("books"))


def series_files(spark: SparkSession, path: str) -> DataFrame:
    """Matches of a folder of series files, with id, kickoff and score from the file's name."""
    raw = spark.read.text(path, wholetext=True).select(match_file(F.col("_metadata.file_path")).alias("m"), F.col("value").alias("text")).where("m IS NOT NULL").select("m.*", "text")
    out = series_matches(raw).join(raw.drop("text"), "match_id")
    return out.withColumn("result", result_of(F.col("home_score"), F.col("away_score")))


def series_table(spark: SparkSession, odds: str, matches: str) -> DataFrame:
    """The same from a table of prices (match_id, text), gzipped or not, and one of matches (match_id, date, score "h-a", league)."""
    info = spark.read.csv(matches, header=True)
    score = lambda i: F.regexp_extract(F.trim("score"), r"^(\d+)\s*-\s*(\d+)$", i).try_cast("int")
    meta = info.select(F.col("match_id").try_cast("long").alias("match_id"), F.col("date").try_cast("timestamp").alias("kickoff"), score(1).alias("home_score"), score(2).alias("away_score"), F.col("league"))
    texts = spark.read.csv(odds, header=True, multiLine=True, escape='"').select(F.col("match_id").try_cast("long").alias("match_id"), "text")
    return series_matches(texts).join(meta.where("home_score IS NOT NULL AND kickoff IS NOT NULL"), "match_id").withColumn("result", result_of(F.col("home_score"), F.col("away_score")))


def wide_rows(series: DataFrame) -> DataFrame:
    """Series matches in the columns of a season's table: the mean stands in for the sharp price."""
    names = {"open_mean": "PS", "open_best": "Max", "close_mean": "PSC", "close_best": "MaxC"}
    return series.select("match_id", F.to_date("kickoff").alias("Date"), F.col("home_score").alias("FTHG"), F.col("away_score").alias("FTAG"), F.col("result").alias("FTR"), *(F.round(F.col(f"{n}_{s.lower()}"), 6).alias(f"{t}{s}") for n, t in names.items() for s in "HDA"))


def game_day(mmdd: Column, season: Column) -> Column:
    """A month and day of a season, which turns its year in August; null if there is no such day."""
    text = F.regexp_replace(F.trim(mmdd.cast("string")), r"\.0$", "")
    padded = F.lpad(text, 4, "0")
    month = F.left(padded, F.lit(2)).try_cast("int")
    year = F.when(month >= 8, season).otherwise(season + 1)
    return F.when(text.rlike(r"^\d{3,4}$"), F.to_date(F.try_to_timestamp(F.concat(year.cast("string"), padded), F.lit("yyyyMMdd"))))


def spread_cell(c: Column) -> Column:
    """A number of points; "pk" is none, other text null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("pk", "p"), 0.0).otherwise(t.try_cast("double"))


def grid_games(rows: DataFrame) -> DataFrame:
    """Games of grids with a visitor's and a home row each, one after another.

    rows: grid (a file or sheet), line (position in it), season, cells (array of at least 13 texts). Rows are
    paired within their grid; pairs that are not V and H, without scores or tied are left out. The smaller opening number
    is the spread, which the favourite gives; the larger is the total.
    """
    body = rows.where((F.size("cells") >= 13) & ~F.lower(F.trim(F.get("cells", 0))).isin("date", ""))
    w = Window.partitionBy("grid").orderBy("line")
    pairs = body.withColumn("i", F.row_number().over(w)).withColumn("h", F.lead("cells").over(w)).where("i % 2 = 1 AND h IS NOT NULL")
    away, home = (lambda i: F.get("cells", i)), (lambda i: F.get("h", i))
    score = lambda c: F.regexp_replace(F.trim(c), r"\.0$", "").try_cast("int")
    us = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+(\.0)?$"), F.trim(c).try_cast("double").cast("int"))
    p = pairs.where((F.upper(F.trim(away(2))) == "V") & (F.upper(F.trim(home(2))) == "H")).select(
        "grid", "season", game_day(away(0), F.col("season")).alias("played"), F.trim(away(3)).alias("away"), F.trim(home(3)).alias("home"), score(away(8)).alias("away_final"), score(home(8)).alias("home_final"),
        us(away(11)).alias("away_us"), us(home(11)).alias("home_us"), spread_cell(away(9)).alias("ao"), spread_cell(home(9)).alias("ho"), spread_cell(away(10)).alias("ac"), spread_cell(home(10)).alias("hc"),
    ).where("played IS NOT NULL AND away_final <> home_final")
    favourite = F.when(F.col("home_us").isNotNull() & F.col("away_us").isNotNull(), F.col("home_us") < F.col("away_us")).otherwise(F.coalesce(F.col("ho") <= F.col("ao"), F.lit(False)))
    both = F.col("ho").isNotNull() & F.col("ao").isNotNull()
    small = F.col("ho") <= F.col("ao")
    spread = lambda h, a: F.when(both, F.abs(F.when(small, F.col(h)).otherwise(F.col(a))) * F.when(favourite, -1.0).otherwise(1.0))
    total = lambda h, a: F.when(both, F.when(small, F.col(a)).otherwise(F.col(h)))
    return p.select(
        "grid", "season", "played", "away", "home", "away_final", "home_final", F.when(F.col("home_final") > F.col("away_final"), "H").otherwise("A").alias("result"), "away_us", "home_us", american(F.col("away_us")).alias("away_ml"), american(F.col("home_us")).alias("home_ml"),
        spread("ho", "ao").alias("home_open_spread"), (-spread("ho", "ao")).alias("away_open_spread"), spread("hc", "ac").alias("home_close_spread"), (-spread("hc", "ac")).alias("away_close_spread"), total("ho", "ao").alias("open_total"), total("hc", "ac").alias("close_total"),
    )


def grid_rows(spark: SparkSession, path: str, season: int) -> DataFrame:
    """Rows of a folder's grids: comma-separated files, or the first table of web pages."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("grid"), "value")
    is_page = F.col("grid").rlike(r"\.html?$")
    table = F.regexp_extract("value", r"(?is)<table[^>]*>(.*?)</table>", 1)
    page_rows = F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", ""))))
    plain_rows = F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, ","))
    return files.select("grid", F.posexplode(F.when(is_page, page_rows).otherwise(plain_rows)).alias("line", "cells"), F.lit(season).alias("season"))


def total_result(home: Column, away: Column, line: Column) -> Column:
    """over, under or push of a game's points, null for numbers that can't be."""
    sane = line.between(100, 400) & (home + away).between(80, 400)
    return F.when(sane, F.when(home + away > line, "over").when(home + away < line, "under").otherwise("push"))
