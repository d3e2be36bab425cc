"""Outcomes, profit and closing value of picks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.odds import effective_odds


def settle_h2h(selection: Column, home: Column, away: Column) -> Column:
    result = F.when(home > away, "home").when(home < away, "away").otherwise("draw")
    return F.when(home.isNull() | away.isNull(), None).when(selection == result, "won").otherwise("lost")


def settle_totals(side: Column, line: Column, home: Column, away: Column) -> Column:
    """over or under a line; equal is a push."""
    margin = F.when(side == "over", home + away - line).otherwise(line - home - away)
    return component(margin)


def settle_both_score(yes: Column, home: Column, away: Column) -> Column:
    return F.when(((home > 0) & (away > 0)) == yes, "won").otherwise("lost")


def settle_draw_no_bet(selection: Column, home: Column, away: Column) -> Column:
    return F.when(home == away, "push").otherwise(settle_h2h(selection, home, away))


def settle_double_chance(selection: Column, home: Column, away: Column) -> Column:
    """1X, X2 or 12."""
    mark = F.when(home > away, "1").when(home < away, "2").otherwise("X")
    return F.when(F.contains(selection, mark), "won").otherwise("lost")


def component(margin: Column) -> Column:
    return F.when(margin > 0, "won").when(margin == 0, "push").otherwise("lost")


def settle_handicap(side: Column, line: Column, home: Column, away: Column) -> Column:
    """A quarter line is two half stakes; a tie on a whole line alone loses, as the European form has it."""
    margin = F.when(side == "home", home - away).otherwise(away - home) + line
    quarter = F.abs(line * 4) % 2 == 1
    a, b = component(margin - 0.25), component(margin + 0.25)
    split = F.when((a == "won") & (b == "won"), "won").when((a == "lost") & (b == "lost"), "lost").when((a == "won") | (b == "won"), "half_won").otherwise("half_lost")
    return F.when(quarter, split).when(margin > 0, "won").otherwise("lost")


def pick_pnl(outcome: Column, stake: Column, odds: Column) -> Column:
    """Profit to the cent, half to even, in decimals."""
    stake, win = stake.cast("decimal(12,2)"), odds.cast("decimal(10,4)") - 1
    gain = F.when(outcome == "won", stake * win).when(outcome == "half_won", stake * win / 2).when(outcome == "half_lost", -stake / 2).when(outcome == "lost", -stake).otherwise(F.lit(0))
    return F.bround(gain, 2).cast("double")


def pick_roi(pnl: Column, stake: Column) -> Column:
    return F.when(stake != 0, pnl / stake)


def tautological(clv: Column, closing_fair: Column, fill: Column) -> Column:
    """A close that only repeats the fill's own price."""
    return F.abs(closing_fair - 1 / fill) <= 1e-9


def close_independent(close_book: Column, fill_book: Column, anchor_book: Column) -> Column:
    """A consensus or unnamed close is independent; the fill's or the anchor's own book is not."""
    named = F.coalesce(F.lower(F.trim(close_book)), F.lit(""))
    return (named == "") | named.startswith("consensus") | ((named != F.lower(F.trim(fill_book))) & (named != F.coalesce(F.lower(F.trim(anchor_book)), F.lit(""))))


def settled(picks: DataFrame, finals: DataFrame, stake: float = 10.0) -> DataFrame:
    """Picks with outcome and pnl by the final scores; those without a score stay open."""
    found = picks.join(finals, "event_id", "left").withColumn("outcome", settle_h2h(F.col("selection"), F.col("home_score"), F.col("away_score")))
    return found.withColumn("stake", F.lit(stake)).withColumn("pnl", F.when(F.col("outcome").isNotNull(), pick_pnl(F.col("outcome"), F.col("stake"), F.col("odds"))))


def bankroll_path(settled: DataFrame, starting: float, order: list[str], by: list[str]) -> DataFrame:
    """Running bankroll, its peak and the drawdown of each series."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    path = settled.withColumn("bankroll", starting + F.sum("pnl").over(w))
    path = path.withColumn("peak", F.greatest(F.lit(starting), F.max("bankroll").over(w)))
    return path.withColumn("drawdown", (F.col("peak") - F.col("bankroll")) / F.col("peak"))


def reserved_exposure(requests: DataFrame, *, day_cap: float, order: list[str], by: list[str]) -> DataFrame:
    """Grants in order under a daily cap: what of a request fits in the room that the ones before left."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.least(F.coalesce(F.sum("fraction").over(before), F.lit(0.0)), F.lit(day_cap))
    return requests.withColumn("granted", F.greatest(F.lit(0.0), F.least(F.col("fraction"), F.lit(day_cap) - used)))


def settle_selection(family: Column, selection: Column, home: Column, away: Column, home_score: Column, away_score: Column) -> Column:
    """Outcome of a selection's text under its market; null if it can't be read or the score is missing, never a guess."""
    won = lambda c: F.when(c, "won").otherwise("lost")
    side = F.when(selection == home, "home").when(selection == away, "away")
    h2h = F.when(side == "home", won(home_score > away_score)).when(side == "away", won(away_score > home_score)).when(selection == "Draw", won(home_score == away_score))
    over = F.regexp_extract(selection, r"^(Over|Under) \d+(?:\.\d+)?$", 1)
    totals = F.when(over != "", settle_totals(F.lower(over), F.regexp_extract(selection, r"([\d.]+)$", 1).try_cast("double"), home_score, away_score))
    both = F.when(selection.isin("BTTS Yes", "BTTS No"), settle_both_score(selection == "BTTS Yes", home_score, away_score))
    dnb = F.when(side.isNotNull(), settle_draw_no_bet(side, home_score, away_score))
    named = lambda a, b: selection == F.concat_ws(" or ", a, b)
    draw = F.lit("Draw")
    chance = F.when(named(home, draw), won(home_score >= away_score)).when(named(home, away), won(home_score != away_score)).when(named(draw, away), won(away_score >= home_score))
    tie_line = F.regexp_extract(selection, r"^Draw \(([+-]?\d+(?:\.\d+)?)\)$", 1)
    line = F.regexp_extract(selection, r"^.* ([+-]\d+(?:\.\d+)?)$", 1)
    team = F.regexp_extract(selection, r"^(.*) [+-]\d+(?:\.\d+)?$", 1)
    number = lambda text: text.try_cast("double")
    spread = F.when(tie_line != "", won(home_score + number(tie_line) == away_score)).when((line != "") & ((team == home) | (team == away)), settle_handicap(F.when(team == home, "home").otherwise("away"), number(line), home_score, away_score))
    known = home_score.isNotNull() & away_score.isNotNull() & (home_score >= 0) & (away_score >= 0)
    by_family = F.when(family == "h2h", h2h).when(family == "totals", totals).when(family == "btts", both).when(family == "dnb", dnb).when(family == "double_chance", chance).when(family == "spreads", spread)
    return F.when(known, by_family)


def settlement_step(
    picks: DataFrame, now: Column, *, delay: str = "2 hours", no_kickoff_days: int = 14, no_score_days: int = 15,
) -> DataFrame:
    """Open picks with outcome, pnl and roi after one cycle.

    picks: created_at, kickoff, family, selection, home, away, home_score, away_score, stake, odds. A
    pick is settled once its kickoff is past by the delay; without a kickoff, or without a score that
    settles it, it is void after some days; the others stay open with a null outcome.
    """
    outcome = settle_selection(*(F.col(c) for c in ("family", "selection", "home", "away", "home_score", "away_score")))
    due = F.col("kickoff") <= now - F.expr(f"INTERVAL {delay}")
    void = F.col("kickoff").isNull() & (F.col("created_at") <= now - F.expr(f"INTERVAL {no_kickoff_days} days")) | (F.col("kickoff") <= now - F.expr(f"INTERVAL {no_score_days} days"))
    done = picks.withColumn("outcome", F.coalesce(F.when(due, outcome), F.when(void, "void")))
    done = done.withColumn("pnl", F.when(F.col("outcome").isNotNull(), pick_pnl(F.col("outcome"), F.col("stake"), F.col("odds"))))
    return done.withColumn("roi", pick_roi(F.col("pnl"), F.col("stake")))


def stake_and_odds(picks: DataFrame, logs: DataFrame) -> DataFrame:
    """picks with the stake and odds of the latest manual log that has a stake, else their own. logs: pick_id, log_id, stake, odds."""
    last = logs.where("stake IS NOT NULL").groupBy("pick_id").agg(F.max_by(F.struct("stake", "odds"), "log_id").alias("m"))
    return picks.join(last, "pick_id", "left").withColumns({"stake": F.coalesce("m.stake", "stake"), "odds": F.coalesce("m.odds", "odds")}).drop("m")


#: By how much a close must differ from the pick's fair chance, and what a close can't exceed. Fixed values.
MOVED, CLOSE_EDGE, CLOSE_LOG = 1e-3, 0.20, 0.5


def independent_close(close_book: Column, fill_book: Column, pick_type: Column, close_type: Column, pick_book: Column) -> Column:
    """Whether a close was priced by another source than the pick's: not by the fill's book, nor by the pick's anchor (its book if known, else its type)."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    free = (norm(close_book) == "") | (norm(close_book) == "consensus")
    named = (norm(pick_book) != "") & (norm(pick_book) != "consensus")
    same_type = (norm(pick_type) != "") & (norm(pick_type) == norm(close_type))
    return F.when(free, True).when(norm(close_book) == norm(fill_book), False).when(named, norm(pick_book) != norm(close_book)).otherwise(~same_type)


def close_moved(pick_fair: Column, close_fair: Column) -> Column:
    """Whether the close is another number than the pick's; an unknown one proves nothing."""
    return F.coalesce(F.abs(close_fair - pick_fair) > MOVED, F.lit(False))


def kept_independent(close_book: Column, fill_book: Column, pick_fair: Column, close_fair: Column) -> Column:
    """What is stored with a pick: another book than the fill's, and a moved price."""
    none = F.lit(None).cast("string")
    return independent_close(close_book, fill_book, none, none, none) & close_moved(pick_fair, close_fair)


def tautological_close(clv: Column, close_fair: Column, pick_fair: Column) -> Column:
    """A close that provably is the pick's own number."""
    return F.coalesce(clv.isNotNull() & (F.abs(close_fair - pick_fair) <= MOVED), F.lit(False))


def fabricated_close(clv: Column, odds: Column, close_fair: Column) -> Column:
    """A close whose edge or whose log value can't be real."""
    return F.coalesce(clv.isNotNull() & (F.coalesce(close_fair - 1 / odds > CLOSE_EDGE, F.lit(False)) | (F.abs(clv) > CLOSE_LOG)), F.lit(False))


def asymmetric_fallback(mint: Column, close: Column) -> Column:
    """Whether one of the two fair chances alone fell back; an unknown one counts as equal."""
    return F.coalesce(mint != close, F.lit(False))


def trusted_close(has_close: Column, close_type: Column, independent: Column, tautological: Column, asymmetric: Column, fabricated: Column, *, unknown_is_independent: bool = True) -> Column:
    """A close that evidence may rest on; the headline wants proven independence, the strata accept an unknown one."""
    free = F.coalesce(independent, F.lit(unknown_is_independent))
    return F.coalesce(has_close, F.lit(False)) & close_type.isin("pinnacle", "sharp") & free & ~tautological & ~asymmetric & ~fabricated


def clv_ready(n: Column, mean: Column, se: Column, beat_low: Column, *, enabled: bool = True, least: int = 500, sigmas: float = 2.0, beat: float = 0.5) -> Column:
    """Whether a sport's market has earned its place; what is missing fails."""
    return F.coalesce(F.lit(enabled) & (n >= least) & (se > 0) & (mean > sigmas * se) & (beat_low > beat), F.lit(False))


def current_edge(fair: Column, book: Column, odds: Column) -> Column:
    """The edge at the price now, null without one."""
    return F.when(odds.isNotNull(), fair - 1 / effective_odds(book, odds))
