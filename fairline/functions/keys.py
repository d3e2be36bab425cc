"""Market keys, lines, selections and the policy look-ups that go by them, as column expressions.

A key names a market and its line as sources do ("1x2", "over_under_2_5", "asian_handicap_-1_5");
its family is one of h2h, totals, spreads, btts, dnb and double_chance.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairline.functions.devig import let
from fairline.functions.text import plain, plain_number

#: Keys without a line, and the families they belong to; hosts of match pages.
FAMILIES = {"1x2": "h2h", "home_away": "h2h", "match_winner": "h2h", "btts": "btts", "dnb": "dnb", "double_chance": "double_chance"}
PLAIN = ("h2h", "totals", "spreads", "btts", "dnb", "double_chance")
HOSTS = ("oddsportal.com", "www.oddsportal.com")
PREFIXES = r"^(?:over_under_sets_|over_under_games_|over_under_|asian_handicap_games_|asian_handicap_|european_handicap_)"


def looked_up(values: Mapping[str, object], key: Column) -> Column:
    """A small fixed mapping as one expression; null for an unknown key."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key] if values else F.lit(None)


def family_of(key: Column) -> Column:
    """The family of a provider's key, null for an unknown one."""
    return F.coalesce(looked_up(FAMILIES, key), F.when(key.startswith("over_under_"), "totals").when(key.startswith("asian_handicap") | key.startswith("european_handicap"), "spreads"))


def stored_key(family: Column, detail: Column) -> Column:
    """What an observation is kept under: its line's key, else its family."""
    return F.left(F.coalesce(F.when(detail != "", detail), family), F.lit(64))


def read_key(key: Column) -> Column:
    """(family, detail) of a stored key, null for an unknown one, which is to be skipped."""
    known = F.when(key.isin(*PLAIN), F.struct(key.alias("family"), F.lit(None).cast("string").alias("detail")))
    return F.coalesce(known, F.when(family_of(key).isNotNull(), F.struct(family_of(key).alias("family"), key.alias("detail"))))


def line_of_key(key: Column) -> Column:
    """The number in a key, whatever axis words stand around it."""
    bare = F.regexp_replace(F.regexp_replace(key, PREFIXES, ""), r"(?:_sets)?(?:_games)?$", "")
    return F.when(key.rlike(PREFIXES), F.replace(bare, F.lit("_"), F.lit(".")).try_cast("double"))


def labels_of_key(key: Column, home: Column, away: Column) -> Column:
    """array of (label, selection): a source's label of each outcome and our name of it; empty for an unknown key."""
    return let(line_of_key(key), lambda line: labels_by_line(key, line, home, away))


def labels_by_line(key: Column, line: Column, home: Column, away: Column) -> Column:
    pair = lambda *rows: F.array(*(F.struct(F.lit(a).alias("label"), b.alias("selection")) for a, b in rows))
    handicap = lambda team, value: F.concat_ws(" ", team, plain_number(value, signed=True))
    sides = lambda a, b: pair((a, handicap(home, line)), (b, handicap(away, -line)))
    draw = F.lit("Draw")
    none = F.array().cast("array<struct<label:string,selection:string>>")
    return (
        F.when(key == "1x2", pair(("1", home), ("X", draw), ("2", away))).when(key == "home_away", pair(("1", home), ("2", away)))
        .when(key == "match_winner", pair(("player_1", home), ("player_2", away))).when(key == "dnb", pair(("dnb_team1", home), ("dnb_team2", away)))
        .when(key == "btts", pair(("btts_yes", F.lit("BTTS Yes")), ("btts_no", F.lit("BTTS No"))))
        .when(key == "double_chance", pair(("1X", F.concat_ws(" or ", home, draw)), ("12", F.concat_ws(" or ", home, away)), ("X2", F.concat_ws(" or ", draw, away))))
        .when(line.isNull(), none)
        .when(key.startswith("over_under_"), pair(("odds_over", F.concat_ws(" ", F.lit("Over"), plain_number(line))), ("odds_under", F.concat_ws(" ", F.lit("Under"), plain_number(line)))))
        .when(key.startswith("asian_handicap_games_"), sides("handicap_team_1", "handicap_team_2"))
        .when(key.startswith("asian_handicap_") & key.endswith("_sets"), sides("sets_handicap_player_1", "sets_handicap_player_2"))
        .when(key.startswith("asian_handicap_") & key.endswith("_games"), sides("games_handicap_player_1", "games_handicap_player_2"))
        .when(key.startswith("asian_handicap_"), sides("team1_handicap", "team2_handicap"))
        .when(key.startswith("european_handicap_"), F.array_insert(sides("team1_handicap", "team2_handicap"), 2, F.struct(F.lit("draw_handicap").alias("label"), F.concat(F.lit("Draw ("), plain_number(line, signed=True), F.lit(")")).alias("selection"))))
        .otherwise(none)
    )


def line_of_selection(selection: Column) -> Column:
    """The number that ends a selection ("Over 2.5", "Alpha -1.5", "Draw (+1)"), else null."""
    return F.translate(F.regexp_extract(selection, r"(\S+)\s*$", 1), "()", "").try_cast("double")


def key_line(line: Column, signed: bool = True) -> Column:
    return F.replace(plain_number(line, signed), F.lit("."), F.lit("_"))


def keys_of_pick(sport: Column, family: Column, selection: Column) -> Column:
    """The provider's keys that price a pick again; both signs of a handicap, null if there is no mapping."""
    return let(line_of_selection(selection), lambda line: keys_by_line(sport, family, line))


def keys_by_line(sport: Column, family: Column, line: Column) -> Column:
    basketball = sport == "basketball"
    low, high = F.least(line, -line), F.greatest(line, -line)
    both = lambda start, end="": F.array(*(F.concat(F.lit(start), key_line(x), F.lit(end)) for x in (low, high)))
    return (
        F.when(family == "h2h", F.array(F.when(basketball, "home_away").otherwise("1x2"))).when(family.isin("btts", "dnb"), F.array(family))
        .when(family == "double_chance", F.array(F.lit("double_chance"), F.lit("1x2")))
        .when((family == "totals") & (line > 0), F.array(F.concat(F.when(basketball, "over_under_games_").otherwise("over_under_"), key_line(line, False))))
        .when((family == "spreads") & (line != 0), F.when(basketball, both("asian_handicap_games_", "_games")).when(line == F.floor(line), both("european_handicap_")).otherwise(both("asian_handicap_")))
    )


def keys_of_picks(keys: Column) -> Column:
    """Aggregate: the distinct keys of a group of picks, null (all of them) if one has no mapping."""
    return F.when(F.count_if(keys.isNull()) == 0, F.array_sort(F.array_distinct(F.flatten(F.collect_set(keys)))))


def lookup_keys(family: Column, detail: Column) -> Column:
    """The keys of a policy to try: the line's, then the family's."""
    return F.array_distinct(F.array_compact(F.array(F.when(F.trim(detail) != "", F.lower(F.trim(detail))), F.lower(F.trim(family)))))


def policy_value(values: Mapping[str, object], family: Column, detail: Column, default: object) -> Column:
    """An override by market, the most specific first, else the default: least and greatest edge, margin method, fewest books."""
    detail_key = F.when(F.trim(detail) != "", F.lower(F.trim(detail)))
    found = [looked_up(values, detail_key), looked_up(values, F.lower(F.trim(family)))] if values else []
    return F.coalesce(*found, F.lit(default))


def league_name(name: Column) -> Column:
    return plain(name)


def major_league(majors: Sequence[str], name: Column) -> Column:
    """Whether a league is one of the majors; no majors let all pass, a blank name is none."""
    if not majors:
        return F.lit(True)
    return F.coalesce((plain(name) != "") & plain(name).isin(*[plain(F.lit(m)) for m in majors]), F.lit(False))


def sport_in_scope(entry: str | None, sport: Column) -> Column:
    """An entry without a sport holds for all; with one, for it and what is below it."""
    return F.lit(True) if entry is None else F.coalesce((sport == entry) | sport.startswith(f"{entry}_"), F.lit(False))


def split_entry(entry: str) -> tuple[str | None, str]:
    """(sport or None, market) of "sport:market" or "market"."""
    sport, colon, market = entry.strip().lower().partition(":")
    return (sport.strip() or None, market.strip()) if colon else (None, sport)


def visibility_only(entries: Sequence[str], family: Column, detail: Column, sport: Column) -> Column:
    """Whether a market is only shown: an entry names it, its family or the stem of its line, for its sport."""
    key, name, hit = F.coalesce(F.lower(F.trim(detail)), F.lit("")), F.lower(F.trim(family)), F.lit(False)
    for scope, market in map(split_entry, entries):
        if market:
            named = (key == market) | (name == market) | key.startswith(f"{market}_")
            hit = hit | (sport_in_scope(scope, F.lower(F.trim(F.coalesce(sport, F.lit(""))))) & named)
    return hit


def in_bands(odds: Column, bands: Sequence[tuple[float, float]]) -> Column:
    """Within any of the bands, bounds included; no bands let all pass."""
    inside = F.lit(not bands)
    for low, high in bands:
        inside = inside | odds.between(low, high)
    return inside


def asian_handicap(detail: Column) -> Column:
    return F.coalesce(detail.startswith("asian_handicap"), F.lit(False))


def plausible_handicap(odds: Column, fair: Column, implied: Column, *, max_odds: float = 6.0, max_ratio: float = 1.5) -> Column:
    """No long price and no fair chance far over the price's: the marks of a feed's filler."""
    return (odds <= max_odds) & (implied > 0) & (fair <= max_ratio * implied)


def implausible_final(sport: Column, home: Column, away: Column) -> Column:
    """A basketball result that can't be: a tie or under 100 points."""
    return F.coalesce(F.contains(F.lower(sport), F.lit("basketball")), F.lit(False)) & ((home == away) | (home + away < 100))


def allowed_url(url: Column, hosts: Sequence[str] = HOSTS) -> Column:
    """Whether a page may be fetched: https, a listed host, the standard port, nothing that parsers read differently."""
    bad = url.rlike(r"[\\\s]") | url.rlike(r"^[^/]*//[^/?#]*@")
    authority = F.lower(F.regexp_extract(url, r"^[hH][tT][tT][pP][sS]://([^/?#]*)", 1))
    return F.coalesce(~bad & F.regexp_replace(authority, r":(443)?$", "").isin(*hosts), F.lit(False))


def date_only(at: Column) -> Column:
    """A time of exactly midnight stands for a date alone."""
    return at == F.date_trunc("day", at)


def preferred_kickoff(existing: Column, incoming: Column) -> Column:
    """The incoming kickoff unless it is missing, or a date alone where a time is known."""
    keep = incoming.isNull() | (date_only(incoming) & existing.isNotNull() & ~date_only(existing))
    return F.when(keep, existing).otherwise(incoming)


def covered(market: str, keys: Column) -> Column:
    """Whether an array of keys has the market or one of its lines."""
    return F.exists(keys, lambda k: (k == market) | k.startswith(f"{market}_"))


def fingerprint(**policy: object) -> str:
    """One line that names every setting of a policy, the same for equal ones."""
    return "|".join(f"{k}={v:g}" if isinstance(v, float) else f"{k}={v}" for k, v in sorted(policy.items()))


def unvalidated_sport(sport: Column) -> Column:
    return ~F.coalesce(sport.startswith("soccer"), F.lit(False))
