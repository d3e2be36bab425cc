"""Golden values and properties of single operators."""

import datetime as dt
import difflib
import json
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairline.functions import devig as dv
from fairline.functions import odds as fo
from fairline.functions import text
from fairline.operators import market, resampling, resolve, settlement, timeline
from fairline.plans import markets
from fairline.streaming import live
from tests.conftest import SF


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("method", sorted(dv.METHODS))
def test_devig_properties(spark, method):
    books = [[1.5, 4.0, 8.0], [2.0, 2.0], [1.02, 40.0], [3.1, 3.2, 2.5], [1.91, 1.91], [2.2, 4.4, 6.0]]
    rows = spark.createDataFrame([(b,) for b in books], "odds array<double>").select("odds", dv.devig(F.col("odds"), method).alias("d")).collect()
    for r in rows:
        assert abs(sum(r.d.fair) - 1) < 1e-9 and all(0 < p < 1 for p in r.d.fair)
        assert sorted(range(len(r.odds)), key=lambda i: r.odds[i]) == sorted(range(len(r.odds)), key=lambda i: -r.d.fair[i])


def test_devig_of_bad_prices_is_null(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "odds array<double>").select(dv.devig(F.col("odds"), "power").alias("d")).collect()
    assert [r.d for r in rows] == [None, None]


@settings(max_examples=40, deadline=None)
@given(st.floats(0.05, 0.95), st.floats(0.01, 0.5))
def test_drawdown_multiplier_bounds(p, d):
    assert 0 < fo.drawdown_multiplier(d, p) <= 1


def test_stakes_and_prices(spark):
    r = one(spark, fo.recommended_stake(F.lit(0.55), F.lit(2.0)))
    assert abs(r.raw - 0.1) < 1e-12 and abs(r.fractional - 0.025) < 1e-12 and r.final == 0.02
    assert one(spark, fo.kelly_fraction(F.lit(0.3), F.lit(2.0))) == 0.0
    assert one(spark, fo.american_to_decimal(F.lit(150))) == 2.5 and one(spark, fo.american_to_decimal(F.lit(-200))) == 1.5
    assert one(spark, fo.min_acceptable_odds(F.lit(0.01), 0.02, F.lit("bwin"))) is None
    assert one(spark, fo.time_bucket(F.lit(-1.0))) is None
    assert one(spark, fo.price_age(F.lit(10.0), F.lit(None).cast("double"))) == float("inf") and one(spark, fo.price_age(F.lit(10.0), F.lit(12.0))) == 0
    assert one(spark, settlement.pick_pnl(F.lit("won"), F.lit(10.0), F.lit(1.2345))) == 2.34  # half to even


@pytest.mark.parametrize(
    ("side", "line", "home", "away", "outcome"),
    [("home", -1.0, 2, 1, "lost"), ("home", -0.75, 2, 1, "half_won"), ("home", -0.25, 1, 1, "half_lost"), ("away", 0.5, 1, 1, "won"), ("home", -1.25, 2, 1, "half_lost"), ("away", 0.25, 0, 0, "half_won")],
)
def test_handicaps(spark, side, line, home, away, outcome):
    assert one(spark, settlement.settle_handicap(F.lit(side), F.lit(line), F.lit(home), F.lit(away))) == outcome


def test_closing_flags(spark):
    independent = lambda *x: one(spark, settlement.close_independent(*(F.lit(v) for v in x)))
    assert independent("consensus", "bwin", None) and not independent("Bwin ", "bwin", None) and not independent("pinnacle", "bwin", "Pinnacle")


NAMES = ["  Ålesund-FK  2 ", "Arsenal Women", "Arsenal U21", "Sub20 Leeds", "Real Madrid B", "Schalke 04", "Boca Juniors", "FC", "", "Junior", "IF Elfsborg", "Club Brugge II", "Bayern Damen", "B", "Málaga C.F.", "Atlético Madrid"]


def plain_name(name):
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return " ".join("".join(c if c.isalnum() else " " for c in text).split())


def normal_name(name):
    return " ".join(w for w in plain_name(name).split() if w not in resolve.CLUB_WORDS)


def marks_of(name):
    w = name.split()
    found = {"women" for x in w if x in resolve.WOMEN} | {"youth" for x in w if x in resolve.YOUTH or re.match(resolve.YOUTH_AGE, x)} | {"reserve" for x in w if x in resolve.RESERVE}
    return found | ({"reserve"} if len(w) >= 2 and w[-1] in resolve.LAST_RESERVE else set())


def base_of(name):
    if name in resolve.SENIOR:
        return name
    w = name.split()
    w = w[:-1] if len(w) >= 2 and w[-1] in resolve.LAST_RESERVE else w
    return " ".join(x for x in w if not marks_of(x)) or name


def one_club(a, b):
    if a == b:
        return bool(a)
    apart = set(a.split()) ^ set(b.split())
    if not a or not b or apart and apart <= set(resolve.APART) or resolve.jaro_winkler(a, b) < resolve.ALIKE:
        return False
    return 100 * difflib.SequenceMatcher(None, " ".join(sorted(a.split())), " ".join(sorted(b.split())), False).ratio() >= resolve.SORTED_ALIKE


def test_names(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", text.plain(F.col("name")).alias("p"), resolve.normalized(F.col("name")).alias("n"))
    for r in rows.select("*", resolve.markers(F.col("n")).alias("m"), resolve.base_name(F.col("n")).alias("b")).collect():
        assert (r.p, r.n, set(r.m), r.b) == (plain_name(r.name), normal_name(r.name), marks_of(r.n), base_of(r.n)), r
    assert resolve.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert resolve.jaro_winkler("manchester united", "manchester city") == pytest.approx(0.926, abs=1e-3)


def test_players(spark):
    forms = {"Federer R.": "federer r", "R. Federer": "federer r", "Roger Federer": "federer r", "Federer": "federer", "": "", "Del Potro J.": "delpotro j", "Müller, A": "muller a"}
    rows = spark.createDataFrame([(k,) for k in forms], "name string").select("name", text.canonical_player(F.col("name")).alias("p")).collect()
    assert {r.name: r.p for r in rows} == forms


SIDE = "ref long, home string, away string, league string, kickoff timestamp"


def brute_matches(left, right, minutes=360):
    found = {}
    for ref, home, away, league, at in left:
        good = []
        for other, h, a, other_league, then in right:
            apart = abs((then - at).total_seconds())
            leagues = not normal_name(league or "") or not normal_name(other_league or "") or normal_name(league) == normal_name(other_league)
            names = home != away and h != a and home and away and h and a and one_club(base_of(home), base_of(h)) and one_club(base_of(away), base_of(a))
            if apart <= 60 * minutes and leagues and names and marks_of(home) == marks_of(h) and marks_of(away) == marks_of(a):
                good.append((-(resolve.jaro_winkler(base_of(home), base_of(h)) + resolve.jaro_winkler(base_of(away), base_of(a))), apart, other, h, a, then))
        good.sort()
        if not good or len(good) > 1 and good[1][3:5] != good[0][3:5] and good[1][0] - good[0][0] < resolve.MARGIN:
            continue
        if any(g[3:5] == good[0][3:5] and abs((g[5] - good[0][5]).total_seconds()) > 60 * minutes for g in good[1:]):
            continue
        found[ref] = good[0][2]
    return found


def test_events_equal_brute_force(spark):
    """Typing errors keep their match, unclear ones have none, several fixtures a day compete, other teams of a club stay apart."""
    names = ["dynamo kiev", "dinamo kiev", "dnyamo kiev", "arsenal", "arsenals", "arsenal women", "leeds", "leeds united", "leeds city", "manchester united", "manchester city", "real madrid b", "real madrid", "a", ""]
    fixtures = [(h, a) for h in names for a in names if h != a]
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    league = lambda i: ("x", "y", None)[i % 3]
    left = [(i, h, a, league(i), at(i * 7 % 300)) for i, (h, a) in enumerate(fixtures)]
    right = [(1000 + i, h, a, league(i * 5), at(i * 5 % 300)) for i, (h, a) in enumerate(fixtures)]
    left += [(900, "dynamo kiev", "leeds", None, at(2000)), (901, "dynamo kiev", "leeds", None, at(3000)), (902, "arsenal", "leeds", "x", at(4000))]
    right += [(1900, "dynamo kyiv", "leeds", None, at(2002)), (1901, "dynamo kiev", "leeds", None, at(2995)), (1902, "dynamo kiev", "leeds", None, at(3005)), (1903, "arsenal", "leeds", "y", at(4000))]
    found = {r.left_ref: r.right_ref for r in resolve.match_hardened(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE)).collect()}
    assert found == brute_matches(left, right) and 901 not in found and 902 not in found


def test_aliases_and_wrong_games(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps({"teams": {"Manchester United": ["Man Utd", "MUFC"], "Inter": ["Internazionale", ""]}}))
    table = resolve.aliases_from_seed(spark, str(tmp_path / "seed.json"))
    assert {(r.alias, r.canonical) for r in table.collect()} >= {("man utd", "manchester united"), ("mufc", "manchester united"), ("manchester united", "manchester united"), ("internazionale", "inter")}
    assert {r.canonical: r.names for r in resolve.aliases_of(table).collect()}["inter"] == ["inter", "internazionale"]
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "bayern munich", "gjovik", t, "bayern munich allianz sponsor", "gjoevik", t), (2, "arsenal", "leeds", t, "arsenal women", "leeds", t), (3, "leeds united", "x y", t, "leeds city", "x y", t), (4, "ann bell", "cleo dorn", t, "ann bell", "cleo dorn", t + dt.timedelta(hours=7)), (5, "ann bell", "cleo dorn", t, "cleo dorn", "ann bell", t)]
    pairs = spark.createDataFrame(rows, "i int, home string, away string, kickoff timestamp, anchor_home string, anchor_away string, anchor_kickoff timestamp")
    assert {r.i: r.reason for r in resolve.wrong_games(pairs).collect()} == {1: None, 2: "markers", 3: "names", 4: "kickoff", 5: "names"}
    assert {r.i: r.reason for r in resolve.wrong_games(pairs, ordered=False).collect()}[5] is None


def test_later_rows_do_not_change_the_state_at_kickoff(spark):
    """Leakage: what is captured after kickoff leaves the movement as it is."""
    schema = "event_id long, book_id long, sel_idx int, odds double, captured_at timestamp, kickoff timestamp, l_orderkey long, l_linenumber int"
    k = dt.datetime(2024, 1, 2)
    rows = [(1, 1, 0, 2.0, k - dt.timedelta(hours=5), k, 1, 1), (1, 1, 0, 2.2, k - dt.timedelta(hours=1), k, 2, 1)]
    late = [(1, 1, 0, 9.0, k + dt.timedelta(hours=1), k, 3, 1)]
    a, b = (timeline.movement(spark.createDataFrame(r, schema)).collect() for r in (rows, rows + late))
    assert a == b and a[0].open == 2.0 and a[0].close == 2.2


def test_bootstraps_repeat(spark):
    rows = spark.createDataFrame([(i, 1.0 * (i % 3), 1.0) for i in range(60)], "match long, pnl double, stake double")
    a, b = (resampling.poisson_bootstrap(rows, "match", "pnl", "stake", replicates=50).first() for _ in range(2))
    assert a == b and a.low < a.mean < a.high
    series = spark.createDataFrame([(i, 0.01 * (-1) ** i) for i in range(30)], "position long, log_return double")
    paths = resampling.block_bootstrap_paths(series, paths=20, block=5).collect()
    assert len(paths) == 20 and all(p.terminal > 0 and 0 <= p.drawdown < 1 for p in paths)


def test_stream_of_changes_equals_batch(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=m)
    rows = [(1, "bwin", "home", at(m), o) for m, o in enumerate([2.0, 2.0, 2.1, 2.1, 2.0])] + [(1, "bwin", "away", at(0), 3.0), (2, "bwin", "home", at(1), 3.0)]
    src = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, live.CHANGED).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(live.CHANGED).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.changed(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    found = sorted((r.event_id, r.selection, r.captured_at, r.odds) for r in spark.table("changes").collect())
    assert found == sorted((e, s, t, o) for e, _, s, t, o in (rows[0], rows[2], rows[4], rows[5], rows[6]))


def test_fresh_drops_stale_and_unknown(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, t), (2, t - dt.timedelta(hours=1), t), (3, None, t), (4, t + dt.timedelta(hours=1), t)], "i int, captured_at timestamp, ingested_at timestamp")
    assert sorted(r.i for r in live.fresh(df).collect()) == [1, 4]


@pytest.mark.parametrize("guard", [False, True])
def test_scan_keeps_no_condition_on_a_markets_arrays(spark, guard):
    q = markets.rows(spark, SF, close="kickoff")
    found = market.value_scan(market.with_anchor(q, method="multiplicative"), guard=guard)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "lambdafunction" in line]


def test_best_soft_looks_a_price_up_once(spark):
    """One look-up a book, whatever is made of the price; a book without one, and sharp ones, make no offer; equal offers go to the first book."""
    rows = [(0, "Pinnacle", "pinnacle", [(0, 9.0)]), (1, "bet365", "bet365", [(0, 2.5)]), (2, "bwin", "bwin", [(0, 2.5), (1, 3.0)]), (3, "matchbook", "matchbook", [(0, 2.51)])]
    books = "array<struct<book_id:long,book:string,norm:string,odds:array<struct<sel_idx:int,odds:double>>>>"
    df = spark.createDataFrame([(rows,)], f"books {books}").select(*(market.best_soft(F.col("books"), F.lit(i)).alias(f"o{i}") for i in (0, 1, 2)))
    got = df.first()
    assert (got.o0.net, got.o0.book, got.o0.odds) == (2.5, "bet365", 2.5) and (got.o1.book, got.o1.odds) == ("bwin", 3.0) and got.o2 is None
    one = spark.createDataFrame([(rows,)], f"books {books}").select(market.best_soft(F.col("books"), F.lit(0)).alias("o"))
    assert one._jdf.queryExecution().analyzed().toString().count("filter(") == 2  # soft books, and the price of each
