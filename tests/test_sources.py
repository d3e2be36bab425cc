"""Parsers of other sources' files and feeds, on small files written here."""

import bz2
import datetime as dt
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from fairline.sources import exchange, feeds, tables

T = dt.datetime(2024, 3, 1, 12)


def values(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p) if not isinstance(p, str) else p,) for p in payloads], "value string")


def csv(spark, tmp_path, text, header=True):
    (tmp_path / "x.csv").write_text(text)
    return spark.read.csv(str(tmp_path / "x.csv"), header=header)


def test_new_leagues(spark, tmp_path):
    raw = csv(spark, tmp_path, "Date,Home,Away,HG,AG,Res,PSCH,PSCD,PSCA\n01/02/2023,A,B,2,1,H,1.9,3.4,1.0\n1/2/23,C,D,x,1,A,,,\nbad,E,F,1,1,D,,,\n")
    r = tables.new_league_matches(raw).collect()
    assert len(r) == 1 and r[0].played == dt.date(2023, 2, 1) and (r[0].sharp_close_h, r[0].sharp_close_a, r[0].soft_h, r[0].best_close_h) == (1.9, None, None, None)


def test_averages(spark, tmp_path):
    head = "league,match_date,home_score,away_score," + ",".join(f"{k}_odds_{s}" for k in ("avg", "max") for s in ("home_win", "draw", "away_win"))
    raw = csv(spark, tmp_path, f"{head}\nX,2015-01-02,1,1,2.0,3.0,4.0,2.1,3.1,4.1\nX,2015-01-03,1,1,2.0,3.0,,2.1,3.1,4.1\n")
    assert [(r.result, r.avg_h, r.max_a) for r in tables.average_matches(raw).collect()] == [("D", 2.0, 4.1)]


def test_tennis(spark, tmp_path):
    lines = ["Comment,Loser,MaxL,MaxW,PSL,PSW,Winner,Date", "Completed,Brandt L.,3.45,1.42,3.3,1.37,Okafor T.,17/06/2021", "Retired,Q,,,,,P,2021-06-18", "Completed,S,,,,,R,"]
    m = tables.tennis_matches(csv(spark, tmp_path, "\n".join(lines) + "\n"))
    assert [(r.winner, r.completed, r.sharp_w) for r in m.orderBy("played").collect()] == [("Okafor T.", True, 1.37), ("P", False, None)]
    t = tables.two_sided(m).first()
    assert t.players[t.result] == "Okafor T." and t.sharp[t.result] == 1.37
    many = spark.createDataFrame([(dt.date(2023, 1, 1) + dt.timedelta(days=i), f"w{i}", f"l{i}", True, 1.5, 2.5, 1.6, 2.6) for i in range(200)], "played date, winner string, loser string, completed boolean, sharp_w double, sharp_l double, best_w double, best_l double")
    assert 60 < tables.two_sided(many).where("result = 1").count() < 140


def test_internationals(spark, tmp_path):
    raw = csv(spark, tmp_path, "date,home_team,away_team,home_score,away_score,tournament,neutral\n2022-11-20,Qatar,Ecuador,0,2,Cup,FALSE\n2026-06-11,Mexico,X,NA,NA,Cup,TRUE\n2026-06-12,,X,NA,NA,Cup,TRUE\nbad,A,B,1,1,Cup,TRUE\n")
    assert [(r.home, r.result, r.neutral) for r in tables.international_results(raw).collect()] == [("Qatar", "A", False)]
    assert [(r.home, r.neutral) for r in tables.international_fixtures(raw, "Cup", F.lit("2023-01-01").cast("date")).collect()] == [("Mexico", True)]


def test_gridiron_kickoffs(spark, tmp_path):
    raw = csv(spark, tmp_path, "game_id,season,week,gameday,gametime,home_team,away_team,home_score,away_score,spread_line\ng1,2023,1,2023-09-10,13:00,A,B,20,17,3.5\ng2,2023,18,2024-01-07,13:00,A,B,,,nan\ng3,2023,1,,13:00,A,B,1,2,3\n")
    r = {x.game_id: x for x in tables.gridiron_games(raw).collect()}
    assert set(r) == {"g1", "g2"} and r["g1"].kickoff == dt.datetime(2023, 9, 10, 17) and r["g2"].kickoff == dt.datetime(2024, 1, 7, 18) and r["g2"].home_score is None and r["g2"].spread_line is None


def test_headerless(spark, tmp_path):
    raw = csv(spark, tmp_path, "s,England,PL,A,B,x,x,x,2,1,2012-01-02,1.5,4.0,7.0\ns,England,PL,A,B,x,x,x,2,1,2012-01-02,NULL,4.0,7.0\n", header=False)
    assert [(r.home, r.home_score, r.sharp_a) for r in tables.headerless_matches(raw).collect()] == [("A", 2, 7.0)]


def matrix(*books):
    lines = []
    for book in books:
        cells = ["nan"] * 216
        for hour, triple in book.items():
            for i, x in enumerate(triple):
                cells[i * 72 + hour] = str(x)
        lines.append(",".join(cells))
    return "\n".join(lines)


def test_series(spark, tmp_path):
    text = matrix({5: (2.0, 3.0, 4.0), 70: (1.8, 3.2, 4.4)}, {60: (2.2, 3.4, 3.6), 61: (9.0, "nan", 9.0), 62: (1.0, 3.0, 3.0)}, {})
    folder = tmp_path / "series"
    folder.mkdir()
    (folder / "match_12_2015_9_1_19_45_0_2_1.txt").write_text(text)
    (folder / "other.txt").write_text(text)
    (folder / "match_13_2015_9_1_19_45_0_2_1.txt").write_text(matrix({}) + "\nshort,1,2")
    r = tables.series_files(spark, str(folder)).collect()
    assert len(r) == 1 and (r[0].match_id, r[0].kickoff, r[0].result, r[0].books) == (12, dt.datetime(2015, 9, 1, 19, 45), "H", 2)
    assert r[0].open_mean_h == pytest.approx(2.1) and r[0].open_best_h == 2.2 and r[0].close_mean_a == pytest.approx(4.0) and r[0].close_best_a == 4.4
    w = tables.wide_rows(tables.series_files(spark, str(folder))).first()
    assert w.PSH == pytest.approx(2.1) and w.MaxCA == 4.4 and w.FTR == "H"
    (tmp_path / "odds.csv").write_text('match_id,text\n12,"' + text + '"\n')
    (tmp_path / "m.csv").write_text("match_id,date,score,league\n12,2015-09-01 19:45:00,2 - 1,X\n99,2015-09-01,1-1,X\n")
    s = tables.series_table(spark, str(tmp_path / "odds.csv"), str(tmp_path / "m.csv")).collect()
    assert len(s) == 1 and (s[0].home_score, s[0].league, s[0].close_best_a) == (2, "X", 4.4)


GRID = [
    ["Date", "Rot", "VH", "Team", "1", "2", "3", "4", "Final", "Open", "Close", "ML", "2H"],
    ["1018", "1", "V", "Lakers", "", "", "", "", "100", "210", "212", "150", ""], ["1018", "2", "H", "Bulls", "", "", "", "", "110", "5", "4.5", "-170", ""],
    ["115", "1", "V", "Heat", "", "", "", "", "90", "pk", "1", "100", ""], ["115", "2", "H", "Nets", "", "", "", "", "80", "200", "199", "NL", ""],
    ["116", "1", "V", "A", "", "", "", "", "90", "3", "3", "-110", ""], ["116", "2", "H", "B", "", "", "", "", "90", "200", "200", "-110", ""],
    ["117", "1", "V", "A", "", "", "", "", "90", "3", "3", "-110", ""],
]


@pytest.mark.parametrize("form", ["csv", "html"])
def test_grids(spark, tmp_path, form):
    if form == "csv":
        (tmp_path / "g.csv").write_text("\n".join(",".join(r) for r in GRID))
    else:
        (tmp_path / "g.html").write_text("<p>x</p><table>" + "".join("<tr>" + "".join(f"<td><b>{c}</b></td>" for c in r) + "</tr>" for r in GRID) + "</table><table><tr><td>no</td></tr></table>")
    r = tables.grid_games(tables.grid_rows(spark, str(tmp_path), 2019)).orderBy("played").collect()
    assert [(x.played, x.home, x.result) for x in r] == [(dt.date(2019, 10, 18), "Bulls", "H"), (dt.date(2020, 1, 15), "Nets", "A")]
    assert (r[0].home_open_spread, r[0].away_close_spread, r[0].open_total, r[0].close_total, r[0].home_ml) == (-5.0, 4.5, 210.0, 212.0, pytest.approx(1 + 100 / 170))
    assert r[1].home_us is None and r[1].open_total == 200.0 and r[1].close_total == 199.0


def test_totals(spark):
    rows = spark.createDataFrame([(100, 110, 205.5), (100, 110, 210.0), (90, 100, 205.5), (100, 110, 20.0)], "h int, a int, line double")
    assert [r[0] for r in rows.select(tables.total_result(F.col("h"), F.col("a"), F.col("line"))).collect()] == ["over", "push", "under", None]


def stream(live=True):
    runners = [{"id": 1, "name": "Arsenal", "sortPriority": 1, "status": "WINNER", "bsp": 2.5}, {"id": 2, "name": "Leeds", "sortPriority": 2, "status": "LOSER"}, {"id": 58805, "name": "The Draw", "sortPriority": 3, "status": "LOSER"}]
    d = {"eventTypeId": "1", "eventName": "Arsenal v Leeds", "marketType": "MATCH_ODDS", "marketTime": "2024-03-01T15:00:00.000Z", "status": "OPEN", "inPlay": False, "runners": [{**r, "status": "ACTIVE", "bsp": "NaN"} for r in runners], "competition": {"name": "PL"}}
    m = lambda pt, **c: json.dumps({"op": "mcm", "pt": pt, "mc": [{"id": "1.1", **c}]})
    out = [m(1, marketDefinition=d), "not json", json.dumps({"op": "other"}), m(2, rc=[{"id": 1, "batb": [[0, 2.4, 9]]}, {"id": 2, "ltp": 3.1}, {"id": 58805, "bdatb": [[0, 1.0, 2]], "batb": [[0, 3.4, 2]]}]), m(3, rc=[{"id": 2, "bdatb": [[0, 3.2, 5]], "ltp": 9.0}])]
    if live:
        out += [m(4, marketDefinition={**d, "inPlay": True}, rc=[{"id": 2, "ltp": 8.0}]), m(5, rc=[{"id": 58805, "ltp": 20.0}]), m(6, marketDefinition={**d, "status": "CLOSED", "inPlay": True, "bspReconciled": True, "runners": runners})]
    return out


def test_market_streams(spark, tmp_path):
    (tmp_path / "a.bz2").write_bytes(bz2.compress("\n".join(stream()).encode()))
    (tmp_path / "b.json").write_text("\n".join(stream(live=False)).replace('"1.1"', '"1.2"'))
    (tmp_path / "c.json").write_text("nothing")
    r = {(x.market_id, x.selection_id): x for x in exchange.market_closes(exchange.stream_lines(spark, str(tmp_path))).collect()}
    assert len(r) == 6 and (r["1.1", 1].close, r["1.1", 1].bsp, r["1.1", 1].won) == (2.5, 2.5, True)
    assert (r["1.1", 2].close, r["1.1", 58805].close, r["1.1", 2].won) == (3.2, 3.4, False) and r["1.1", 2].settled and r["1.1", 2].reconciled
    assert r["1.1", 2].kickoff == dt.datetime(2024, 3, 1, 15) and r["1.2", 1].close == 2.4 and r["1.2", 1].won is None and not r["1.2", 1].settled and r["1.2", 1].in_play is None
    folder = tmp_path / "tar"
    folder.mkdir()
    with tarfile.open(folder / "x.tar", "w") as tar:
        for name, data in (("m/1.bz2", bz2.compress("\n".join(stream()).encode())), ("m/2.json", "\n".join(stream(live=False)).replace('"1.1"', '"1.2"').encode())):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    closes = exchange.market_closes(exchange.tar_lines(spark, str(folder)))
    assert {(x.market_id, x.selection_id): x.close for x in closes.collect()} == {k: x.close for k, x in r.items()}
    assert exchange.market_closes(exchange.tar_lines(spark, str(folder)), event_type="7522").count() == 0 and exchange.market_closes(exchange.tar_lines(spark, str(folder)), market_types=("MATCH_ODDS",)).count() == 6
    exchange.write_market_cache(closes, str(tmp_path / "cache"))
    assert exchange.read_market_cache(spark, str(tmp_path / "cache"), closes.schema).count() == 6
    fixtures = spark.createDataFrame([("1.1", "arsenal", "leeds"), ("1.2", "arsenal", "chelsea")], "market_id string, home string, away string")
    assert [tuple(x) for x in exchange.match_odds_closes(closes, fixtures).collect()] == [("1.1", 2.5, 3.4, 3.2, "H")]
    assert exchange.merged_markets(closes.where("market_id = '1.1'"), closes).count() == 6


def test_over_under_and_sides(spark):
    rows = spark.createDataFrame([("m", 47973, None, 1.9, True), ("m", 47972, None, 2.0, False), ("n", 5, "Over 2.5 Goals", 1.8, None), ("n", 6, "Under 2.5 Goals", 2.1, None), ("o", 5, "Over", 1.8, None), ("o", 7, "Over", 1.8, None)], "market_id string, selection_id long, name string, close double, won boolean")
    assert sorted(map(tuple, exchange.over_under_closes(rows).collect()), key=lambda x: x[0]) == [("m", 1.9, 2.0, "O"), ("n", 1.8, 2.1, None)]
    names = spark.createDataFrame([("A v B",), ("A v B v C",), ("A",), (None,), (" v B",)], "n string").select(exchange.event_sides(F.col("n")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in names] == [("A", "B"), None, None, None, None]


def test_attached_closes(spark):
    rows = spark.createDataFrame([(1, "a", "b", dt.date(2024, 3, 1), "H"), (2, "a", "b", dt.date(2024, 3, 20), "H"), (3, "c", "d", dt.date(2024, 3, 1), "A")], "match_id long, home string, away string, played date, result string")
    closes = spark.createDataFrame([("a", "b", T + dt.timedelta(days=1), 2.0, 3.0, 4.0, "H"), ("a", "b", T, 2.1, 3.1, 4.1, "H"), ("c", "d", T, 2.0, 3.0, 4.0, "D")], "home string, away string, kickoff timestamp, close_h double, close_d double, close_a double, result string")
    out, stats = exchange.attached_closes(rows, closes)
    assert {r.match_id: r.close_h for r in out.collect()} == {1: 2.1, 2: None} and tuple(stats.first()) == (3, 2, 1, 1)


def test_catalogues_and_books(spark):
    runner = lambda place, name, number: {"sortPriority": place, "runnerName": name, "selectionId": number}
    whole = {"event": {"name": "Norrvik v Saltholm"}, "runners": [runner(3, "The Draw", exchange.DRAW), runner(2, "Saltholm", 9002), runner(1, "Norrvik", 9001)], "marketStartTime": "2022-08-20T18:30:00Z", "marketId": "1.77"}
    half = {"event": {"name": "cup winner"}, "runners": [runner(1, "Norrvik", 9001)], "marketId": "1.78"}
    to_back = lambda number, *levels: {"ex": {"availableToBack": [dict(zip(("price", "size"), x, strict=False)) for x in levels]}, "selectionId": number}
    book = [{"runners": [to_back(exchange.DRAW, (0.9, 12), (4.3,)), to_back(9002), to_back(9001, (1.71, 30), (1.74, -8))], "marketId": "1.77"}]
    backs = exchange.book_backs(values(spark, book))
    assert {r.selection_id: (r.price, r.size) for r in backs.collect()} == {9001: (1.74, 0.0), exchange.DRAW: (4.3, 0.0)}
    r = exchange.joined_match_odds(exchange.catalogue_runners(values(spark, [half, whole])), backs).collect()
    assert [(x.market_id, x.home, x.draw, x.away) for x in r] == [("1.77", 1.74, 4.3, None)]
    mine = spark.createDataFrame([("e", "home", 2.0, T), ("e", "away", 3.0, T)], "event_id string, role string, price double, at timestamp")
    ref = spark.createDataFrame([("e", "home", 2.02, T - dt.timedelta(minutes=1)), ("e", "away", 3.2, T)], "event_id string, role string, price double, at timestamp")
    assert tuple(exchange.compared(mine, ref).first()) == (2, 0.11, 0.5, 0.5)


def test_fixture_bundles(spark):
    hist = lambda *p: {"players": {"0": [{"createdAt": f"2024-01-0{i + 1}", "price": x, "active": True} for i, x in enumerate(p)], "1": [{"createdAt": "2023-01-01", "price": 9.0, "active": False}]}}
    book = lambda h, a: {"markets": {"11": {"outcomes": {"1": hist(*h), "2": hist(*a)}}}}
    b = {"fixtureId": "f", "startTime": "2024-01-05T00:00:00Z", "home_team": " A ", "away_team": "B", "home_score": 99, "away_score": 101, "moneyline": {"marketId": "11", "home_outcomeId": "1", "away_outcomeId": "2"}, "historical_odds": {"bookmakers": {"pinnacle": book((1.9, 1.8), (2.0, 2.1)), "x": book((1.95,), (2.05,)), "y": book((2.0, 1.7), (1.9,))}}}
    none = json.loads(json.dumps(b))
    del none["historical_odds"]["bookmakers"]["pinnacle"]
    games = feeds.fixture_bundles(values(spark, b, none, "[1]"), ("x", "y"))
    r = games.collect()
    assert len(r) == 1 and (r[0].home, r[0].result, r[0].home_sharp_open, r[0].home_sharp_close, r[0].home_soft_open, r[0].home_soft_close, r[0].away_soft_open) == ("A", "A", 1.9, 1.8, 2.0, 1.95, 2.05)
    assert tuple(feeds.sharp_soft_rows(games).first())[2:] == ([1.9, 2.0], [2.0, 2.05], [1.8, 2.1], 1)


def test_listed_quotes(spark):
    named = lambda name, price, **more: {"price": price, "name": name} | more
    kinds = {"odd": [], "h2h": [named("Saltholm", 0.95), named("Norrvik", 2.36)], "spreads": [named("Norrvik", 1.83, point=-2.25), named("Saltholm", 2.08, point=2.25)]}
    e = {"bookmakers": [{"markets": [{"outcomes": o, "key": k} for k, o in kinds.items()], "last_update": "2022-08-20T09:15:00Z", "key": "betfair_ex_eu"}], "id": "n1"}
    r = feeds.listed_quotes(values(spark, [{"id": ""}, e]), F.lit(T)).collect()
    assert sorted((x.book, x.family, x.line, x.selection, x.odds) for x in r if x.line) == [("betfair exchange", "spreads", -2.25, "Norrvik -2.25", 1.83), ("betfair exchange", "spreads", -2.25, "Saltholm 2.25", 2.08)] and len(r) == 3



def test_matchups(spark):
    side = lambda h, a: [{"name": h, "alignment": "home"}, {"name": a, "alignment": "away"}]
    good = {"id": 7, "type": "matchup", "startTime": "2024-03-01T20:00:00Z", "cutoffAt": "2024-03-01T19:55:00Z", "league": {"name": "PL"}, "participants": side("A", "B")}
    raw = [good, {**good, "id": 8, "type": "special"}, {**good, "id": 9, "parent": {"id": 7}}, {**good, "id": 10, "participants": side("A", "B")[:1]}, {**good, "id": 11, "cutoffAt": None, "startTime": "2024-03-01T11:00:00Z"}]
    events = feeds.matchups(values(spark, raw), F.lit(T), F.lit(T + dt.timedelta(days=1)))
    assert [(r.event_id, r.kickoff) for r in events.collect()] == [("7", dt.datetime(2024, 3, 1, 19, 55))]
    m = lambda key, kind, prices, **more: {"key": key, "type": kind, "period": 0, "status": "open", "matchupId": 7, "version": 3, "prices": prices, **more}
    p = lambda d, price, points=None: {"designation": d, "price": price, "points": points}
    markets = [m("s;0;m", "moneyline", [p("home", -120), p("draw", 250), p("away", 300), p(None, 100)]), m("s;0;ou;2.5", "total", [p("over", -105, 2.5), p("under", -115, 2.5)]), m("s;0;s;-0.5", "spread", [p("home", 100, -0.5), p("away", -120, 0.5)]), m("s;0;ou;3.5", "total", [p("over", 200, 3.5)], isAlternate=True), m("s;1;m", "moneyline", [p("home", 100)], period=1)]
    rows = {(r.family, r.key, r.selection): r.odds for r in feeds.matchup_quotes(events, values(spark, markets)).collect()}
    assert set(rows) == {("h2h", None, "A"), ("h2h", None, "Draw"), ("h2h", None, "B"), ("totals", "over_under_2_5", "Over 2.5"), ("totals", "over_under_2_5", "Under 2.5"), ("spreads", "asian_handicap_-0_5", "A -0.5"), ("spreads", "asian_handicap_-0_5", "B +0.5")} and rows["h2h", None, "Draw"] == 3.5
    assert {r.key for r in feeds.matchup_quotes(events, values(spark, markets), games=True).collect() if r.key} == {"over_under_games_2_5", "asian_handicap_games_-0_5"}


def test_feed_quotes(spark):
    feed = {"d": {"time-base": 1709290800, "oddsdata": {"back": {"E-1-2-0-0-0": {"odds": {"18": {"0": 2.0, "1": "3.4", "2": 1.0}, "99": {"0": 5}, "19": {"0": 2.5}}}, "E-2-2-0-2.5-0": {"odds": {"18": [1.9, 2.0]}}, "E-9": {"odds": {"18": [1, 2]}}}}}}
    payloads = spark.createDataFrame([("e", "A", "B", json.dumps(feed)), ("f", "A", "B", "{}")], "event_id string, home string, away string, value string")
    books = spark.createDataFrame([("18", "Pinnacle"), ("19", "Pinnacle")], "id string, book string")
    wanted = spark.createDataFrame([("1x2", "E-1-2-0-0-0", ["1", "X", "2"]), ("over_under_2_5", "E-2-2-0-2.5-0", ["odds_over", "odds_under"])], "key string, feed_key string, labels array<string>")
    r = feeds.feed_quotes(payloads, books, wanted, F.lit(T)).collect()
    assert sorted((x.key, x.book, x.selection, x.odds) for x in r) == [("1x2", "Pinnacle", "A", 2.0), ("1x2", "Pinnacle", "Draw", 3.4), ("over_under_2_5", "Pinnacle", "Over 2.5", 1.9), ("over_under_2_5", "Pinnacle", "Under 2.5", 2.0)]
    assert {x.captured_at for x in r} == {dt.datetime(2024, 3, 1, 11)}


def test_scoreboards(spark):
    comp = lambda done, *sides: {"date": "2024-03-01T02:00Z", "status": {"type": {"completed": done}}, "competitors": list(sides)}
    team = lambda ha, name, score: {"homeAway": ha, "score": score, "team": {"displayName": name}}
    board = {"events": [{"competitions": [comp(True, team("home", "A", "101"), team("away", "B", "99")), comp(False, team("home", "A", "1"), team("away", "B", "2")), comp(True, team("home", "A", "x"), team("away", "B", "2"))]}]}
    assert [tuple(r) for r in feeds.scoreboard(values(spark, board)).collect()] == [("A", "B", dt.date(2024, 3, 1), 101, 99)]
    player = lambda ha, name, *games: {"homeAway": ha, "athlete": {"displayName": name}, "linescores": [{"value": g} for g in games]}
    tennis = {"events": [{"date": "2024-03-02T02:00Z", "groupings": [{"competitions": [{**comp(True, player("home", "Okafor", 7, 2, 6), player("away", "Brandt", 5, 6, 1)), "date": None}, comp(True, player("home", "P"), player("away", "Q"))]}]}]}
    assert [tuple(r) for r in feeds.tennis_scoreboard(values(spark, tennis)).collect()] == [("Okafor", "Brandt", dt.date(2024, 3, 2), 2, 1)]
