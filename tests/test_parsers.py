"""Parsers over small files of our own."""

import datetime as dt
import json

from fairline.sources import parsers


def test_season_matches(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,PSH,PSD,PSA\n03/02/2021,Aa,Bb,2,1,1.9,x,4\n04/02/21,Cc,Dd,0,0,1.0,3,5\n,Ee,Ff,1,1,2,2,2\n05/02/2021,Gg,Hh,NA,1,2,2,2\n")
    rows = sorted(parsers.season_matches(spark, str(tmp_path)).collect())
    assert [(r.played, r.home, r.home_goals, r.sharp_h, r.sharp_d, r.soft_h) for r in rows] == [(dt.date(2021, 2, 3), "Aa", 2, 1.9, None, None), (dt.date(2021, 2, 4), "Cc", 0, None, 3.0, None)]


def test_history_open_close(spark):
    entry = lambda t, p, a: {"createdAt": t, "price": p, "active": a}
    rows = [(1, json.dumps([entry("2024-02", 2.5, True), entry("2024-01", 2.0, True), entry("2024-03", 9.0, False), entry("2024-04", 1.0, True)])), (2, "[]"), (3, None)]
    got = {r.i: (r.open, r.close) for r in parsers.history_open_close(spark.createDataFrame(rows, "i int, entries string")).collect()}
    assert got == {1: (2.0, 2.5), 2: (None, None), 3: (None, None)}


def test_matrix_triples(spark):
    cells = ["nan"] * 216
    for side, price in enumerate((2.0, 3.0, 4.0)):
        cells[side * 72 + 5] = str(price)
    cells[7] = "2.2"
    rows = parsers.matrix_triples(spark.createDataFrame([(1, ",".join(cells) + "\n" + ",".join(["nan"] * 10))], "match_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 5, 2.0, 3.0, 4.0)]
