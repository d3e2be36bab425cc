"""Closes over sources: tied quotes, and books that can't be used."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from fairline.operators import closes
from fairline.plans import registry
from tests.conftest import plain_rows

#: Two parts of one market on each order line: its quotes tie on all but their odds.
TIED = """SELECT o AS l_orderkey, 8 * (o // 6 % 50) + m + 4 * t AS l_partkey, CAST(n AS INTEGER) AS l_linenumber
FROM range(1200) a(o), range(1, 8) b(n), range(4) c(m), range(2) d(t) ORDER BY o, n, m, t"""


@pytest.mark.parametrize("turn", ["", " DESC"])
def test_tied_quotes_are_told_apart_by_their_odds(spark, tmp_path, turn):
    """The rows are the SQL's in whatever order the tied ones are read."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM ({TIED}) ORDER BY l_orderkey, l_linenumber, l_partkey{turn}) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df = registry.QUERIES["trusted_closes"](spark, str(tmp_path))
    found = con.execute(registry.ORACLES["trusted_closes"])
    rows, names = df.collect(), [d[0] for d in found.description]
    assert {r.close_source for r in rows} == {"archive", "pinnacle", "betfair exchange", "soft", None}
    assert plain_rows(df.columns, rows) == plain_rows(names, found.fetchall())


def test_close_of_the_first_book_that_can_be_used(spark):
    """A book with a price of 1 is no close: the next of the source's books stands in, and without one there is none."""
    kickoff = dt.datetime(2024, 1, 1, 12)
    prices = {(1, "bwin"): (1.0, 3.0), (1, " Unibet"): (2.0, 2.0), (2, "bwin"): (1.5, 3.0), (2, " Unibet"): (2.0, 2.0), (3, "bwin"): (1.0, 3.0)}
    rows = [(event, "home_away", book, i, o, kickoff - dt.timedelta(hours=1), kickoff, event, i) for (event, book), odds in prices.items() for i, o in enumerate(odds)]
    quotes = spark.createDataFrame(rows, "event_id long, key string, book string, sel_idx int, odds double, captured_at timestamp_ntz, kickoff timestamp_ntz, l_orderkey long, l_linenumber int")
    found = closes.source_closes(quotes, {"soft": F.lower(F.trim("book")).isin("bwin", "unibet")}).collect()
    assert {(r.event_id, r.sel_idx): round(r.fair, 6) for r in found} == {(1, 0): 0.5, (1, 1): 0.5, (2, 0): 0.666667, (2, 1): 0.333333}
