"""Every query with SQL gives the SQL's rows; the others run."""

import datetime as dt
from collections import defaultdict

import pytest

from fairline.plans import history, registry
from tests.conftest import SF
from tests.test_operators import brute_matches


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, same_rows):
    same_rows(registry.QUERIES[name], registry.ORACLES[name])


def test_probit_sums_to_one(spark):
    for r in registry.QUERIES["devig_probit"](spark, SF).limit(50).collect():
        assert abs(r.p0 + r.p1 + r.p2 - 1) < 1e-5


def test_matched_events_equal_brute_force(spark):
    """Every match takes part, and those found are the ones of all pairs within a day."""
    ours, theirs = ([(r.ref, r.home, r.away, r.league, r.kickoff) for r in side.collect()] for side in history.event_sides(spark, SF))
    assert len(ours) == len(theirs) == history.matches(spark, SF).count()
    by_day = defaultdict(list)
    for r in theirs:
        by_day[r[4].date()].append(r)
    expected = {}
    for r in ours:
        expected |= brute_matches([r], [x for d in (-1, 0, 1) for x in by_day[r[4].date() + dt.timedelta(days=d)]])
    found = {r.left_ref: r.right_ref for r in registry.QUERIES["matched_events"](spark, SF).collect()}
    assert found == expected and len(found) > 0.4 * len(ours)


def test_entry_and_plan(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() >= 0 and "CartesianProduct" not in plan and "Python" not in plan
    assert set(e.oracle_sql()) <= set(e.queries())
