"""Grants of the exposure ledger against one fold in order."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairline.operators import ledger
from fairline.session import cut

ASK = "day string, event_id long, seq long, fraction double"


def one_by_one(rows, before, day_cap, event_cap):
    day, event, out = defaultdict(float), defaultdict(float), {}
    for d, e, f in before:
        day[d] += f
        event[d, e] += f
    for d, e, i, f in sorted(rows, key=lambda r: (r[0], r[2])):
        if f < 0:
            g = -min(-f, day[d])
            event[d, e] = max(event[d, e] + f, 0.0)
        else:
            g = min(f, max(day_cap - day[d], 0.0))
            if event_cap is not None:
                g = min(g, max(event_cap - event[d, e], 0.0))
            event[d, e] += g
        day[d] += g
        out[i] = g
    return out


@pytest.mark.parametrize("event_cap", [None, 0.012])
@pytest.mark.parametrize("releases", [False, True])
def test_grants(spark, event_cap, releases):
    rnd = random.Random(5)
    rows = [(f"d{rnd.randrange(6)}", rnd.randrange(5), i, -0.006 if releases and i % 7 == 0 and i % 3 else 0.001 * rnd.randint(0, 7)) for i in range(240)]
    before = [("d0", 1, 0.008), ("d2", 3, 0.02), ("d3", 1, 0.09)]
    found = ledger.reserved(spark.createDataFrame(rows, ASK), day_cap=0.06, event_cap=event_cap, preloaded=spark.createDataFrame(before, "day string, event_id long, fraction double"), order=["seq"]).collect()
    expected = one_by_one(rows, before, 0.06, event_cap)
    assert len(found) == len(rows) and all(math.isclose(expected[r.seq], r.granted, abs_tol=1e-9) for r in found)


def test_a_day_of_a_million_requests(spark, monkeypatch):
    """One day goes over all tasks; grants are those of one fold."""
    n, cuts = 1_000_000, []
    monkeypatch.setattr(ledger, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    asked = spark.range(n).select(F.lit("d").alias("day"), (F.col("id") * 7919 % 5003).alias("event_id"), F.col("id").alias("seq"), ((F.col("id") * 104729 % 9) / 1e6).alias("fraction"))
    got = ledger.reserved(asked, day_cap=2.5, event_cap=0.0006, order=["seq"])
    rows = got.select("seq", "granted").toArrow()
    order = np.argsort(rows.column("seq").to_numpy())
    granted = rows.column("granted").to_numpy()[order]
    i = np.arange(n)
    day, event, expected = 0.0, defaultdict(float), np.empty(n)
    for k, (e, f) in enumerate(zip((i * 7919 % 5003).tolist(), ((i * 104729 % 9) / 1e6).tolist(), strict=True)):
        g = min(f, max(2.5 - day, 0.0), max(0.0006 - event[e], 0.0))
        day += g
        event[e] += g
        expected[k] = g
    assert np.allclose(granted, expected, atol=1e-9) and 2.4 < granted.sum() <= 2.5 + 1e-6
    assert all(c.select("part").distinct().count() > 1 for c in cuts)


def test_stakes_are_written_back(spark):
    rows = [("d", 1, 1, "premium", 0.02, "inserted"), ("d", 1, 2, "premium", 0.02, "duplicate"), ("d", 2, 3, "premium", 0.02, "upgraded"), ("d", 3, 4, "premium", 0.02, "inserted"), ("d", 3, 5, "premium", 0.02, "upgraded")]
    picks = spark.createDataFrame(rows, "day string, event_id long, pick_id long, tier string, fraction double, outcome string")
    kept = spark.createDataFrame([("d", 1, "premium", 0.005), ("d", 9, "volume", 0.5)], "day string, event_id long, tier string, fraction double")
    found = {r.pick_id: (round(r.granted, 9), float(r.stake), r.clipped, r.skipped) for r in ledger.written_stakes(picks, bankroll=1000.0, day_cap=0.03, preloaded=ledger.seeded(kept), order=["pick_id"]).collect()}
    assert found == {1: (0.02, 20.0, False, False), 2: (0.02, 20.0, False, False), 3: (0.005, 5.0, True, False), 4: (0.0, 0.0, True, True), 5: (0.0, 0.0, True, False)}
