"""Models beside the anchors: what they predict, and what no prediction gives."""

import pytest
from pyspark.sql import functions as F

from fairline.operators import market, models
from fairline.plans import markets
from tests.conftest import SF


def test_grid_chances_sum_to_one(spark):
    e = spark.createDataFrame([(1, 1.4, 1.1, 0.7), (2, 1.4, 1.1, 0.9), (3, 0.4, 2.6, 0.5)], "event_id long, home_exp double, away_exp double, confidence double")
    found = models.grid_model(e).groupBy("event_id", "key").agg(F.sum("probability").alias("p"), F.count("*").alias("n"), F.first("confidence").alias("c")).collect()
    assert len(found) == 6 and all(r.p == pytest.approx(1) and r.n == (3 if r.key == "1x2" else 2) for r in found) and {r.c for r in found if r.event_id == 2} == {0.9}


def test_the_null_model_picks_nothing(spark):
    m = market.with_anchor(markets.rows(spark, SF, close="kickoff"), method="multiplicative")
    assert models.model_candidates(models.null_model(spark), m).isEmpty()


def test_gates(spark):
    rows = [(1, 0.5, 2.2, 0.45, 0.05, 0.1, 0.7, 3.0), (2, 0.5, 2.2, 0.49, 0.01, 0.1, 0.7, 3.0), (3, 0.5, 2.2, 0.45, 0.05, 0.0, 0.7, 3.0), (4, 0.5, 2.2, 0.45, 0.05, 0.1, 0.5, 3.0), (5, 0.5, 2.2, 0.45, 0.05, 0.1, 0.7, 49.0), (6, 0.5, 2.2, 0.45, 0.05, 0.1, 0.7, None), (7, 0.05, 40.0, 0.02, 0.03, 1.0, 0.7, 1.0)]
    c = spark.createDataFrame(rows, "i int, probability double, odds double, book_fair double, edge double, ev double, confidence double, age double")
    found = models.model_picks(c, F.col("age")).collect()
    assert [(r.i, r.tier) for r in found] == [(1, "premium")] and found[0].fraction == pytest.approx(min(0.02, 0.25 * (1.2 * 0.5 - 0.5) / 1.2)) and found[0].stake == pytest.approx(1000 * found[0].fraction, abs=0.01)
