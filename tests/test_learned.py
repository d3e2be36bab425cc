"""Folds, adoption of a learned filter, and calibration periods that are fitted together."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fairline.operators import calibrate, filtering
from fairline.plans import learned
from tests.conftest import SF


def test_folds_keep_a_season_for_calibration():
    assert filtering.folds(["d", "a", "c", "b"]) == [(["a"], "b", "c"), (["a", "b"], "c", "d")] and filtering.folds(["a", "b"]) == []


def test_no_row_calibrates_the_model_that_it_made(spark, monkeypatch):
    fitted, calibrated = [], []
    fit, fit_calibrator, score = filtering.fit, filtering.fit_calibrator, filtering.score
    seasons_of = lambda df: sorted(r[0] for r in df.select("season").distinct().collect())
    monkeypatch.setattr(filtering, "fit", lambda rows, kind: fitted.append(seasons_of(rows)) or fit(rows, kind))
    monkeypatch.setattr(filtering, "score", lambda model, rows, m=None: calibrated.append((seasons_of(rows), m is not None)) or score(model, rows, m))
    monkeypatch.setattr(filtering, "fit_calibrator", lambda rows: fit_calibrator(rows))
    rows = learned.features(spark, SF).where("clv IS NOT NULL").withColumn("y", F.col("beat_close")).cache()
    seasons = seasons_of(rows)[:4]
    out = filtering.out_of_fold(rows.where(F.col("season").isin(seasons)), seasons)
    assert seasons_of(out) == seasons[2:] and fitted == [seasons[:1], seasons[:2]]
    assert calibrated == [([seasons[1]], False), ([seasons[2]], True), ([seasons[2]], False), ([seasons[3]], True)]
    assert out.where("score < 0 OR score > 1").isEmpty()


GOOD = {"verdict": "ADOPT", "operating_point": {"q": 0.7}, "holdout": {"meta": {"inc_clv_max": {"point": 0.04, "boot_se": 0.01}, "roi": 0.1, "n": 300}, "control": {"inc_clv_max": {"point": 0.02}}, "volume": {"roi": 0.1}}}


@pytest.mark.parametrize(
    ("path", "value", "faults"),
    [
        ((), None, []), (("holdout", "meta", "n"), 299, ["bets"]), (("holdout", "meta", "inc_clv_max", "boot_se"), 0.02, ["increment"]), (("holdout", "meta", "inc_clv_max", "boot_se"), float("nan"), ["holdout"]), (("holdout", "volume", "roi"), 0.2, ["return"]),
        (("holdout", "control", "inc_clv_max", "point"), 0.04, ["control"]), (("holdout", "meta", "roi"), "x", ["holdout"]), (("holdout",), [], ["holdout"]), (("verdict",), "REJECT", []), (("holdout", "meta", "inc_clv_max", "point"), float("inf"), ["holdout"]), (("holdout", "least_n"), 1, []),
    ],
)
def test_adoption(spark, tmp_path, path, value, faults):
    manifest = json.loads(json.dumps(GOOD))
    at = manifest
    for k in path[:-1]:
        at = at[k]
    if path:
        at[path[-1]] = value
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert filtering.adoption_faults(manifest) == faults
    good = not faults and manifest["verdict"] == "ADOPT"
    assert filtering.adopted(manifest) == good and filtering.operating_point(spark, str(tmp_path / "m.json")) == (0.7 if good else None)


def test_periods_fitted_together_equal_one_by_one(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(f"p{k}", p, float(rnd.random() < (p**1.4 if k % 2 else 1 - p))) for k in range(6) for p in (rnd.uniform(0.05, 0.95) for _ in range(60 + 30 * k))]
    df = spark.createDataFrame(rows, "period string, p double, y double")
    scans, fold_sums = [], calibrate.fold_sums
    monkeypatch.setattr(calibrate, "fold_sums", lambda *a: scans.append(len(a[1])) or fold_sums(*a))
    found = {r.period: r for r in calibrate.walk_forward_folds(df, least_train=100, least_test=50).collect()}
    assert sorted(found) == ["p2", "p3", "p4", "p5"] and len(scans) <= 40 and max(scans) == 4
    for period, r in found.items():
        m = calibrate.fit_beta(df.where(F.col("period") < period))
        one = df.where(F.col("period") == period).agg(F.avg(calibrate.log_loss(F.col("p"), F.col("y"))).alias("raw"), F.avg(calibrate.log_loss(calibrate.calibrated(F.col("p"), m), F.col("y"))).alias("fitted")).first()
        assert (r.raw, r.fitted) == (pytest.approx(one.raw), pytest.approx(one.fitted, abs=1e-7))
    assert calibrate.walk_forward_gain(df.limit(0)).first().folds == 0


def test_folds_read_rows_that_are_cut(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(filtering, "out_of_fold", lambda rows, seasons: taken.append(rows) or rows.withColumn("score", F.lit(0.5)))
    learned.filter_scores(spark, SF)
    plan = taken[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
