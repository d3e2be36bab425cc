"""The learned filter: candidate features and labels, contracts against leakage, folds, models, out-of-fold scores and what may be adopted."""

import json
import math
import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.functions.keys import looked_up
from fairline.functions.text import ascii_folded
from fairline.operators.calibrate import calibrated, fit_calibrator, log_loss
from fairline.session import cut

#: Columns by role, and league codes of labels.
KEYS, LABELS = ("match_id", "pick"), ("beat_close", "won", "clv", "unit", "close_fair", "result", "home_goals", "away_goals")
NUMBERS = ("edge", "fair", "spread", "rank", "scored_r5", "conceded_r5", "days_left")
WORDS = ("league", "kind")
CODES = {
    "englandpremierleague": "E0", "premierleague": "E0", "englandchampionship": "E1", "championship": "E1", "englandleagueone": "E2", "leagueone": "E2", "englandleaguetwo": "E3", "leaguetwo": "E3", "scotlandpremiership": "SC0", "premiership": "SC0",
    "germanybundesliga": "D1", "bundesliga": "D1", "germany2bundesliga": "D2", "2bundesliga": "D2", "italyseriea": "I1", "seriea": "I1", "italyserieb": "I2", "serieb": "I2", "spainlaliga": "SP1", "laliga": "SP1", "spainlaliga2": "SP2", "laliga2": "SP2",
    "franceligue1": "F1", "ligue1": "F1", "franceligue2": "F2", "ligue2": "F2", "netherlandseredivisie": "N1", "eredivisie": "N1", "belgiumjupilerproleague": "B1", "jupilerproleague": "B1", "portugalligaportugal": "P1", "ligaportugal": "P1",
    "turkeysuperlig": "T1", "superlig": "T1", "greecesuperleague": "G1", "superleague": "G1",
}


def league_code(label: Column) -> Column:
    """The trained code of a league's label, null outside of the scope."""
    return looked_up(CODES, F.regexp_replace(F.lower(ascii_folded(label)), r"[^a-z0-9]", ""))


def market_scope(family: Column, key: Column, selections: Column) -> Column:
    """The two markets that the model knows; null for others."""
    return F.when((family == "h2h") & (selections == 3), "1x2").when((family == "totals") & (key == "over_under_2_5"), "ou25")


def selection_type(scope: Column, fair: Column, rank: Column, draw: Column) -> Column:
    return F.when((scope == "1x2") & draw, "draw").when(rank == 1, "fav").otherwise("dog")


def season_end(day: Column) -> Column:
    """The 30th of June that ends a season; July still belongs to the one before."""
    return F.make_date(F.year(day) + F.when(F.month(day) <= 7, 0).otherwise(1), F.lit(6), F.lit(30))


def season_code(day: Column) -> Column:
    """A season from July to June, as "1516"."""
    first = F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(first), two(first + 1))


def local_kickoff(day: Column, time: Column, zone: str = "Europe/London") -> Column:
    """A day and a local time as UTC, null without a time."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), time), F.lit("yyyy-MM-dd HH:mm")), zone)


def half_line(line: Column) -> Column:
    return F.abs(line * 2) % 2 == 1


def book_count(prices: list[Column], named: Column | None = None) -> Column:
    """A source's own count of books, else how many of its price columns are over 1."""
    counted = sum((F.when(p > 1, 1).otherwise(0) for p in prices), F.lit(0))
    return F.coalesce(named, counted) if named is not None else counted


def method_spread(fairs: list[Column]) -> Column:
    """How far the margin methods disagree on a selection."""
    return F.greatest(*fairs) - F.least(*fairs)


def fair_rank(by: list[str]) -> Column:
    """1 for the likeliest selection of a market, the first if equal."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("fair"), "pick"))


def form(long: DataFrame, stats: tuple[str, ...], sizes: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Means of a team's last values strictly before each match; matches without a value do not count among the last.

    long: team, played, match_id and the stats. A count of known values numbers them, so a frame of
    known rows needs no second sort.
    """
    for s in stats:
        seen = F.count(s).over(Window.partitionBy("team").orderBy("played", "match_id").rowsBetween(Window.unboundedPreceding, -1))
        long = long.withColumn(f"n_{s}", seen)
        w = Window.partitionBy("team").orderBy(F.col(f"n_{s}"))
        for k in sizes:
            # A known row with number n has n known ones before it: those numbered n - k to n - 1.
            long = long.withColumn(f"{s}_r{k}", F.avg(s).over(w.rangeBetween(-k, -1)))
        long = long.drop(f"n_{s}")
    return long


def assert_no_leak(features: tuple[str, ...], labels: tuple[str, ...] = LABELS) -> None:
    """A feature that is a label, or is made of one by its name, must not reach a model."""
    bad = [f for f in features if f in labels or any(f.startswith(x + "_") and f.rsplit("_", 1)[-1][:1] != "r" for x in labels)]
    if bad:
        raise ValueError(f"features made of labels: {bad}")


def assert_train_only(seasons: list, holdout: list) -> None:
    if both := sorted(set(seasons) & set(holdout)):
        raise ValueError(f"holdout seasons must not be used here: {both}")


def folds(seasons: list) -> list[tuple[list, object, object]]:
    """Expanding folds: (the seasons to fit on, the next one to calibrate on, the one after to predict); the first two are never predicted."""
    ordered = sorted(seasons)
    return [(ordered[: k - 1], ordered[k - 1], ordered[k]) for k in range(2, len(ordered))]


def stages(kind: str, numbers=NUMBERS, words=WORDS, params: dict | None = None) -> list:
    """Vocabulary and medians from the fitted slice alone, then the model: logistic or boosted trees."""
    index = StringIndexer(inputCols=list(words), outputCols=[f"{w}_i" for w in words], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{w}_i" for w in words], outputCols=[f"{w}_h" for w in words])
    fill = Imputer(strategy="median", inputCols=list(numbers), outputCols=[f"{n}_f" for n in numbers])
    join = VectorAssembler(inputCols=[*(f"{n}_f" for n in numbers), *(f"{w}_{'h' if kind == 'logistic' else 'i'}" for w in words)], outputCol="features", handleInvalid="keep")
    model = LogisticRegression(labelCol="y", regParam=0.01, **(params or {})) if kind == "logistic" else GBTClassifier(labelCol="y", maxIter=15, maxDepth=3, seed=7, maxBins=64, **(params or {}))
    return [index, *([hot] if kind == "logistic" else []), fill, join, model]


def fit(rows: DataFrame, kind: str = "logistic", **params):
    """A model of y by the features."""
    assert_no_leak((*NUMBERS, *WORDS))
    return Pipeline(stages=stages(kind, params=params or None)).fit(rows)


def score(model, rows: DataFrame, fitted: dict | None = None) -> DataFrame:
    """rows with raw, the model's chance, and score, the calibrated one."""
    out = model.transform(rows).withColumn("raw", vector_to_array("probability")[1]).select(*rows.columns, "raw")
    return out.withColumn("score", calibrated(F.col("raw"), fitted) if fitted else F.col("raw"))


def out_of_fold(rows: DataFrame, seasons: list, kind: str = "logistic") -> DataFrame:
    """Calibrated scores of every season but the first two: the model is fitted on the seasons before, its calibrator on one that the model has not seen, and neither has seen the season itself. Each fit scans its rows many times: hand in rows that are cut; what a calibrator is fitted on is cut here."""
    every = None
    for before, between, season in folds(seasons):
        model = fit(rows.where(F.col("season").isin(before)), kind)
        fitted = fit_calibrator(cut(score(model, rows.where(F.col("season") == between)).select(F.col("raw").alias("p"), F.col("y"))))
        one = score(model, rows.where(F.col("season") == season), fitted)
        every = one if every is None else every.unionByName(one)
    return every


def fold_metrics(scored: DataFrame) -> DataFrame:
    """Rows, log loss and the base rate's, by season."""
    base = F.avg("y")
    return scored.groupBy("season").agg(F.count("*").alias("n"), F.avg(log_loss(F.col("score"), F.col("y"))).alias("loss"), (-(base * F.log(base) + (1 - base) * F.log(1 - base))).alias("base_loss"))


def drawn_params(draws: int, seed: int = 7) -> list[dict]:
    """Random settings of the trees, the same for the same seed."""
    rng = random.Random(seed)
    return [{"maxDepth": rng.randint(2, 4), "stepSize": round(math.exp(rng.uniform(math.log(0.03), math.log(0.3))), 4), "subsamplingRate": round(rng.uniform(0.5, 1.0), 2)} for _ in range(draws)]


def importances(model) -> list[tuple[str, float]]:
    """Weight of each input of a tree model, the largest first."""
    names = [*NUMBERS, *WORDS]
    return sorted(zip(names, map(float, model.stages[-1].featureImportances.toArray()), strict=False), key=lambda x: -x[1])


#: Least bets of a holdout whose numbers may adopt a model; a fixed value, never a manifest's own.
LEAST_HOLDOUT = 300


def adoption_faults(manifest: dict) -> list[str]:
    """Which of the four rules the holdout's own numbers break; a missing, wrong or non-finite number breaks all."""
    try:
        meta, control, volume = (manifest["holdout"][k] for k in ("meta", "control", "volume"))
        point, error, roi, n = float(meta["inc_clv_max"]["point"]), float(meta["inc_clv_max"]["boot_se"]), float(meta["roi"]), int(meta["n"])
        base, other = float(volume["roi"]), float(control["inc_clv_max"]["point"])
    except (KeyError, TypeError, ValueError):
        return ["holdout"]
    if not all(map(math.isfinite, (point, error, roi, base, other))):
        return ["holdout"]
    rules = {"increment": point - 2 * error > 0, "return": roi >= base, "control": point > other, "bets": n >= LEAST_HOLDOUT}
    return [name for name, good in rules.items() if not good]


def adopted(manifest: dict) -> bool:
    """Whether a manifest says that its model is adopted and its holdout's numbers bear that out."""
    return manifest.get("verdict") == "ADOPT" and not adoption_faults(manifest)


def operating_point(spark: SparkSession, path: str) -> float | None:
    """The cut of a manifest's file, null unless the model is adopted."""
    found = spark.read.option("wholetext", True).text(path).first()
    manifest = json.loads(found.value) if found else {}
    point = manifest.get("operating_point") or {}
    return float(point["q"]) if adopted(manifest) and point.get("q") is not None else None


def quality_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and the share of nulls of each column, in one pass."""
    wide = rows.agg(F.count("*").alias("n"), *(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), "n", F.round(F.col(c), 6).alias("null_rate")) for c in columns))).alias("r")).select("r.*")


def unmatched_names(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Names by league that a lookup does not know, and how often they come."""
    names = rows.select("league", F.explode(F.array("home", "away")).alias("team"))
    return names.join(known.select("league", "team").distinct(), ["league", "team"], "left_anti").groupBy("league", "team").agg(F.count("*").alias("n"))
