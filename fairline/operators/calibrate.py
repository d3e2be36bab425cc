"""Calibration of chances: fitted maps and how they apply, reliability by bands, drift over periods."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.operators.reports import calibration

EDGE = 1e-6


def clipped(p: Column, edge: float = EDGE) -> Column:
    return F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(p: Column, slope: float, shift: float) -> Column:
    return clipped(sigmoid(slope * p + shift))


def beta_map(p: Column, a: float, b: float, c: float) -> Column:
    """sigmoid(a ln p - b ln(1 - p) + c)."""
    q = clipped(p)
    return clipped(sigmoid(a * F.log(q) - b * F.log(1 - q) + c))


def isotonic(p: Column, xs: list[float], ys: list[float]) -> Column:
    """Straight lines between breakpoints, flat beyond them."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        share = (p - xs[i - 1]) / (xs[i] - xs[i - 1]) if xs[i] > xs[i - 1] else F.lit(1.0)
        out = F.when(p <= xs[i], ys[i - 1] + (ys[i] - ys[i - 1]) * share).otherwise(out)
    return clipped(F.when(p <= xs[0], float(ys[0])).otherwise(out))


def calibrated(p: Column, fitted: dict) -> Column:
    """A fitted map applied: kind platt, beta or isotonic, and its numbers."""
    kind = fitted["kind"]
    if kind == "platt":
        return platt(p, fitted["coef"], fitted["intercept"])
    if kind == "beta":
        return beta_map(p, fitted["a"], fitted["b"], fitted["c"])
    if kind == "isotonic":
        return isotonic(p, fitted["x"], fitted["y"])
    raise ValueError(f"unknown calibrator: {kind}")


def fitted_logistic(rows: DataFrame, features: list[Column], *, ridge: float = 1e-9, iterations: int = 50, tolerance: float = 1e-9) -> list[float]:
    """Coefficients of a logistic regression with an intercept last, by Newton's steps; every step is one aggregation of a few sums. rows: y and what the features name."""
    k = len(features) + 1
    beta = [0.0] * k
    kept = rows.select(F.col("y").cast("double").alias("y"), *(f.alias(f"x{i}") for i, f in enumerate(features))).withColumn(f"x{k - 1}", F.lit(1.0))
    for _ in range(iterations):
        eta = F.lit(0.0)
        for i, b in enumerate(beta):
            eta = eta + b * F.col(f"x{i}")
        p = sigmoid(eta)
        sums = [F.sum((F.col("y") - p) * F.col(f"x{i}")) for i in range(k)] + [F.sum(p * (1 - p) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i + 1)]
        found = kept.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        if found[0] is None:
            return beta
        gradient, hessian, at = list(found[:k]), [[0.0] * k for _ in range(k)], k
        for i in range(k):
            for j in range(i + 1):
                hessian[i][j] = hessian[j][i] = found[at] + (ridge if i == j else 0.0)
                at += 1
        move = solved(hessian, gradient)
        beta = [b + m for b, m in zip(beta, move, strict=True)]
        if max(map(abs, move)) < tolerance:
            break
    return beta


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """a x = b for a few unknowns."""
    n = len(b)
    m = [[*row, x] for row, x in zip(a, b, strict=True)]
    for i in range(n):
        top = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[top] = m[top], m[i]
        if abs(m[i][i]) < 1e-14:
            return [0.0] * n
        for r in range(i + 1, n):
            f = m[r][i] / m[i][i]
            m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    out = [0.0] * n
    for i in range(n - 1, -1, -1):
        out[i] = (m[i][n] - sum(m[i][j] * out[j] for j in range(i + 1, n))) / m[i][i]
    return out


def fit_platt(rows: DataFrame) -> dict:
    """rows: p, y."""
    slope, shift = fitted_logistic(rows, [F.col("p")])
    return {"kind": "platt", "coef": slope, "intercept": shift}


def fit_beta(rows: DataFrame) -> dict:
    """The three-number map; a negative coefficient is dropped and the other fitted again. rows: p, y."""
    q = clipped(F.col("p"))
    first, second = F.log(q), -F.log(1 - q)
    a, b, c = fitted_logistic(rows, [first, second])
    if a < 0:
        a, (b, c) = 0.0, fitted_logistic(rows, [second])
    elif b < 0:
        b, (a, c) = 0.0, fitted_logistic(rows, [first])
    return {"kind": "beta", "a": a, "b": b, "c": c}


def fit_isotonic(rows: DataFrame) -> dict:
    """Breakpoints of the pooled-adjacent-violators fit. rows: p, y."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol="p", labelCol="y").fit(rows.select("p", F.col("y").cast("double").alias("y"), F.lit(1.0).alias("weight")))
    return {"kind": "isotonic", "x": [float(x) for x in model.boundaries], "y": [float(x) for x in model.predictions]}


def fit_calibrator(rows: DataFrame, *, enough: int = 1000) -> dict:
    """Isotonic with enough rows, else Platt's."""
    return fit_isotonic(rows) if rows.count() >= enough else fit_platt(rows)


def log_loss(p: Column, y: Column) -> Column:
    q = clipped(p, 1e-12)
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def ranked_calibrators(fit: DataFrame, held: DataFrame) -> DataFrame:
    """(kind, log_loss) of each map fitted on one set and judged on another, the best first."""
    maps = [("none", None), ("platt", fit_platt(fit)), ("beta", fit_beta(fit)), ("isotonic", fit_isotonic(fit))]
    losses = [F.avg(log_loss(calibrated(F.col("p"), m) if m else F.col("p"), F.col("y"))).alias(k) for k, m in maps]
    wide = held.agg(*losses)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("log_loss")) for k, _ in maps))).alias("r")).select("r.*").orderBy("log_loss")


def band_reliability(rows: DataFrame, *, low: float = 0.1, high: float = 0.9, bins: int = 10) -> DataFrame:
    """The calibration report of the rows between two quantiles of their own prices. rows: p, won, odds."""
    ends = rows.agg(F.percentile("odds", low).alias("lo"), F.percentile("odds", high).alias("hi"))
    return calibration(rows.crossJoin(F.broadcast(ends)).where("odds BETWEEN lo AND hi"), bins)  # one row of ends beside each


def quantile_bins(rows: DataFrame, *, bins: int = 10) -> DataFrame:
    """Mean chance, share won and their gap by bins of equal counts. rows: p, won. Equal edges are one."""
    edges = rows.agg(F.array_distinct(F.percentile("p", F.array(*(F.lit(i / bins) for i in range(1, bins))))).alias("edges"))
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("p"))))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("won"), 6).alias("rate"), F.round(F.abs(F.avg("p") - F.avg("won")), 6).alias("gap"))


def fold_sums(rows: DataFrame, betas: dict[int, list[float]], active: dict[int, list[bool]], k: int) -> dict[int, tuple]:
    """Newton's sums of every fold at its own coefficients, in one scan: a row counts for each fold after its period. rows: period_no, y, x0 to xk-1."""
    params = F.array(*(F.struct(F.lit(t).alias("fold"), *(F.lit(float(b)).alias(f"b{i}") for i, b in enumerate(betas[t])), *(F.lit(float(a)).alias(f"a{i}") for i, a in enumerate(active[t]))) for t in sorted(betas)))
    each = rows.select("y", *(f"x{i}" for i in range(k)), F.explode(F.filter(params, lambda f: f["fold"] > F.col("period_no"))).alias("f"))
    each = each.select("y", F.col("f.fold").alias("fold"), *((F.col(f"x{i}") * F.col(f"f.a{i}")).alias(f"x{i}") for i in range(k)), sigmoid(sum((F.col(f"f.b{i}") * F.col(f"x{i}") for i in range(k)), F.lit(0.0))).alias("p"))
    sums = [F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(k)] + [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i + 1)]
    return {r[0]: tuple(r[1:]) for r in each.groupBy("fold").agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).collect()}


def fitted_folds(rows: DataFrame, folds: list[int], active: dict[int, list[bool]], k: int, *, ridge: float = 1e-9, iterations: int = 50, tolerance: float = 1e-9) -> dict[int, list[float]]:
    """Coefficients of a logistic regression for every fold, each on all rows of earlier periods; all folds take a step together, so scans do not grow with their number. Inactive coefficients stay 0."""
    betas = {t: [0.0] * k for t in folds}
    open_ = set(folds)
    for _ in range(iterations):
        if not open_:
            break
        found = fold_sums(rows, {t: betas[t] for t in open_}, active, k)
        for t in sorted(open_):
            sums = found.get(t)
            if sums is None:
                open_.discard(t)
                continue
            gradient, hessian, at = list(sums[:k]), [[0.0] * k for _ in range(k)], k
            for i in range(k):
                for j in range(i + 1):
                    hessian[i][j] = hessian[j][i] = sums[at] + (ridge if i == j else 0.0)
                    at += 1
            move = [m if a else 0.0 for m, a in zip(solved(hessian, gradient), active[t], strict=True)]
            betas[t] = [b + m for b, m in zip(betas[t], move, strict=True)]
            if max(map(abs, move)) < tolerance:
                open_.discard(t)
    return betas


def beta_folds(rows: DataFrame, folds: list[int]) -> dict[int, dict]:
    """The beta map of every fold, fitted on all rows of earlier periods; a negative coefficient is dropped and the other fitted again. rows: period_no, p, y."""
    q = clipped(F.col("p"))
    kept = rows.select("period_no", F.col("y").cast("double").alias("y"), F.log(q).alias("x0"), (-F.log(1 - q)).alias("x1"), F.lit(1.0).alias("x2")).cache()
    try:
        betas = fitted_folds(kept, folds, {t: [True] * 3 for t in folds}, 3)
        again = {t: [b[0] >= 0, b[0] < 0 or b[1] >= 0, True] for t, b in betas.items() if b[0] < 0 or b[1] < 0}
        betas |= fitted_folds(kept, list(again), again, 3) if again else {}
    finally:
        kept.unpersist()
    return {t: {"kind": "beta", "a": b[0], "b": b[1], "c": b[2]} for t, b in betas.items()}


def walk_forward_folds(rows: DataFrame, *, least_train: int = 2000, least_test: int = 200) -> DataFrame:
    """(period, n, raw, fitted): log loss of each period with enough rows, without and with the beta map of all earlier periods. rows: period, p, y.

    One scan counts the periods, one each of Newton's steps, of all folds at once, and one takes the losses; a row a period reaches the driver.
    """
    counts = [(r.period, r.n) for r in rows.groupBy("period").agg(F.count("*").alias("n")).orderBy("period").collect()]
    before, folds = 0, []
    for k, (_, n) in enumerate(counts):
        if before >= least_train and n >= least_test:
            folds.append(k)
        before += n
    if not folds:
        return rows.sparkSession.createDataFrame([], "period string, n long, raw double, fitted double")
    number = F.create_map(*(F.lit(x) for k, (period, _) in enumerate(counts) for x in (period, k)))
    numbered = rows.where("period IS NOT NULL").withColumn("period_no", number[F.col("period")])
    maps = beta_folds(numbered, folds)
    of = F.create_map(*(x for t, m in maps.items() for x in (F.lit(t), F.struct(*(F.lit(float(m[c])).alias(c) for c in "abc")))))
    tested = numbered.where(F.col("period_no").isin(folds)).withColumn("m", of[F.col("period_no")])
    fitted = beta_map(F.col("p"), F.col("m.a"), F.col("m.b"), F.col("m.c"))
    return tested.groupBy("period").agg(F.count("*").alias("n"), F.avg(log_loss(F.col("p"), F.col("y"))).alias("raw"), F.avg(log_loss(fitted, F.col("y"))).alias("fitted"))


def walk_forward_gain(rows: DataFrame, *, least_train: int = 2000, least_test: int = 200, warrant: float = 0.005) -> DataFrame:
    """What a beta map fitted on all earlier periods gains in each period, and whether that warrants it: the pooled gain is enough and no period loses. rows: period, p, y."""
    folds = walk_forward_folds(rows, least_train=least_train, least_test=least_test)
    gain = F.sum(F.col("n") * (F.col("raw") - F.col("fitted"))) / F.sum(F.col("n") * F.col("raw"))
    return folds.agg(F.count("*").alias("folds"), gain.alias("gain"), F.coalesce((gain >= warrant) & (F.min(F.col("raw") - F.col("fitted")) > 0), F.lit(False)).alias("warranted"))


def t_cdf(t: float, df: int) -> float:
    """Student's distribution for whole degrees of freedom, in closed form."""
    angle = math.atan2(t, math.sqrt(df))
    if df % 2:
        total, term = angle, math.sin(angle) * math.cos(angle)
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= math.cos(angle) ** 2 * (2 * k) / (2 * k + 1)
        return 0.5 + total / math.pi
    total, term = 0.0, math.sin(angle)
    for k in range(1, df // 2 + 1):
        total += term
        term *= math.cos(angle) ** 2 * (2 * k - 1) / (2 * k)
    return 0.5 + total / 2


def t_quantile(p: float, df: int) -> float:
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def t_bound(df: Column, p: float = 0.975, exact: int = 100) -> Column:
    """The quantile of Student's distribution: exact for few degrees of freedom, by an expansion of the normal one beyond."""
    z = 1.959963984540054 if p == 0.975 else t_quantile(p, 20000)
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    far = z + g[0] / df + g[1] / (df * df) + g[2] / (df * df * df)
    near = F.array(*(F.lit(t_quantile(p, d)) for d in range(1, exact + 1)))
    return F.when(df < 1, None).when(df <= exact, F.get(near, (df - 1).cast("int"))).otherwise(far)
