"""Bootstraps: replicates and paths are the parallel axis, draws follow from hashes, so a rerun gives the same."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.session import cut

#: Chances of a Poisson(1) weight of at most 0, 1, 2, ...
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
#: Positions of a series that a task holds at a time; returns drawn at a time; blocks of a path that are put in a row together.
CHUNK, DRAWN, IN_A_ROW = 4096, 1 << 18, 4096


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def poisson_weight(u: Column) -> Column:
    """How often a cluster stands in a replicate, from a uniform number."""
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out


def replicated(rows: DataFrame, cluster: str, sums: dict[str, Column], *, replicates: int, seed: int = 12, draw=None) -> DataFrame:
    """(replicate, sums): sums over rows, resampled by cluster with Poisson(1) weights.

    Rows are summed by cluster first; a cluster is then one row a replicate, summed map-side. draw:
    the uniform number of a cluster and replicate.
    """
    draw = draw or (lambda c, r: uniform(c, r, F.lit(seed)))
    by_cluster = rows.groupBy(cluster).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    each = by_cluster.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("w", poisson_weight(draw(F.col(cluster), F.col("replicate"))))
    return each.groupBy("replicate").agg(*(F.sum(F.col(n) * F.col("w")).alias(n) for n in sums), F.sum("w").alias("clusters"))


def interval(values: DataFrame, value: Column, alpha: float = 0.05) -> DataFrame:
    """mean, low, high and how many replicates have the value."""
    v = values.select(value.alias("v")).where("v IS NOT NULL")
    return v.agg(F.avg("v").alias("mean"), F.percentile("v", alpha / 2).alias("low"), F.percentile("v", 1 - alpha / 2).alias("high"), F.count("*").alias("replicates"))


def poisson_bootstrap(rows: DataFrame, cluster: str, numerator: str, denominator: str, *, replicates: int = 200, seed: int = 12, draw=None) -> DataFrame:
    """Mean and 95 % interval of sum(numerator)/sum(denominator), resampled by cluster."""
    each = replicated(rows, cluster, {"a": F.col(numerator), "b": F.col(denominator)}, replicates=replicates, seed=seed, draw=draw)
    return interval(each, F.when(F.col("b") != 0, F.col("a") / F.col("b")))


def paired_increment(chosen: DataFrame, base: DataFrame, cluster: str, value: str, *, replicates: int = 200, seed: int = 12, draw=None) -> DataFrame:
    """Interval of the chosen rows' mean value minus the base's on the same draws of clusters; stable says whether enough replicates have both."""
    both = chosen.select(cluster, F.col(value).alias("s"), F.lit(1.0).alias("n"), F.lit(0.0).alias("bs"), F.lit(0.0).alias("bn")).unionByName(base.select(cluster, F.lit(0.0).alias("s"), F.lit(0.0).alias("n"), F.col(value).alias("bs"), F.lit(1.0).alias("bn")))
    each = replicated(both.where("s IS NOT NULL AND bs IS NOT NULL"), cluster, {c: F.col(c) for c in ("s", "n", "bs", "bn")}, replicates=replicates, seed=seed, draw=draw)
    diff = F.when((F.col("n") > 0) & (F.col("bn") > 0), F.col("s") / F.col("n") - F.col("bs") / F.col("bn"))
    return interval(each, diff).withColumn("stable", F.col("replicates") >= max(50, replicates // 2))


def positioned(rows: DataFrame, day: str, order: list[str]) -> DataFrame:
    """rows with position, from 0 in order of day and order. Only rows of one day are sorted together; the days before are a running sum of one row a day, which are broadcast."""
    days = rows.groupBy(day).agg(F.count("*").alias("n")).withColumn("year", F.year(day))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("year").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    years = days.groupBy("year").agg(F.sum("n").alias("n"))
    earlier = years.alias("y").join(years.alias("e"), F.col("e.year") < F.col("y.year"), "left").groupBy("y.year").agg(F.coalesce(F.sum("e.n"), F.lit(0)).alias("earlier"))  # a row a year
    ahead = days.withColumn("inside", inside).join(F.broadcast(earlier), "year").select(day, (F.col("inside") + F.col("earlier")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    return rows.join(F.broadcast(ahead), day).withColumn("position", F.col("ahead") + place - 1).drop("ahead")


def reduced(v: np.ndarray) -> list[np.ndarray]:
    """Total, highest and lowest running sum, and deepest fall from an own running sum, of each row of returns."""
    sums = np.cumsum(v, axis=1)
    return [sums[:, -1], sums.max(1), sums.min(1), (np.maximum.accumulate(sums, axis=1) - sums).max(1)]


def drawn_blocks(cells: DataFrame, returns: DataFrame, names: list[str], n: int, block: int, blocks: int, *, steps: bool) -> DataFrame:
    """(path, k) of each cell with its block of every series: reduced() as columns s, t, l, f and the series' number, or with steps the returns r of the first.

    A cell meets the CHUNK positions that its start is in, and those that a block there reaches
    into, so a drawn return is never a row: only cells and the series are shuffled.
    """
    chunk = max(CHUNK, block)
    part = lambda p: F.floor(p / chunk)
    near = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: part(F.pmod(F.col("position") - i, F.lit(n)))))
    series = returns.select("position", *names, F.explode(F.when(F.col("position") % chunk >= block - 1, F.array(part(F.col("position")))).otherwise(near)).alias("chunk"))
    kinds = "r array<double>" if steps else ", ".join(f"{c}{j} double" for j in range(len(names)) for c in "stlf")

    def draw(cells: pa.Table, series: pa.Table) -> pa.Table:
        path, k, start, position = (t.column(c).to_numpy() for t, c in ((cells, "path"), (cells, "k"), (cells, "start"), (series, "position")))
        order = np.argsort(position)
        position, values = position[order], [series.column(c).to_numpy()[order] for c in names]
        lengths = np.where(k == blocks - 1, n - (blocks - 1) * block, block)  # a path ends with the series' length
        out = []
        for size in np.unique(lengths):
            own = lengths == size
            for some in np.array_split(np.flatnonzero(own), -(-int(own.sum()) * int(size) // DRAWN)):
                at = np.searchsorted(position, (start[some, None] + np.arange(size)) % n)
                found = [pa.array(list(values[0][at]), pa.list_(pa.float64()))] if steps else [pa.array(c) for v in values for c in reduced(v[at])]
                out.append(pa.Table.from_arrays([pa.array(path[some]), pa.array(k[some]), *found], names=["path", "k", *(c.split()[0] for c in kinds.split(", "))]))
        return pa.concat_tables(out) if out else empty

    empty = pa.schema([("path", pa.int64()), ("k", pa.int64()), *((c.split()[0], pa.list_(pa.float64()) if steps else pa.float64()) for c in kinds.split(", "))]).empty_table()
    return cells.withColumn("chunk", part(F.col("start"))).groupBy("chunk").cogroup(series.groupBy("chunk")).applyInArrow(draw, f"path long, k long, {kinds}")


def put_in_a_row(parts: DataFrame, series: int, by: list[str], order: str) -> DataFrame:
    """reduced() of what each key's parts are in order: one row a key."""
    names = [f"{c}{j}" for j in range(series) for c in "stlf"]

    def compose(rows: pa.Table) -> pa.Table:
        at = np.argsort(rows.column(order).to_numpy())
        out = [pa.array(rows.column(c).to_numpy()[:1]) for c in by]
        for j in range(series):
            s, top, low, fall = (rows.column(f"{c}{j}").to_numpy()[at] for c in "stlf")
            ahead = np.cumsum(s) - s
            peak = np.maximum.accumulate(ahead + top)
            across = (peak[:-1] - (ahead + low)[1:]).max(initial=0.0)
            out += [pa.array([x]) for x in (s.sum(), peak[-1], (ahead + low).min(), max(fall.max(), across))]
        return pa.Table.from_arrays(out, names=[*by, *names])

    return parts.groupBy(*by).applyInArrow(compose, ", ".join([*(f"{c} long" for c in by), *(f"{c} double" for c in names)]))


def bootstrap_paths(returns: DataFrame, names: list[str], *, paths: int, block: int, starting: float = 1.0, seed: int = 7, flat: bool = False, draw=None) -> DataFrame:
    """(path, series, terminal, drawdown) of every named series of returns over the same draws; flat: of the first."""
    draw = draw or (lambda p, k: uniform(p, k, F.lit(seed)))
    n = returns.count()
    spark, blocks = returns.sparkSession, -(-n // block) if n else 0
    cells = spark.range(paths * blocks).select(F.floor(F.col("id") / max(blocks, 1)).alias("path"), (F.col("id") % max(blocks, 1)).alias("k"))
    cells = cells.withColumn("start", F.floor(draw(F.col("path"), F.col("k")) * n))
    steps = drawn_blocks(cells, returns, names[:1] if flat else names, max(n, 1), block, blocks, steps=flat)
    if flat:
        return flat_paths(steps, starting).select("path", F.lit(names[0]).alias("series"), "terminal", "drawdown")
    parts = put_in_a_row(steps.withColumn("part", F.floor(F.col("k") / IN_A_ROW)), len(names), ["path", "part"], "k")
    whole = put_in_a_row(parts, len(names), ["path"], "part")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("series"), *(F.col(f"{x}{j}").alias(x) for x in "slf")) for j, c in enumerate(names)))).alias("e")
    return whole.select("path", each).select("path", "e.series", (starting * F.exp("e.s")).alias("terminal"), (1 - F.exp(-F.greatest("e.f", -F.col("e.l"), F.lit(0.0)))).alias("drawdown"))


def flat_paths(steps: DataFrame, starting: float) -> DataFrame:
    """Terminal wealth and worst fall of blocks (path, k, r) of units won at a fixed stake; a fall is a share of the wealth at its peak."""
    sums = steps.select("path", "k", "r", F.aggregate("r", F.struct(F.lit(0.0).alias("sum"), F.lit(-math.inf).alias("top")), lambda s, r: F.struct((s["sum"] + r).alias("sum"), F.greatest(s["top"], s["sum"] + r).alias("top"))).alias("b"))
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("b.sum").over(before), F.lit(0.0)))
    ahead = ahead.withColumn("peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("ahead") + F.col("b.top")).over(before), F.lit(0.0))))

    def step(s: Column, r: Column) -> Column:
        now = s["now"] + r
        top = F.greatest(s["top"], now)
        return F.struct(now.alias("now"), top.alias("top"), F.greatest(s["fall"], (top - now) / (starting + top)).alias("fall"))

    walked = ahead.withColumn("w", F.aggregate("r", F.struct(F.col("ahead").alias("now"), F.col("peak").alias("top"), F.lit(0.0).alias("fall")), step))
    return walked.groupBy("path").agg((starting + F.sum("b.sum")).alias("terminal"), F.max("w.fall").alias("drawdown"))


def block_bootstrap_paths(returns: DataFrame, *, paths: int = 500, block: int = 20, starting: float = 1.0, seed: int = 7, flat: bool = False, draw=None) -> DataFrame:
    """Terminal wealth and worst drawdown of circular block bootstrap paths over one ordered series.

    returns: (position, log_return), positions 0 to n - 1; flat: returns are units won at a fixed
    stake instead of logarithms. A path's blocks meet the series by chunks of positions; a block is reduced to
    its total, extremes and inner drawdown where it is drawn, and blocks are put in a row by parts of a path.
    """
    return bootstrap_paths(returns, ["log_return"], paths=paths, block=block, starting=starting, seed=seed, flat=flat, draw=draw).drop("series")


def path_summary(paths: DataFrame, *, ruin: float = 0.5) -> DataFrame:
    """Median and outer percentiles of terminal wealth, the 95th of drawdown, share of paths ruined."""
    return paths.agg(
        F.median("terminal").alias("median"), F.percentile("terminal", 0.05).alias("p5"), F.percentile("terminal", 0.95).alias("p95"), F.percentile("drawdown", 0.95).alias("drawdown_p95"),
        F.avg((F.col("terminal") <= ruin).cast("double")).alias("ruined"), F.count("*").alias("paths"),
    )


def policy_paths(picks: DataFrame, policies: dict[str, Column], *, paths: int = 500, block: int = 20, seed: int = 7) -> DataFrame:
    """Summary of every staking policy over the same paths. picks: position, unit (profit of a unit stake); a policy: share of wealth staked on a pick."""
    logs = cut(picks.select("position", *(F.log(F.greatest(1 + share * F.col("unit"), F.lit(1e-12))).alias(f"r{i}") for i, share in enumerate(policies.values()))))
    found = bootstrap_paths(logs, [f"r{i}" for i in range(len(policies))], paths=paths, block=block, seed=seed)
    found, every = cut(found), None
    for i, name in enumerate(policies):
        one = path_summary(found.where(F.col("series") == f"r{i}")).withColumn("policy", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return every


def recommended_policy(summary: DataFrame, default: str, *, growth_cost: float = 0.02, less_drawdown: float = 0.01) -> DataFrame:
    """Whether each variant passes (a smaller drawdown at an acceptable cost of growth), and which is chosen: the safest that passes, else the default."""
    base = summary.where(F.col("policy") == default).select(F.col("median").alias("base_median"), F.col("drawdown_p95").alias("base_drawdown"))
    judged = summary.crossJoin(F.broadcast(base))  # one row of the summary beside each
    cheap = F.col("median") >= F.col("base_median") * (1 - growth_cost)
    passes = (F.col("policy") != default) & cheap & (F.col("drawdown_p95") <= F.col("base_drawdown") - less_drawdown)
    judged = judged.withColumn("passes", passes)
    best = judged.where("passes").agg(F.min_by("policy", F.struct("drawdown_p95", "policy")).alias("best"))
    return judged.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("policy") == F.coalesce("best", F.lit(default))).drop("best", "base_median", "base_drawdown")
