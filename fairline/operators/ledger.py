"""The exposure ledger: grants in order under a day's and an event's cap, by composed clamps.

A reservation moves what is used up by at most its fraction and not over the cap, a release down and
not under zero: both are x -> min(max(x + a, lo), hi), and two of them in a row are one of the same
kind. So a day's chain is cut into parts, each part composed by itself, and what is used before a
part follows from the parts before it: one short row a part. No task holds a day, and no row all of its requests.

With an event's cap as well, the event's chains come first as if the day had room; the day's chain over
their grants is then exact, as it takes nothing once it is full. That needs days without
releases; a day with releases and an event cap, or that began over its cap and releases, is
folded in order by one task, a row at a time.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.functions.odds import stake_amount
from fairline.session import cut

AROUND = ("a", "lo", "hi")


def composed(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The clamp that does all before each row since its key's head: rows of (a, lo, hi); and each key's whole clamp in the row after its last."""
    out = np.empty((len(a) + 1, 3))
    x, y, z = 0.0, -math.inf, math.inf
    for i, (da, dl, dh, h) in enumerate(zip(a.tolist(), lo.tolist(), hi.tolist(), head.tolist(), strict=True)):
        if h:
            x, y, z = 0.0, -math.inf, math.inf
        out[i] = x, y, z
        x, y, z = x + da, min(max(y + da, dl), dh), min(max(z + da, dl), dh)
    out[len(a)] = x, y, z
    return out


def clamped(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with `moved`: how much each row's clamp (a, lo, hi) moves its key's value, in order; start: the value before the key's first row."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("ba", "blo", "bhi")), T.StructField("part", T.IntegerType())])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, carry = TaskContext.get().partitionId(), None, None
        for pdf in batches:
            keys = list(pdf[key].itertuples(index=False, name=None))
            head = np.array([True] + [x != y for x, y in zip(keys[1:], keys[:-1], strict=True)])
            a, lo, hi = (pdf[c].to_numpy(float) for c in AROUND)
            if keys[0] == last:  # the batch goes on with a key: its clamp so far comes first
                a, lo, hi, head = (np.concatenate([[v], x]) for v, x in zip((*carry, True), (a, lo, hi, head), strict=True))
                head[1] = False
                out = composed(a, lo, hi, head)[1:]
            else:
                out = composed(a, lo, hi, head)
            last, carry = keys[-1], out[-1]
            pdf["ba"], pdf["blo"], pdf["bhi"] = out[:-1].T
            pdf["part"] = np.int32(part)
            yield pdf

    local = cut(rows.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order).mapInPandas(compose, schema))
    clamp = lambda x, a, lo, hi: F.least(F.greatest(x + a, lo), hi)
    # A part's whole clamp is that before its last row, and the row's own.
    whole = F.struct((F.col("ba") + F.col("a")).alias("a"), clamp(F.col("blo"), F.col("a"), F.col("lo"), F.col("hi")).alias("lo"), clamp(F.col("bhi"), F.col("a"), F.col("lo"), F.col("hi")).alias("hi"))
    ends = local.groupBy(*key, "part").agg(F.max_by(whole, F.struct(*order)).alias("w"), F.first("start").alias("start"))
    row = F.array_sort(F.collect_list(F.struct("part", "w")))
    fold = F.aggregate("parts", F.struct(F.col("start").alias("x"), F.array().cast("array<struct<part:int,x:double>>").alias("out")), lambda s, p: F.struct(clamp(s["x"], p["w"]["a"], p["w"]["lo"], p["w"]["hi"]).alias("x"), F.array_append(s["out"], F.struct(p["part"].alias("part"), s["x"].alias("x"))).alias("out")))
    entry = ends.groupBy(*key).agg(row.alias("parts"), F.first("start").alias("start")).select(*key, F.explode(fold["out"]).alias("e")).select(*key, "e.part", F.col("e.x").alias("entry"))
    at = clamp(F.col("entry"), F.col("ba"), F.col("blo"), F.col("bhi"))
    return local.join(entry, [*key, "part"]).withColumn("used", at).withColumn("moved", clamp(F.col("used"), F.col("a"), F.col("lo"), F.col("hi")) - F.col("used")).select(*names, "moved")


def folded(requests: DataFrame, taken: DataFrame, *, day_cap: float, event_cap: float | None, order: list[str]) -> DataFrame:
    """Grants by one pass over each day in order; taken: day, event_id, used. A day's rows go through one task, a row at a time, with what is used by event."""
    schema = T.StructType([*requests.schema.fields, T.StructField("granted", T.DoubleType())])
    both = requests.withColumn("first", F.lit(1)).unionByName(taken.select("day", "event_id", F.col("used").alias("fraction"), F.lit(0).alias("first")), allowMissingColumns=True)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, used, events = None, 0.0, {}
        for pdf in batches:
            grants = []
            for d, e, f, first in zip(pdf["day"], pdf["event_id"], pdf["fraction"], pdf["first"], strict=True):
                if d != day:
                    day, used, events = d, 0.0, {}
                if not first:
                    g = f
                elif f < 0:
                    g = -min(-f, used)
                else:
                    g = min(f, max(day_cap - used, 0.0))
                    g = min(g, max(event_cap - events.get(e, 0.0), 0.0)) if event_cap is not None else g
                used, events[e] = used + g, max(events.get(e, 0.0) + (f if f < 0 and first else g), 0.0)
                grants.append(g)
            pdf["granted"] = grants
            yield pdf[pdf["first"] == 1][[f.name for f in schema]]

    return both.repartition("day").sortWithinPartitions("day", "first", *order).mapInPandas(walk, schema)


def reserved(requests: DataFrame, *, day_cap: float, event_cap: float | None = None, preloaded: DataFrame | None = None, order: list[str]) -> DataFrame:
    """requests with what is granted of each, in order within its day: what fits in the day's room and the event's, after what was taken before.

    requests: day, event_id, fraction and the order's columns, which tell a day's rows apart; preloaded: day, event_id,
    fraction already taken. A negative fraction gives back, at most what is used.
    """
    names = requests.columns
    taken = preloaded if preloaded is not None else requests.select("day", "event_id", "fraction").limit(0)
    by_event = taken.groupBy("day", "event_id").agg(F.sum("fraction").alias("used"))
    by_day = taken.groupBy("day").agg(F.sum("fraction").alias("day_used"))
    kinds = requests.groupBy("day").agg(F.max((F.col("fraction") < 0).cast("int")).alias("releases")).join(by_day, "day", "left")
    alone = (F.col("releases") == 1) & (F.lit(event_cap is not None) | (F.coalesce("day_used", F.lit(0.0)) > day_cap))
    judged = requests.join(kinds.select("day", F.coalesce("day_used", F.lit(0.0)).alias("day_used"), alone.alias("alone")), "day")
    composable, single = judged.where("NOT alone").drop("alone"), judged.where("alone").select(*names)
    infinite = F.lit(math.inf)
    release = F.col("fraction") < 0
    if event_cap is not None:
        own = composable.join(by_event, ["day", "event_id"], "left").withColumns({"start": F.least(F.coalesce("used", F.lit(0.0)), F.lit(event_cap)), "a": F.col("fraction"), "lo": -infinite, "hi": F.lit(event_cap)}).drop("used")
        composable = clamped(own, ["day", "event_id"], order).withColumn("asked", F.col("moved")).drop("moved", "start", *AROUND)
    else:
        composable = composable.withColumn("asked", F.col("fraction"))
    chain = composable.withColumns({"start": F.least(F.col("day_used"), F.lit(day_cap)), "a": F.col("asked"), "lo": F.when(release, 0.0).otherwise(-infinite), "hi": F.when(release, infinite).otherwise(F.lit(day_cap))})
    granted = clamped(chain, ["day"], order).select(*names, F.col("moved").alias("granted"))
    return granted.unionByName(folded(single, by_event.join(single.select("day").distinct(), "day", "left_semi"), day_cap=day_cap, event_cap=event_cap, order=order))


def seeded(picks: DataFrame) -> DataFrame:
    """(day, event_id, fraction): what kept premium picks have taken of each day and event."""
    return picks.where("tier = 'premium'").groupBy("day", "event_id").agg(F.sum("fraction").alias("fraction"))


def written_stakes(picks: DataFrame, *, bankroll: float, day_cap: float, event_cap: float | None = None, preloaded: DataFrame | None = None, order: list[str]) -> DataFrame:
    """picks with granted, stake, clipped and skipped: what the ledger lets each take once it is known what became of it.

    outcome: an inserted or upgraded pick reserves its fraction, a duplicate or one that was not written
    nothing, and keeps it. A new pick with nothing granted is skipped; an upgraded one never is.
    """
    asks = F.col("outcome").isin("inserted", "upgraded")
    grants = reserved(picks.where(asks).select("day", "event_id", "fraction", *order), day_cap=day_cap, event_cap=event_cap, preloaded=preloaded, order=order).select("day", *order, "granted")
    out = picks.join(grants, ["day", *order], "left").withColumn("granted", F.when(asks, F.col("granted")).otherwise(F.col("fraction")))
    return out.withColumns({"stake": stake_amount(F.col("granted"), bankroll), "clipped": asks & (F.col("granted") < F.col("fraction") - 1e-12), "skipped": (F.col("outcome") == "inserted") & (F.col("granted") <= 0)})
