"""The exchange's market streams, catalogues and books.

A stream's state is not folded message by message: the last price before the first message that says in-play is an
aggregate over positions, so a market is reduced map-side and any number of markets run side by side.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions.odds import parsed_odds
from fairline.operators.resolve import normalized

#: The draw's runner, and those of over and under 2.5 goals.
DRAW, OVER, UNDER = 58805, 47973, 47972
RUNNER = "struct<id: bigint, name: string, sortPriority: int, status: string, bsp: string>"
DEFINITION = f"struct<eventTypeId: string, eventName: string, marketType: string, marketTime: string, status: string, bspReconciled: boolean, inPlay: boolean, competition: struct<name: string>, runners: array<{RUNNER}>>"
MESSAGE = f"struct<op: string, pt: bigint, mc: array<struct<id: string, marketDefinition: {DEFINITION}, rc: array<struct<id: bigint, bdatb: array<array<string>>, batb: array<array<string>>, ltp: string>>>>>"


def best_back(change: Column) -> Column:
    """The best price to back of a runner's change: of the displayed ladder, else the raw one, else the last trade."""
    level = lambda ladder: parsed_odds(F.get(F.get(ladder, 0), 1))
    return F.coalesce(level(change["bdatb"]), level(change["batb"]), parsed_odds(change["ltp"]))


def utc_time(text: Column) -> Column:
    """An ISO time, UTC where it names no zone."""
    return F.try_to_timestamp(F.when(text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z"))))


def market_closes(lines: DataFrame, *, event_type: str | None = None, market_types: tuple[str, ...] = ()) -> DataFrame:
    """A row a runner of each market: close (the exchange's starting price, else the last price before in-play), and the market's facts.

    lines: file (one market a file), seq (position of the line), value. Lines that are no JSON or no market
    change are skipped; markets without runners have no rows.
    """
    m = lines.withColumn("m", F.from_json("value", MESSAGE)).where("m.op = 'mcm'")
    c = m.select("file", "seq", "m.pt", F.posexplode("m.mc").alias("i", "c")).withColumn("at", F.struct("seq", "i"))
    d = F.col("c.marketDefinition")
    facts = c.groupBy("file").agg(F.max_by("c.id", F.when(F.col("c.id").isNotNull(), F.col("at"))).alias("market_id"), F.max_by(d, F.when(d.isNotNull(), F.col("at"))).alias("d"), F.min(F.when(d["inPlay"], F.struct("at", "pt"))).alias("live")).where("d IS NOT NULL")
    if event_type:
        facts = facts.where(F.col("d.eventTypeId") == event_type)
    if market_types:
        facts = facts.where(F.col("d.marketType").isin(*market_types))
    prices = c.select("file", "at", F.posexplode("c.rc").alias("j", "r")).select("file", "at", "j", F.col("r.id").alias("id"), best_back(F.col("r")).alias("price")).where("price IS NOT NULL")
    before = prices.join(facts.select("file", F.col("live.at").alias("live_at")), "file").where("live_at IS NULL OR at < live_at")
    last = before.groupBy("file", "id").agg(F.max_by("price", F.struct("at", "j")).alias("last"))
    runners = facts.select("file", "market_id", "d", F.col("live.pt").alias("live_pt"), F.explode("d.runners").alias("r")).where("r.id IS NOT NULL")
    full = runners.withColumn("id", F.col("r.id")).join(last, ["file", "id"], "left")
    bsp = parsed_odds(F.col("r.bsp"))
    return full.select(
        F.coalesce("market_id", F.lit("")).alias("market_id"), F.col("d.eventTypeId").alias("event_type"), F.col("d.eventName").alias("event_name"), F.col("d.competition.name").alias("competition"), F.col("d.marketType").alias("market_type"),
        utc_time(F.col("d.marketTime")).alias("kickoff"), F.timestamp_millis("live_pt").alias("in_play"), (F.col("d.status") == "CLOSED").alias("settled"), F.coalesce("d.bspReconciled", F.lit(False)).alias("reconciled"),
        F.col("id").alias("selection_id"), F.col("r.name").alias("name"), F.col("r.sortPriority").alias("priority"), bsp.alias("bsp"), F.coalesce(bsp, F.col("last")).alias("close"), won(F.col("r.status")).alias("won"),
    )


def won(status: Column) -> Column:
    return F.when(status == "WINNER", True).when(status == "LOSER", False)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of streams, compressed or not, numbered within their file."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("l"))
    return raw.select("file", F.posexplode("l").alias("seq", "value")).where("value <> ''")


def tar_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of tar archives: each member, bz2 or plain, is a market's file. An archive is read by one task, member by member."""
    import bz2
    import io
    import tarfile

    import pandas as pd

    def members(batches):
        for pdf in batches:
            for content, name in zip(pdf["content"], pdf["path"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            data = tar.extractfile(m).read()
                            text = (bz2.decompress(data) if m.name.endswith(".bz2") else data).decode("utf-8", "replace")
                            lines = [x for x in text.splitlines() if x.strip()]
                            yield pd.DataFrame({"file": f"{name}#{m.name}", "seq": range(len(lines)), "value": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "file string, seq int, value string")


def event_sides(name: Column) -> Column:
    """(home, away) of "Home v Away", null unless there are exactly two."""
    parts = F.split(name, " v ")
    side = lambda i: F.trim(F.get(parts, i))
    return F.when((F.size(parts) == 2) & (side(0) != "") & (side(1) != ""), F.struct(side(0).alias("home"), side(1).alias("away")))


def match_odds_closes(runners: DataFrame, fixtures: DataFrame) -> DataFrame:
    """market_id with the closes of home, draw and away and the result for each market's fixture; unclear sides give none.

    runners: market_closes(); fixtures: market_id, home, away (normalized).
    """
    r = runners.join(fixtures.select("market_id", "home", "away"), "market_id").withColumn("n", normalized(F.col("name")))
    draw = (F.col("selection_id") == DRAW) | F.coalesce(F.col("n") == "draw", F.lit(False))
    role = F.when(draw, "D").when(F.col("n") == F.col("home"), "H").when(F.col("n") == F.col("away"), "A")
    of = lambda x, c: F.max(F.when(F.col("role") == x, F.col(c)))
    count = lambda x: F.count_if(F.col("role") == x)
    g = r.withColumn("role", role).groupBy("market_id").agg(*(of(x, "close").alias(f"close_{x.lower()}") for x in "HDA"), *(of(x, "won").alias(f"won_{x.lower()}") for x in "HDA"), count("H").alias("nh"), count("A").alias("na"))
    result = F.when(F.col("won_h"), "H").when(F.col("won_a"), "A").when(F.col("won_d"), "D")
    return g.where("nh = 1 AND na = 1").select("market_id", "close_h", "close_d", "close_a", result.alias("result"))


def over_under_closes(runners: DataFrame) -> DataFrame:
    """market_id with the closes of over and under and which won; a side that is missing or twice gives none."""
    n = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    role = F.when((F.col("selection_id") == OVER) | n.startswith("over"), "O").when((F.col("selection_id") == UNDER) | n.startswith("under"), "U")
    of = lambda x, c: F.max(F.when(F.col("role") == x, F.col(c)))
    g = runners.withColumn("role", role).groupBy("market_id").agg(of("O", "close").alias("close_o"), of("U", "close").alias("close_u"), of("O", "won").alias("wo"), of("U", "won").alias("wu"), F.count_if(F.col("role") == "O").alias("no"), F.count_if(F.col("role") == "U").alias("nu"))
    return g.where("no = 1 AND nu = 1").select("market_id", "close_o", "close_u", F.when(F.col("wo"), "O").when(F.col("wu"), "U").alias("result"))


def attached_closes(rows: DataFrame, closes: DataFrame, *, days: int = 1) -> tuple[DataFrame, DataFrame]:
    """rows with the nearest close of the same sides within some days in place of their own, and one row of counters.

    rows: match_id, home, away (canonical), played, result; closes: home, away, kickoff, close_h, close_d, close_a, result. A match whose
    result the close contradicts is dropped, one without a close keeps nulls.
    """
    window = rows.select("match_id", "home", "away", "played", F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda d: F.date_add("played", d))).alias("day"))
    c = closes.withColumn("day", F.to_date("kickoff")).withColumnRenamed("result", "close_result")
    near = window.join(c, ["home", "away", "day"]).groupBy("match_id").agg(F.min_by(F.struct("close_h", "close_d", "close_a", "close_result"), F.struct(F.abs(F.datediff("day", "played")), "kickoff")).alias("c"), F.count("*").alias("found"))
    joined = rows.join(near, "match_id", "left")
    conflict = F.coalesce(F.col("c.close_result") != F.col("result"), F.lit(False))
    stats = joined.agg(F.count("*").alias("rows"), F.count_if(F.col("c").isNotNull()).alias("matched"), F.count_if(conflict).alias("conflicts"), F.count_if(F.col("found") > 1).alias("several"))
    return joined.where(~conflict).select(*rows.columns, "c.close_h", "c.close_d", "c.close_a"), stats


def merged_markets(kept: DataFrame, incoming: DataFrame) -> DataFrame:
    """Markets of both by id, the kept ones first; those without an id all stay."""
    both = kept.withColumn("turn", F.lit(0)).unionByName(incoming.withColumn("turn", F.lit(1)))
    first = both.where("market_id <> ''").groupBy("market_id").agg(F.min("turn").alias("turn"))
    return both.join(first, ["market_id", "turn"], "left_semi").unionByName(both.where("market_id = ''")).drop("turn")


def write_market_cache(runners: DataFrame, path: str) -> None:
    runners.write.mode("overwrite").json(path, compression="gzip")


def read_market_cache(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


CATALOGUE = "array<struct<marketId: string, marketName: string, marketStartTime: string, event: struct<id: string, name: string>, competition: struct<name: string>, runners: array<struct<selectionId: bigint, runnerName: string, sortPriority: int>>>>"
BOOK = "array<struct<marketId: string, status: string, inplay: boolean, runners: array<struct<selectionId: bigint, status: string, ex: struct<availableToBack: array<struct<price: double, size: double>>>>>>>"


def catalogue_runners(payloads: DataFrame) -> DataFrame:
    """A row a runner of market catalogues, with its role: home and away by priority 1 and 2, the draw by its id, name or priority 3. payloads: value."""
    m = payloads.select(F.explode(F.from_json("value", CATALOGUE)).alias("m")).where("m.marketId IS NOT NULL")
    r = m.select(F.col("m.marketId").alias("market_id"), F.col("m.event.name").alias("event_name"), utc_time(F.col("m.marketStartTime")).alias("kickoff"), F.explode("m.runners").alias("r")).select("market_id", "event_name", "kickoff", F.col("r.selectionId").alias("selection_id"), F.col("r.runnerName").alias("name"), F.col("r.sortPriority").alias("priority"))
    draw = (F.col("selection_id") == DRAW) | (F.lower("name") == "the draw") | (F.lower("name") == "draw")
    return r.withColumn("role", F.when(F.coalesce(draw, F.lit(False)), "draw").when(F.col("priority") == 1, "home").when(F.col("priority") == 2, "away").when(F.col("priority") == 3, "draw"))


def book_backs(payloads: DataFrame) -> DataFrame:
    """(market_id, selection_id, price, size) of the best price to back in market books; a bad size is 0."""
    r = payloads.select(F.explode(F.from_json("value", BOOK)).alias("m")).select(F.col("m.marketId").alias("market_id"), F.explode("m.runners").alias("r"))
    best = F.array_max(F.transform(F.filter("r.ex.availableToBack", lambda x: x["price"] > 1), lambda x: F.struct(x["price"].alias("price"), F.greatest(F.coalesce(x["size"], F.lit(0.0)), F.lit(0.0)).alias("size"))))
    return r.select("market_id", F.col("r.selectionId").alias("selection_id"), best.alias("b")).where("b IS NOT NULL").select("market_id", "selection_id", "b.price", "b.size")


def joined_match_odds(catalogue: DataFrame, backs: DataFrame) -> DataFrame:
    """A row a market with both sides: home, draw and away price, null where there is none to back."""
    j = catalogue.join(backs, ["market_id", "selection_id"], "left")
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    g = j.groupBy("market_id", "event_name", "kickoff").agg(*(of(r, "price").alias(r) for r in ("home", "draw", "away")), *(of(r, "name").alias(f"{r}_name") for r in ("home", "away")))
    return g.where("home_name IS NOT NULL AND away_name IS NOT NULL")


def compared(api: DataFrame, reference: DataFrame) -> DataFrame:
    """Price and freshness of the exchange's own prices against another capture's, over all roles. Both: event_id, role, price, at."""
    from fairline.functions.odds import within_one_tick

    j = api.alias("x").join(reference.alias("y"), ["event_id", "role"])
    return j.agg(
        F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("x.price") - F.col("y.price"))), 6).alias("mean_delta"), F.round(F.avg(within_one_tick(F.col("x.price"), F.col("y.price")).cast("int")), 6).alias("within_tick"), F.round(F.avg((F.col("x.at") > F.col("y.at")).cast("int")), 6).alias("fresher"),
    )
