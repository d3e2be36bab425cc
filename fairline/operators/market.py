"""From observations to picks: state as of a time, one row a market, anchors, and the scan for value.

A market is known by its keys (an event, or an event with a market's name and line) and may have
any number of selections. Observations are read once whatever the number of cutoffs: series
are reduced by map-side aggregation, then dealt out by market once, and everything after that is
columns of a market's row, which holds its books' prices (as many as books price a market).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.devig import devig, let
from fairline.functions.odds import SHARP, anchor_type, commission, edge, expected_value, normal_book, pick_tier

MARKET = ("event_id",)
TIME = ("captured_at", "l_orderkey", "l_linenumber", "odds")
#: Fewest full-market books of a consensus; overround bounds of an anchor; by how much a consensus must separate two selections to outrank the anchor. Fixed values.
BOOKS, MAX_OVERROUND, SWAP = 3, 0.12, 0.10


def last_before(cutoff: Column, row: Column, time: tuple[str, ...] = TIME) -> Column:
    """Aggregate: the row with the latest time at or before the cutoff; an old price is still live, so no age limit."""
    return F.max_by(row, F.when(F.col(time[0]) <= cutoff, F.struct(*time)))


def state_at(book: DataFrame, cutoff: Column | str = "kickoff", keys: tuple[str, ...] = MARKET) -> DataFrame:
    """Each (market, book, selection)'s last row at or before the cutoff."""
    cutoff = F.col(cutoff) if isinstance(cutoff, str) else cutoff
    series = [*keys, "book_id", "sel_idx"]
    row = F.struct(*[c for c in book.columns if c not in series])
    return book.where(F.col("captured_at") <= cutoff).groupBy(*series).agg(last_before(cutoff, row).alias("r")).select(*series, "r.*")


def market_rows(book: DataFrame, cutoffs: dict[str, Column], keys: tuple[str, ...] = MARKET, carry: tuple[str, ...] = ("kickoff",)) -> DataFrame:
    """One row a market, with a column of books for each cutoff: array of (book, book_id, odds by selection, last capture).

    Two spellings of a book are one, with the better price. carry: columns that are the same
    throughout a market.
    """
    series = [*keys, "book_id", "sel_idx"]
    row = F.struct("odds", "captured_at")
    held = [F.any_value(c).alias(c) for c in (*carry, "book", "selection")]
    last = book.groupBy(*series).agg(*(last_before(c, row).alias(n) for n, c in cutoffs.items()), *held).repartition(*keys)
    per_book = last.groupBy(*keys, normal_book(F.col("book")).alias("norm")).agg(
        F.min("book_id").alias("book_id"), F.min("book").alias("book"),
        *(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("sel_idx", F.col(n)["odds"].alias("odds")))).alias(n) for n in cutoffs),
        *(F.max(F.col(n)["captured_at"]).alias(f"{n}_at") for n in cutoffs),
        F.collect_set(F.struct("sel_idx", "selection")).alias("names"), *(F.any_value(c).alias(c) for c in carry),
    )
    priced = lambda n: F.transform(
        F.sort_array(F.array_distinct(F.transform(n, lambda x: x["sel_idx"]))), lambda i: F.array_max(F.filter(n, lambda x: x["sel_idx"] == i))
    )
    out = per_book.groupBy(*keys).agg(
        *(F.sort_array(F.collect_list(F.when(F.size(n) > 0, F.struct("book_id", "book", F.col("norm"), priced(F.col(n)).alias("odds"), F.col(f"{n}_at").alias("at"))))).alias(n) for n in cutoffs),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), *(F.any_value(c).alias(c) for c in carry),
    )
    return out.select(*keys, *carry, *cutoffs, F.map_from_entries("names").alias("names"))


def selections(books: Column) -> Column:
    """The selections that any book prices, in order."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(books, lambda b: F.transform(b["odds"], lambda x: x["sel_idx"])))))


def price(book: Column, sel: Column) -> Column:
    """A book's odds of a selection, null if it has none."""
    return F.get(F.filter(book["odds"], lambda x: x["sel_idx"] == sel), 0)["odds"]


def net(book: Column, odds: Column) -> Column:
    return 1 + (odds - 1) * (1 - commission(book))


def full_books(books: Column, sels: Column) -> Column:
    """The books that price every selection: book_id, book, norm, gross and net odds in order of the selections."""
    vector = lambda b: F.transform(sels, lambda s: price(b, s))
    priced = F.transform(books, lambda b: F.struct(b["book_id"].alias("book_id"), b["book"].alias("book"), b["norm"].alias("norm"), vector(b).alias("gross")))
    whole = F.filter(priced, lambda b: ~F.exists(b["gross"], lambda o: o.isNull()))
    return F.transform(whole, lambda b: F.struct(b["book_id"].alias("book_id"), b["book"].alias("book"), b["norm"].alias("norm"), b["gross"].alias("gross"), let(1 - commission(b["norm"]), lambda kept: F.transform(b["gross"], lambda o: 1 + (o - 1) * kept)).alias("net")))


def booksum(odds: Column) -> Column:
    return F.aggregate(odds, F.lit(0.0), lambda s, o: s + 1 / o)


def median(values: Column) -> Column:
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return let(F.sort_array(values), middle)


def by_selection(full: Column, sels: Column, value) -> Column:
    """The median over books of a value of the net odds, for each selection."""
    return F.transform(sels, lambda s, i: median(F.transform(full, lambda b: value(F.get(b["net"], i)))))


def sharp_odds(full: Column, max_overround: float = MAX_OVERROUND) -> Column:
    """(rank, book, gross odds) of the first sharp book by preference whose net overround is in bounds."""
    names = F.array(*map(F.lit, SHARP))
    good = F.filter(full, lambda b: (F.array_position(names, b["norm"]) > 0) & (booksum(b["net"]) - 1).between(0, max_overround))
    return F.array_min(F.transform(good, lambda b: F.struct(F.array_position(names, b["norm"]).alias("rank"), b["book"].alias("book"), b["gross"].alias("odds"))))


def consensus_odds(full: Column, sels: Column, max_overround: float = MAX_OVERROUND) -> Column:
    """Median net odds of each selection over at least BOOKS full-market books, null if their overround is out of bounds."""
    found = by_selection(full, sels, lambda o: o)
    return let(found, lambda m: F.when((F.size(full) >= BOOKS) & (booksum(m) - 1).between(0, max_overround), m))


def logit_pool(full: Column, sels: Column, method: str = "multiplicative", max_overround: float = MAX_OVERROUND) -> Column:
    """Each book devigged, logits averaged by selection, back to probabilities that sum to 1; null without BOOKS full-market books."""
    fairs = F.transform(F.filter(full, lambda b: booksum(b["net"]) - 1 <= max_overround), lambda b: devig(b["net"], method)["fair"])

    def pooled(f: Column) -> Column:
        mean = lambda i: F.aggregate(f, F.lit(0.0), lambda s, p: s + F.log(F.get(p, i) / (1 - F.get(p, i)))) / F.greatest(F.size(f), F.lit(1))
        p = F.transform(sels, lambda s, i: 1 / (1 + F.exp(-mean(i))))
        return let(p, lambda q: F.when(F.size(f) >= BOOKS, F.transform(q, lambda x: x / F.aggregate(q, F.lit(0.0), lambda s, y: s + y))))

    return let(fairs, pooled)


def with_anchor(markets: DataFrame, books: str = "close", *, method: str = "power", pool: bool = False, prefix: str = "") -> DataFrame:
    """markets with sels, full, and the anchor: book, type, fair (array in order of sels) and fell_back; null without an anchor.

    The named sharp book's gross odds are devigged, else the consensus of net odds, or with pool
    the logit pool of each book's fair odds.
    """
    p = prefix
    found = markets.withColumn(f"{p}sels", selections(F.col(books)))
    found = found.withColumn(f"{p}full", full_books(F.col(books), F.col(f"{p}sels")))
    found = found.withColumn(f"{p}sharp", sharp_odds(F.col(f"{p}full")))
    two = F.size(f"{p}sels") >= 2
    if pool:
        fair = logit_pool(F.col(f"{p}full"), F.col(f"{p}sels"), method)
        named = devig(F.col(f"{p}sharp.odds"), method)
        found = found.withColumn(f"{p}d", F.when(F.col(f"{p}sharp").isNotNull(), named).otherwise(F.when(fair.isNotNull(), F.struct(fair.alias("fair"), F.lit(False).alias("fell_back")))))
    else:
        found = found.withColumn(f"{p}base", F.coalesce(F.col(f"{p}sharp.odds"), consensus_odds(F.col(f"{p}full"), F.col(f"{p}sels"))))
        found = found.withColumn(f"{p}d", F.when(two, devig(F.col(f"{p}base"), method))).drop(f"{p}base")
    book = F.when(F.col(f"{p}d").isNotNull(), F.coalesce(F.col(f"{p}sharp.book"), F.lit("consensus")))
    return found.withColumns({f"{p}anchor_book": book, f"{p}anchor_type": F.when(book.isNotNull(), anchor_type(book)), f"{p}fair": F.col(f"{p}d.fair"), f"{p}fell_back": F.col(f"{p}d.fell_back")}).drop(f"{p}sharp", f"{p}d")


def swapped(full: Column, sels: Column, fair: Column, tolerance: float = SWAP) -> Column:
    """Whether the consensus of BOOKS books clearly ranks one selection over another and the anchor does not."""

    def judged(q: Column) -> Column:
        share = F.transform(q, lambda x: x / F.aggregate(q, F.lit(0.0), lambda s, y: s + y))
        pairs = F.arrays_zip(share.alias("q"), fair.alias("f"))
        return let(pairs, lambda m: F.exists(m, lambda a: F.exists(m, lambda b: (a["q"] - b["q"] > tolerance) & (a["f"] <= b["f"]))))

    return F.coalesce((F.size(full) >= BOOKS) & let(by_selection(full, sels, lambda o: 1 / o), judged), F.lit(False))


def best_soft(books: Column, sel: Column) -> Column:
    """The soft book with the best net odds of a selection: net, book, gross odds; the first book if equal. A price is looked up once a book."""
    soft = F.filter(books, lambda b: ~b["norm"].isin(*SHARP))
    offer = lambda b, odds: F.when(odds.isNotNull(), F.struct(net(b["norm"], odds).alias("net"), (-b["book_id"]).alias("turn"), b["book"].alias("book"), odds.alias("odds")))
    return F.array_max(F.transform(soft, lambda b: let(price(b, sel), lambda odds: offer(b, odds))))


def book_count(books: Column, exclude: tuple[str, ...] = SHARP) -> Column:
    """Distinct books that price any selection, but for those excluded."""
    return F.size(F.filter(books, lambda b: ~b["norm"].isin(*exclude)))


def value_scan(markets: DataFrame, books: str = "close", *, min_edge: float | Column = 0.015, max_edge: float | Column = 0.30, min_odds: float = 1.2, guard: bool = True) -> DataFrame:
    """The best soft price of each selection against the anchor's fair probability, where the edge is in bounds.

    markets: with_anchor(). A market whose anchor is swapped has none.
    """
    sels, fair = F.col("sels"), F.col("fair")
    offered = F.transform(F.arrays_zip(sels.alias("sel_idx"), fair.alias("fair")), lambda x: F.struct(x["sel_idx"].alias("sel_idx"), x["fair"].alias("fair"), F.try_element_at("names", x["sel_idx"]).alias("selection"), best_soft(F.col(books), x["sel_idx"]).alias("offer")))
    legs = markets.withColumns({"n_books": book_count(F.col(books)), "legs": F.when(~swapped(F.col("full"), sels, fair), offered) if guard else offered})
    # explode_outer, and conditions on what comes out of it alone: those on a market's arrays, explode's own too, are pushed below and repeat all that the arrays are made of.
    legs = legs.select("*", F.explode_outer("legs").alias("leg")).drop("legs", "fair", "full", "sels", "names").where("leg.offer.net IS NOT NULL")
    found = legs.select("*", "leg.sel_idx", "leg.fair", "leg.selection", "leg.offer.book", "leg.offer.odds", "leg.offer.net").drop("leg")
    found = found.withColumn("edge", edge(F.col("fair"), F.col("net"))).withColumn("ev", expected_value(F.col("fair"), F.col("net")))
    return found.where((F.col("edge") >= min_edge) & (F.col("edge") <= max_edge) & (F.col("net") >= min_odds)).withColumn("tier", pick_tier(F.col("edge")))


def top_pick(picks: DataFrame, keys: tuple[str, ...] = MARKET) -> DataFrame:
    """One pick a market: the largest edge, the first selection if equal."""
    rest = [c for c in picks.columns if c not in keys]
    return picks.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("edge", -F.col("sel_idx"))).alias("p")).select(*keys, "p.*")


def double_chance(fair: Column) -> Column:
    """Pairwise sums of a three-way fair market, as an array of (selection, fair); null for any other."""
    legs = F.array(*(F.struct(F.lit(n).alias("selection"), (F.get(fair, a) + F.get(fair, b)).alias("fair")) for n, a, b in (("1X", 0, 1), ("X2", 1, 2), ("12", 0, 2))))
    return F.when(F.size(fair) == 3, legs)
