"""Column builders for prices, stakes and closing value. Every one stays JVM-side."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commission on net winnings by book, and the sharp books in order of preference. Fixed values.
COMMISSIONS = {"betfair exchange": 0.05, "betfair": 0.05, "smarkets": 0.02, "matchbook": 0.02}
SHARP = ("pinnacle", "pinnacle sports", "betfair exchange", "smarkets")
#: Price ladder of the exchange: (below, tick). Fixed values.
TICKS = ((2, 0.01), (3, 0.02), (4, 0.05), (6, 0.1), (10, 0.2), (20, 0.5), (30, 1.0), (50, 2.0), (100, 5.0), (math.inf, 10.0))


def normal_book(book: Column) -> Column:
    return F.lower(F.trim(book))


def implied(odds: Column) -> Column:
    """1/odds for a price over 1, else null."""
    return F.when(odds > 1, 1 / odds)


def commission(book: Column) -> Column:
    out = F.lit(0.0)
    for name, share in COMMISSIONS.items():
        out = F.when(normal_book(book) == name, share).otherwise(out)
    return out


def effective_odds(book: Column, odds: Column) -> Column:
    """The price net of the book's commission."""
    return 1 + (odds - 1) * (1 - commission(book))


def overround(odds: Column) -> Column:
    """Sum of 1/odds over an array of prices, minus 1."""
    return F.aggregate(odds, F.lit(0.0), lambda s, x: s + 1 / x) - 1


def american_to_decimal(price: Column) -> Column:
    """+a is 1 + a/100, -a is 1 + 100/a; 0 is null."""
    return F.when(price > 0, 1 + price / 100.0).when(price < 0, 1 + 100.0 / -price)


def parsed_odds(text: Column) -> Column:
    """A price from text: over 1, else null."""
    value = text.try_cast("double")
    return F.when((value > 1) & ~F.isnan(value), value)


def edge(fair: Column, net_odds: Column) -> Column:
    return fair - 1 / net_odds


def expected_value(p: Column, odds: Column) -> Column:
    return p * (odds - 1) - (1 - p)


def kelly_fraction(p: Column, odds: Column) -> Column:
    """Kelly's share of the bankroll, never negative."""
    return F.greatest(((odds - 1) * p - (1 - p)) / (odds - 1), F.lit(0.0))


def drawdown_multiplier(max_drawdown: float, probability: float) -> float:
    """The Kelly share that keeps the chance of a drawdown under a probability."""
    return min(1.0, 2 / (1 + math.log(probability) / math.log(1 - max_drawdown)))


def uncertainty_multiplier(base: Column, variance: Column, coefficient: float) -> Column:
    return base / (1 + coefficient * variance)


def correlation_haircut(legs: Column, rho: float) -> Column:
    """1/sqrt(1 + (n - 1) rho)."""
    return F.when((legs <= 1) | (F.lit(rho) == 0), 1.0).otherwise(1 / F.sqrt(1 + (legs - 1) * rho))


def recommended_stake(
    p: Column, odds: Column, *, fraction: float = 0.25, cap: float = 0.02, max_drawdown: float | None = None, probability: float | None = None,
    variance: Column | None = None, coefficient: float | None = None, legs: Column | None = None, rho: float = 0.0,
) -> Column:
    """raw, fractional, capped and final Kelly as a struct; the multiplier falls with the edge's variance, the final stake with correlated legs."""
    raw = kelly_fraction(p, odds)
    share = F.lit(effective_multiplier(fraction, max_drawdown, probability))
    if coefficient and variance is not None:
        share = uncertainty_multiplier(share, variance, coefficient)
    capped = F.least(raw * share, F.lit(cap))
    final = capped * correlation_haircut(legs, rho) if legs is not None else capped
    return F.struct(raw.alias("raw"), (raw * share).alias("fractional"), capped.alias("capped"), final.alias("final"))


def stake_amount(fraction: Column, bankroll: float) -> Column:
    """Cents, half up."""
    return F.round((fraction * bankroll).cast("decimal(18,6)"), 2)


def clv_log(fill: Column, closing_fair: Column) -> Column:
    return F.when((fill > 1) & (closing_fair > 0) & (closing_fair < 1), F.log(fill * closing_fair))


def min_acceptable_odds(fair: Column, min_edge: float, book: Column) -> Column:
    """The lowest gross price with the edge; null without headroom."""
    head = fair - min_edge
    return F.when(head > 0, 1 + (1 / head - 1) / (1 - commission(book)))


def ceil_odds(value: Column) -> Column:
    """Up to cents, after rounding to six places."""
    return F.ceil(F.round(value, 6) * 100) / 100


def tick_size(price: Column) -> Column:
    out = F.lit(TICKS[-1][1])
    for below, tick in TICKS[-2::-1]:
        out = F.when(price < below, tick).otherwise(out)
    return out


def within_one_tick(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= tick_size(F.greatest(a, b)) + 1e-9


def anchor_type(book: Column) -> Column:
    """pinnacle, sharp or consensus by the anchor's book: any other name, a soft book's too, is no better than a consensus."""
    b = normal_book(F.coalesce(book, F.lit("")))
    return F.when(F.contains(b, F.lit("pinnacle")), "pinnacle").when(b.isin(*SHARP), "sharp").otherwise("consensus")


def sharp_anchored(book: Column) -> Column:
    return anchor_type(book) != "consensus"


def pick_tier(edge: Column, premium: float = 0.03, volume: float = 0.015) -> Column:
    return F.when(edge >= premium, "premium").when(edge >= volume, "volume")


def odds_band(price: Column, bounds=(1.5, 2.0, 3.0, 5.0, 10.0)) -> Column:
    """Band number by upper-inclusive bounds."""
    out = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(price <= b, i).otherwise(out)
    return out


def time_bucket(hours: Column) -> Column:
    """Hours before the start, lower bound inside; null after it."""
    return F.when(hours < 0, None).when(hours < 1, "<1h").when(hours < 5, "1-5h").when(hours < 24, "5-24h").when(hours < 48, "24-48h").otherwise(">48h")


def price_age(now: Column, captured: Column) -> Column:
    """Seconds, 0 for the future, infinite if unknown."""
    return F.when(captured.isNull() | now.isNull(), math.inf).otherwise(F.greatest(F.lit(0.0), now - captured))


def confidence(edge: Column, threshold: float, anchor: Column, score: Column, *, high: float = 0.725, low: float = 0.60) -> Column:
    """1 to 5 stars from the edge band, the anchor and the model score; what is unknown adds nothing."""
    return confidence_rating(edge, threshold, anchor, score, high=high, low=low)["level"]


def confidence_rating(edge: Column, threshold: float, anchor: Column, score: Column, *, high: float = 0.725, low: float = 0.60) -> Column:
    """level, label, score before the bounds, and the bands that counted, as a struct."""
    e = F.when(edge >= 2 * threshold, 2).when(edge >= threshold, 1).otherwise(0)
    a = F.when(anchor == "pinnacle", 2).when(anchor == "sharp", 1).otherwise(0)
    m = F.when(score >= high, 1).when(score < low, -1).otherwise(0)
    level = F.greatest(F.lit(1), F.least(F.lit(5), 1 + e + a + m))
    bands = F.array_compact(
        F.array(
            F.when(e == 2, "edge 2x floor").when(e == 1, "edge at floor").otherwise("edge below floor"),
            F.when(anchor.isNotNull(), F.format_string("%s anchor +%d", anchor, a)),
            F.when(score >= high, "score high").when(score >= low, "score middle").when(score < low, "score weak"),
        )
    )
    labels = F.array(*map(F.lit, ("minimal", "low", "moderate", "high", "very high")))
    return F.struct(level.alias("level"), labels[level - 1].alias("label"), (e + a + m).alias("score"), bands.alias("reasons"))


def effective_multiplier(fraction: float, max_drawdown: float | None = None, probability: float | None = None) -> float:
    """The Kelly share: the fraction, or what the drawdown bound allows if that is less; the bound needs both of its numbers."""
    return min(fraction, drawdown_multiplier(max_drawdown, probability)) if max_drawdown and probability else fraction
