"""Refits that run beside each other give what one loop over the matches gives."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairline.operators import goals, walkforward
from fairline.plans import study
from tests.conftest import SF

XI, WINDOW, EVERY, WARMUP, LEAST = 0.0019, 1500, 90, 60, 40


def loop(matches):
    """match_id -> chances by one model after the other; fits over rows, not sums."""
    out, ordered = {}, sorted(matches, key=lambda m: (m.played, m.match_id))
    last = model = None
    for i, m in enumerate(x for x in ordered if x.eligible):
        if i < WARMUP:
            continue
        if last is None or (m.played - last).days >= EVERY:
            last = m.played
            seen = [x for x in ordered if last - dt.timedelta(days=WINDOW) <= x.played < last]
            model = fit(seen, last) if len(seen) >= LEAST else None
        out[m.match_id] = (last, chances(model, m) if model else None)
    return out


def fit(rows, day):
    attack, defence, edge = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0), 1.2
    teams = sorted({t for r in rows for t in (r.home, r.away)})
    w = [np.exp(-XI * (day - r.played).days) for r in rows]
    for _ in range(200):
        up, down = defaultdict(lambda: 1e-6), defaultdict(lambda: 1e-6)
        for r, x in zip(rows, w, strict=True):
            e = 1.0 if r.neutral else edge
            up[r.home] += x * r.home_goals
            up[r.away] += x * r.away_goals
            down[r.home] += x * e * defence[r.away]
            down[r.away] += x * defence[r.home]
        attack = {t: up[t] / down[t] for t in teams}
        mean = np.mean(list(attack.values()))
        attack = {t: v / mean for t, v in attack.items()}
        up, down = defaultdict(lambda: 1e-6), defaultdict(lambda: 1e-6)
        for r, x in zip(rows, w, strict=True):
            e = 1.0 if r.neutral else edge
            up[r.away] += x * r.home_goals
            up[r.home] += x * r.away_goals
            down[r.away] += x * e * attack[r.home]
            down[r.home] += x * attack[r.away]
        defence = {t: up[t] / down[t] for t in teams}
        own = [(x, r) for r, x in zip(rows, w, strict=True) if not r.neutral]
        edge = max(0.2, sum(x * r.home_goals for x, r in own) / max(sum(x * attack[r.home] * defence[r.away] for x, r in own), 1e-9)) if own else 1.0

    def likelihood(rho):
        total = 0.0
        for r, x in zip(rows, w, strict=True):
            h, a = attack[r.home] * defence[r.away] * (1.0 if r.neutral else edge), attack[r.away] * defence[r.home]
            t = {(0, 0): 1 - h * a * rho, (0, 1): 1 + h * rho, (1, 0): 1 + a * rho, (1, 1): 1 - rho}.get((r.home_goals, r.away_goals), 1.0)
            total += x * np.log(max(t, 1e-9))
        return total

    return attack, defence, edge, max(np.linspace(-0.2, 0.2, 81), key=likelihood)


def chances(model, m):
    attack, defence, edge, rho = model
    if m.home not in attack or m.away not in attack:
        return None
    h, a = attack[m.home] * defence[m.away] * (1.0 if m.neutral else edge), attack[m.away] * defence[m.home]
    g = goals.grid_of(np.array([h]), np.array([a]), np.array([rho]))[0]
    i, j = np.indices(g.shape)
    return [g[i > j].sum(), g[i == j].sum(), g[i < j].sum()]


@pytest.fixture(scope="module")
def matches(spark):
    return study.wide(spark, SF).where("league = 'L2'").withColumns({"neutral": F.col("match_id") % 7 == 0, "eligible": F.col("match_id") % 11 != 0})


def test_forecasts_equal_one_loop(matches):
    expected = loop(matches.collect())
    found = {r.match_id: r for r in walkforward.walk_forward(matches, warmup=WARMUP, window_days=WINDOW, every_days=EVERY, least=LEAST, xi=XI).collect()}
    assert set(found) == set(expected) and sum(p is not None for _, p in expected.values()) > 50
    for i, (epoch, p) in expected.items():
        assert found[i].epoch == epoch
        if p is None:
            assert found[i].p_home is None
        else:
            assert [found[i].p_home, found[i].p_draw, found[i].p_away] == pytest.approx(p, abs=1e-6)


def test_a_thin_window_has_no_model(matches):
    found = walkforward.walk_forward(matches, warmup=WARMUP, window_days=WINDOW, every_days=EVERY, least=10_000)
    assert found.where("p_home IS NOT NULL").isEmpty() and found.count() > 0
    assert walkforward.walk_forward(matches.limit(0)).isEmpty()


def test_bets_have_edge_and_value(matches):
    b = walkforward.model_bets(walkforward.walk_forward(matches, warmup=WARMUP, window_days=WINDOW, every_days=EVERY, least=LEAST)).collect()
    assert b and all(r.edge > 0 and r.ev > 0 and r.edge == pytest.approx(r.model_p - r.fair) and r.unit == (r.odds - 1 if r.won else -1) for r in b)
