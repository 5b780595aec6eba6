import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from topspin.operators import matches, rating
from topspin.schema import RATED

DDL = "id long, player_a_id long, player_b_id long, edition_id long, status string, winner_id long, round string, match_date date, score string, temporal_order long, t_level string, t_tour string"


def make(n=300, players=25, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.sample(range(players), 2)
        women = (a + b) % 2 == 0
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 900))
        winner = rng.choice([a, b])
        rows.append((i, a, b, i % 9, rng.choice(["completed"] * 4 + ["retired", "walkover", "upcoming"]), winner, rng.choice(["F", "R32"]), None if i % 31 == 0 else day, rng.choice(["6-0 6-0", "6-4 3-6 7-6(5)", "4-6 3-6", None, "W/O", "6-2 2-1 RET"]), None, rng.choice(["WTA 125", "WTA 1000"]) if women else rng.choice(["Grand Slam", "ITF", "ATP 250"]), "WTA" if women else "ATP"))
    return rows


def frame(spark, rows):
    return matches.with_order(spark.createDataFrame(rows, DDL))


def margin(score, a_won):
    from decimal import Decimal

    games = [tuple(int(x.split("(")[0]) for x in t.split("-")) for t in (score or "").replace("RET", "").split() if "-" in t]
    if not games:
        return 1.0
    a, b = (sum(g[k] for g in games) for k in (0, 1))
    ratio = Decimal(str((a - b) if a_won else (b - a))) / Decimal(a + b)
    return float(max(Decimal("0.5"), min(Decimal(2), Decimal("0.85") + ratio * Decimal("0.3"))).quantize(Decimal("0.0001")))


def plain_fold(rows, fast=False):
    """The fold as a loop over all matches, with everything worked out on the way."""
    k = {"F": 183, "C": 137, "A": 108, "M": 107, "G": 116}
    s = {"F": 1241, "C": 1441, "A": 1670, "M": 1809, "G": 1428}
    codes = {"WTA 125": "C", "WTA 1000": "M", "Grand Slam": "G", "ITF": "F", "ATP 250": "A"}
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.temporal_order, r.id)):
        code, pool, won = codes[r.t_level], 0, r.winner_id == r.player_a_id
        pre, boosts = [], []
        for p in (r.player_a_id, r.player_b_id):
            n, last = state.get(("n", p), 0), state.get(("d", p))
            days = (r.match_date - last).days if r.match_date and last else None
            x = state.get((pool, p), 1500.0)
            pre.append(1500 + (x - 1500) * math.exp(-0.05 * (days - 60) / 365) if days is not None and days > 60 else x)
            boosts.append(max(1, min(3, (1 + 0.5 * (1 - n / 30) if n < 30 else 1) * (1.3 if days is not None and days > 180 else 1))))
        p = 1 / (1 + 10 ** ((pre[1] - pre[0]) / s[code]))
        m = k[code] * margin(r.score, won)
        post = [pre[0] + m * boosts[0] * (won - p), pre[1] + m * boosts[1] * (p - won)]
        if not fast:
            pre, post = [round(x, 2) for x in pre], [round(x, 2) for x in post]
        for q, x in zip((r.player_a_id, r.player_b_id), post, strict=True):
            state[(pool, q)] = x
            state[("n", q)] = state.get(("n", q), 0) + 1
            state[("d", q)] = r.match_date or state.get(("d", q))
        out[r.id] = (*pre, *post)
    return out


@pytest.mark.parametrize("fast", [False, True])
def test_fold_equals_a_plain_loop(spark, fast):
    df = frame(spark, make())
    statuses = ("completed", "retired") if fast else RATED
    want = plain_fold([r for r in df.collect() if r.status in statuses], fast)
    got = {r.id: (r.pre_a, r.pre_b, r.post_a, r.post_b) for r in rating.rebuild(df, fast=fast).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=0.011 if not fast else 1e-9) for i in want)


def test_incremental_with_late_matches_equals_rebuild(spark):
    df = frame(spark, make())
    whole = {r.id: r for r in rating.rebuild(df).collect()}
    early = df.where((F.col("id") % 10 != 0) & (F.col("match_date") < F.lit(dt.date(2021, 9, 1))))
    first = rating.rebuild(early)
    rated, states = rating.update_ratings(df, first, rating.states_after(first, df))
    got = {r.id: r for r in rated.collect()}
    assert got.keys() == whole.keys()
    assert all(got[i].post_a == pytest.approx(whole[i].post_a, abs=0.02) and got[i].post_b == pytest.approx(whole[i].post_b, abs=0.02) for i in whole)
    want = {r.player_id: r for r in rating.states_after(rating.rebuild(df), df).collect()}
    for r in states.collect():
        assert (r.match_count, r.last_match_date, r.last_temporal_order) == (want[r.player_id].match_count, want[r.player_id].last_match_date, want[r.player_id].last_temporal_order)


@pytest.mark.parametrize("fast", [False, True])
def test_windows_and_pools_change_nothing(spark, fast):
    # two sets of players that never meet, besides those that don't meet within a window
    rows = make(200, 40)
    rows += [(1000 + r[0], r[1] + 100, r[2] + 100, *r[3:5], r[5] + 100, *r[6:]) for r in make(60, 12, seed=2)]
    df = frame(spark, rows)
    whole = {r.id: tuple(r) for r in rating.rebuild(df, fast=fast).collect()}
    got = {r.id: tuple(r) for r in rating.rebuild(df, fast=fast, window_rows=140).collect()}
    assert got == whole and len(got) > 150


def test_late_matches_leave_what_they_cannot_reach(spark):
    rows = make(120, 10) + [(1000 + r[0], r[1] + 100, r[2] + 100, *r[3:5], r[5] + 100, *r[6:]) for r in make(120, 10, seed=2)]
    df = frame(spark, rows)
    first = rating.rebuild(df.where(F.col("id") != 1003)).withColumn("pre_a", F.col("pre_a") + F.when(F.col("id") < 1000, 0.5).otherwise(0.0))
    rated, _ = rating.update_ratings(df, first, rating.states_after(first, df))
    whole, before = ({r.id: tuple(r) for r in x.collect()} for x in (rating.rebuild(df), first))
    got = {r.id: tuple(r) for r in rated.collect()}
    assert got.keys() == whole.keys()
    for i in got:  # marked values of the players that no late match can reach are still there
        assert got[i] == (before[i] if i < 1000 else whole[i])


def test_rounding_is_that_of_python():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 10**6, 20000) / 1000, rng.uniform(0, 3000, 20000), [69.255, 2.675, 1500.125, 1500.375]])
    assert rating._cents(x).tolist() == [round(v, 2) for v in x.tolist()]


def test_known_values(spark):
    one = spark.range(1).select(
        rating.updated(F.lit(1500.0), F.lit(1500.0), F.lit(True), 108.0, 1670.0).alias("even"),
        rating.win_probability(F.lit(2000.0), F.lit(1500.0), 1670.0).alias("p"),
        rating.decayed(F.lit(1800.0), F.lit(200)).alias("idle"),
        rating.k_boost(F.lit(15), F.lit(181)).alias("boost"),
        rating.rating_for_probability(F.lit(1.0), F.lit(1500.0), 1670.0).alias("sure"),
        rating.expected(F.lit(0.0), F.lit(1e9), 1.0).alias("far"),
    ).first()
    assert one.even.after_a == 1554.0 and one.even.after_b == 1446.0 and not one.even.upset
    assert one.p == 0.6658 and one.idle == pytest.approx(1794.30, abs=0.01) and one.boost == pytest.approx(1.625)
    assert one.sure == 2500 and one.far == 0.001
    rows = [(1, 1, 2, 1, "completed", 1, "F", dt.date(2024, 1, 1), "6-0 6-0", None, "ATP 250", "ATP")]
    r = rating.rebuild(frame(spark, rows)).first()
    assert (r.post_a, r.post_b) == (1593.15, 1406.85)


def test_search_never_gets_worse_and_splits_by_time(spark):
    df = frame(spark, make(500)).where("match_date IS NOT NULL")
    parts = rating.chronological_split(df.where(F.col("status").isin("completed", "retired")))
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    total = sum(counts.values())
    assert counts["train"] == int(total * 0.7) and counts["validation"] == int(total * 0.85) - int(total * 0.7)
    best, losses = rating.search(df, parts, rounds=((3, 1.0), (2, 0.2)))
    found = {(r.candidate, r.part): r.log_loss for r in losses.collect()}
    assert min(v for (c, p), v in found.items() if p == "validation") <= found[(0, "validation")]
    assert best.s["G"] <= min(best.s.values()) and rating.worth_activating(0.65, 0.64) and not rating.worth_activating(0.65, 0.649)
