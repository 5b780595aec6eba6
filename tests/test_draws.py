import random

import pytest
from pyspark.sql import functions as F

from topspin.operators import ingest

MATCH = "id long, edition_id long, round string, draw_position int, player_a_id long, player_b_id long, player_a_seed int, player_b_seed int, status string, winner_id long, score string, external_id string, match_date date"
ENTRY = "edition_id long, round string, draw_position int, player_a_id long, player_b_id long, player_a_seed int, player_b_seed int, is_bye boolean, winner_id long, score string, external_id string"
ROUNDS = ["R16", "QF", "SF", "F"]
TOLD = ("edition_id", "round", "draw_position", "player_a_id", "player_b_id", "player_a_seed", "player_b_seed", "status", "winner_id", "score", "external_id")


def loop(rows, entries, overwrite):
    """One entry after another, by round and position."""
    rank = lambda m: (0 if m["status"] in ("upcoming", "scheduled") else 2 if m["status"] == "cancelled" else 1, -m["id"])
    slots, named = {}, {}
    for m in sorted(rows, key=rank, reverse=True):
        if m["draw_position"] is not None:
            slots[m["edition_id"], m["round"], m["draw_position"]] = m
    for m in sorted(rows, key=lambda m: -m["id"]):
        if m["external_id"]:
            named[m["edition_id"], m["external_id"]] = m
    pair = lambda m: {m["player_a_id"], m["player_b_id"]}
    alive = []
    for e in sorted(entries, key=lambda e: (ROUNDS.index(e["round"]), e["draw_position"])):
        held = slots.get((e["edition_id"], e["round"], e["draw_position"]))
        if e["is_bye"] or e["player_a_id"] is None or e["player_b_id"] is None or held and held["status"] not in ("upcoming", "scheduled"):
            continue
        alive.append((e, held if held and pair(held) == pair(e) else None, held if held and pair(held) != pair(e) else None))
    for _, _, stale in alive:
        if stale:
            stale["status"] = "cancelled"
    seen, claimed, made = set(), set(), []
    first = []
    for e, held, _ in alive:
        key = (e["edition_id"], e["external_id"])
        if e["external_id"] and key in seen:
            continue
        seen.add(key)
        first.append((e, held, named.get(key) if e["external_id"] else None))
    for e, held, own in sorted(first, key=lambda f: f[2] is None):
        target = own or held
        done = e["winner_id"] is not None and bool((e["score"] or "").strip())
        told = {c: e[c] for c in ("player_a_id", "player_b_id", "player_a_seed", "player_b_seed", "score")} | {"status": "completed" if done else "upcoming", "winner_id": e["winner_id"] if done else None}
        if target is None:
            made.append({"id": None, "match_date": None} | {c: e[c] for c in ("edition_id", "round", "draw_position", "external_id")} | told)
        elif id(target) not in claimed:
            claimed.add(id(target))
            if overwrite:
                target.update(told)
                target["external_id"] = e["external_id"] or target["external_id"]
            for c in ("draw_position", "player_a_seed", "player_b_seed", "external_id"):
                target[c] = e[c] if target[c] is None else target[c]
    return rows + made


def random_draw(rng, rows):
    entries, known = [], [m["external_id"] for m in rows if m["external_id"]]
    for edition in (1, 2):
        for depth, name in enumerate(ROUNDS):
            for position in range(1, (8 >> depth) + 1):
                if rng.random() < 0.25:
                    continue
                a, b = rng.sample(range(1, 7), 2)
                held = [m for m in rows if (m["edition_id"], m["round"], m["draw_position"]) == (edition, name, position)]
                if held and rng.random() < 0.7:
                    a, b = rng.choice(held)["player_b_id"], held[-1]["player_a_id"]
                ext = rng.choice([None, f"{edition}_{name}_{min(a, b)}_{max(a, b)}", f"{edition}_{rng.randint(0, 9)}", rng.choice(known) if known else None])
                finished = rng.random() < 0.2
                entries.append({
                    "edition_id": edition, "round": name, "draw_position": position, "player_a_id": a, "player_b_id": b if a != b and rng.random() < 0.9 else None, "player_a_seed": rng.choice([None, 1, 5]), "player_b_seed": rng.choice([None, 2]),
                    "is_bye": rng.random() < 0.1, "winner_id": a if finished or rng.random() < 0.05 else None, "score": "6-0 6-0" if finished else rng.choice([None, None, " "]), "external_id": ext,
                })
    return entries


@pytest.mark.parametrize("seed", range(4))
def test_draws_in_a_row_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [
        {"id": 1, "edition_id": 1, "round": "QF", "draw_position": None, "player_a_id": 1, "player_b_id": 2, "player_a_seed": None, "player_b_seed": None, "status": "upcoming", "winner_id": None, "score": None, "external_id": "1_3", "match_date": None},
        {"id": 2, "edition_id": 1, "round": "QF", "draw_position": 2, "player_a_id": 1, "player_b_id": 2, "player_a_seed": 7, "player_b_seed": None, "status": "cancelled", "winner_id": None, "score": None, "external_id": None, "match_date": None},
    ]
    for step in range(4):
        entries, overwrite = random_draw(rng, rows), step == 2
        got = ingest.apply_draw(spark.createDataFrame(rows, MATCH), spark.createDataFrame(entries, ENTRY), overwrite=overwrite)
        got = [r.asDict() for r in got.collect()]
        want = loop([dict(m) for m in rows], entries, overwrite)
        key = lambda m: repr([m[c] for c in TOLD])
        assert sorted(map(key, got)) == sorted(map(key, want))
        assert len({m["id"] for m in got}) == len(got)
        rows = got
        if step == 1:  # results come in between
            for m in rows:
                if m["status"] == "upcoming" and rng.random() < 0.3:
                    m |= {"status": "completed", "winner_id": m["player_a_id"], "score": "6-4 6-4"}


def test_a_draw_twice_changes_nothing_more(spark):
    entries = spark.createDataFrame([e | {"external_id": None} for e in random_draw(random.Random(9), [])], ENTRY)
    once = ingest.apply_draw(spark.createDataFrame([], MATCH), entries)
    twice = ingest.apply_draw(once, entries)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))


def test_expected_dates_are_given(spark):
    entries = spark.createDataFrame([(1, "F", 1, 5, 6, None, None, False, None, None, "x")], ENTRY)
    editions = spark.createDataFrame([(1, "2024-01-01", "2024-01-08")], "id long, start_date string, end_date string").withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})
    made = ingest.apply_draw(spark.createDataFrame([], MATCH), entries, editions).first()
    assert str(made.match_date) == "2024-01-08" and made.status == "upcoming"
