import random

import pytest

from topspin.functions import names
from topspin.operators import identity


def grams(text):
    return {("  " + w + " ")[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in text).split() for i in range(len(w) + 1)}


def last(name):
    words = name.split()
    return "" if not words else " ".join(words[-2:]) if len(words) >= 3 and words[-2] in names.PARTICLES else words[-1]


def abbreviates(a, b):
    """Whether ``b`` stands for ``a`` with an initial in place of a first name of three letters or more, or the other way round."""
    x, y = a.split(), b.split()
    if len(x) < 2 or len(y) < 2 or not last(a):
        return False
    if len(x[0].rstrip(".")) == 1:
        first = y[0].rstrip(".")
        return len(first) >= 3 and last(b) == last(a) and first.startswith(x[0].rstrip("."))
    return b in (f"{x[0][0]} {last(a)}", f"{x[0][0]}. {last(a)}")


def loop(records, players, aliases, genders):
    """One record after another, all players looked at each time."""
    people = {i: {"atp": a, "wta": w} for i, _, a, w in players}
    owners = sorted({(n, i) for i, n, _, _ in players if n} | set(aliases))
    out = []
    for rid, name, source, external, expected in records:
        fits = lambda p: expected is None or genders.get(p) in (None, expected)  # noqa: B023, E731

        def learn(p, with_id):
            if (name, p) not in owners:  # noqa: B023
                owners.append((name, p))  # noqa: B023
            if with_id and external and people[p].get(source) is None:  # noqa: B023
                people[p][source] = external  # noqa: B023

        def best(score):
            found = {}
            for alias, p in owners:
                if (s := score(alias)) is not None:
                    found[p] = max(s, found.get(p, 0))
            return found

        by_id = [p for p, ids in people.items() if external and ids.get(source) == external]
        owner = next((p for n, p in owners if n == name), None)
        if by_id:
            learn(by_id[0], False)
            out.append((rid, by_id[0], "matched"))
            continue
        if owner is not None and fits(owner):
            out.append((rid, owner, "matched"))
            continue
        short = {p: s for p, s in best(lambda n: names.name_similarity(name, n) if n != name and abbreviates(name, n) else None).items() if fits(p)}  # noqa: B023
        if len(short) == 1:
            learn(next(iter(short)), True)
            out.append((rid, next(iter(short)), "matched"))
            continue
        if sum(s >= 0.95 for s in short.values()) > 1:
            out.append((rid, None, "queued"))
            continue
        share = lambda n: len(grams(name) & grams(n)) / len(grams(name) | grams(n)) if grams(name) | grams(n) else 0  # noqa: B023, E731
        close = best(lambda n: s if (s := 1.0 if n == name else share(n)) >= 0.95 else None)  # noqa: B023
        if max(close.values(), default=0) < 0.98:
            for p, s in best(lambda n: s if last(n) == last(name) != "" and (s := names.name_similarity(name, n)) >= 0.95 else None).items():  # noqa: B023
                close[p] = max(s, close.get(p, 0))
        top = sorted(close.items(), key=lambda c: (-c[1], isinstance(c[0], str), c[0]))[:5]
        strong = [(p, s) for p, s in top if fits(p)]
        if strong and strong[0][1] >= 0.98:
            learn(strong[0][0], True)
            out.append((rid, strong[0][0], "matched"))
        elif len(strong) > 1:
            out.append((rid, None, "queued"))
        else:
            made = f"made {rid:06d}"
            people[made] = {}
            learn(made, True)
            out.append((rid, made, "created"))
    return out


def run(spark, records, players, aliases, genders):
    done = identity.resolve(
        spark.createDataFrame(records, "id long, name string, source_key string, external_id string, gender string"), spark.createDataFrame(players, "id long, name string, atp_id string, wta_id string"),
        spark.createDataFrame([(*a, "atp") for a in aliases], "alias string, player_id long, source string"), spark.createDataFrame(list(genders.items()), "player_id long, gender string"),
    ).collect()
    assert len({(r.player_id, r.made_by) for r in done}) == len({r.player_id for r in done})
    return sorted((r.in_id, f"made {r.made_by:06d}" if r.made_by is not None else r.player_id, r.status) for r in done)


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_loop_over_records(spark, monkeypatch, seed):
    monkeypatch.setattr(identity, "BLOCK", 6)
    rng = random.Random(seed)
    firsts = ["jessica", "jessicca", "jan", "jane", "j.", "j", "maria", "marie", "m.", "bo", "maximiliana alexandrina", "maximiliana alexandrinaa", ""]
    lasts = ["pegula", "sakkaris", "de la cruz", "la cruz", "smith", "smithe", "papadopoulou konstantinidou", "papadopoulou konstantinido"]
    name = lambda: f"{rng.choice(firsts)} {rng.choice(lasts)}".strip()
    players = [(i, name(), f"A{i}" if rng.random() < 0.4 else None, f"W{i}" if rng.random() < 0.2 else None) for i in range(14)]
    aliases = [(name(), rng.randrange(14)) for _ in range(8)]
    genders = {i: g for i in range(14) if (g := rng.choice(["men", "women", "mixed", None]))}
    records = [(100 + i, rng.choice([name(), name(), "", "jessica pegula"]), rng.choice(["atp", "wta"]), rng.choice([None, None, "A3", "N1", "N2", f"A{rng.randrange(14)}", f"W{rng.randrange(14)}"]), rng.choice(["men", "women", None])) for i in range(160)]
    got, want = run(spark, records, players, aliases, genders), loop(records, players, aliases, genders)
    assert got == want
    assert {s for _, _, s in want} == {"matched", "queued", "created"}


def test_gender_gates_every_stage_but_ids(spark):
    players = [(1, "maria sakkaris", "A1", None), (2, "jessica pegula", None, None), (3, "jan pegula", None, None)]
    genders = {1: "women", 2: "women", 3: "men"}
    records = [(10, "maria sakkaris", "atp", None, "men"), (11, "maria-sakkaris", "atp", None, "men"), (12, "j. pegula", "wta", None, "women"), (13, "x", "atp", "A1", "men"), (14, "maria sakkaris", "atp", None, "men")]
    assert run(spark, records, players, [], genders) == [(10, "made 000010", "created"), (11, "made 000010", "matched"), (12, 2, "matched"), (13, 1, "matched"), (14, "made 000010", "matched")]


def test_large_ids_stay_exact(spark):
    big = 2**62 + 1
    done = identity.resolve(
        spark.createDataFrame([(big + 2, "bo lee", "atp", None, None), (big + 4, "new one", "atp", None, None)], "id long, name string, source_key string, external_id string, gender string"),
        spark.createDataFrame([(big, "bo lee", None, None)], "id long, name string, atp_id string, wta_id string"), identity.empty_aliases(spark),
    ).collect()
    assert {(r.in_id, r.made_by, r.status) for r in done} == {(big + 2, None, "matched"), (big + 4, big + 4, "created")} and big in {r.player_id for r in done}


def test_no_records_and_no_players(spark):
    assert run(spark, [], [(1, "a b", None, None)], [], {}) == []
    assert run(spark, [(1, "a b", "atp", None, None), (2, "a b", "wta", None, None)], [], [], {}) == [(1, "made 000001", "created"), (2, "made 000001", "matched")]
