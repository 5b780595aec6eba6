import hashlib
import itertools
import random
import re
import zlib

import pytest

from topspin.llm import queries, turn_repair

GOOD = re.compile(r"(s?(ua)+)?\Z")


def cheapest(facts):
    """Of all scripts (an insert at most before, between and behind turns) the cheapest, then the least, as ``(cost, script)``."""
    best = None
    for edits in itertools.product(*[("D",) if go else ("D", "K", "Ru", "Ra") for _, go, _ in facts]):
        for inserts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(facts) + 1):
            roles, script, cost = "", "", 0
            for k, said in enumerate(inserts):
                roles, script, cost = roles + said, script + "I" * len(said), cost + 5 * len(said)
                if k < len(facts):
                    initial, _, cut = facts[k]
                    e = edits[k]
                    roles += "" if e == "D" else (initial or "?") if e == "K" else e[1]
                    script += e[0]
                    cost += {"D": 2, "K": 0, "R": 1}[e[0]] + 5 * (cut and e != "D")
            if GOOD.match(roles) and (best is None or (cost, script) < best):
                best = cost, script
    return best


def plain(rows):
    """A dynamic program that carries whole scripts, for any number of turns ``(turn, role, text)``."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    seen, counts, states = set(), dict.fromkeys(("", "blank", "duplicate", "truncated"), 0), {"": (0, "", ())}

    def better(new, state, way):
        if state not in new or way[:2] < new[state][:2]:
            new[state] = way

    def inserted(states):
        found = {}
        for state, (cost, script, turns) in states.items():
            for _ in range(3):
                better(found, state, (cost, script, turns))
                state = after[state]
                cost, script, turns = cost + 5, script + "I", (*turns, {"u": "user", "a": "assistant"}[state] + ":")
        return found

    for _, role, text in rows:
        ends = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not ends else "duplicate" if (role, text) in seen else "" if ends[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        new, extra = {}, 5 * (fault == "truncated")
        # every way to insert before the turn, kept apart: a later edit may turn a dearer start into a lesser script only at equal cost
        for state, way in inserted(states).items():
            cost, script, turns = way
            better(new, state, (cost + 2, script + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            kept = role[:1]
            if kept and (kept == "s" and state == "" or kept in "ua" and after[state] == kept):
                better(new, kept, (cost + extra, script + "K", (*turns, f"{role}:{text}")))
            better(new, after[state], (cost + extra + 1, script + "R", (*turns, {"u": "user", "a": "assistant"}[after[state]] + ":" + text)))
        states = new
    cost, script, turns = min(w for s, w in inserted(states).items() if s in ("", "a"))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, script, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def broken(rows):
    found = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        turns = found.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return found


def talk(rng, conv, size):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "u", None]
    texts = ["Yes.", "No!", "So?", "cut", " ", "", None, "ok .\t", "Été.", "Ж…"]
    return [(conv, rng.choice([None, t, t, t, t // 2]), rng.choice(roles), rng.choice([*texts, f"Turn {t}.", f"Turn {t}."])) for t in range(size)]


def test_script_is_the_cheapest_and_least_of_all():
    kinds = [*((i, False, cut) for i in ("s", "u", "a", "t", "") for cut in (False, True)), ("u", True, False)]
    rng = random.Random(1)
    cases = [[], *([k] for k in kinds), *(list(c) for c in itertools.product(kinds, repeat=2)), *(rng.choices(kinds, k=3) for _ in range(60))]
    for facts in cases:
        assert turn_repair.script(iter(facts)) == cheapest(facts), facts


@pytest.mark.parametrize("partitions", [1, 7])
def test_query_equals_a_program_over_whole_scripts(spark, tmp_path, partitions):
    rng = random.Random(partitions)
    rows = [r for c in range(120) for r in talk(rng, c, rng.randint(1, 9))] + talk(rng, None, 6) + talk(rng, 500, 700) + talk(rng, 501, 30) * 2
    rows += [(600, t, "user" if t % 2 else "assistant", "Same." if t % 3 else "x" * 5000 + ".") for t in range(400)]
    spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string").write.parquet(str(tmp_path / "conversations.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = queries.op11_turn_repair(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = broken(rows)
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((c, *plain(found.get(c, [])))) for c in {r[0] for r in rows})


def test_repaired_turns_come_in_order(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (1, 2, "assistant", "Yes."), (2, 5, "assistant", "")], "conv_id long, turn long, role string, text string")
    scripts = turn_repair.repair_scripts(turns)
    assert sorted((r.conv_id, r.cost, r.audit) for r in scripts.collect()) == [(1, 2, "DKK"), (2, 2, "D")]
    left = turn_repair.repaired_turns(turns, scripts).collect()
    assert [tuple(r) for r in left] == [(1, 0, "user", "Well?"), (1, 1, "assistant", "Yes.")]


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair_scripts(turns).collect() == []
