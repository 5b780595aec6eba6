import itertools
import random

from pyspark.sql import functions as F

from topspin.functions import names
from topspin.operators import identity, ingest, rating, tables

PLAYERS = "id long, name string, atp_id string, wta_id string"


def people(n=60, seed=3):
    rng = random.Random(seed)
    first, last = ["jessica", "jan", "anna", "annabel", "carlos", "iga", "j.", "marie claire"], ["pegula", "smith", "smyth", "de la cruz", "swiatek", "alcaraz garfia"]
    return [(i, f"{rng.choice(first)} {rng.choice(last)}") for i in range(n)]


def test_pairs_of_large_blocks_are_all_compared(spark, monkeypatch):
    rng = random.Random(1)
    rows = sorted({"".join(rng.choices("abc", k=4)) + " smith" for _ in range(60)})
    rows = [(i, n) for i, n in enumerate(rows)] + [(100, "x smith")] * 2 + [(101, "x smith")]
    df = spark.createDataFrame(rows, "id long, name string")
    want = {(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations({r for r in rows if r[0] != 101}, 2) if a != b and names.name_similarity(a, b) >= 0.9} | {(100, 101)}
    for block in (4, 1000):
        monkeypatch.setattr(identity, "BLOCK", block)
        got = [(r.id_a, r.id_b) for r in identity.duplicate_pairs(df, 0.9).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_fuzzy_matches_find_misspelt_last_names_and_fall_back_to_equal_ones(spark):
    players = spark.createDataFrame([(1, "alexander zverevsky"), (2, "anna smith"), (3, "ann smith"), (4, "bo lee")], "id long, name string")
    asked = spark.createDataFrame([(10, "alexander zverevskyy"), (11, "anne smith"), (12, "bo lee"), (13, ""), (14, "nobody here")], "id long, name string")
    got = {(r.id, r.other): r.score for r in identity.fuzzy_matches(asked, players).collect()}
    assert (10, 1) in got and got[(12, 4)] == 1 and not any(i in (13, 14) for i, _ in got)
    assert {(11, 2), (11, 3)} <= got.keys()
    for (i, o), score in got.items():
        a, b = asked.where(F.col("id") == i).first().name, players.where(F.col("id") == o).first().name
        assert score >= 0.85 or names.name_similarity(a, b) == score


def test_resolve_review_and_merges(spark):
    players = spark.createDataFrame([(1, "j. pegula", None, None), (2, "jessica pegula", "A2", "W2"), (3, "bo lee", "A3", None), (4, "anna smith", None, None)], PLAYERS)
    queue = spark.createDataFrame([(7, "robert lee", "atp", "A9", "pending", None), (8, "new one", "wta", "W8", "pending", None), (9, "x", "atp", None, "pending", None), (10, "y", "atp", None, "pending", None)], "id long, name string, source string, external_id string, status string, resolved_player_id long")
    decisions = spark.createDataFrame([(7, "match", 4), (8, "create", None), (9, "ignore", None), (10, "match", None)], "id long, action string, player_id long")
    items, known, aliases = identity.resolve_review(queue, decisions, players, identity.empty_aliases(spark))
    got = {r.id: (r.status, r.resolved_player_id) for r in items.collect()}
    assert got[7] == ("matched", 4) and got[8][0] == "new_player" and got[9] == ("ignored", None) and got[10] == ("pending", None)
    rows = {r.id: r for r in known.collect()}
    assert rows[4].atp_id == "A9" and rows[got[8][1]].wta_id == "W8" and len(rows) == 5
    assert {(r.alias, r.player_id) for r in aliases.collect()} == {("robert lee", 4), ("new one", got[8][1])}

    redirects = spark.createDataFrame([(2, 1), (3, 2)], "merge_id long, keep_id long")
    merged, audit = identity.merge_profiles(redirects, players)
    kept = {r.id: tuple(r)[1:] for r in merged.collect()}
    assert kept == {1: ("jessica pegula", "A2", "W2", True), 4: ("anna smith", None, None, False)}
    assert {tuple(r) for r in audit.collect()} == {(1, 2, "jessica pegula"), (1, 3, "bo lee")}
    again = identity.merge_queue(redirects, items.withColumn("suggested", F.array(F.lit(3), F.lit(4), F.lit(2)).cast("array<bigint>")))
    assert {tuple(r.suggested) for r in again.collect()} == {(1, 4)}


def test_full_names_of_others_need_a_single_candidate(spark):
    rows = spark.createDataFrame([(1, "j. pegula"), (2, "jessica pegula"), (3, "c. alcaraz"), (4, "carlos alcaraz"), (5, "carla alcaraz"), (6, "i swiatek")], "id long, name string")
    assert {tuple(r) for r in identity.full_names_of_others(rows).collect()} == {(1, "jessica pegula")}


def test_draw_with_byes_results_and_history(spark):
    ddl = "id long, edition_id long, round string, draw_position int, player_a_id long, player_b_id long, status string, winner_id long, score string, external_id string, match_date date, scheduled_date date"
    stored = spark.createDataFrame([(1, 5, "QF", 1, 10, 11, "completed", 10, "6-0 6-0", "E1", None, None), (2, 5, "QF", 2, 12, 13, "upcoming", None, None, None, None, None), (3, 5, "QF", 3, 14, 15, "scheduled", None, None, "E3", None, None)], ddl)
    entry = "edition_id long, round string, draw_position int, player_a_id long, player_b_id long, is_bye boolean, winner_id long, score string, external_id string"
    entries = spark.createDataFrame([(5, "QF", 1, 10, 99, False, None, None, "X1"), (5, "QF", 2, 13, 12, False, None, None, "X2"), (5, "QF", 3, 14, 16, False, 16, "6-1 6-1", "E9"), (5, "QF", 4, None, 17, True, None, None, None)], entry)
    rows = ingest.apply_draw(stored, entries).collect()
    old, made = {r.id: r for r in rows if r.id in (1, 2, 3)}, [r for r in rows if r.id not in (1, 2, 3)]
    assert (old[1].status, old[1].player_b_id) == ("completed", 11) and old[2].external_id == "X2" and old[3].status == "cancelled"
    assert [(r.player_a_id, r.player_b_id, r.status, r.winner_id, r.external_id) for r in made] == [(14, 16, "completed", 16, "E9")]
    after = ingest.apply_draw(stored, entries)
    assert {(r.round, r.draw_position, r.player_a_id, r.player_b_id) for r in ingest.propagate(after, entries).collect()} == {("SF", 2, 16, 17)}
    assert ingest.propagate(after, entries, spark.createDataFrame([(1,)], "id long")).count() == 0

    result = "id long, external_id string, edition_id long, round string, player_a_id long, player_b_id long, match_date date, winner_id long, score string"
    results = spark.createDataFrame([(1, None, 5, "QF", 13, 12, None, 12, "6-4 6-4"), (2, None, 5, "SF", 10, 12, None, 10, "W/O"), (3, None, 5, "SF", 12, 10, None, 10, "W/O"), (4, None, 5, "SF", 12, None, None, 12, "6-0 6-0")], result)
    for update, status in ((True, "completed"), (False, "upcoming")):
        rows = {(r.round, r.draw_position): r for r in ingest.ingest_results(stored, results, F.col("id"), update).collect()}
        assert len(rows) == 4 and rows[("QF", 2)].status == status and rows[("SF", None)].status == "walkover"


def test_trigram_matches_equal_brute_force(spark):
    rows = people()
    df = spark.createDataFrame(rows, "id long, name string")
    got = {(r.left_id, r.right_id) for r in identity.trigram_matches(df, df, 0.5).where("left_id < right_id").collect()}

    def grams(name):
        return {("  " + w + " ")[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in name).split() for i in range(len(w) + 1)}

    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5}
    assert got == want


def test_fingerprints_see_changes_but_no_order(spark):
    rows = [(1, i, f"v{i}") for i in range(20)] + [(2, 1, None)]
    mark = lambda r: {x.g: x.fingerprint for x in tables.fingerprint(spark.createDataFrame(r, "g int, k int, v string"), ["g"], ["k", "v"]).collect()}
    assert mark(rows) == mark(rows[::-1])
    changed = mark([*rows[:5], (1, 5, "other"), *rows[6:]])
    assert changed[1] != mark(rows)[1] and changed[2] == mark(rows)[2]


def test_activation_is_guarded(spark):
    sets = spark.createDataFrame([("old", "{}", True)], "name string, params string, is_active boolean").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    new = lambda loss: rating.activated(sets, "new", rating.Params(margin_base=0.9), 0.65, loss, F.lit("2024-02-01").cast("timestamp"))
    assert new(0.649).count() == 1 and rating.active_params(new(0.649)) == rating.Params()
    assert rating.active_params(new(0.6)) == rating.Params(margin_base=0.9)
    assert rating.different([rating.Params(), rating.Params(margin_base=0.9), rating.Params()]) == [rating.Params(), rating.Params(margin_base=0.9)]
