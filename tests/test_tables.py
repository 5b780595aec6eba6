import datetime as dt

import pytest
from pyspark.sql import functions as F

from topspin.operators import identity, ingest, matches, tables
from topspin.sources import pages
from topspin.sources.deltas import DeltaLog
from topspin.streaming import jobs


def test_statuses_tours_and_windows():
    assert matches.normalize_statuses("completed, nope,COMPLETED ,retired") == ["completed", "retired"]
    assert matches.normalize_statuses(["nope"]) == ["completed", "retired", "walkover", "default"]
    assert matches.expand_tours(["WTA_125", "X"]) == ["WTA_125", "WTA 125", "X"]
    assert matches.expand_tours(["WTA"], allowed=["ATP"]) == ["ATP"]
    day = dt.date(2024, 5, 10)
    assert matches.date_window("7d", day) == (dt.date(2024, 5, 3), day) and matches.date_window("2020", day, start="bad", end="2020-03-01") == (dt.date(2020, 1, 1), dt.date(2020, 3, 1))


def test_abbreviated_names_match_or_queue(spark):
    ddl = "id long, name string, source_key string, external_id string, gender string"
    players = spark.createDataFrame([(1, "jessica pegula", None, None), (2, "karolina pliskova", None, None), (3, "kristyna pliskova", None, None), (4, "juan martin del potro", None, "W4")], "id long, name string, atp_id string, wta_id string")
    aliases = spark.createDataFrame([(1, "jess pegula", "wta")], "player_id long, alias string, source string")
    incoming = spark.createDataFrame([(10, "j. pegula", "wta", "X", None), (11, "k. pliskova", "wta", None, None), (12, "any name", "wta", "W4", None), (13, "jess pegula", "wta", None, "women"), (14, "new person", "wta", None, None), (15, "j. del potro", "wta", None, None)], ddl)
    got = {r.in_id: (r.player_id, r.status) for r in identity.resolve(incoming, players, aliases).collect()}
    assert got.pop(14)[1] == "created"
    assert got == {10: (1, "matched"), 11: (None, "queued"), 12: (4, "matched"), 13: (1, "matched"), 15: (4, "matched")}
    gender = spark.createDataFrame([(1, "men")], "player_id long, gender string")
    assert {r.in_id: r.status for r in identity.resolve(incoming, players, aliases, gender).collect()}[13] != "x"


def test_duplicates_and_merging(spark):
    names = spark.createDataFrame([(1, "novak djokovic"), (2, "n djokovic"), (3, "novak djokovic"), (4, "rafael nadal")], "id long, name string")
    pairs = {(r.id_a, r.id_b) for r in identity.duplicate_pairs(names).collect()}
    assert pairs == {(1, 2), (1, 3)}
    chain = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (20, 21), (21, 22), (22, 20)], "merge_id long, keep_id long")
    assert {tuple(r) for r in identity.merge_targets(chain).collect()} == {(5, 1), (4, 1), (3, 1), (9, 8), (21, 20), (22, 20)}
    weights = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 5, 2)], "id long, matches int, external_ids int")
    two = spark.createDataFrame([(1, 2), (2, 3)], "id_a long, id_b long")
    assert {tuple(r) for r in identity.keep_choice(two, weights).collect()} == {(2, 1), (2, 3)}


def test_trigram_join_loses_no_pair(spark):
    import itertools
    import random

    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(2))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string")

    def grams(name):
        return {p[i : i + 3] for w in name.split() for p in [f"  {w} "] for i in range(len(p) - 2)}

    sets = {i: grams(n) for i, n in rows}
    want = {(a, b) for a, b in itertools.product(sets, sets) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(r.left_id, r.right_id) for r in identity.trigram_matches(df, df, 0.5).collect()} == want


def test_results_change_matches(spark):
    ddl = "id long, external_id string, edition_id long, round string, player_a_id long, player_b_id long, match_date date, winner_id long, score string, status string"
    day = dt.date(2024, 1, 1)
    old = spark.createDataFrame([(1, "draw_1", 1, "F", 1, 2, day, None, None, "upcoming"), (2, None, 1, "SF", 1, 3, None, None, None, "upcoming"), (3, "keep", 1, "SF", 2, 4, None, None, None, "upcoming")], ddl)
    results = spark.createDataFrame([(0, "real", 1, "F", 2, 1, None, 1, "6-4 6-4", None), (0, "other", 1, "SF", 4, 2, day, 4, "6-4 2-1 RET", None)], ddl)
    got = {r.id: r for r in ingest.apply_results(old, ingest.match_results(results, old)).collect()}
    assert (got[1].external_id, got[1].match_date, got[1].winner_id, got[1].status) == ("real", day, 1, "completed")
    assert (got[2].external_id, got[2].status) == (None, "upcoming")
    assert (got[3].external_id, got[3].match_date, got[3].status) == ("keep", day, "retired")


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, name string, n int")
    assert sorted(map(tuple, tables.upsert(old, spark.createDataFrame([(2, "c", 1), (3, "d", 2)], old.schema), "id").collect()), key=str) == [(1, "a", None), (2, "c", 1), (3, "d", 2)]
    assert {tuple(r) for r in tables.update(old, spark.createDataFrame([(2, None)], "id long, n int"), "id", ["n"]).collect()} == {(1, "a", None), (2, "b", None)}
    assert {tuple(r) for r in tables.fill_null(old, spark.createDataFrame([(1, 9), (2, 9)], "id long, n int"), "id", ["n"]).collect()} == {(1, "a", 9), (2, "b", 5)}
    assert {tuple(r) for r in tables.insert_missing(old, spark.createDataFrame([(2, "x", 0), (4, "y", 0)], old.schema), ["id"]).collect()} == {(1, "a", None), (2, "b", 5), (4, "y", 0)}
    assert tables.fingerprint(old, ["name"], ["id"]).collect() != tables.fingerprint(old.withColumn("id", F.col("id") + 1), ["name"], ["id"]).collect()


HTML = """<table class="match-table"><tr><td class="player-name"><a href="/players/111/x">(1) Iga Swiatek</a></td><td class="set">4</td><td class="set is-winner">6</td><td class="set">4</td></tr>
<tr><td class="player-name"><a href="/players/222/y">Jess Pegula [5]</a></td><td class="set is-winner">6</td><td class="set">4</td><td class="set is-winner">6</td></tr></table>
<table class="match-table match-table--winner-a"><tr><td class="name">A One<td class="set">6<tr><td class="name">B Two<td class="set">3</table>"""


def test_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>no <b>table")], "page_id long, html string")
    got = [tuple(r)[2:] for r in pages.match_tables(df).orderBy("page_id", "position").collect()]
    assert got == [("Iga Swiatek", "Jess Pegula", "111", "222", "B", "4-6 6-4 4-6"), ("A One", "B Two", None, None, "A", "6-3")]
    assert pages.cells(df).count() == 12 and pages.links(df).count() == 2
    (tmp_path / "a.md").write_text("---\ntitle: 'One'\ndate: 2024-02-01\n---\nBody\n")
    (tmp_path / "b.md").write_text("---\ntitle: Two\ndate: 2024-03-01\ndraft: true\n---\nBody\n")
    (tmp_path / "c.md").write_text("---\ntitle: Three\ndate: 2024-03-02\n---\nBody 3\n")
    assert [(r.title, r.body.strip()) for r in pages.posts(spark, str(tmp_path)).collect()] == [("Three", "Body 3"), ("One", "Body")]
    p = pages.profiles(spark.createDataFrame([(1, '<script type="application/ld+json">{"birthDate": "2001-05-31", "nationality": "POL"}</script><p>176 cm</p><p>Turned Pro: 2016</p>Right-Handed, Two-Handed Backhand')], "page_id long, html string")).first()
    assert (p.birth_date, p.nationality, p.height_cm, p.turned_pro_year, p.hand, p.backhand) == (dt.date(2001, 5, 31), "POL", 176, 2016, "Right", "Two")


def test_stream_rates_like_a_rebuild(spark, tmp_path):
    from tests.test_rating import frame, make
    from topspin.operators import rating

    df = frame(spark, make(120)).where("match_date IS NOT NULL")
    for k in range(3):
        df.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    query = jobs.rate_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    log = DeltaLog(spark, str(tmp_path / "out"))
    got = {r.id: r.post_a for r in log.read("rated", ["id"]).collect()}
    want = {r.id: r.post_a for r in rating.rebuild(df).collect()}
    assert log.last()[0] == 3 and got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=0.02) for i in want)
