"""Operators that no query shows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tests.test_rating import frame, make
from topspin.operators import bracket, control, identity, rating
from topspin.sources import sinks
from topspin.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rejects_and_audit_records(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "id long, v string")
    good, bad = sinks.split_rejects(df, (F.col("id") > 0) & F.col("v").isNotNull())
    assert rows(good) == [(1, "a")] and rows(bad) == [(2, None), (None, "c")]
    for part in (good, bad):
        sinks.append_audit(part, str(tmp_path / "audit"), "kind")
    assert sorted((r.update_type, json.dumps(json.loads(r.details), sort_keys=True)) for r in spark.read.parquet(str(tmp_path / "audit")).collect()) == [("kind", '{"id": 1, "v": "a"}'), ("kind", '{"id": 2}'), ("kind", '{"v": "c"}')]
    assert [json.loads(r.json) for r in sinks.as_json(good).collect()] == [{"id": 1, "v": "a"}]


def test_sources_that_changed(spark):
    seen = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, fingerprint string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "k string, fingerprint string")
    assert rows(jobs.changed_sources(seen, now, ["k"])) == [("b", "3"), ("c", "4")]


def test_stream_without_repeats(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:06:00")], "event_id long, ts string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.deduplicated(jobs.file_stream(spark, str(tmp_path / "in"), df.schema), "event_id")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_better_metadata_and_winners(spark):
    old = spark.createDataFrame([(1, " ", "Hard"), (2, "339", None), (3, "Brisbane", "Clay"), (4, "Rome", "Hard")], "id long, name string, surface string")
    new = spark.createDataFrame([(1, "Paris", "Clay"), (2, "Oslo", "Grass"), (3, "x", "Grass"), (4, None, None)], "id long, name string, surface string")
    assert rows(control.better_metadata(old, new)) == [(1, "Paris", "Clay"), (2, "Oslo", "Grass"), (3, "Brisbane", "Clay"), (4, "Rome", "Hard")]
    df = spark.createDataFrame([("x", "x", "y"), ("y", "x", "y"), ("z", "x", "y"), (" ", "x", "y"), (None, "x", "y")], "w string, a string, b string")
    assert [r[0] for r in df.select(control.winner_by_name(F.col("w"), F.col("a"), F.col("b"))).collect()] == ["A", "B", "A", None, None]
    df = spark.createDataFrame([("A", "B", None), (None, "B", None), (None, None, "4-6 3-6"), (None, None, None)], "c string, s string, score string")
    assert [r[0] for r in df.select(control.winner_of_page(F.col("c"), F.col("s"), F.col("score"))).collect()] == ["A", "B", "B", None]


def test_best_candidate_and_parameter_tables(spark):
    df = frame(spark, make(400, players=10))
    parts = rating.chronological_split(df.where(F.col("status").isin("completed", "retired")))
    candidates = [rating.Params(), rating.Params(margin_base=0.5, new_boost=2.5), rating.Params()]
    best, losses = rating.best_on(df, candidates, parts)
    every = {(r.candidate, r.part): r.log_loss for r in rating.evaluate(df, candidates[:2], parts).collect()}
    at = min((0, 1), key=lambda c: every[c, "validation"])
    assert best == candidates[at] and losses == {p: every[at, p] for p in ("train", "validation", "test")}
    table = rating.params_table(spark, {"now": rating.Params(), "new": candidates[1]})
    assert {r.name: (r.margin_base, r.k["G"]) for r in table.collect()} == {"now": (0.85, 116.0), "new": (0.5, 116.0)}


def test_gender_gate(spark):
    df = spark.createDataFrame([(None, "men"), ("men", None), ("men", "men"), ("men", "women"), ("women", "mixed")], "e string, i string")
    assert [r[0] for r in df.select(identity.same_gender(F.col("e"), F.col("i"))).collect()] == [True, True, True, False, False]


def test_draw_from_names_to_matches(spark):
    """Known, new and ambiguous names; a result, a bye, an open slot, and what they lead to."""
    players = spark.createDataFrame([(1, "jannik sinner", "S0AG", None), (2, "maria sakkari", None, None), (3, "jan lee", None, None), (4, "jane lee", None, None)], "id long, name string, atp_id string, wta_id string")
    genders = spark.createDataFrame([(2, "women")], "player_id long, gender string")
    entry = "edition_id long, round string, draw_position int, player_a string, player_a_external_id string, player_a_seed int, player_b string, player_b_external_id string, player_b_seed int, winner string, score string, is_bye boolean, source string"
    scraped = spark.createDataFrame([
        (7, "QF", 1, "Jannik Sinner", "S0AG", 1, "New Man", "N1", None, "Jannik Sinner", "6-1 6-1", False, "atp"),
        (7, "QF", 2, "Maria Sakkari", None, None, None, None, None, None, None, True, "atp"),
        (7, "QF", 3, "J. Lee", None, None, "Other Man", "N2", None, None, None, False, "atp"),
        (7, "QF", 4, "J. Lee", "L9", None, "Jannik Sinner", "S0AG", 1, None, None, False, "atp"),
    ], entry)
    editions = spark.createDataFrame([(7, "rome", 2024, dt.date(2024, 5, 1), dt.date(2024, 5, 8))], "id long, code string, year int, start_date date, end_date date")
    empty = spark.createDataFrame([], "id long, edition_id long, round string, draw_position int, player_a_id long, player_b_id long, player_a_seed int, status string, winner_id long, score string, external_id string, match_date date")
    done, people, aliases = bracket.ingest_draw(empty, scraped, players, identity.empty_aliases(spark), editions, genders)
    name = {r.id: (r.name, r.atp_id) for r in people.collect()}
    got = {(r.round, r.draw_position): (name[r.player_a_id], name[r.player_b_id], r.status, r.external_id) for r in done.collect()}
    assert got == {
        ("QF", 1): (("jannik sinner", "S0AG"), ("new man", "N1"), "completed", "2024_ROME_QF_N1_S0AG"), ("QF", 4): (("j. lee", "L9"), ("jannik sinner", "S0AG"), "upcoming", "2024_ROME_QF_L9_S0AG"),
        ("SF", 1): (("jannik sinner", "S0AG"), ("maria sakkari", None), "upcoming", "draw_2024_rome_SF_1"),
    }
    assert len(name) == 8  # a man named like the woman, two new men, and one of the two who might be others
    assert {(r.alias, r.source) for r in aliases.collect()} == {("jannik sinner", "atp"), ("new man", "atp"), ("maria sakkari", "atp"), ("other man", "atp"), ("j. lee", "atp")}
    certain = scraped.where("draw_position <> 3")  # by now, the name of the third slot is known
    again, more, _ = bracket.ingest_draw(done, certain, people, aliases, editions, genders)
    assert rows(again) == rows(done) and rows(more) == rows(people)
