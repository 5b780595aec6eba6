import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_rating import frame, make
from topspin.operators import ingest, rating
from topspin.sources import deltas
from topspin.sources.deltas import DeltaLog
from topspin.streaming import jobs


def written(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_latest_rows_by_key_and_compaction(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path), base_every=2)
    rows = lambda *r: spark.createDataFrame(r, "id long, v string")
    assert log.read("t", ["id"]) is None and log.last() == (0, {})
    assert log.append(1, {"t": rows((1, "a"), (2, "b"))}) and log.append(2, {"t": rows((2, "c")), "other": rows((7, "x"))}, {"note": 5})
    assert not log.append(2, {"t": rows((9, "z"))})
    assert sorted(map(tuple, log.read("t", ["id"]).collect())) == [(1, "a"), (2, "c")] and sorted(map(tuple, log.read("t", ["id"], 1).collect())) == [(1, "a"), (2, "b")]
    assert log.compact({"t": ["id"], "other": ["id"]}) == 3 and log.last()[1]["tables"]["t"] == {"base": 3, "deltas": []} and log.last()[1]["info"] == {"note": 5}
    log.append(4, {"t": rows((3, "d"))})
    assert sorted(map(tuple, log.read("t", ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")] and log.read("other", ["id"]).count() == 1


def played(spark, n=120, seed=1):
    return frame(spark, make(n, seed=seed)).where("match_date IS NOT NULL")


def put(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_bytes_follow_the_batch(spark, tmp_path):
    df = played(spark, 1500)
    last = df.orderBy(F.desc("temporal_order")).limit(5).select("id")
    put(df.join(last, "id", "left_anti"), tmp_path / "in")

    def run():
        jobs.rate_stream(jobs.file_stream(spark, str(tmp_path / "in"), df.schema, 1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return written(tmp_path / "out")

    first = run()
    put(df.join(last, "id", "left_semi"), tmp_path / "in")
    assert run() - first < first / 5
    log = DeltaLog(spark, str(tmp_path / "out"))
    got, want = log.read("rated", ["id"]), rating.rebuild(df)
    assert sorted(map(tuple, got.select("id", "post_a", "post_b").collect())) == sorted(map(tuple, want.select("id", "post_a", "post_b").collect()))
    states = {r.player_id: r for r in log.read("states", ["player_id"]).collect()}
    assert states == {r.player_id: r for r in rating.states_after(want, df).select(*log.read("states", ["player_id"]).columns).collect()}


def test_restart_after_a_failure_in_between_gives_the_same_tables(spark, tmp_path, monkeypatch):
    df = played(spark)
    for k in range(3):
        put(df.where(F.col("id") % 3 == k), tmp_path / "in")
    tables = {}
    for name in ("whole", "broken"):
        commit, failures = DeltaLog._commit, [2, 3] if name == "broken" else []

        def failing(self, version, content, failures=failures, commit=commit):
            if version in failures:
                failures.remove(version)
                raise RuntimeError("lost")
            return commit(self, version, content)

        monkeypatch.setattr(DeltaLog, "_commit", failing)
        for _ in range(3):
            query = jobs.rate_stream(jobs.file_stream(spark, str(tmp_path / "in"), df.schema, 1), str(tmp_path / name), str(tmp_path / f"check-{name}"))
            try:
                query.awaitTermination()
                break
            except Exception as error:
                assert "lost" in str(error)
        log = DeltaLog(spark, str(tmp_path / name))
        assert log.last()[0] == 3 and not failures
        tables[name] = [sorted(map(tuple, log.read(t, k).collect()), key=repr) for t, k in jobs.RATING_KEYS.items()]
    assert tables["whole"] == tables["broken"]


def test_a_job_killed_after_any_page_does_each_row_once(spark, tmp_path, monkeypatch):
    source = spark.range(0, 1000, 7).selectExpr("id", "cast(id % 5 as string) AS v").repartition(3)
    log, commit, rng = DeltaLog(spark, str(tmp_path)), DeltaLog._commit, random.Random(3)

    def dying(self, version, content):
        if rng.random() < 0.4:
            raise RuntimeError("killed")
        return commit(self, version, content)

    monkeypatch.setattr(DeltaLog, "_commit", dying)
    for _ in range(40):
        try:
            if deltas.keyset_job(log, source, "id", lambda page: page.withColumn("seen", F.lit(1)), size=25, pages=2) < 2:
                break
        except RuntimeError:
            pass
    got = log.read("done").collect()
    assert sorted(r.id for r in got) == list(range(0, 1000, 7)) and log.last()[0] == 6


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_in_any_order_equals_the_batch_operator(spark, tmp_path, seed):
    rng = random.Random(seed)
    rounds = {"R16": 8, "QF": 4, "SF": 2, "F": 1}
    rows = [(i, e, r, p, rng.choice([None, rng.randint(1, 9)])) for i, (e, r, p) in enumerate(((e, r, p) for e in (1, 2, 3) for r, n in rounds.items() for p in range(1, n + 1)), 1) if rng.random() < 0.85]
    rows += [(500 + i, *rng.choice(rows)[1:4], rng.randint(1, 9)) for i in range(6)] + [(900, 1, "QF", None, 3), (0, 2, "R16", 3, 8)]
    df = spark.createDataFrame(rows, "id long, edition_id long, round string, draw_position int, winner_id long")
    rng.shuffle(rows)
    for part in range(3):
        put(spark.createDataFrame(rows[part::3], df.schema), tmp_path / "in")
    jobs.propagate_stream(jobs.file_stream(spark, str(tmp_path / "in"), df.schema, 1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    byes = df.where("id = 0").selectExpr("edition_id", "round", "draw_position", "winner_id AS player_a_id", "CAST(NULL AS LONG) AS player_b_id", "true AS is_bye")
    want = ingest.propagate(df.where("id <> 0"), byes)
    columns = ["edition_id", "round", "draw_position", "player_a_id", "player_b_id"]
    got = jobs.propagated(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())) != []


def test_point_reads_reach_the_scan_and_rate_just_those(spark, tmp_path, capsys):
    df = played(spark, 300)
    df.write.parquet(str(tmp_path / "star"))
    star = spark.read.parquet(str(tmp_path / "star"))
    early = star.where("match_date < '2022-05-01'")
    rated = rating.rebuild(early)
    rated.write.parquet(str(tmp_path / "rated"))
    rated = spark.read.parquet(str(tmp_path / "rated"))
    states = rating.states_after(rated, star)
    ids = star.where("match_date >= '2022-05-01'").select("id")
    for most in (1000, 2):
        rating.by_ids(star, ids, most).explain("formatted")
        plan = capsys.readouterr().out
        pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
        assert any("In(id, [" in line if most > 2 else "GreaterThanOrEqual(id" in line for line in pushed), plan
        assert sorted(r.id for r in rating.by_ids(star, ids, most).collect()) == sorted(r.id for r in ids.collect())
    by_point, by_run = rating.update_ratings(star, rated, states, ids=ids), rating.update_ratings(star, rated, states)
    for a, b in zip(by_point, by_run, strict=True):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)
    assert rating.by_ids(star, ids.limit(0)).count() == 0
