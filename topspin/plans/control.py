"""Queries of gates, reports and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from topspin.functions import names
from topspin.operators import control, identity, metrics
from topspin.plans.registry import query
from topspin.sources import store
from topspin.sources.sinks import durable
from topspin.sources.store import WITH


def _day(text):
    return F.lit(text).cast("date")


@query(WITH + " SELECT id FROM m WHERE status IN ('completed', 'retired') AND (id % 3 = 0 OR id % 4 = 0)")
def unprocessed_matches(spark, sf_dir):
    done = F.when(F.col("id") % 3 != 0, F.lit(1500.0))
    rows = store.matches(spark, sf_dir).withColumns({"elo_post_player_a": done, "elo_post_player_b": done, "elo_needs_recompute": F.col("id") % 4 == 0})
    return control.unprocessed(rows).select("id")


@query(WITH + """, x AS (SELECT id, start_date + CAST(id AS INTEGER) AS s, CASE WHEN id % 4 <> 0 THEN start_date + CAST(id AS INTEGER) + 6 END AS e, DATE '1996-01-12' AS t FROM ed)
    SELECT id, coalesce(e >= t - 1, true) AS schedule, coalesce(e >= t - 1, true) AND coalesce(s - 1 <= t AND t <= e + 1, true) AS schedule_fast, s <= t + 1 AS results, s <= t + 1 AND coalesce(e >= t - 1, true) AS results_fast FROM x""")
def scrape_gates(spark, sf_dir):
    start = F.date_add("start_date", F.col("id").cast("int"))
    rows = store.editions(spark, sf_dir).select("id", start.alias("s"), F.when(F.col("id") % 4 != 0, F.date_add(start, 6)).alias("e"))
    a = (F.col("s"), F.col("e"), _day("1996-01-12"))
    return rows.select("id", control.wants_schedule(*a, False).alias("schedule"), control.wants_schedule(*a, True).alias("schedule_fast"), control.wants_results(*a, False).alias("results"), control.wants_results(*a, True).alias("results_fast"))


@query(WITH + " SELECT edition_id, count(*) AS matches, count(scheduled_date) AS dated, count(*) FILTER (status = 'scheduled') AS scheduled FROM m GROUP BY edition_id")
def schedule_coverage(spark, sf_dir):
    return control.schedule_coverage(store.matches(spark, sf_dir))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(7 + least(greatest(2024 - (2020 + n_nationkey % 7), 0), 2) AS INTEGER) AS priority FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 1")
def queueable_tournaments(spark, sf_dir):
    n = store.raw(spark, sf_dir, "nation")
    rows = n.select(F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey").cast("string")).alias("tournament_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 1, "2030-01-01").otherwise("soon").alias("start_date"), (2020 + F.col("n_nationkey") % 7).alias("year"))
    found = control.normalize_tournaments(rows.drop("year"), "atp", 2020).drop("year").join(rows.select(F.col("tournament_id").alias("id"), "year"), "id")
    none = spark.createDataFrame([], "tournament_id string")
    return control.queueable(found, none, _day("2024-05-01")).select("id", "name", F.col("priority").cast("int").alias("priority"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '14:30' WHEN 2 THEN '15:05' WHEN 3 THEN NULL WHEN 4 THEN '09:00' ELSE NULL END AS time, event_id % 6 IN (3, 5) AS followed_by FROM events""")
def schedule_times(spark, sf_dir):
    texts = ["Warmup 12:00", "Starts at 14:30 (Venue) Your time 09:30", "Not before 3:05 PM", "Followed by", "Starts at 9 am", "On court 10:00"]
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 6 + 1).cast("int"))
    return store.raw(spark, sf_dir, "events").select("event_id", control.match_time(text).alias("t")).select("event_id", "t.time", "t.followed_by")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'completed' WHEN event_type = 'view' THEN 'live' END AS state FROM events")
def schedule_states(spark, sf_dir):
    kind = F.col("event_type")
    code, text = F.when(kind == "view", "ip"), F.when(kind == "click", "Match Finished").otherwise("later")
    return store.raw(spark, sf_dir, "events").select("event_id", control.schedule_state(code, text).alias("state"))


@query("WITH s AS (SELECT user_id AS run_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN value > 95 THEN 'failed' ELSE 'success' END WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS st FROM events) SELECT run_id, CASE WHEN bool_or(st = 'failed') THEN 'failed' ELSE 'success' END AS status, count(*) AS stages FROM s GROUP BY run_id")
def run_statuses(spark, sf_dir):
    payload = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.when(F.col("value") > 95, "failed").otherwise("success").alias("status"))))
    rows = store.raw(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), payload.alias("payload"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"))
    return control.run_status(rows)


@query("""WITH r AS (SELECT user_id % 20 AS run_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value AS v FROM events),
    f AS (SELECT run_id, 'k' AS metric, k AS x FROM r UNION ALL SELECT run_id, 'timings.total', v FROM r UNION ALL SELECT run_id, 'timings.half', v / 2 FROM r WHERE k > 50)
    SELECT run_id, metric, round(sum(x), 6) AS total, count(*) AS workers FROM f WHERE x IS NOT NULL GROUP BY run_id, metric""")
def run_metrics(spark, sf_dir):
    """Payloads with a counter, a status and timings of their own."""
    timings = F.struct(F.col("value").alias("total"), F.when(F.get_json_object("props", "$.k").cast("int") > 50, F.col("value") / 2).alias("half"))
    payload = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.lit("ok").alias("status"), timings.alias("timings")))
    rows = store.raw(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run_id"), payload.alias("payload"))
    return metrics.run_metrics(rows).withColumn("total", F.round("total", 6))


@query(WITH + " SELECT count(*) AS matches, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (winner_id IS NOT NULL AND match_date IS NULL) AS undated, count(DISTINCT edition_id) FILTER (status = 'completed') AS editions FROM m")
def observed_counters(spark, sf_dir):
    """Counters of the pass that writes the matches, and of the one that counts their editions."""
    counters = metrics.Counters()
    rows = store.matches(spark, sf_dir)
    rows = counters.on(rows, matches=F.count("*"), completed=F.count_if(F.col("status") == "completed"), undated=F.count_if(F.col("winner_id").isNotNull() & F.col("match_date").isNull()))
    written = durable(rows)
    each = counters.on(written.where("status = 'completed'").groupBy("edition_id").count(), editions=F.count("*"))
    durable(each)
    found = counters.values()
    return spark.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in found.items()])


@query("SELECT c_custkey AS player_id, lower(c_name) AS alias FROM customer WHERE c_custkey % 4 = 1")
def recovered_aliases(spark, sf_dir):
    players = store.players(spark, sf_dir).select("id", F.lower("name").alias("name"))
    log = players.where("id % 2 = 1").select(F.to_json(F.struct(F.col("id").alias("keep_id"), F.col("name").alias("merged_name"))).alias("details"))
    known = players.where("id % 4 = 3").select(F.col("id").alias("player_id"), F.col("name").alias("alias"))
    return identity.recovered_aliases(log, known, players)


@query("SELECT c_custkey AS player_id, 'full name ' || c_custkey AS name FROM customer WHERE c_custkey % 2 = 0")
def best_aliases(spark, sf_dir):
    key = F.col("id").cast("string")
    forms = F.array(F.concat(F.lit("f. name "), key), F.when(F.col("id") % 2 == 0, F.concat(F.lit("full name "), key)), F.when(F.col("id") % 2 == 0, F.concat(F.lit("fu name "), key)))
    rows = store.players(spark, sf_dir).select(F.col("id").alias("player_id"), F.explode(forms).alias("alias")).where("alias IS NOT NULL")
    return identity.best_alias(rows)


@query("SELECT doc_id AS id, doc_id + 1 AS best FROM documents WHERE doc_id % 2 = 0 AND doc_id + 1 < (SELECT count(*) FROM documents)")
def review_queue_rows(spark, sf_dir):
    docs = store.raw(spark, sf_dir, "documents")
    item = lambda k: F.struct((F.col("doc_id") + k).alias("player_id"), F.lit(0.9).alias("confidence"))
    queue = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.array(F.struct(F.lit(-1).cast("long").alias("player_id"), F.lit(0.99).alias("confidence")), item(1), item(2)).alias("suggested"))
    people = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    return control.review_rows(queue, people).where("suggested IS NOT NULL").select("id", F.get("suggested", F.lit(0))["player_id"].alias("best"))


@query(WITH + ", u AS (SELECT id, 'atp' AS s, atp_id AS x FROM p WHERE atp_id IS NOT NULL UNION ALL SELECT id, 'wta', wta_id FROM p WHERE wta_id IS NOT NULL) SELECT id, s AS source_key, x AS external_id FROM u")
def external_id_keys(spark, sf_dir):
    pair = lambda s: F.struct(F.lit(s).alias("source_key"), F.col(f"{s}_id").alias("external_id"))
    rows = store.players(spark, sf_dir).select("id", F.inline(F.array(pair("atp"), pair("wta"))))
    return rows.where("external_id IS NOT NULL")


@query(WITH + " SELECT id, lower(name) AS variant FROM p")
def player_variants(spark, sf_dir):
    return identity.variants(store.players(spark, sf_dir).select("id", names.normalize_name(F.col("name")).alias("name")))
