"""What to scrape, replay and report: gates, classifications and run summaries as columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topspin.functions.domain import chain
from topspin.functions.scores import parse_score
from topspin.schema import RATED


def unprocessed(matches: DataFrame) -> DataFrame:
    """Finished matches with a winner that lack a rating or are flagged to be rated again."""
    return matches.where(F.col("status").isin(*RATED) & F.col("winner_id").isNotNull() & (F.col("elo_post_player_a").isNull() | F.col("elo_post_player_b").isNull() | F.coalesce("elo_needs_recompute", F.lit(False))))


def wants_schedule(start: Column, end: Column, today: Column, fast: bool) -> Column:
    """Whether a tournament's schedule is scraped: not once it has ended; in fast mode only around its days."""
    over = F.coalesce(end < F.date_sub(today, 1), F.lit(False))
    near = F.coalesce((F.date_sub(start, 1) <= today) & (today <= F.date_add(end, 1)), F.lit(True))
    return ~over & near if fast else ~over


def wants_results(start: Column, end: Column, today: Column, fast: bool) -> Column:
    """Whether a tournament's results are scraped: not before it has begun; in fast mode not after it has ended."""
    early = F.coalesce(start > F.date_add(today, 1), F.lit(False))
    return ~early & ~F.coalesce(end < F.date_sub(today, 1), F.lit(False)) if fast else ~early


def normalize_tournaments(rows: DataFrame, tour_key: str, year: int) -> DataFrame:
    """Scraped tournaments in one form; those without an id are left out."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    key = F.coalesce(F.nullif(have("id").cast("string"), F.lit("")), F.nullif(have("tournament_id").cast("string"), F.lit("")))
    out = rows.select(key.alias("id"), *[have(c).alias(c) for c in ("name", "level", "surface", "location", "start_date", "end_date", "number", "url")], F.lit(tour_key).alias("tour_key"), F.lit(year).alias("year"))
    return out.where(F.col("id").isNotNull())


def task_params(tournaments: DataFrame) -> DataFrame:
    """Parameters of a task for each tournament, as JSON; places and numbers only where the tour has them."""
    tour_c = F.col("tour_key").startswith("itf")
    own = F.struct("tour_key", "year", F.col("id").alias("tournament_id"), F.col("name").alias("tournament_name"), "start_date", "end_date", F.when(tour_c, F.col("url")).alias("tournament_url"), F.when(~tour_c, F.col("number")).alias("tournament_number"))
    return tournaments.select(F.lit("historical_tournament").alias("task_type"), F.to_json(own).alias("task_params"))


def queueable(tournaments: DataFrame, queued: DataFrame, today: Column) -> DataFrame:
    """Tournaments that aren't queued and don't start more than a week from now (unreadable dates count as near), with their priority: the older, the lower."""
    start = F.try_to_date("start_date", "yyyy-MM-dd")
    rows = tournaments.where(~F.coalesce(start > F.date_add(today, 7), F.lit(False))).join(queued.select(F.col("tournament_id").alias("id")), "id", "left_anti")
    return rows.withColumn("priority", 7 + F.least(F.greatest(2024 - F.col("year"), F.lit(0)), F.lit(2)))


def schedule_state(code: Column, text: Column) -> Column:
    """``completed``, ``live`` or null, from a schedule row's status code and text."""
    c, t = F.upper(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return chain((c.eqNullSafe("F") | t.contains("finished"), "completed"), (c.isin("L", "LIVE", "I", "IN PROGRESS", "P", "IP") | t.contains("live match"), "live"))


def match_time(text: Column) -> Column:
    """``struct<time, followed_by>`` of a schedule text: the venue's time, else one behind "not before", "starts at" or the like."""
    t = F.lower(F.coalesce(text, F.lit("")))
    follows = t.contains("follows previous match") | t.contains("followed by")
    venue = F.nullif(F.regexp_extract(text, r"(\d{1,2}:\d{2})(?=\s*\(Venue\))", 1), F.lit(""))
    own = F.trim(F.substring_index(text, "Your time", 1))
    told = follows | F.lower(own).rlike("not before|after rest|starts? at")
    hour = F.regexp_extract(own, r"(?i)(\d{1,2})(?::(\d{2}))?\s*([AP]M)", 1).try_cast("int")
    minute = F.coalesce(F.nullif(F.regexp_extract(own, r"(?i)(\d{1,2})(?::(\d{2}))?\s*([AP]M)", 2), F.lit("")), F.lit("00"))
    pm = F.lower(F.regexp_extract(own, r"(?i)(\d{1,2})(?::(\d{2}))?\s*([AP]M)", 3)) == "pm"
    half = F.when(hour.isNotNull(), F.concat(F.lpad((hour % 12 + F.when(pm, 12).otherwise(0)).cast("string"), 2, "0"), F.lit(":"), minute))
    whole = F.nullif(F.regexp_extract(own, r"(\d{1,2}:\d{2})", 1), F.lit(""))
    time = chain((t.contains("warmup") | t.contains("on court"), None), (venue.isNotNull(), venue), (told, F.coalesce(half, F.lpad(whole, 5, "0"))))
    return F.struct(time.alias("time"), (follows | (t.contains("on court") & ~t.contains("warmup"))).alias("followed_by"))


def is_bye(name_a: Column, name_b: Column, one_named: bool = False) -> Column:
    """A draw entry with a bye: said so, or (where a source leaves the other name out) with exactly one player."""
    said = F.lower(F.trim(F.coalesce(name_a, F.lit("")))).isin("bye") | F.lower(F.trim(F.coalesce(name_b, F.lit("")))).isin("bye")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return said | (empty(name_a) != empty(name_b)) if one_named else said


def schedule_coverage(matches: DataFrame) -> DataFrame:
    """Matches of each edition, and how many have a date and are scheduled."""
    return matches.groupBy("edition_id").agg(F.count("*").alias("matches"), F.count("scheduled_date").alias("dated"), F.count_if(F.col("status") == "scheduled").alias("scheduled"))


def review_rows(queue: DataFrame, players: DataFrame) -> DataFrame:
    """Review items (``id``, ``suggested`` as array of ``player_id`` and ``confidence``) with the suggested players' names in order; unknown ones are skipped."""
    each = queue.select("id", F.posexplode("suggested").alias("at", "s")).select("id", "at", "s.player_id", "s.confidence")
    known = each.join(players.select(F.col("id").alias("player_id"), "name"), "player_id")
    rows = known.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "player_id", "name", "confidence"))), lambda x: F.struct(x["player_id"].alias("player_id"), x["name"].alias("name"), x["confidence"].alias("confidence"))).alias("suggested"))
    return queue.select("id").join(rows, "id", "left")


def run_status(stages: DataFrame) -> DataFrame:
    """Each run's status: failed if a stage failed; what a stage's own payload says goes before its exit code."""
    status = F.coalesce(F.get_json_object("payload", "$.status"), F.when(F.col("exit_code") == 0, "success").otherwise("failed"))
    return stages.groupBy("run_id").agg(F.when(F.max(F.when(status == "failed", 1).otherwise(0)) == 1, "failed").otherwise("success").alias("status"), F.count("*").alias("stages"))


def better_metadata(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Tournaments with better names and surfaces: a name that is empty or only an id is replaced, a surface only where the old one is the default."""
    found = new.select(F.col(key), F.col("name").alias("_name"), F.col("surface").alias("_surface"))
    poor = F.col("name").isNull() | F.col("name").rlike(r"^\s*$|^[\d\W_]+$")
    rows = old.join(found, key, "left")
    return rows.select(*[{"name": F.when(poor & F.col("_name").isNotNull(), F.col("_name")).otherwise(F.col("name")), "surface": F.when((F.coalesce("surface", F.lit("Hard")) == "Hard") & F.col("_surface").isNotNull(), F.col("_surface")).otherwise(F.col("surface"))}.get(c, F.col(c)).alias(c) for c in old.columns])


def winner_by_name(winner: Column, a: Column, b: Column) -> Column:
    """A or B by the winner's name; a name that is neither counts as A, no name as null."""
    return F.when(winner.isNull() | (F.trim(winner) == ""), None).when(winner == a, "A").when(winner == b, "B").otherwise("A")


def winner_of_page(by_class: Column, by_sets: Column, score: Column) -> Column:
    return F.coalesce(by_class, by_sets, parse_score(score)["winner"])
