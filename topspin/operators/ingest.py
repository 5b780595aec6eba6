"""Ingestion: results, draws, schedules and the work queue as changes to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topspin.functions.domain import edition_end, expected_matches, next_position, next_round, round_date, round_order
from topspin.functions.scores import parse_score
from topspin.operators.tables import first_by
from topspin.schema import STATUS_GROUPS
from topspin.sources.sinks import durable

PENDING, TERMINAL = STATUS_GROUPS["pending"], STATUS_GROUPS["terminal"]


def sibling_dates(matches: DataFrame) -> DataFrame:
    """``matches`` with ``sibling_date``: the last date of the same edition and round."""
    last = matches.groupBy("edition_id", "round").agg(F.max("match_date").alias("sibling_date"))
    return matches.join(last, ["edition_id", "round"])


def fill_dates(matches: DataFrame) -> DataFrame:
    """Effective dates: the match's, the scheduled, the siblings', the round's estimate from ``start_date`` and ``end_date``."""
    rows = sibling_dates(matches)
    return rows.withColumn("effective_date", F.coalesce("match_date", "scheduled_date", "sibling_date", round_date(F.col("start_date"), F.col("end_date"), F.col("round"))))


def dedupe_results(results: DataFrame, order: Column) -> DataFrame:
    """The first record of each external id, or of each pair, round and date without one."""
    rest = F.struct("edition_id", "round", F.least("player_a_id", "player_b_id").alias("low"), F.greatest("player_a_id", "player_b_id").alias("high"), "match_date")
    key = F.struct("external_id", F.when(F.col("external_id").isNull(), rest).alias("rest"))
    return first_by(results.withColumn("_key", key), ["_key"], [order]).drop("_key")


def match_results(results: DataFrame, matches: DataFrame) -> DataFrame:
    """``results`` with ``match_id``: the stored match by external id, else the first by edition, round and pair in either order."""
    by_id = first_by(matches.where(F.col("external_id").isNotNull()).select("external_id", F.col("id").alias("by_id")), ["external_id"], [F.col("by_id")])
    pair = [F.least("player_a_id", "player_b_id").alias("low"), F.greatest("player_a_id", "player_b_id").alias("high")]
    by_pair = matches.groupBy("edition_id", "round", *pair).agg(F.min("id").alias("by_pair"))
    rows = results.withColumns({"low": pair[0], "high": pair[1]}).join(by_id, "external_id", "left").join(by_pair, ["edition_id", "round", "low", "high"], "left")
    return rows.withColumn("match_id", F.coalesce("by_id", "by_pair")).drop("by_id", "by_pair", "low", "high")


def apply_results(matches: DataFrame, matched: DataFrame) -> DataFrame:
    """``matches`` with the results of ``match_results()``: a real date is never replaced by none; an id is replaced if it is missing or the draw's own; status and winner follow the score."""
    parsed = parse_score(F.col("score"))
    new = first_by(matched.where(F.col("match_id").isNotNull()), ["match_id"], [F.col("external_id").asc_nulls_last(), F.col("score")])
    new = new.select(F.col("match_id").alias("id"), F.struct(F.col("external_id").alias("ext"), F.col("match_date").alias("date"), F.col("winner_id").alias("winner"), F.col("score").alias("score"), parsed["status"].alias("status")).alias("_n"))
    rows = matches.join(new, "id", "left")
    hit, weak = F.col("_n").isNotNull(), F.col("external_id").isNull() | F.col("external_id").startswith("draw_")
    change = {
        "external_id": F.when(hit & weak, F.coalesce("_n.ext", "external_id")).otherwise(F.col("external_id")),
        "match_date": F.when(hit, F.coalesce("_n.date", "match_date")).otherwise(F.col("match_date")),
        "winner_id": F.when(hit, F.coalesce("_n.winner", "winner_id")).otherwise(F.col("winner_id")),
        "score": F.when(hit, F.coalesce("_n.score", "score")).otherwise(F.col("score")),
        "status": F.when(hit & F.col("_n.status").isNotNull(), F.col("_n.status")).otherwise(F.col("status")),
    }
    return rows.select(*[change[c].alias(c) if c in change else F.col(c) for c in matches.columns])


def ingest_results(matches: DataFrame, results: DataFrame, order: Column, update_existing: bool = True) -> DataFrame:
    """``matches`` after a batch of results: each once, stored ones updated by ``apply_results()``, the others made. Ids of new matches are hashes of what identifies them.

    ``results`` has ``external_id``, ``edition_id``, ``round``, the players, ``match_date``, ``winner_id`` and ``score``; those without both players are left out. Without
    ``update_existing`` (history that is read again) stored matches stay as they are.
    """
    known = results.where(F.col("player_a_id").isNotNull() & F.col("player_b_id").isNotNull() & (F.col("player_a_id") != F.col("player_b_id")))
    matched = durable(match_results(dedupe_results(known, order), matches))
    key = F.xxhash64(F.lit("result"), F.coalesce("external_id", F.lit("")), "edition_id", "round", F.least("player_a_id", "player_b_id"), F.greatest("player_a_id", "player_b_id"), F.coalesce(F.col("match_date").cast("string"), F.lit("")))
    status = F.coalesce(parse_score(F.col("score"))["status"], F.when(F.col("winner_id").isNotNull(), "completed").otherwise("upcoming"))
    made = matched.where(F.col("match_id").isNull()).select(key.alias("id"), "external_id", "edition_id", "round", "player_a_id", "player_b_id", "match_date", "winner_id", "score", status.alias("status"))
    kept = apply_results(matches, matched) if update_existing else matches
    return kept.unionByName(made, allowMissingColumns=True)


def stale_pending(matches: DataFrame, step: int = 2, skip_round_robin: bool = False) -> DataFrame:
    """Pending matches of rounds that lie more than ``step`` rounds behind the furthest finished one of their edition."""
    order = {r: i for i, r in enumerate(x for x in ("Q1", "Q2", "Q3", "R128", "R64", "R32", "RR", "R16", "QF", "SF", "F") if not (skip_round_robin and x == "RR"))}
    place = F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("round"))
    furthest = matches.where(F.col("status").isin("completed", "retired", "walkover", "default")).groupBy("edition_id").agg(F.max(place).alias("furthest"))
    return matches.where(F.col("status").isin(*PENDING)).join(furthest, "edition_id").where(F.col("furthest") - place > step).select("id", "edition_id", "round")


SLOT = ("edition_id", "round", "draw_position")


def slot_rows(stored: DataFrame) -> DataFrame:
    """The match that stands for each slot: a pending one, else a finished one, else a cancelled one; of several the one with the greatest id."""
    rank = F.when(F.col("status").isin(*PENDING), 0).when(F.col("status") == "cancelled", 2).otherwise(1)
    return first_by(stored.where(F.col("draw_position").isNotNull()), SLOT, [rank, F.col("id").desc()])


def _pair(a: str = "player_a_id", b: str = "player_b_id") -> Column:
    return F.array_sort(F.array(a, b))


def draw_actions(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """What a scraped draw does to the stored one, slot by slot: create, keep, fill, replace (cancel and create) or preserve; byes and undecided slots are skipped.

    ``entries`` has ``edition_id``, ``round``, ``draw_position``, ``player_a_id``, ``player_b_id``, ``is_bye``; ``stored`` the same and ``status``, ``id``.
    """
    held = slot_rows(stored).select(*SLOT, F.col("id").alias("match_id"), F.col("status").alias("held_status"), _pair().alias("held_pair"), F.col("external_id").alias("held_external_id"))
    rows = entries.join(held, list(SLOT), "left")
    same = _pair() == F.col("held_pair")
    action = (
        F.when(F.coalesce("is_bye", F.lit(False)), "bye").when(F.col("player_a_id").isNull() | F.col("player_b_id").isNull(), "undecided").when(F.col("match_id").isNull(), "create")
        .when(F.col("held_status").isin(*TERMINAL), "preserve").when(same & F.col("held_external_id").isNull(), "fill").when(same, "keep").otherwise("replace")
    )
    return rows.select(*SLOT, "match_id", action.alias("action"))


def bye_winners(entries: DataFrame) -> DataFrame:
    """``(edition_id, round, draw_position, winner_id)`` of byes: the player who is there."""
    there = F.coalesce("player_a_id", "player_b_id")
    return entries.where(F.col("is_bye") & there.isNotNull()).select("edition_id", "round", "draw_position", there.alias("winner_id"))


def draw_targets(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries`` with what they do to stored matches: ``cancel`` (the id of one that goes), ``target`` (of one that is updated), ``how`` and ``held`` (the slot's matches so far).

    A slot's finished match keeps its entry out. A pending one of other players is cancelled. What is updated is the edition's match with the entry's external id, else the
    slot's match of the same players; else a match is made. Of entries with one external id the first (by round and position) holds, and a stored match is
    updated once: by the entry that has its external id, before one that has its slot.
    """
    one = first_by(entries.where(~F.coalesce("is_bye", F.lit(False)) & F.col("player_a_id").isNotNull() & F.col("player_b_id").isNotNull()), SLOT, [F.col("player_a_id"), F.col("player_b_id")])
    sizes = matches.groupBy(*SLOT).agg(F.count("*").alias("held"))
    slots = slot_rows(matches).select(*SLOT, F.col("id").alias("_slot"), F.col("status").isin(*PENDING).alias("_pending"), _pair().alias("_pair")).join(sizes, list(SLOT))
    named = matches.where(F.col("external_id").isNotNull()).groupBy("edition_id", "external_id").agg(F.min("id").alias("_named"))
    rows = one.join(slots, list(SLOT), "left").where(F.coalesce("_pending", F.lit(True))).join(named, ["edition_id", "external_id"], "left")
    same = F.coalesce(_pair() == F.col("_pair"), F.lit(False))
    rows = rows.withColumns({"cancel": F.when(~same, F.col("_slot")), "target": F.coalesce("_named", F.when(same, F.col("_slot")))})
    place = [round_order(F.col("round")), F.col("draw_position"), F.col("round")]
    # entries without an external id, and those without a target, are groups of their own
    own = F.struct(*SLOT)
    again = F.row_number().over(Window.partitionBy("edition_id", "external_id", F.when(F.col("external_id").isNull(), own)).orderBy(*place)) > 1
    rows = rows.withColumn("_again", again)
    taken = F.row_number().over(Window.partitionBy("target", F.when(F.col("target").isNull() | F.col("_again"), own)).orderBy(F.col("_named").isNull(), *place)) > 1
    how = F.when(F.col("_again"), "repeated").when(F.col("target").isNull(), "create").when(taken, "taken").otherwise("update")
    return rows.withColumn("how", how).withColumn("held", F.coalesce("held", F.lit(0))).drop("_slot", "_pending", "_pair", "_named", "_again")


def apply_draw(matches: DataFrame, entries: DataFrame, editions: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """``matches`` after a scraped draw, by ``draw_targets()``.

    ``entries`` has the slot, ``player_a_id``, ``player_b_id``, ``is_bye``, ``winner_id``, ``score`` and ``external_id``, and may have the players' seeds. An updated match only
    gets what it lacks: position, seeds and external id. With ``overwrite`` it gets all that the entry tells, but for the slot of another position. A match is finished if
    the entry has winner and score. ``editions`` (``id``, ``start_date``, ``end_date``) gives made and overwritten matches the date that their round is expected at. New ids are hashes of
    slot, players and the number of matches that the slot had. Byes make no match; ``propagate()`` advances their players.
    """
    seeds = [c for c in ("player_a_seed", "player_b_seed") if c in entries.columns]
    rows = draw_targets(matches, entries)
    done = F.col("winner_id").isNotNull() & (F.trim(F.coalesce("score", F.lit(""))) != "")
    given = {"status": F.when(done, "completed").otherwise("upcoming"), "winner_id": F.when(done, F.col("winner_id"))}
    if editions is not None:
        rows = rows.join(editions.select(F.col("id").alias("edition_id"), "start_date", "end_date"), "edition_id", "left")
        given["match_date"] = round_date(F.col("start_date"), F.col("end_date"), F.col("round"))
    rows = durable(rows.withColumns(given))
    told = ["player_a_id", "player_b_id", *seeds, "score", *given]
    updates = rows.where("how = 'update'").select(F.col("target").alias("id"), F.struct("draw_position", "external_id", *told).alias("_new"))
    gone = rows.where(F.col("cancel").isNotNull()).select(F.col("cancel").alias("id"), F.lit(True).alias("_gone"))
    old = matches.join(gone, "id", "left").join(updates, "id", "left").withColumn("status", F.when(F.col("_gone"), "cancelled").otherwise(F.col("status")))
    filled = {c: F.coalesce(c, F.col(f"_new.{c}")) for c in ("draw_position", "external_id", *seeds)}
    if overwrite:
        filled |= {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in told} | {"external_id": F.coalesce("_new.external_id", "external_id")}
    old = old.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in matches.columns])
    made = rows.where("how = 'create'").select(F.xxhash64(*SLOT, "player_a_id", "player_b_id", "held").alias("id"), *SLOT, *told, "external_id")
    return old.unionByName(made.select(*[c for c in made.columns if c in matches.columns]), allowMissingColumns=True)


def propagate(matches: DataFrame, byes: DataFrame | None = None, decided: DataFrame | None = None) -> DataFrame:
    """Next-round matches whose two feeders have winners (or a bye) and which aren't there yet: one level. Odd slots feed the first player.

    With ``decided`` (``id``), only what those matches feed.
    """
    slots = matches.where(F.col("winner_id").isNotNull() & F.col("draw_position").isNotNull()).select("edition_id", "round", "draw_position", "winner_id", "id")
    if byes is not None:
        slots = slots.unionByName(bye_winners(byes).withColumn("id", F.lit(0).cast(slots.schema["id"].dataType)))
    won = slots.where(next_round(F.col("round")).isNotNull())
    won = won.select("edition_id", next_round(F.col("round")).alias("round"), next_position(F.col("draw_position")).alias("position"), (F.col("draw_position") % 2 == 1).alias("odd"), "winner_id", "id")
    if decided is not None:
        won = won.join(won.join(decided.select("id"), "id", "left_semi").select("edition_id", "round", "position").distinct(), ["edition_id", "round", "position"], "left_semi")
    of = lambda odd: F.max_by(F.when(F.col("odd") == F.lit(odd), F.col("winner_id")), F.when(F.col("odd") == F.lit(odd), F.col("id")))
    pairs = won.groupBy("edition_id", "round", "position").agg(of(True).alias("player_a_id"), of(False).alias("player_b_id")).where("player_a_id IS NOT NULL AND player_b_id IS NOT NULL AND player_a_id <> player_b_id")
    there = matches.select("edition_id", "round", F.col("draw_position").alias("position")).distinct()
    return pairs.join(there, ["edition_id", "round", "position"], "left_anti").withColumnRenamed("position", "draw_position")


def validate_draw(matches: DataFrame) -> DataFrame:
    """Per edition and round: slots, different slots, slots out of range, and whether the round is known."""
    most = expected_matches(F.col("round"))
    return matches.groupBy("edition_id", "round").agg(
        F.count("draw_position").alias("slots"), F.countDistinct("draw_position").alias("different"),
        F.count_if((F.col("draw_position") < 1) | (F.col("draw_position") > most)).alias("out_of_range"), F.first(most).isNotNull().alias("known_round"),
    )


def schedule_updates(matches: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Matches with their fixture's date and court; upcoming becomes scheduled only where something changed.

    ``fixtures`` has ``external_id``, ``scheduled_date`` and ``court``; ids are compared in upper case. A fixture whose id no match has is looked up by
    edition, round and pair in either order, if it has those columns.
    """
    pending = matches.where(F.col("status").isin(*PENDING))
    late = F.col("scheduled_date").desc_nulls_last()
    fixture = F.struct(F.col("scheduled_date").alias("date"), "court").alias("_f")
    new = first_by(fixtures.withColumn("_id", F.upper("external_id")), ["_id"], [late]).where(F.col("_id").isNotNull()).select("_id", fixture)
    rows = pending.join(new, F.upper("external_id") == F.col("_id")).drop("_id")
    by_pair = ["edition_id", "round", "_low", "_high"]
    if {"edition_id", "round", "player_a_id", "player_b_id"} <= set(fixtures.columns):
        pair = {"_low": F.least("player_a_id", "player_b_id"), "_high": F.greatest("player_a_id", "player_b_id")}
        ids = matches.select(F.upper("external_id").alias("_id")).where(F.col("_id").isNotNull()).distinct()
        rest = fixtures.withColumns(pair | {"_id": F.upper("external_id")}).join(ids, "_id", "left_anti")
        rest = first_by(rest, by_pair, [late]).select(*by_pair, fixture)
        first = first_by(matches.withColumns(pair), by_pair, [F.col("id")]).select("id", *by_pair)
        found = first.join(rest, by_pair).select("id", "_f")
        rows = rows.unionByName(pending.join(found, "id").join(rows.select("id"), "id", "left_anti").select(*rows.columns))
    changed = ~F.coalesce("_f.date", "scheduled_date").eqNullSafe(F.col("scheduled_date"))
    return rows.select("id", F.coalesce("_f.date", "scheduled_date").alias("scheduled_date"), F.col("_f.court").alias("court"), F.when(changed & (F.col("status") == "upcoming"), "scheduled").otherwise(F.col("status")).alias("status"))


def with_player_ids(fixtures: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """``fixtures`` with the external ids they lack, found by the players' names (``player_a``, ``player_b``, normalised).

    ``aliases`` has ``alias``, ``player_id``; ``ids`` has ``player_id``, ``external_id`` of the fixtures' source.
    """
    known = first_by(aliases, ["alias"], [F.col("player_id")]).join(ids, "player_id").select("alias", F.col("external_id").alias("_id"))
    for s in "ab":
        fixtures = fixtures.join(known, F.col(f"player_{s}") == F.col("alias"), "left").withColumn(f"player_{s}_external_id", F.coalesce(f"player_{s}_external_id", "_id")).drop("alias", "_id")
    return fixtures


def followed_by(rows: DataFrame, group: str, order: str, start: str, hours: int = 2) -> DataFrame:
    """``rows`` with ``estimated``: a known start, else the last known one before it plus two hours for each row since."""
    window = Window.partitionBy(group).orderBy(order)
    runs = rows.withColumn("_anchor", F.last(start, ignorenulls=True).over(window)).withColumn("_run", F.count(start).over(window))
    place = F.row_number().over(Window.partitionBy(group, "_run").orderBy(order)) - 1
    return runs.withColumn("estimated", F.when(F.col("_anchor").isNotNull(), F.col("_anchor") + F.make_interval(hours=place * hours))).drop("_anchor", "_run")


def carried_forward(rows: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Nulls of ``column`` filled with the last value before them in the group."""
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(group).orderBy(order)))


def in_window(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Whether a tournament overlaps a window; a missing end is a week after the start, without a start it doesn't."""
    return F.coalesce((start <= last) & (F.coalesce(end, F.date_add(start, 7)) >= first), F.lit(False))


def ready_tasks(queue: DataFrame, now: Column) -> DataFrame:
    return queue.where(F.col("status").isin("pending", "retry") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))


def next_task(queue: DataFrame, now: Column) -> DataFrame:
    return ready_tasks(queue, now).orderBy("priority", "created_at", "id").limit(1)


def enqueue(queue: DataFrame, tasks: DataFrame) -> DataFrame:
    """The new tasks that no active one equals in type and parameters, each once."""
    active = queue.where(F.col("status").isin("pending", "retry", "in_progress")).select("task_type", "task_params").distinct()
    return tasks.dropDuplicates(["task_type", "task_params"]).join(active, ["task_type", "task_params"], "left_anti")


def failed(queue: DataFrame, ids: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """``queue`` after the tasks of ``ids`` have failed: another try after 5, 10, ... minutes, or failed for good."""
    rows = queue.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    attempts = F.col("attempts") + F.when(F.col("_hit"), 1).otherwise(0)
    wait = F.make_interval(mins=(5 * F.pow(F.lit(2), attempts - 1)).cast("int"))
    status = F.when(F.col("_hit") & (attempts >= most), "failed").when(F.col("_hit"), "retry").otherwise(F.col("status"))
    return rows.select(*[{"attempts": attempts, "status": status, "next_retry_at": F.when(F.col("_hit") & (attempts < most), now + wait).otherwise(F.col("next_retry_at"))}.get(c, F.col(c)).alias(c) for c in queue.columns])


def started(queue: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """``queue`` with the tasks of ``ids`` in progress, one attempt more."""
    return _changed(queue, ids, {"status": F.lit("in_progress"), "started_at": now, "attempts": F.col("attempts") + 1})


def completed(queue: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return _changed(queue, ids, {"status": F.lit("completed"), "completed_at": now})


def reset(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """``queue`` with the tasks of ``ids`` as if they had never been tried."""
    return _changed(queue, ids, {"status": F.lit("pending"), "attempts": F.lit(0)} | dict.fromkeys(("last_error", "next_retry_at", "started_at", "completed_at"), F.lit(None)))


def cancelled(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """``queue`` without those of ``ids`` that wait for a first or another try; others can't be cancelled."""
    hit = queue.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("status").isin("pending", "retry")).select("id")
    return queue.join(hit, "id", "left_anti")


def _changed(queue: DataFrame, ids: DataFrame, new: dict[str, Column]) -> DataFrame:
    rows = queue.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return rows.select(*[F.when(hit, new[c].cast(queue.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns])


def queue_report(queue: DataFrame, now: Column) -> DataFrame:
    """Tasks, mean attempts and ready ones of each status."""
    ready = F.col("status").isin("pending", "retry") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    return queue.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("attempts"), 1).alias("mean_attempts"), F.count_if(ready).alias("ready"))


def round_histogram(matches: DataFrame) -> DataFrame:
    return matches.groupBy("round").agg(F.count("*").alias("n"), F.first(round_order(F.col("round"))).alias("place"))


def get_or_create_editions(editions: DataFrame, seen: DataFrame) -> DataFrame:
    """Editions with those of ``seen`` (``tournament_id``, ``year``) that are missing; new ids are hashes of the key."""
    new = seen.select("tournament_id", "year").distinct().join(editions.select("tournament_id", "year"), ["tournament_id", "year"], "left_anti")
    return editions.select("id", "tournament_id", "year").unionByName(new.select(F.xxhash64("tournament_id", "year").alias("id"), "tournament_id", "year"))


def claimed_tournaments(tournaments: DataFrame, seen: DataFrame) -> DataFrame:
    """``tournaments`` (``id``, ``code``, ``tour``, ``gender``) with those of ``seen`` (``code``, ``tour``, ``gender``) that are missing.

    A row without a gender is claimed by a seen gender that has no row of its own (by the first, if there are two); what is then still missing is made, with a
    hash of the key as its id.
    """
    key = ["code", "tour", "gender"]
    missing = durable(seen.select(*key).distinct().join(tournaments.select(*key), key, "left_anti"))
    open_ = first_by(tournaments.where(F.col("gender").isNull()), ["code", "tour"], [F.col("id")]).select("id", "code", "tour")
    claims = durable(first_by(missing.join(open_, ["code", "tour"]), ["id"], [F.col("gender")]).select("id", *key))
    old = tournaments.join(claims.select("id", F.col("gender").alias("_gender")), "id", "left").withColumn("gender", F.coalesce("gender", "_gender")).select(*tournaments.columns)
    made = missing.join(claims.select(*key), key, "left_anti").select(F.xxhash64(*key).alias("id"), *key)
    return old.unionByName(made, allowMissingColumns=True)


def dated_editions(editions: DataFrame, seen: DataFrame) -> DataFrame:
    """``editions`` with missing dates from ``seen`` (``tournament_id``, ``year``, ``start_date``, ``end_date``, ``level``); an end that nobody knows is estimated by level."""
    new = first_by(seen, ["tournament_id", "year"], [F.col("start_date").asc_nulls_last(), F.col("end_date").asc_nulls_last(), F.col("level")]).select("tournament_id", "year", F.struct("start_date", "end_date", "level").alias("_s"))
    rows = editions.join(new, ["tournament_id", "year"], "left")
    start = F.coalesce("start_date", "_s.start_date")
    end = F.coalesce("end_date", "_s.end_date", F.when(F.col("_s").isNotNull(), edition_end(start, F.coalesce("_s.level", F.lit("ATP 250")))))
    return rows.withColumns({"start_date": start, "end_date": end}).select(*editions.columns)
