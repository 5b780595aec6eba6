"""Incremental work as Structured Streaming jobs.

A match changes the states of two players at once, so ratings are no state by key: each micro-batch is rated by the
incremental operator, and what it changed is appended to a log of deltas. Late matches are never dropped by a watermark: they send back
what came after them. A commit tells the batch's number, so a batch that is run again after a failure changes nothing. Slots of a draw are
state by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from topspin.functions.domain import next_position, next_round
from topspin.operators.rating import Params, changed_states, rating_changes, rebuild
from topspin.operators.tables import first_by
from topspin.sources.deltas import DeltaLog
from topspin.sources.sinks import durable


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _run(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keys of the rating stream's tables.
RATING_KEYS = {"matches": ["id"], "rated": ["id"], "states": ["player_id"]}


def rate_stream(stream: DataFrame, folder: str, checkpoint: str, params: Params | None = None, base_every: int = 20) -> StreamingQuery:
    """Rate a stream of finished matches (rows of ``star()`` with ``temporal_order``).

    ``folder`` is a ``DeltaLog`` of ``matches``, ``rated`` and ``states``: a batch writes its own matches, the ratings that it made or changed, and its players' states.
    """

    def step(batch: DataFrame, number: int) -> None:
        log = DeltaLog(batch.sparkSession, folder, base_every)
        last, told = log.last()
        if number <= told.get("info", {}).get("batch", -1):
            return
        fresh = first_by(batch, ["id"], [F.col("temporal_order")])
        before = log.read("matches")
        if before is None:
            fresh = durable(fresh)
            rated = durable(rebuild(fresh, params))
            changed = {"matches": fresh, "rated": rated, "states": changed_states(rated, fresh)}
        else:
            fresh = durable(fresh.join(before.select("id"), "id", "left_anti"))
            rated, states = rating_changes(before.unionByName(fresh), log.read("rated", ["id"]), log.read("states", ["player_id"]), params)
            changed = {"matches": fresh, "rated": rated, "states": states}
        log.append(last + 1, changed, info={"batch": number})
        log.compact(RATING_KEYS)

    return _run(stream, step, checkpoint)


#: Keys of the propagation stream's table.
SLOT_KEY = ["edition_id", "round", "draw_position"]
_SLOT_STATE = "top long, top_id long, bottom long, bottom_id long, taken boolean"


def _fill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A slot of the next round: the latest winners of its two feeders, and whether it has a match of its own."""
    top, top_id, bottom, bottom_id, taken = state.get if state.exists else (None, None, None, None, False)
    for rows in batches:
        taken = taken or bool(rows["taken"].any())
        for odd, winner, at in rows.loc[rows["winner_id"].notna(), ["odd", "winner_id", "id"]].itertuples(index=False):
            if odd and (top_id is None or at > top_id):
                top, top_id = int(winner), int(at)
            elif not odd and (bottom_id is None or at > bottom_id):
                bottom, bottom_id = int(winner), int(at)
    state.update((top, top_id, bottom, bottom_id, taken))
    yield pd.DataFrame({"edition_id": [key[0]], "round": [key[1]], "draw_position": [key[2]], "player_a_id": [top], "player_b_id": [bottom], "taken": [taken]}).astype({"player_a_id": "Int64", "player_b_id": "Int64"})


def propagate_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Next-round matches out of a stream of matches (``id``, ``edition_id``, ``round``, ``draw_position``, ``winner_id``): a slot is filled when both its feeders have winners.

    Half-filled slots are keyed state of the stream; its key spreads them over all tasks. ``folder`` is a ``DeltaLog``; ``propagated()`` reads what is to be made. Byes are rows
    without an own match: id 0 and the player who is there as the winner.
    """
    rows = stream.where("draw_position IS NOT NULL")
    feeds = rows.where(F.col("winner_id").isNotNull() & next_round(F.col("round")).isNotNull())
    feeds = feeds.select("edition_id", next_round(F.col("round")).alias("round"), next_position(F.col("draw_position")).cast("int").alias("draw_position"), (F.col("draw_position") % 2 == 1).alias("odd"), "winner_id", "id", F.lit(False).alias("taken"))
    own = rows.where("id <> 0").select("edition_id", "round", F.col("draw_position").cast("int").alias("draw_position"), F.lit(False).alias("odd"), F.lit(None).cast("long").alias("winner_id"), "id", F.lit(True).alias("taken"))
    slots = feeds.unionByName(own).groupBy(*SLOT_KEY).applyInPandasWithState(
        _fill, "edition_id long, round string, draw_position int, player_a_id long, player_b_id long, taken boolean", _SLOT_STATE, "update", GroupStateTimeout.NoTimeout
    )

    def step(batch: DataFrame, number: int) -> None:
        log = DeltaLog(batch.sparkSession, folder)
        last, told = log.last()
        if number > told.get("info", {}).get("batch", -1):
            log.append(last + 1, {"slots": batch}, info={"batch": number})
            log.compact({"slots": SLOT_KEY})

    return slots.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def propagated(spark: SparkSession, folder: str) -> DataFrame | None:
    """``(edition_id, round, draw_position, player_a_id, player_b_id)`` of the slots that have two different players and no match yet."""
    slots = DeltaLog(spark, folder).read("slots", SLOT_KEY)
    return slots if slots is None else slots.where("NOT taken AND player_a_id <> player_b_id").drop("taken")


def changed_sources(seen: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """Sources whose ``fingerprint`` differs from the one seen last, and new ones: what fast mode still has to ingest."""
    before = seen.select(*key, F.col("fingerprint").alias("_seen"))
    return now.join(before, key, "left").where(F.col("_seen").isNull() | (F.col("_seen") != F.col("fingerprint"))).drop("_seen")


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and values of events by tumbling windows, for streams and tables; later events than ``late`` are left out of a stream."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])
