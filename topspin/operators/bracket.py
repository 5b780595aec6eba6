"""A scraped draw from names to matches: players resolved, slots filled, results carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topspin.functions.domain import external_id, round_date, round_order
from topspin.functions.names import normalize_name
from topspin.operators.identity import learned, resolve
from topspin.operators.ingest import SLOT, apply_draw, propagate
from topspin.operators.tables import first_by
from topspin.sources.sinks import durable

#: Whom a source's players are. Fixed values.
GENDERS = {"atp": "men", "wta": "women", "wta_125": "women", "wta125": "women", "itf_men": "men", "itf-men": "men", "itf_women": "women", "itf-women": "women"}


def _people(scraped: DataFrame) -> DataFrame:
    """Each person of the draw once, numbered by the first slot: ``(id, label, source, external_id)``."""
    place = (F.col("edition_id") * 128 + round_order(F.col("round"))) * 4096 + F.col("draw_position")
    side = lambda s, k: scraped.select((place * 2 + k).alias("id"), F.col(f"player_{s}").alias("label"), "source", F.col(f"player_{s}_external_id").alias("external_id"))
    both = side("a", 0).unionByName(side("b", 1)).where(F.col("label").isNotNull() & (F.lower("label") != "bye"))
    return both.groupBy("label", "source", "external_id").agg(F.min("id").alias("id"))


def ingest_draw(matches: DataFrame, scraped: DataFrame, players: DataFrame, aliases: DataFrame, editions: DataFrame, genders: DataFrame | None = None, overwrite: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, players and aliases after a scraped draw.

    ``scraped`` has the rows of ``draw_page()`` with ``edition_id`` in place of the page, and ``source``; ``editions`` has ``id``, ``code`` (of the tournament), ``year``, ``start_date`` and
    ``end_date``. Names are resolved in the order of rounds and positions; one that would have to be reviewed is created if it has an external id, else its slot
    stays open. Then ``apply_draw()``, and one level of ``propagate()`` from winners and byes.
    """
    people = durable(_people(scraped))
    expected = F.create_map(*[F.lit(x) for item in GENDERS.items() for x in item])
    incoming = durable(people.select("id", normalize_name(F.col("label")).alias("name"), F.regexp_replace(F.lower("source"), "[-_].*$", "").alias("source_key"), "external_id", F.try_element_at(expected, F.lower("source")).alias("gender")))
    found = resolve(incoming, players, aliases, genders)
    # who waits for a review, but has an id, is made
    waits = (F.col("status") == "queued") & F.col("_external").isNotNull()
    found = found.join(incoming.select(F.col("id").alias("in_id"), F.col("external_id").alias("_external")), "in_id")
    found = durable(found.select(
        "in_id", F.when(waits, F.xxhash64(F.lit("player"), "in_id")).otherwise(F.col("player_id")).alias("player_id"), F.when(waits, F.col("in_id")).otherwise(F.col("made_by")).alias("made_by"),
        F.when(waits, "created").otherwise(F.col("status")).alias("status"), (F.col("linked") | waits).alias("linked"),
    ))
    players, aliases = learned(incoming, found, players, aliases)
    players = durable(players)
    known = people.join(found.select(F.col("in_id").alias("id"), "player_id"), "id")
    sources = [c for c in players.columns if c.endswith("_id")]
    ids = players.select(F.col("id").alias("_pid"), F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_id")).alias("_source"), F.col(c).alias("_own")) for c in sources])).alias("x")).select("_pid", "x.*").where("_own IS NOT NULL")
    rows = scraped
    for s in "ab":
        person = known.select(F.col("label").alias("_label"), F.col("source").alias("_from"), F.col("external_id").alias("_ext"), F.col("player_id").alias(f"player_{s}_id"))
        same = (F.col(f"player_{s}") == F.col("_label")) & F.col("source").eqNullSafe(F.col("_from")) & F.col(f"player_{s}_external_id").eqNullSafe(F.col("_ext"))
        rows = rows.join(person, same, "left").drop("_label", "_from", "_ext")
        own = (F.col(f"player_{s}_id") == F.col("_pid")) & (F.regexp_replace(F.lower("source"), "[-_].*$", "") == F.col("_source"))
        rows = rows.join(ids, own, "left").withColumn(f"ext_{s}", F.coalesce(f"player_{s}_external_id", "_own")).drop("_pid", "_source", "_own")
    rows = rows.join(editions.select(F.col("id").alias("edition_id"), "code", "year"), "edition_id")
    won = F.when(F.coalesce("winner", F.lit("")) == "", None).when(F.col("winner") == F.col("player_b"), F.col("player_b_id")).otherwise(F.col("player_a_id"))
    entries = durable(rows.select(
        *SLOT, "player_a_id", "player_b_id", "player_a_seed", "player_b_seed", "is_bye", won.alias("winner_id"), "score",
        F.when(~F.col("is_bye"), external_id(F.col("year"), F.col("code"), F.col("round"), F.col("ext_a"), F.col("ext_b"))).alias("external_id"),
    ))
    done = durable(apply_draw(matches, entries, editions, overwrite))
    more = first_by(propagate(done, entries), SLOT, [F.col("player_a_id")])
    more = more.join(editions.select(F.col("id").alias("edition_id"), "code", "year", "start_date", "end_date"), "edition_id")
    more = more.select(
        F.xxhash64(*SLOT, "player_a_id", "player_b_id", F.lit(0)).alias("id"), *SLOT, "player_a_id", "player_b_id", F.lit("upcoming").alias("status"),
        F.concat_ws("_", F.lit("draw"), "year", "code", "round", "draw_position").alias("external_id"), round_date(F.col("start_date"), F.col("end_date"), F.col("round")).alias("match_date"),
    )
    return done.unionByName(more.select(*[c for c in more.columns if c in matches.columns]), allowMissingColumns=True), players, aliases
