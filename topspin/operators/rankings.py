"""Leaderboards, player search and counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topspin.operators.matches import sides


def gender_counts(rows: DataFrame) -> DataFrame:
    """Matches of each player by the tournament's gender: ``(player_id, men, women)``, from rows of ``star()``."""
    each = sides(rows, "t_gender")
    return each.groupBy("player_id").agg(F.count_if(F.col("t_gender") == "men").alias("men"), F.count_if(F.col("t_gender") == "women").alias("women"))


def majority(counts: DataFrame, ties: str | None = None) -> DataFrame:
    """``(player_id, gender)`` by strict majority. Ties get ``ties``; where that is null they are left out (a player without matches too)."""
    gender = F.when(F.col("men") > F.col("women"), "men").when(F.col("women") > F.col("men"), "women").otherwise(F.lit(ties))
    return counts.select("player_id", gender.alias("gender")).where(F.col("gender").isNotNull())


def leaderboard(states: DataFrame, players: DataFrame, genders: DataFrame, gender: str, today: dt.date, include_inactive: bool = False) -> DataFrame:
    """Players of a gender by rating, then name; inactive for more than 183 days left out. Ranks start at 1."""
    if not include_inactive:
        states = states.where(F.col("last_match_date") >= F.date_sub(F.lit(today), 183))
    rows = states.join(genders.where(F.col("gender") == gender), "player_id").join(players.select(F.col("id").alias("player_id"), "name", "nationality"), "player_id")
    return rows.select("player_id", "name", "nationality", "rating", F.col("rating").cast("int").alias("shown_rating"), "match_count")


def top_ranked(board: DataFrame, per_page: int, page: int = 1) -> DataFrame:
    """One page with ranks. Only the rows up to the page's end reach the window that numbers them."""
    order = [F.col("rating").desc(), F.col("name")]
    rows = board.orderBy(*order).limit(page * per_page)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > (page - 1) * per_page)


def ranked_by_gender(states: DataFrame, players: DataFrame, genders: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` of each gender with their ranks. A window's top-k filter runs before the shuffle, so no group is sorted whole."""
    rows = states.join(genders, "player_id").join(players.select(F.col("id").alias("player_id"), "name"), "player_id")
    order = Window.partitionBy("gender").orderBy(F.col("rating").desc(), "name")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("gender", "rank", "player_id", "name", "rating")


def search_players(players: DataFrame, aliases: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Players whose name or alias contains ``text``: names that start with it first, then by name; each player once."""
    like = f"%{text}%"
    by_name = players.where(F.col("name").ilike(like)).select("id", "name")
    by_alias = aliases.where(F.col("alias").ilike(like)).select(F.col("player_id").alias("id")).distinct().join(players.select("id", "name"), "id")
    found = by_name.unionByName(by_alias.select("id", "name")).distinct()
    starts = F.lower("name").startswith(text.lower())
    return found.orderBy(F.when(starts, 0).otherwise(1), F.lower("name"), "id").limit(limit)


def player_details(players: DataFrame, aliases: DataFrame, matches: DataFrame, states: DataFrame) -> DataFrame:
    """Aliases, matches and whole rating of each player; 0 where there are none."""
    named = aliases.groupBy(F.col("player_id").alias("id")).agg(F.count("*").alias("aliases"))
    played = sides(matches).groupBy(F.col("player_id").alias("id")).agg(F.count("*").alias("matches"))
    rated = states.select(F.col("player_id").alias("id"), F.col("rating").cast("int").alias("rating"))
    rows = players.select("id", "name").join(named, "id", "left").join(played, "id", "left").join(rated, "id", "left")
    return rows.select("id", "name", F.coalesce("aliases", F.lit(0)).alias("aliases"), F.coalesce("matches", F.lit(0)).alias("matches"), "rating")


def weighted_match_counts(matches: DataFrame) -> DataFrame:
    """``(player_id, n)``: a match counts for both players and once more for the winner."""
    each = matches.select(F.explode(F.array("player_a_id", "player_b_id", "winner_id")).alias("player_id"))
    return each.where(F.col("player_id").isNotNull()).groupBy("player_id").agg(F.count("*").alias("n"))


def status_match_counts(matches: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    return sides(matches.where(F.col("status").isin(*statuses))).groupBy("player_id").agg(F.count("*").alias("n"))
