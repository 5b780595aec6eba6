"""Look-ups in dictionaries of places (``name``, ``value``), which are tables of the user's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topspin.operators.tables import first_by, fill_null


def _folded(name: Column) -> Column:
    return F.lower(F.trim(name))


def look_up(rows: DataFrame, column: str, dictionary: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: the value of ``column`` as it is written, else without regard to case and outer blanks, else null.

    Of entries that differ only in case the last by name holds, as in a dictionary that is filled in order.
    """
    exact = first_by(dictionary.where(F.col("name") != ""), ["name"], [F.col("value")]).select(F.col("name").alias("_exact"), F.col("value").alias("_by_name"))
    loose = first_by(dictionary.where(F.col("name") != "").withColumn("_key", F.lower("name")), ["_key"], [F.col("name").desc(), F.col("value")]).select("_key", F.col("value").alias("_by_key"))
    found = rows.join(exact, F.col(column) == F.col("_exact"), "left").join(loose, _folded(F.col(column)) == F.col("_key"), "left")
    return found.withColumn(out, F.coalesce("_by_name", "_by_key")).drop("_exact", "_by_name", "_key", "_by_key")


def city_codes(rows: DataFrame, column: str, cities: DataFrame, countries: DataFrame) -> DataFrame:
    """``rows`` with ``found_country`` of a city and ``found_code`` of that country."""
    return look_up(look_up(rows, column, cities, "found_country"), "found_country", countries, "found_code")


def backfill_countries(tournaments: DataFrame, cities: DataFrame, countries: DataFrame) -> DataFrame:
    """``tournaments`` (``id``, ``city``, ``country``, ``country_code``) with missing countries and codes out of their city; a city that isn't known changes nothing."""
    missing = tournaments.where(F.col("city").isNotNull() & (F.col("country").isNull() | F.col("country_code").isNull()))
    found = city_codes(missing.select("id", "city"), "city", cities, countries)
    found = found.where(F.col("found_country").isNotNull()).select("id", F.col("found_country").alias("country"), F.col("found_code").alias("country_code"))
    return fill_null(tournaments, found, "id", ["country", "country_code"])


def unmapped_cities(tournaments: DataFrame, cities: DataFrame) -> DataFrame:
    """Cities without a country, each once, with the number of their tournaments."""
    rows = look_up(tournaments.where(F.col("city").isNotNull()).select("city"), "city", cities, "_country")
    return rows.where(F.col("_country").isNull()).groupBy("city").agg(F.count("*").alias("n"))
