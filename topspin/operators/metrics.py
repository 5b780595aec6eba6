"""Counters of a run: collected in the pass that does the work, appended as JSON lines, summed by run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counters:
    """Named counters over the rows that an action writes or reads anyway.

    ``on`` attaches counters to a DataFrame; when an action on it has run, ``values`` has them all. Nothing is computed twice.
    """

    def __init__(self) -> None:
        self._observed: list[Observation] = []

    def on(self, df: DataFrame, **counters: Column) -> DataFrame:
        """``counters`` are aggregates, such as ``count_if(...)``."""
        observation = Observation()
        self._observed.append(observation)
        return df.observe(observation, *[c.alias(n) for n, c in counters.items()])

    def values(self) -> dict[str, object]:
        """Of counters with one name the sum. Waits for actions that haven't run yet."""
        out: dict = {}
        for observation in self._observed:
            for name, value in observation.get.items():
                out[name] = value if out.get(name) is None else out[name] + value if value is not None else out[name]
        return out


def append_event(spark: SparkSession, folder: str, run_id: str, worker: str, at: Column, payload: dict) -> None:
    """Append one line ``{run_id, worker, at, payload}`` to a log of JSON lines."""
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(worker).alias("worker"), at.alias("at"), F.lit(json.dumps(payload, default=str)).alias("payload"))
    row.coalesce(1).write.mode("append").json(folder)


def events_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("run_id string, worker string, at timestamp, payload string").json(folder)


def run_metrics(events: DataFrame, run: str = "run_id", payload: str = "payload") -> DataFrame:
    """``(run, metric, total, workers)``: the sums of all numbers in the payloads (JSON objects; a nested object's numbers are ``outer.inner``) of each run."""
    numbers = "map<string,string>"
    top = events.select(F.col(run).alias("run"), F.explode(F.from_json(payload, numbers)).alias("metric", "value"))
    nested = top.where(F.col("value").startswith("{")).select("run", "metric", F.explode(F.from_json("value", numbers)).alias("inner", "value"))
    flat = top.where(~F.col("value").startswith("{")).unionByName(nested.select("run", F.concat_ws(".", "metric", "inner").alias("metric"), "value"))
    flat = flat.withColumn("number", F.col("value").try_cast("double")).where("number IS NOT NULL")
    return flat.groupBy(F.col("run").alias(run), "metric").agg(F.sum("number").alias("total"), F.count("*").alias("workers"))
