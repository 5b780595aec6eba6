"""Tables that grow by batches: a batch writes its changed rows only, and its commit makes them all visible at once.

Below a folder, each table has ``name/delta-v...`` (the rows that a version has brought) and at times ``name/base-v...`` (the whole table as of a version). A commit is
one small file, created last and only if it isn't there: what a failed attempt has left without one is overwritten by the next attempt, and a version that is committed
is never written again. Bytes written follow the batches; every ``base_every`` versions ``compact`` writes a base, so that readers have few files to merge.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "_version"


class DeltaLog:
    """Versions of several tables with one commit."""

    def __init__(self, spark: SparkSession, folder: str, base_every: int = 20):
        self.spark, self.folder, self.base_every = spark, folder.rstrip("/"), base_every
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _commit_file(self, version: int):
        return self._path(f"_commits/v{version:08d}.json")

    def last(self) -> tuple[int, dict]:
        """The last committed version (0 before the first) and what its commit tells."""
        if not self._fs.exists(self._path("_commits")):
            return 0, {}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_commits"))]
        version = max((int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)
        return version, self.told(version) if version else {}

    def told(self, version: int) -> dict:
        stream = self._fs.open(self._commit_file(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, key: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """The table as of a version (the last): for each key its latest row. Without a key all rows, for tables that only grow. None before the first."""
        last, told = self.last()
        if version is not None and version != last:
            last, told = version, self.told(version) if version else {}
        table = told.get("tables", {}).get(name)
        if table is None:
            return None
        paths = [f"{self.folder}/{name}/delta-v{v:08d}" for v in table["deltas"]]
        if table["base"]:
            paths.insert(0, f"{self.folder}/{name}/base-v{table['base']:08d}")
        rows = self.spark.read.parquet(*paths)
        if not key:
            return rows.drop(VERSION)
        if len(paths) > 1:
            latest = Window.partitionBy(*key).orderBy(F.col(VERSION).desc())
            rows = rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        return rows.drop(VERSION)

    def append(self, version: int, tables: dict[str, DataFrame], info: dict | None = None) -> bool:
        """Write a version's changed rows (each key once) and commit it with ``info``; False if it has been committed already."""
        last, told = self.last()
        if version <= last:
            return False
        state = {n: dict(t) for n, t in told.get("tables", {}).items()}
        for name, rows in tables.items():
            rows.withColumn(VERSION, F.lit(version)).write.mode("overwrite").parquet(f"{self.folder}/{name}/delta-v{version:08d}")
            own = state.setdefault(name, {"base": 0, "deltas": []})
            own["deltas"] = [*own["deltas"], version]
        return self._commit(version, {"tables": state, "info": info or {}})

    def compact(self, keys: dict[str, list[str]]) -> int:
        """Where a table has ``base_every`` deltas or more, write it as a whole and commit that as a version of its own; returns the last version."""
        last, told = self.last()
        full = {n: t for n, t in told.get("tables", {}).items() if len(t["deltas"]) >= self.base_every and n in keys}
        if not full:
            return last
        state = told["tables"]
        for name in full:
            self.read(name, keys[name]).withColumn(VERSION, F.lit(last)).write.mode("overwrite").parquet(f"{self.folder}/{name}/base-v{last + 1:08d}")
            state[name] = {"base": last + 1, "deltas": []}
        self._commit(last + 1, {"tables": state, "info": told["info"]})
        return last + 1

    def _commit(self, version: int, content: dict) -> bool:
        """A commit is written beside and renamed, which fails if the version is there."""
        own = self._path(f"_commits/.v{version:08d}-{self.spark.sparkContext.applicationId}")
        stream = self._fs.create(own, True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if self._fs.exists(self._commit_file(version)) or not self._fs.rename(own, self._commit_file(version)):
            self._fs.delete(own, False)
            return False
        return True


def keyset_job(log: DeltaLog, source: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], size: int = 100_000, pages: int | None = None, table: str = "done") -> int:
    """Go through ``source`` in pages of ``size`` rows by ``key`` (unique, ascending), from where the last commit stands; returns the number of pages done.

    ``work`` turns a page into output rows, which are appended to ``table``. Output and cursor are one commit: whenever the job is stopped, the next run goes on behind the
    last committed page, and each row has been worked on once in what is read. ``pages`` limits a run.
    """
    done = 0
    while pages is None or done < pages:
        version, told = log.last()
        cursor = told.get("info", {}).get("cursor")
        rest = source if cursor is None else source.where(F.col(key) > F.lit(cursor).cast(source.schema[key].dataType))
        page = rest.orderBy(key).limit(size)
        # the page's last key decides the cursor; the page itself is bounded by keys, so that it can be computed again
        end = page.agg(F.max(key).cast("string").alias("end")).first().end
        if end is None:
            return done
        log.append(version + 1, {table: work(rest.where(F.col(key) <= F.lit(end).cast(source.schema[key].dataType)))}, info={"cursor": end})
        done += 1
    return done
