"""Changes to tables. A table is never changed in place: each operator returns its next version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't among them."""
    keys = [key] if isinstance(key, str) else list(key)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def update(old: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``old`` with ``columns`` from ``changes`` where it has the key (nulls there too count as changes)."""
    delta = changes.select(F.col(key), F.struct(*columns).alias("_new"))
    rows = old.join(delta, key, "left")
    return rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def set_where(old: DataFrame, test: Column, values: dict[str, object]) -> DataFrame:
    return old.withColumns({c: F.when(test, F.lit(v) if not isinstance(v, Column) else v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(old: DataFrame, test: Column) -> DataFrame:
    """Rows for which ``test`` is false or null."""
    return old.where(~F.coalesce(test, F.lit(False)))


def remap(old: DataFrame, redirects: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``old`` with each id in ``columns`` replaced by ``redirects`` (``from_id``, ``to_id``), where it has one."""
    for c in columns:
        target = redirects.select(F.col("from_id").alias("_from"), F.col("to_id").alias("_to"))
        old = old.join(target, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", F.col(c))).drop("_from", "_to")
    return old


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; the filter on the rank prunes before the shuffle."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, one for each key."""
    fresh = new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti")
    return old.unionByName(fresh)


def fill_null(old: DataFrame, found: DataFrame, key: str, columns: Sequence[str], overwrite: bool = False) -> DataFrame:
    """``old`` with its nulls in ``columns`` taken from ``found``; with ``overwrite`` found values go before old ones."""
    extra = found.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = old.join(extra, key, "left")
    pick = lambda c: F.coalesce(f"_{c}", c) if overwrite else F.coalesce(c, f"_{c}")
    return rows.select(*[pick(c).alias(c) if c in columns else F.col(c) for c in old.columns])


def any_missing(columns: Sequence[str]) -> Column:
    return F.array_contains(F.array(*[F.col(c).isNull() for c in columns]), True)


def keyset_page(rows: DataFrame, key: str, after: object, size: int) -> DataFrame:
    return rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def activate(sets: DataFrame, new: DataFrame) -> DataFrame:
    """Parameter sets with the new one active and all others not."""
    return sets.withColumn("is_active", F.lit(False)).unionByName(new.withColumn("is_active", F.lit(True)))


def fingerprint(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A hash of each group's rows that doesn't depend on their order, to see whether a source has changed: their number and sums of two hashes, so nothing is gathered."""
    whole = F.to_json(F.struct(*columns))
    sums = [F.sum(F.conv(F.substring(F.md5(whole), at, 16), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 17)]
    return rows.groupBy(*group).agg(F.sha1(F.concat_ws("|", F.count("*").cast("string"), *sums)).alias("fingerprint"))
