"""The match store: filters, joins, order, pages and serialisation of matches."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topspin.functions.domain import temporal_order
from topspin.functions.scores import flip
from topspin.schema import STATUS_GROUPS, STATUSES, TOUR_ALIASES


def with_order(matches: DataFrame) -> DataFrame:
    """``matches`` with ``temporal_order``, the key by which they are replayed."""
    return matches.withColumn("temporal_order", temporal_order(F.col("match_date"), F.col("edition_id"), F.col("round")))


def sides(matches: DataFrame, *keep: str) -> DataFrame:
    """A row for each player of a match, ``player_id``, ``opponent_id`` and ``side``; the matches are read once."""
    a = F.struct(F.col("player_a_id").alias("player_id"), F.col("player_b_id").alias("opponent_id"), F.lit("A").alias("side"))
    b = F.struct(F.col("player_b_id").alias("player_id"), F.col("player_a_id").alias("opponent_id"), F.lit("B").alias("side"))
    return matches.select(*keep, F.inline(F.array(a, b)))


def star(matches: DataFrame, editions: DataFrame, tournaments: DataFrame, how: str = "left") -> DataFrame:
    """Matches with the columns of their edition (``ed_``) and tournament (``t_``). The small sides are broadcast if their size allows it."""
    ed = editions.select(*[F.col(c).alias(f"ed_{c}") for c in editions.columns])
    t = tournaments.select(*[F.col(c).alias(f"t_{c}") for c in tournaments.columns])
    return matches.join(ed, F.col("edition_id") == F.col("ed_id"), how).join(t, F.col("ed_tournament_id") == F.col("t_id"), how)


def normalize_statuses(wanted: Sequence[str] | str | None, default: str = "historical_default") -> list[str]:
    """Known statuses in the order given; a group's name stands for its members; nothing known gives the default group."""
    parts = wanted.split(",") if isinstance(wanted, str) else list(wanted or ())
    out: list[str] = []
    for part in (p.strip().lower() for p in parts):
        out += [s for s in STATUS_GROUPS.get(part, (part,)) if s in STATUSES and s not in out]
    return out or list(STATUS_GROUPS[default])


def expand_tours(tours: Sequence[str], allowed: Sequence[str] | None = None) -> list[str]:
    """All spellings of the tours; with ``allowed`` only tours of that list, or all of it if none is left."""
    if allowed is not None:
        tours = [t for t in tours if t in allowed] or list(allowed)
    return list(dict.fromkeys(s for t in tours for s in TOUR_ALIASES.get(t, (t,))))


def date_window(preset: str | None, today: dt.date, start: str | None = None, end: str | None = None) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a preset (7d, 30d, 90d, ytd or a year); explicit dates go before it, malformed ones are ignored."""

    def day(text: str | None) -> dt.date | None:
        try:
            return dt.date.fromisoformat(text) if text else None
        except ValueError:
            return None

    low = high = None
    if preset in ("7d", "30d", "90d"):
        low, high = today - dt.timedelta(days=int(preset[:-1])), today
    elif preset == "ytd":
        low, high = today.replace(month=1, day=1), today
    elif preset and preset.isdigit() and len(preset) == 4:
        low, high = dt.date(int(preset), 1, 1), dt.date(int(preset), 12, 31)
    return day(start) or low, day(end) or high


@dataclass(frozen=True)
class MatchFilter:
    """What a match query may ask for; empty fields ask for nothing. Head-to-head goes before a player's id, that before a name."""

    statuses: Sequence[str] = ()
    tours: Sequence[str] = ()
    genders: Sequence[str] = ()
    surfaces: Sequence[str] = ()
    levels: Sequence[str] = ()
    rounds: Sequence[str] = ()
    head_to_head: tuple[int, int] | None = None
    player_id: int | None = None
    player_name: str | None = None
    tournament: str | None = None
    preset: str | None = None
    start: str | None = None
    end: str | None = None
    today: dt.date = field(default_factory=lambda: dt.date(2001, 8, 1))


def filter_matches(rows: DataFrame, wanted: MatchFilter, players: DataFrame | None = None) -> DataFrame:
    """The rows of ``star()`` that fit. A name matches by ``ILIKE``, so its ``%`` and ``_`` are wildcards."""
    col = F.col
    if wanted.statuses:
        rows = rows.where(col("status").isin(normalize_statuses(wanted.statuses)))
    if wanted.tours:
        rows = rows.where(col("t_tour").isin(expand_tours(wanted.tours)))
    if genders := [g for g in wanted.genders if g in ("men", "women")]:
        rows = rows.where(col("t_gender").isin(genders))
    if wanted.surfaces:
        rows = rows.where(col("ed_surface").isin(*wanted.surfaces) | (col("ed_surface").isNull() & col("t_surface").isin(*wanted.surfaces)))
    if wanted.levels:
        rows = rows.where(col("t_level").isin(*wanted.levels))
    if wanted.rounds:
        rows = rows.where(col("round").isin(*wanted.rounds))
    if wanted.head_to_head:
        x, y = wanted.head_to_head
        rows = rows.where(((col("player_a_id") == x) & (col("player_b_id") == y)) | ((col("player_a_id") == y) & (col("player_b_id") == x)))
    elif wanted.player_id is not None:
        rows = rows.where((col("player_a_id") == wanted.player_id) | (col("player_b_id") == wanted.player_id))
    elif wanted.player_name and players is not None:
        found = players.where(col("name").ilike(f"%{wanted.player_name}%")).select(col("id").alias("found"))
        # two equi-joins and a union in place of one join on either column, which would compare all with all
        either = rows.join(found, col("player_a_id") == col("found"), "left_semi")
        other = rows.join(found, col("player_a_id") == col("found"), "left_anti").join(found, col("player_b_id") == col("found"), "left_semi")
        rows = either.unionByName(other)
    if wanted.tournament:
        rows = rows.where(col("t_name").ilike(f"%{wanted.tournament}%"))
    low, high = date_window(wanted.preset, wanted.today, wanted.start, wanted.end)
    if low:
        rows = rows.where(col("match_date") >= F.lit(low))
    if high:
        rows = rows.where(col("match_date") <= F.lit(high))
    return rows


def home_scope() -> Column:
    """What the home page shows: Grand Slams, the main tours, late rounds of the second tours and finals of the third."""
    second = F.col("t_tour").isin("CHALLENGER", "Challenger", "ATP_CHALLENGER", "WTA 125", "WTA_125")
    return (F.col("t_level") == "Grand Slam") | F.col("t_tour").isin("ATP", "WTA") | (second & F.col("round").isin("SF", "F")) | ((F.col("t_tour") == "ITF") & (F.col("round") == "F"))


def newest_first() -> list[Column]:
    return [F.col("match_date").desc_nulls_last(), F.col("temporal_order").desc_nulls_last(), F.col("id").desc()]


def page(rows: DataFrame, order: Sequence[Column], per_page: int, number: int = 1) -> DataFrame:
    """One page of a report: a top-k, so only ``offset + per_page`` rows of each task are kept."""
    return rows.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def upcoming(rows: DataFrame, limit: int = 10) -> DataFrame:
    day = F.coalesce("scheduled_date", "match_date")
    return page(rows.where(F.col("status").isin(*STATUS_GROUPS["pending"]) & home_scope()), [day.asc_nulls_last(), F.col("id")], limit)


def latest(rows: DataFrame, limit: int = 10) -> DataFrame:
    day = F.coalesce("match_date", "scheduled_date")
    return page(rows.where(F.col("status").isin(*STATUS_GROUPS["historical_default"]) & home_scope()), [day.desc_nulls_last(), F.col("id").desc()], limit)


@F.pandas_udf(T.BooleanType())
def shown_swapped(ids: pd.Series, orders: pd.Series) -> pd.Series:
    """Whether a match is shown from the second player's side: the low bit of a one-byte BLAKE2s of id and order."""
    return pd.Series([hashlib.blake2s(f"{i}:{int(t) if t is not None and t == t else 0}".encode(), digest_size=1).digest()[0] & 1 == 1 for i, t in zip(ids, orders, strict=True)])


def serialize(rows: DataFrame, players: DataFrame) -> DataFrame:
    """Rows of ``star()`` as they are shown: names, surface with the edition's first, display date, year."""
    a = players.select(F.col("id").alias("pa"), F.col("name").alias("player_a"))
    b = players.select(F.col("id").alias("pb"), F.col("name").alias("player_b"))
    rows = rows.join(a, F.col("player_a_id") == F.col("pa"), "left").join(b, F.col("player_b_id") == F.col("pb"), "left")
    day = F.coalesce("match_date", "scheduled_date")
    return rows.select(
        "id", F.coalesce("player_a", F.lit("Unknown")).alias("player_a"), F.coalesce("player_b", F.lit("Unknown")).alias("player_b"),
        F.coalesce(F.nullif(F.col("ed_surface"), F.lit("")), F.col("t_surface")).alias("surface"), "round", "status", "score", flip(F.col("score")).alias("flipped_score"),
        F.date_format(day, "dd MMM yyyy").alias("display_date"), F.coalesce(F.year(day), F.col("ed_year")).alias("year"),
        F.when(F.col("winner_id") == F.col("player_a_id"), "A").when(F.col("winner_id") == F.col("player_b_id"), "B").alias("winner"),
    )


def lifecycle(matches: DataFrame) -> DataFrame:
    """Flags of where a match stands."""
    s = F.col("status")
    return matches.withColumns({"is_completed": s.isin(*STATUS_GROUPS["historical_default"]), "is_upcoming": s == "upcoming", "is_scheduled": s == "scheduled", "is_pending": s.isin(*STATUS_GROUPS["pending"])})
