"""The rating engine.

Everything about a match that doesn't depend on ratings (level, margin, how many matches a player had before, how long ago the last
one was) is worked out by windows over the players' matches. What is left is a recursion over pairs of players: an ordered
fold. A match only waits for the matches before it that share a player with it, so the fold goes in waves: of the matches
at hand, all that wait for nothing are rated at once, for all parameter candidates.

Up to ``WINDOW_ROWS`` matches are one task. Beyond, the fold goes through windows of time, one after another; in a window, pools
of players that meet in it are folded side by side. A task holds the ratings of its players and one chunk of matches. All else is done
by all tasks: matches of all windows are sorted by ranges and packed into pieces of many rows before they are folded, and unpacked after.
A window reads its own pieces, and the ratings that earlier windows have left for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from topspin.functions.domain import base_code, level_code
from topspin.functions.scores import dominance, parse_score, to_structured
from topspin.operators.matches import sides
from topspin.operators.tables import activate, upsert
from topspin.schema import RATED, RATED_FAST, RATING_K, RATING_S
from topspin.sources.sinks import discard, durable, written

Number = Column | float

#: Matches of a window of time, those that a task takes at once, and those of a packed piece (over the number of candidates).
WINDOW_ROWS, CHUNK_ROWS, PIECE_ROWS = 4 << 20, 1 << 16, 1 << 13

#: Different scores up to which they are broadcast once parsed.
SPELT_SCORES = 1 << 16


@dataclass(frozen=True)
class Params:
    """Parameters of the engine; K and S by code without the women's W."""

    k: dict[str, float] = field(default_factory=lambda: dict(RATING_K))
    s: dict[str, float] = field(default_factory=lambda: dict(RATING_S))
    margin_base: float = 0.85
    margin_scale: float = 0.3
    decay_rate: float = 0.05
    decay_start: float = 60.0
    new_threshold: float = 30.0
    new_boost: float = 1.5
    returning_days: float = 180.0
    returning_boost: float = 1.3
    start_men: float = 1500.0
    start_women: float = 1500.0

    def row(self, candidate: int) -> dict:
        return {"candidate": candidate} | asdict(self)


CANDIDATE = "candidate int, k map<string,double>, s map<string,double>, margin_base double, margin_scale double, decay_rate double, decay_start double, new_threshold double, new_boost double, returning_days double, returning_boost double, start_men double, start_women double"


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def expected(a: Column, b: Column, s: Number) -> Column:
    """The first player's chance; an overflow gives 0.001 or 0.999."""
    power = (b - a) / _c(s)
    return F.when(power > 308, 0.001).when(power < -308, 0.999).otherwise(1 / (1 + F.pow(F.lit(10.0), power)))


def win_probability(a: Column, b: Column, s: Number) -> Column:
    return F.round(expected(a, b, s), 4)


def rating_for_probability(p: Column, opponent: Column, s: Number) -> Column:
    return F.when(p >= 1, opponent + 1000).when(p <= 0, opponent - 1000).otherwise(opponent - _c(s) * F.log10((1 - p) / F.nullif(p, F.lit(0.0))))


def updated(a: Column, b: Column, a_won: Column, k: Number, s: Number) -> Column:
    """``struct<before_a, before_b, after_a, after_b, expected_a, expected_b, change_a, upset>`` of one match, half-up at two places."""
    p = expected(a, b, s)
    delta = _c(k) * (a_won.cast("int") - p)
    return F.struct(
        a.alias("before_a"), b.alias("before_b"), F.round(a + delta, 2).alias("after_a"), F.round(b - delta, 2).alias("after_b"),
        F.round(p, 4).alias("expected_a"), F.round(1 - p, 4).alias("expected_b"), F.round(delta, 2).alias("change_a"), (((a < b) & a_won) | ((b < a) & ~a_won)).alias("upset"),
    )


def decay_factor(days: Column, rate: Number = 0.05, start: Number = 60.0) -> Column:
    """What is left of the distance to the baseline after so many days."""
    return F.when(days > _c(start), F.exp(-_c(rate) * (days - _c(start)) / 365)).otherwise(1.0)


def decayed(rating: Column, days: Column, target: Number = 1500.0, rate: Number = 0.05, start: Number = 60.0) -> Column:
    return _c(target) + (rating - _c(target)) * decay_factor(days, rate, start)


def k_boost(played: Column, days: Column, threshold: Number = 30.0, new: Number = 1.5, returning_days: Number = 180.0, returning: Number = 1.3) -> Column:
    """Linear fade of the new players' boost, times that of returning ones, within 1 and 3."""
    fresh = F.when((played < _c(threshold)) & (_c(threshold) > 0), 1 + (_c(new) - 1) * (1 - played / F.nullif(_c(threshold), F.lit(0.0)))).otherwise(1.0)
    back = F.when(days > _c(returning_days), _c(returning)).otherwise(1.0)
    return F.greatest(F.lit(1.0), F.least(F.lit(3.0), fresh * back))


def baseline(code: Column, men: Number = 1500.0, women: Number = 1500.0) -> Column:
    return F.when(code.startswith("W"), _c(women)).otherwise(_c(men))


def history(rows: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """``rows`` with, for both players, matches before (``n_a``, ``n_b``) and days since the last dated one (``days_a``, ``days_b``).

    ``rows`` are finished matches with ``temporal_order``; ``states`` holds what came before them. A match of a player against
    themselves is left out.
    """
    rows = rows.where(F.col("player_a_id") != F.col("player_b_id"))
    before = Window.partitionBy("player_id").orderBy("temporal_order", "id")
    each = sides(rows, "id", "temporal_order", "match_date")
    each = each.withColumn("n", F.row_number().over(before) - 1).withColumn("last", F.last("match_date", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    if states is not None:
        known = states.select("player_id", F.col("match_count").alias("_count"), F.col("last_match_date").alias("_last"))
        each = each.join(known, "player_id", "left").withColumn("n", F.col("n") + F.coalesce("_count", F.lit(0))).withColumn("last", F.coalesce("last", "_last"))
    each = each.withColumn("days", F.datediff("match_date", "last"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = each.groupBy("id").agg(*[of(s, c).alias(f"{c}_{s.lower()}") for s in "AB" for c in ("n", "days")])
    return rows.join(both, "id")


def levels(rows: DataFrame) -> DataFrame:
    """Rows of ``star()`` with the level's ``code`` the structured score, and its ``dominance`` if A or B has won; a score is parsed once, however many matches have it."""
    rows = rows.withColumn("code", level_code(F.col("t_level"), F.col("t_tour")))
    spelt = rows.select("score").where("score IS NOT NULL").distinct().select("score", to_structured(parse_score(F.col("score"))).alias("score_structured"))
    spelt = durable(spelt.select("*", *[dominance(F.col("score_structured"), F.lit(a_won)).alias(c) for c, a_won in (("lead_a", True), ("lead_b", False))]))
    spelt = F.broadcast(spelt) if spelt.count() <= SPELT_SCORES else spelt
    return rows.join(spelt, "score", "left").select(*rows.columns, "score_structured", "lead_a", "lead_b")


def margin(structured: Column, a_won: Column, base: Number = 0.85, scale: Number = 0.3) -> Column:
    """The multiplier of K by the winner's share of games: within 0.5 and 2, half-even at four places; 1 without games."""
    return margin_of(dominance(structured, a_won), F.size(structured), base, scale)


def margin_of(lead: Column, count: Column, base: Number = 0.85, scale: Number = 0.3) -> Column:
    """``margin()`` of a known ``dominance`` and the number of sets."""
    exact = F.greatest(F.lit(0.5), F.least(F.lit(2.0), _c(base) + lead * _c(scale)))
    return F.when(F.coalesce(count, F.lit(0)) <= 0, 1.0).otherwise(F.bround(exact.cast("decimal(20,12)"), 4).cast("double"))


def _of_candidate(p: dict[str, Number | Column], a_won: Column) -> Column:
    code = base_code(F.col("code"))
    pick = lambda name: F.coalesce(F.try_element_at(p[name], code), F.try_element_at(p[name], F.lit("A")))
    boost = lambda s: k_boost(F.col(f"n_{s}"), F.col(f"days_{s}"), p["new_threshold"], p["new_boost"], p["returning_days"], p["returning_boost"])
    decay = lambda s: decay_factor(F.col(f"days_{s}"), p["decay_rate"], p["decay_start"])
    k = pick("k") * margin_of(F.when(a_won, F.col("lead_a")).otherwise(F.col("lead_b")), F.size("score_structured"), p["margin_base"], p["margin_scale"])
    return F.struct(
        (k * boost("a")).alias("k_a"), (k * boost("b")).alias("k_b"), pick("s").alias("s"), baseline(F.col("code"), p["start_men"], p["start_women"]).alias("base"),
        decay("a").alias("decay_a"), decay("b").alias("decay_b"),
    )


def factors(rows: DataFrame, candidates: Sequence[Params], fast: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """What the fold needs of each match; ``f`` holds decays, K with margin and boost, S and baseline for each candidate."""
    a_won = F.col("winner_id") == F.col("player_a_id")
    if fast:
        rows = rows.where(a_won | (F.col("winner_id") == F.col("player_b_id")))
    a_won = F.coalesce(a_won, F.lit(False))
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in (kv[0], float(kv[1]))])
    values = [{n: as_map(v) if isinstance(v, dict) else F.lit(float(v)) for n, v in asdict(p).items()} for p in candidates]
    if len(values) == 1:
        own = F.array(_of_candidate(values[0], a_won))
    else:
        own = F.transform(F.array(*[F.struct(*[c.alias(n) for n, c in v.items()]) for v in values]), lambda c: _of_candidate({n: c[n] for n in values[0]}, a_won))
    return rows.select("temporal_order", "id", F.col("player_a_id").alias("a"), F.col("player_b_id").alias("b"), a_won.alias("a_won"), own.alias("f"), *keep)


def _cents(x: np.ndarray) -> np.ndarray:
    """Two places, as ``round`` does: values that look like ties are decided by their exact binary value."""
    scaled = x * 100
    out = np.rint(scaled) / 100
    ties = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6
    if ties.any():
        out[ties] = [round(v, 2) for v in x[ties].tolist()]
    return out


def _waves(a: np.ndarray, b: np.ndarray, players: int) -> list[np.ndarray]:
    """Matches in the order in which they can be rated: each array is of matches that share no player and whose predecessors are in arrays before."""
    free, wave = [0] * players, []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        w = free[x] if free[x] > free[y] else free[y]
        free[x] = free[y] = w + 1
        wave.append(w)
    order = np.argsort(np.array(wave, np.int64), kind="stable")
    return np.split(order, np.cumsum(np.bincount(wave))[:-1]) if wave else []


class _Ratings:
    """Ratings, first baselines and whether they differ from what was known, of the players of a task: a row each, a column for each candidate."""

    def __init__(self, width: int):
        self.width, self.ids, self.place = width, [], {}
        self.rating, self.first, self.moved = np.full((1024, width), np.nan), np.full((1024, width), np.nan), np.zeros(1024, bool)

    def places(self, ids: np.ndarray) -> np.ndarray:
        known, inverse = np.unique(ids, return_inverse=True)
        at = np.empty(len(known), np.int64)
        for i, x in enumerate(known.tolist()):
            if x not in self.place:
                self.place[x] = len(self.ids)
                self.ids.append(x)
            at[i] = self.place[x]
        more = len(self.ids) - len(self.moved)
        if more > 0:
            more += len(self.ids)
            blank = np.full((more, self.width), np.nan)
            self.rating, self.first, self.moved = np.concatenate([self.rating, blank]), np.concatenate([self.first, blank]), np.concatenate([self.moved, np.zeros(more, bool)])
        return at[inverse]

    def rate(self, a: np.ndarray, b: np.ndarray, won: np.ndarray, f: dict[str, np.ndarray], old: np.ndarray | None, fast: bool) -> np.ndarray:
        """Ratings before and after and the winner's chance of each match (the first axis tells which), in the order given."""
        out = np.empty((5, len(a), self.width))
        for at in _waves(a, b, len(self.ids)):
            x, y, w, base = a[at], b[at], won[at, None], f["base"][at]
            base_a = base_b = base
            if fast:
                base_a, base_b = (np.where(np.isnan(self.first[p]), base, self.first[p]) for p in (x, y))
                self.first[x], self.first[y] = base_a, base_b
            now_a, now_b = (np.where(np.isnan(self.rating[p]), base, self.rating[p]) for p in (x, y))
            pre_a, pre_b = base_a + (now_a - base_a) * f["decay_a"][at], base_b + (now_b - base_b) * f["decay_b"][at]
            with np.errstate(over="ignore"):
                odds = np.power(10.0, (pre_b - pre_a) / f["s"][at])
            p = np.where(np.isinf(odds), 0.001, 1 / (1 + odds))
            new = np.stack([pre_a, pre_b, pre_a + f["k_a"][at] * (w - p), pre_b + f["k_b"][at] * (p - w), np.clip(np.where(w > 0, p, 1 - p), 1e-7, 1 - 1e-7)])
            if not fast:
                new[:4] = _cents(new[:4])
            if old is not None:
                moved = np.isnan(old[at, 0]) | self.moved[x] | self.moved[y]
                new = np.where(moved[None, :, None], new, old[at].T[:, :, None])
                self.moved[x], self.moved[y] = moved, moved
            self.rating[x], self.rating[y] = new[2], new[3]
            out[:, at] = new
        return out


_OUT = ("pre_a", "pre_b", "post_a", "post_b", "p_winner")
_RATED = ["id", "player_id", *_OUT, "rating", "first", "moved"]


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def _filled(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) > 0


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in batch.column("piece"):
            yield pa.ipc.open_stream(piece.as_buffer()).read_next_batch()


def _pack(batches: Iterator[pa.RecordBatch], width: int, groups: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as pieces of one group, each under its first row's time; rows that bring a rating and matches aren't mixed."""
    most = max(64, PIECE_ROWS // width)
    for batch in batches:
        own = [*[batch.column(g).to_numpy() for g in groups], batch.column("id").is_null().to_numpy(zero_copy_only=False)]
        cuts = np.flatnonzero(np.logical_or.reduce([g[1:] != g[:-1] for g in own])) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            for start in range(low, high, most):
                rows = batch.slice(start, min(most, high - start))
                piece = pa.array([_packed(rows.drop_columns(list(groups)))], pa.binary())
                head = (*groups, "temporal_order", "id")
                yield pa.RecordBatch.from_arrays([*[rows.column(c).slice(0, 1) for c in head], piece], names=[*head, "piece"])


def _run(batches: Iterator[pa.RecordBatch], width: int, fast: bool, carry: bool) -> Iterator[pa.RecordBatch]:
    """The recursion over pieces in order; pieces of rows without an id, which come first, bring players' ratings. The results are packed; with ``carry``, the last ratings come as such rows."""
    most = max(64, PIECE_ROWS // width)
    for rows, known in _rated(_unpack(batches), width, fast, carry):
        for start in range(0, rows.num_rows, most):
            yield pa.RecordBatch.from_arrays([pa.array([known]), pa.array([_packed(rows.slice(start, most))], pa.binary())], names=["known", "piece"])


def _rated(batches: Iterator[pa.RecordBatch], width: int, fast: bool, carry: bool) -> Iterator[tuple[pa.RecordBatch, bool]]:
    held = _Ratings(width)
    waiting: list[pa.RecordBatch] = []

    def chunk() -> pa.RecordBatch:
        rows = pa.concat_batches(waiting)
        waiting.clear()
        n = rows.num_rows
        both = held.places(np.concatenate([rows.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]))
        own = rows.column("f").flatten()
        f = {own.type.field(i).name: own.field(i).to_numpy(zero_copy_only=False).reshape(n, width) for i in range(own.type.num_fields)}
        old = None
        if "old" in rows.schema.names:
            old, has = np.full((n, 5), np.nan), _filled(rows.column("old"))
            old[has] = rows.column("old").flatten().to_numpy(zero_copy_only=False).reshape(-1, 5)
        out = held.rate(both[:n], both[n:], rows.column("a_won").to_numpy(zero_copy_only=False).astype(float), f, old, fast)
        return pa.RecordBatch.from_arrays([rows.column("id"), pa.nulls(n, pa.int64()), *map(_lists, out), *[pa.nulls(n, pa.list_(pa.float64()))] * 2, pa.nulls(n, pa.bool_())], names=_RATED)

    def start(known: pa.RecordBatch) -> None:
        at = held.places(known.column("a").to_numpy(zero_copy_only=False))
        for name in ("rating", "first"):
            has = _filled(known.column(name))
            getattr(held, name)[at[has]] = known.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        held.moved[at] = known.column("moved").to_numpy(zero_copy_only=False)

    for batch in batches:
        if batch.column("id").null_count:
            start(batch)
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= CHUNK_ROWS:
            yield chunk(), False
    if waiting:
        yield chunk(), False
    if carry and held.ids:
        n = len(held.ids)
        first = _lists(held.first[:n]) if fast else pa.nulls(n, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(held.ids, pa.int64()), *[pa.nulls(n, pa.list_(pa.float64()))] * 5, _lists(held.rating[:n]), first, pa.array(held.moved[:n])], names=_RATED), True


def _laid_out(rows: DataFrame) -> DataFrame:
    """Matches beside which ``_known()`` rows can stand."""
    # lists that are missing are empty: each null among lists costs Arrow's writer a walk through its batch
    none = F.array().cast("array<double>")
    return rows.withColumns({"rating": none, "first": none, "moved": F.lit(False)} | ({"old": F.coalesce("old", none)} if "old" in rows.columns else {}))


def _known(states: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows like ``rows`` that bring players' ratings and first baselines, and whether they differ from what was known; without an id and a time, so that they sort before matches."""
    none = {f.name: F.array().cast(f.dataType) if isinstance(f.dataType, ArrayType) else F.lit(None).cast(f.dataType) for f in rows.schema.fields}
    known = {"a": F.col("player_id")} | {c: F.col(c) for c in ("window", "lane") if c in rows.columns} | {c: F.coalesce(c, none[c]) for c in ("rating", "first") if c in states.columns}
    known["moved"] = F.coalesce("moved", F.lit(False)) if "moved" in states.columns else F.lit(False)
    return states.select(*[(none | known)[c].alias(c) for c in rows.columns])


def _sorted(rows: DataFrame, *groups: str) -> DataFrame:
    order = (*groups, "temporal_order", "id")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _pieces(rows: DataFrame, width: int, *groups: str) -> DataFrame:
    """Sorted rows as pieces of one group, packed by all tasks."""
    return rows.mapInArrow(lambda b: _pack(b, width, groups), "".join(f"{g} int, " for g in groups) + "temporal_order long, id long, piece binary")


def _folded(dealt: DataFrame, width: int, fast: bool, carry: bool) -> DataFrame:
    """One ordered pass over the pieces of each lane: packed pieces of matches, and of ``known`` ratings behind them."""
    return dealt.sortWithinPartitions("lane", "temporal_order", "id").mapInArrow(lambda b: _run(b, width, fast, carry), "known boolean, piece binary")


def _unpacked(pieces: DataFrame) -> DataFrame:
    lists = ", ".join(f"{c} array<double>" for c in (*_OUT, "rating", "first"))
    dealt = pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(_unpack, f"id long, player_id long, {lists}, moved boolean")


def _dealt(rows: DataFrame, states: DataFrame | None, width: int, fast: bool, carry: bool) -> DataFrame:
    """All rows as one lane."""
    rows = _laid_out(rows.withColumn("lane", F.lit(0)))
    rows = rows.unionByName(_known(states.withColumn("lane", F.lit(0)), rows)) if states is not None else rows
    return _unpacked(_folded(_pieces(_sorted(rows, "lane"), width, "lane").repartition(1), width, fast, carry))


def _components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links, and the least node of each one's component: roots are hung below smaller ones until no link joins two."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pool of each player in each window, of matches sorted by window: a task holds the two players of each match of one window."""
    window, held = None, []

    def done() -> pa.RecordBatch:
        nodes, pools = _components(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), window, np.int32)), pa.array(nodes), pa.array(pools)], names=["window", "node", "pool"])

    for batch in batches:
        at, a, b = (batch.column(c).to_numpy() for c in ("window", "a", "b"))
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        for low, high in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if low == high:
                continue
            if held and at[low] != window:
                yield done()
                held = []
            window = at[low]
            held.append((a[low:high].copy(), b[low:high].copy()))
    if held:
        yield done()


def _window(bounds: Sequence[int]) -> Column:
    return reduce(Column.__add__, [(F.col("temporal_order") > b).cast("int") for b in bounds], F.lit(0))


def pools_of(rows: DataFrame, window_rows: int = WINDOW_ROWS) -> tuple:
    """Windows of time of matches (``a``, ``b``, ``temporal_order``): the bounds between them, and the ``pool`` of each player (``node``) in each ``window``. Empty if all of it is one task's."""
    count = rows.count()
    if count <= window_rows:
        return ()
    steps = -(-count // window_rows)
    bounds = [int(x) for x in sorted(set(rows.approxQuantile("temporal_order", [i / steps for i in range(1, steps)], 0.1 / steps)))]
    # a window is bounded, so that its pools are one task's; those of all windows are found side by side
    dealt = rows.select(_window(bounds).alias("window"), "a", "b").where("a <> b").repartitionByRange(len(bounds) + 1, "window").sortWithinPartitions("window")
    return bounds, durable(dealt.mapInArrow(_pools, "window int, node long, pool long"))


def windows_of(rows: DataFrame, window_rows: int = WINDOW_ROWS) -> list[tuple[int | None, int | None, DataFrame]]:
    """``pools_of()`` as a list of windows: bounds, and the ``pool`` of each player who plays in it."""
    bounds, pools = pools_of(rows, window_rows) or ([], None)
    if pools is None:
        return []
    return [(low, high, pools.where(F.col("window") == i).drop("window")) for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None], strict=True))]


def fold(rows: DataFrame, states: DataFrame | None = None, fast: bool = False, width: int = 1, window_rows: int = WINDOW_ROWS, windows: tuple | None = None) -> DataFrame:
    """``id`` and arrays over the candidates: ratings before and after each match of ``factors()``, and the chance that its winner had.

    In the production flavour ratings decay to the match's baseline and are rounded to two places after each match; in the fast one
    they decay to the baseline at which a player was first seen, unrounded. ``states`` (``player_id``, ``rating`` as an array) start the players.
    Rows may bring ``old``, the five values that are known: they hold unless a player's rating has changed since. ``windows`` are those of ``pools_of()`` for these rows or more.
    """
    rows, path = written(rows)
    windows = pools_of(rows, window_rows) if windows is None else windows
    if not windows:
        return _dealt(rows, states, width, fast, False).select("id", *_OUT)
    bounds, pools = windows
    # matches are packed once for all windows, and each rating goes to the next window in which its player plays, so that no window reads another's rows
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stops = pools.select("window", "node", F.pmod(F.xxhash64("pool"), F.lit(lanes)).cast("int").alias("lane"))
    matches = _laid_out(rows.withColumn("window", _window(bounds)).join(stops.withColumnRenamed("node", "a"), ["window", "a"]))
    pieces = durable(_pieces(_sorted(matches, "window", "lane"), width, "window", "lane"), "window")
    discard(rows.sparkSession, path)
    later = Window.partitionBy("node").orderBy("window")
    stops = stops.select(F.col("node").alias("player_id"), F.col("window").alias("at"), *[F.lead(c).over(later).alias(c) for c in ("window", "lane")], F.row_number().over(later).alias("place"), F.col("lane").alias("at_lane"))
    stops = durable(stops, "at")
    start = stops.where("place = 1").select("player_id", F.col("at").alias("window"), F.col("at_lane").alias("lane"))
    to_windows = lambda x: durable(_pieces(_known(x, matches).sortWithinPartitions("window", "lane"), width, "window", "lane").repartition("window"), "window")
    brought = [] if states is None else [to_windows(states.join(start, "player_id"))]
    out = []
    for i in range(len(bounds) + 1):
        here = reduce(DataFrame.unionByName, [x.where(F.col("window") == i).drop("window") for x in (pieces, *brought)])
        done = durable(_folded(here.repartition("lane"), width, fast, i < len(bounds)))
        out.append(_unpacked(done.where("NOT known")).select("id", *_OUT))
        if i < len(bounds):
            after = _unpacked(done.where("known")).select("player_id", "rating", "first", "moved")
            brought.append(to_windows(after.join(stops.where((F.col("at") == i) & F.col("window").isNotNull()), "player_id")))
    return reduce(DataFrame.unionByName, out)


def _single(folded: DataFrame) -> DataFrame:
    return folded.select("id", *[F.col(c)[0].alias(c) for c in _OUT])


def rebuild(star: DataFrame, params: Params | None = None, fast: bool = False, statuses: tuple[str, ...] | None = None, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """All finished matches of ``star()`` (with ``temporal_order``) folded from nothing: ratings before and after, and the winner's chance."""
    rows = levels(star.where(F.col("status").isin(*(statuses or (RATED_FAST if fast else RATED)))))
    return _single(fold(factors(history(rows), [params or Params()], fast), fast=fast, window_rows=window_rows))


def changed_states(rated: DataFrame, matches: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The states of the players of ``rated`` matches behind them: rating, count, last date and order, peak; ``old`` are the states before."""
    rows = matches.select("id", "player_a_id", "player_b_id", "temporal_order", "match_date").join(rated.select("id", "post_a", "post_b"), "id")
    each = sides(rows, "id", "temporal_order", "match_date", "post_a", "post_b").withColumn("post", F.when(F.col("side") == "A", F.col("post_a")).otherwise(F.col("post_b")))
    at = F.struct("temporal_order", "id")
    new = each.groupBy("player_id").agg(
        F.max_by("post", at).alias("rating"), F.count("*").alias("match_count"),
        F.max_by("match_date", F.when(F.col("match_date").isNotNull(), at)).alias("last_match_date"), F.max("temporal_order").alias("last_temporal_order"), F.max("post").alias("career_peak"),
    )
    if old is None:
        return new
    before = old.select("player_id", *[F.col(c).alias(f"_{c}") for c in ("match_count", "last_match_date", "career_peak")])
    return new.join(before, "player_id", "left").select(
        "player_id", "rating", (F.col("match_count") + F.coalesce("_match_count", F.lit(0))).alias("match_count"), F.coalesce("last_match_date", "_last_match_date").alias("last_match_date"),
        "last_temporal_order", F.greatest("career_peak", F.coalesce("_career_peak", "career_peak")).alias("career_peak"),
    )


def states_after(rated: DataFrame, matches: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """All states after ``changed_states()``; players without a new match keep theirs."""
    new = changed_states(rated, matches, old)
    return new if old is None else upsert(old.select(*new.columns), new, "player_id")


def late_point(unprocessed: DataFrame, states: DataFrame) -> DataFrame:
    """One row: the least order of an unprocessed match that comes before a match its player has been rated for; null if none does."""
    last = states.select("player_id", "last_temporal_order")
    each = sides(unprocessed, "temporal_order").join(last, "player_id")
    return each.where(F.col("temporal_order") < F.col("last_temporal_order")).agg(F.min("temporal_order").alias("point"))


def states_before(rated: DataFrame, matches: DataFrame, point: int) -> DataFrame:
    """An as-of join: each player's state after the last rated match before ``point``."""
    return states_after(rated, matches.where(F.col("temporal_order") < point))


def rating_as_of(rated: DataFrame, matches: DataFrame, points: DataFrame) -> DataFrame:
    """For each row of ``points`` (``player_id``, ``as_of``) the rating after the player's last match strictly before; null if there is none.

    A union and one window for each player in place of a range join, so nothing is compared with everything.
    """
    rows = matches.select("id", "player_a_id", "player_b_id", "temporal_order").join(rated.select("id", "post_a", "post_b"), "id")
    each = sides(rows, "id", "temporal_order", "post_a", "post_b")
    each = each.select("player_id", F.col("temporal_order").alias("at"), F.lit(1).alias("kind"), "id", F.when(F.col("side") == "A", F.col("post_a")).otherwise(F.col("post_b")).alias("post"))
    asked = points.select("player_id", F.col("as_of").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("post"))
    order = Window.partitionBy("player_id").orderBy("at", "kind", "id")
    return each.unionByName(asked).withColumn("rating", F.last("post", ignorenulls=True).over(order)).where(F.col("kind") == 0).select("player_id", F.col("at").alias("as_of"), "rating")


#: Ids up to which a list is pushed to the scan.
POINT_IDS = 1000


def by_ids(table: DataFrame, ids: DataFrame, most: int = POINT_IDS) -> DataFrame:
    """The rows of ``table`` whose ``id`` is among ``ids``. Up to ``most`` ids reach the scan as a list, so that only row groups that can hold them are read; beyond, as their range, before a join."""
    ids = ids.select("id").where("id IS NOT NULL").distinct()
    few = [r.id for r in ids.limit(most + 1).collect()]
    if len(few) <= most:
        return table.where(F.col("id").isin(few)) if few else table.where(F.lit(False))
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    return table.where(F.col("id").between(low, high)).join(ids, "id", "left_semi")


def rating_changes(star: DataFrame, rated: DataFrame, states: DataFrame, params: Params | None = None, repair: bool = True, window_rows: int = WINDOW_ROWS, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What rating the finished matches of ``star()`` that ``rated`` lacks changes: rows of ``rated`` and of ``states``, new and replaced ones.

    With ``repair``, a match that comes before what its players have been rated for sends the fold back to its place. Later matches
    are rated again only where it can reach them: those of its players, of their later opponents, and so on; the others keep
    their values. With ``ids``, just those matches are read and rated, from the states as they are.
    """
    done = star.where(F.col("status").isin(*RATED))
    if ids is not None:
        repair, done = False, by_ids(done, ids)
        rated = by_ids(rated, ids)
    fresh = done.join(rated.select("id"), "id", "left_anti")
    point = late_point(fresh, states).first().point if repair else None
    old: list[str] = []
    if point is not None:
        later = done.where(F.col("temporal_order") >= point)
        states = durable(states_before(rated, done, point))
        known = rated.select("id", F.array(*_OUT).alias("old"))
        fresh, old = later.join(known, "id", "left"), ["old"]
    fresh = durable(fresh)
    players = sides(fresh, "id").select("player_id").distinct()
    # only the states of players who play are read on
    states = durable(states.join(players, "player_id", "left_semi"))
    rows = factors(history(levels(fresh), states), [params or Params()], keep=old)
    start = states.select("player_id", F.array(F.col("rating").cast("double")).alias("rating"))
    new = durable(_single(fold(rows, start, window_rows=window_rows)))
    return new.select(*rated.columns), changed_states(new, fresh, states)


def update_ratings(star: DataFrame, rated: DataFrame, states: DataFrame, params: Params | None = None, repair: bool = True, window_rows: int = WINDOW_ROWS, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The next versions of ``rated`` and ``states`` after ``rating_changes()``."""
    new, changed = rating_changes(star, rated, states, params, repair, window_rows, ids)
    changed = durable(changed)
    return upsert(rated, new, "id"), upsert(states.select(*changed.columns), changed, "player_id")


def refresh_snapshots(matches: DataFrame, states: DataFrame, touched: DataFrame) -> DataFrame:
    """Pending matches with a touched player, with both players' current ratings (null without a state)."""
    ids = touched.select("player_id").distinct()
    pending = matches.where(F.col("status").isin("upcoming", "scheduled") & F.col("winner_id").isNull())
    hit = sides(pending, "id").join(ids, "player_id", "left_semi").select("id").distinct()
    a = states.select(F.col("player_id").alias("player_a_id"), F.col("rating").alias("elo_pre_player_a"))
    b = states.select(F.col("player_id").alias("player_b_id"), F.col("rating").alias("elo_pre_player_b"))
    return pending.join(hit, "id", "left_semi").join(a, "player_a_id", "left").join(b, "player_b_id", "left").select("id", "elo_pre_player_a", "elo_pre_player_b")


def log_loss(p: Column) -> Column:
    """Mean negative logarithm, with chances kept off 0 and 1; infinite without rows."""
    return F.coalesce(-F.avg(F.ln(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p)))), F.lit(float("inf")))


def _places(matches: DataFrame) -> tuple[DataFrame, int]:
    """``(id, match_date, place)`` by time, from 1, and how many there are.

    Only ids and orders are sorted to number the rows, by ranges over all tasks: a row's place is the rows of the ranges before it,
    plus its place in its own.
    """
    # written, so that a task that is run again can't put its rows into other ranges than those counted
    ranged = durable(matches.select("id", "temporal_order", "match_date").repartitionByRange("temporal_order", "id").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("range").orderBy("temporal_order", "id")) + F.col("before")
    return ranged.join(F.broadcast(before), "range").select("id", "match_date", place.alias("place")), total


def chronological_split(matches: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """``matches`` with ``part``: train, validation or test, by their place in time."""
    rows, total = _places(matches)
    part = F.when(F.col("place") <= int(total * train), "train").when(F.col("place") <= int(total * (train + validation)), "validation").otherwise("test")
    return matches.join(rows.select("id", part.alias("part")), "id")


def evaluation_split(matches: DataFrame, mode: str = "temporal_order", test_months: int = 12, eval_years: int = 5, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """``matches`` with ``part``: warm-up, train, validation or test.

    What is evaluated starts with the first match (``temporal_order``), or with the first one dated in the last ``test_months`` months of 30 days (``match_date``) or
    ``eval_years`` years of 365 days (``recent_years_ratio``). Refused are fewer than ten matches, fewer than a hundred to evaluate, shares out of bounds, and parts
    that would be empty; each part has at least twenty.
    """
    if mode not in ("temporal_order", "match_date", "recent_years_ratio"):
        raise ValueError(f"unknown mode: {mode}")
    if validation <= 0 or test <= 0 or validation + test >= 0.9:
        raise ValueError("the shares of validation and test must be above 0 and below 0.9 together")
    rows, total = _places(matches)
    if total < 10:
        raise ValueError("at least ten matches are needed")
    rows, start = durable(rows), 0
    if mode != "temporal_order":
        last = rows.agg(F.max("match_date")).first()[0]
        days = test_months * 30 if mode == "match_date" else eval_years * 365
        start = (rows.where(F.col("match_date") >= F.date_sub(F.lit(last), days)).agg(F.min("place")).first()[0] or total + 1) - 1
    count = total - start
    if count < 100:
        raise ValueError(f"only {count} matches to evaluate")
    first = max(start + 20, min(start + int(count * (1 - (validation + test))), total - 40))
    second = max(start + 40, min(start + int(count * (1 - test)), total - 20))
    if not start < first < second < total:
        raise ValueError("a part would be empty")
    place = F.col("place")
    part = F.when(place <= start, "warm-up").when(place <= first, "train").when(place <= second, "validation").otherwise("test")
    return matches.join(rows.select("id", part.alias("part")), "id")


def since(matches: DataFrame, start: Column) -> DataFrame:
    """Matches from that day on; those without a date don't count."""
    return matches.where(F.col("match_date") >= start)


def prepared(star: DataFrame) -> tuple[DataFrame, tuple]:
    """What is the same for all parameters: matches with their history, and their windows. Passes over the same matches share it."""
    rows = history(levels(star.where(F.col("status").isin(*RATED_FAST))))
    rows = durable(rows.select("id", "temporal_order", "player_a_id", "player_b_id", "winner_id", "code", "score_structured", "lead_a", "lead_b", *[f"{c}_{s}" for c in ("n", "days") for s in "ab"]))
    return rows, pools_of(rows.withColumnsRenamed({"player_a_id": "a", "player_b_id": "b"}))


def evaluate(star: DataFrame, candidates: list[Params], parts: DataFrame, shared: tuple[DataFrame, tuple] | None = None) -> DataFrame:
    """Log loss of each candidate on each part (``id``, ``part``). One pass over the matches rates them for all candidates; ``shared`` is ``prepared()``."""
    rows, windows = shared or prepared(star)
    folded = fold(factors(rows, candidates, fast=True), fast=True, width=len(candidates), windows=windows)
    chances = folded.join(parts.select("id", "part"), "id").select("part", F.posexplode("p_winner").alias("candidate", "p"))
    return chances.groupBy("candidate", "part").agg(log_loss(F.col("p")).alias("log_loss"), F.count("*").alias("n"))


#: Bounds and steps of the search. Fixed values.
BOUNDS = {
    "margin_base": (0.5, 1.2, 0.01), "margin_scale": (0.05, 0.8, 0.01), "decay_rate": (0.001, 0.2, 0.005), "decay_start": (20, 180, 5), "new_threshold": (5, 80, 5), "new_boost": (1.0, 2.5, 0.05),
    "returning_days": (60, 365, 5), "returning_boost": (1.0, 2.0, 0.05), "start_men": (1200, 1800, 100), "start_women": (1200, 1800, 100),
}
K_BOUNDS = {"F": (80, 300), "C": (60, 250), "A": (50, 200), "M": (50, 200), "G": (50, 200)}
S_BOUNDS = {"F": (500, 2500), "C": (600, 2800), "A": (800, 3000), "M": (800, 3000), "G": (600, 2800)}


def to_step(value: float, step: float, low: float, high: float) -> float:
    return float(min(high, max(low, round(value / step) * step)))


def propose(count: int, seed: int = 1, around: Params | None = None, width: float = 1.0) -> list[Params]:
    """Candidates drawn within the bounds (or within ``width`` of them around a known one); the Grand Slams' S is never above the others'."""
    rng = np.random.default_rng(seed)

    def draw(low: float, high: float, step: float, centre: float | None) -> float:
        x = rng.uniform(low, high) if centre is None else centre + rng.uniform(-0.5, 0.5) * (high - low) * width
        return to_step(float(x), step, low, high)

    out = []
    for _ in range(count):
        own = {n: draw(*b, getattr(around, n) if around else None) for n, b in BOUNDS.items()}
        k = {c: draw(*b, 5, around.k[c] if around else None) for c, b in K_BOUNDS.items()}
        s = {c: draw(*b, 25, around.s[c] if around else None) for c, b in S_BOUNDS.items()}
        s["G"] = min(s.values())
        out.append(Params(k=k, s=s, **own))
    return out


def search(star: DataFrame, parts: DataFrame, rounds: tuple[tuple[int, float], ...] = ((8, 1.0), (6, 0.3), (4, 0.1)), seed: int = 1, start: Params | None = None) -> tuple[Params, DataFrame]:
    """Staged random search by validation loss: each stage draws around the best so far, which stays in the running."""
    best, losses, shared = start or Params(), None, prepared(star)
    for stage, (count, width) in enumerate(rounds):
        candidates = different([best, *propose(count, seed + stage, best if stage else None, width)])
        losses = durable(evaluate(star, candidates, parts, shared))
        found = losses.where(F.col("part") == "validation").orderBy("log_loss", "candidate").first()
        best = candidates[found.candidate] if found else best
    return best, losses


def different(candidates: Sequence[Params]) -> list[Params]:
    """Each parameter set once, in the order given."""
    return [p for i, p in enumerate(candidates) if p not in candidates[:i]]


def best_on(star: DataFrame, candidates: Sequence[Params], parts: DataFrame, shared: tuple[DataFrame, tuple] | None = None) -> tuple[Params, dict[str, float]]:
    """Of different candidates the one with the least validation loss (of equals the first), and its loss by part."""
    candidates = different(candidates)
    losses = durable(evaluate(star, candidates, parts, shared))
    found = losses.where(F.col("part") == "validation").orderBy("log_loss", "candidate").first()
    if found is None:
        raise ValueError("there is nothing to validate on")
    return candidates[found.candidate], {r.part: r.log_loss for r in losses.where(F.col("candidate") == found.candidate).collect()}


def worth_activating(current: float, best: float, least: float = 0.002) -> bool:
    """Whether the test loss has fallen by enough."""
    return current - best >= least


def activated(sets: DataFrame, name: str, best: Params, current_loss: float, best_loss: float, created_at: Column, least: float = 0.002) -> DataFrame:
    """Parameter sets after a search: the new one as the only active set, if its test loss is enough below the current one's; else as they were."""
    if not worth_activating(current_loss, best_loss, least):
        return sets
    import json

    row = sets.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(json.dumps(asdict(best))).alias("params"), F.lit(True).alias("is_active"), created_at.alias("created_at"))
    return activate(sets, row)


def active_params(sets: DataFrame) -> Params:
    """The latest active parameter set (``name``, ``params`` as JSON, ``is_active``, ``created_at``); the defaults without a readable one."""
    import json

    row = sets.where("is_active").orderBy(F.col("created_at").desc(), F.col("name")).first()
    try:
        return replace(Params(), **json.loads(row.params))
    except (AttributeError, TypeError, ValueError):
        return Params()


def rebuilt_after_activation(star: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ratings and states anew, by the active parameter set: what a change of it asks for, as no state of the old one holds any more."""
    rated = durable(rebuild(star, active_params(sets)))
    return rated, states_after(rated, star)


def params_table(spark: SparkSession, named: dict[str, Params]) -> DataFrame:
    return spark.createDataFrame([{"name": n} | {k: v for k, v in p.row(0).items() if k != "candidate"} for n, p in named.items()], "name string, " + CANDIDATE.split(", ", 1)[1])
