"""Queries of the rating engine and of score strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from topspin.functions import domain, scores
from topspin.operators import identity, matches, rating, search
from topspin.plans.registry import query
from topspin.plans.relational import star
from topspin.sources import store
from topspin.sources.sinks import durable
from topspin.sources.store import WITH

#: Sets of the stand-in scores as lists of games, in the oracle's dialect.
_SETS = WITH + """, sc AS (SELECT id, player_a_id, player_b_id, winner_id, status, score, list_filter(string_split(score, ' '), lambda t: regexp_matches(t, '^[0-9]+-[0-9]+')) AS toks FROM m),
    ga AS (SELECT *, list_transform(toks, lambda t: CAST(regexp_extract(t, '^([0-9]+)-([0-9]+)', 1) AS INTEGER)) AS a, list_transform(toks, lambda t: CAST(regexp_extract(t, '^([0-9]+)-([0-9]+)', 2) AS INTEGER)) AS b FROM sc WHERE score IS NOT NULL),
    gw AS (SELECT *, len(list_filter(toks, lambda t: CAST(regexp_extract(t, '^([0-9]+)-([0-9]+)', 1) AS INTEGER) > CAST(regexp_extract(t, '^([0-9]+)-([0-9]+)', 2) AS INTEGER))) AS wa,
    len(list_filter(toks, lambda t: CAST(regexp_extract(t, '^([0-9]+)-([0-9]+)', 1) AS INTEGER) < CAST(regexp_extract(t, '^([0-9]+)-([0-9]+)', 2) AS INTEGER))) AS wb, coalesce(list_sum(a), 0) AS ta, coalesce(list_sum(b), 0) AS tb FROM ga)"""
_TOLD = "CASE WHEN score = 'W/O' THEN 'A' WHEN wa >= 2 AND wa > wb THEN 'A' WHEN wb >= 2 AND wb > wa THEN 'B' WHEN score LIKE '%RET' THEN CASE WHEN wa > wb THEN 'A' WHEN wb > wa THEN 'B' WHEN a[-1] > b[-1] THEN 'A' WHEN b[-1] > a[-1] THEN 'B' ELSE 'A' END END"


@query(_SETS + f" SELECT id, CAST(len(toks) AS INTEGER) AS n_sets, CAST(ta AS INTEGER) AS games_a, CAST(tb AS INTEGER) AS games_b, {_TOLD} AS winner, CASE WHEN score = 'W/O' THEN 'walkover' WHEN score LIKE '%RET' THEN 'retired' ELSE 'completed' END AS status FROM gw")
def parsed_scores(spark, sf_dir):
    parsed = scores.parse_score(F.col("score"))
    rows = store.matches(spark, sf_dir).where("score IS NOT NULL").select("id", parsed.alias("p"))
    return rows.select("id", F.size("p.sets").alias("n_sets"), scores.games(F.col("p.sets"), True).alias("games_a"), scores.games(F.col("p.sets"), False).alias("games_b"), "p.winner", "p.status")


@query(_SETS + " SELECT id, CASE WHEN score = 'W/O' OR ta + tb = 0 THEN 1.0 ELSE CAST(round_even(CAST(0.85 + 0.3 * ((CASE WHEN winner_id = player_a_id THEN ta - tb ELSE tb - ta END) / CAST(ta + tb AS DOUBLE)) AS DECIMAL(20, 12)), 4) AS DOUBLE) END AS margin FROM gw")
def margin_multipliers(spark, sf_dir):
    parsed = scores.parse_score(F.col("score"))
    rows = store.matches(spark, sf_dir).where("score IS NOT NULL").select("id", scores.to_structured(parsed).alias("s"), (F.col("winner_id") == F.col("player_a_id")).alias("won"))
    return rows.select("id", rating.margin(F.col("s"), F.coalesce("won", F.lit(False))).alias("margin"))


@query(_SETS + f" SELECT id, CASE WHEN {_TOLD} = 'A' THEN player_a_id ELSE player_b_id END AS winner_id FROM gw WHERE winner_id IS NOT NULL AND score <> 'W/O' AND {_TOLD} IS NOT NULL AND CASE WHEN {_TOLD} = 'A' THEN player_a_id ELSE player_b_id END <> winner_id")
def repaired_winners(spark, sf_dir):
    return identity.repaired_winners(store.matches(spark, sf_dir), scores.parse_score(F.col("score"))["winner"])


@query(_SETS + r""" SELECT id, score, CASE WHEN score = 'W/O' THEN 'W/O' ELSE array_to_string(list_transform(toks, lambda t: regexp_extract(t, '^([0-9]+)-', 1) || '-' || regexp_extract(t, '-([0-9]+)', 1) || coalesce(nullif(regexp_extract(t, '(\([0-9]+\))', 1), ''), '')), ' ')
    || CASE WHEN score LIKE '%RET' THEN ' RET' ELSE '' END END AS shown FROM sc WHERE score IS NOT NULL""")
def displayed_scores(spark, sf_dir):
    return store.matches(spark, sf_dir).where("score IS NOT NULL").select("id", "score", scores.display(scores.parse_score(F.col("score"))).alias("shown"))


_CODES = "CASE t_level WHEN 'Grand Slam' THEN 'G' WHEN 'WTA 1000' THEN 'M' WHEN 'ITF' THEN 'F' ELSE 'C' END"
_STAR = WITH + ", s AS (SELECT mt.*, tn.name AS t_name, tn.tour AS t_tour, tn.gender AS t_gender, tn.level AS t_level FROM mt LEFT JOIN ed ON mt.edition_id = ed.id LEFT JOIN tn ON ed.tournament_id = tn.id)"


@query(_STAR + f", c AS (SELECT id, CASE WHEN t_tour = 'WTA' OR t_level LIKE 'WTA%' THEN 'W' || {_CODES} ELSE {_CODES} END AS code FROM s) SELECT id, code, CASE right(code, 1) WHEN 'F' THEN 183.0 WHEN 'C' THEN 137.0 WHEN 'M' THEN 107.0 WHEN 'G' THEN 116.0 ELSE 108.0 END AS k, CASE right(code, 1) WHEN 'F' THEN 1241.0 WHEN 'C' THEN 1441.0 WHEN 'M' THEN 1809.0 WHEN 'G' THEN 1428.0 ELSE 1670.0 END AS s FROM c")
def level_constants(spark, sf_dir):
    rows = star(spark, sf_dir).select("id", domain.level_code(F.col("t_level"), F.col("t_tour")).alias("code"))
    return rows.select("id", "code", domain.k_factor(F.col("code")).alias("k"), domain.s_factor(F.col("code")).alias("s"))


_RATED = WITH + ", r AS (SELECT m.id, CAST(a.rating AS DOUBLE) AS ra, CAST(b.rating AS DOUBLE) AS rb, m.winner_id = m.player_a_id AS won FROM m JOIN st AS a ON a.player_id = player_a_id JOIN st AS b ON b.player_id = player_b_id WHERE winner_id IS NOT NULL)"


def _with_states(spark, sf_dir):
    side = lambda s: store.states(spark, sf_dir).select(F.col("player_id").alias(f"player_{s}_id"), F.col("rating").cast("double").alias(f"r{s}"))
    rows = store.matches(spark, sf_dir).where("winner_id IS NOT NULL")
    return rows.join(side("a"), "player_a_id").join(side("b"), "player_b_id").withColumn("won", F.col("winner_id") == F.col("player_a_id"))


@query(_RATED + " SELECT id, round(1 / (1 + pow(10, (rb - ra) / 1670)), 4) AS expected_a, round(108 * (CASE WHEN won THEN 1 ELSE 0 END - 1 / (1 + pow(10, (rb - ra) / 1670))), 1) AS change_a, (won AND ra < rb) OR (NOT won AND rb < ra) AS upset FROM r")
def single_updates(spark, sf_dir):
    u = rating.updated(F.col("ra"), F.col("rb"), F.col("won"), 108.0, 1670.0)
    rows = _with_states(spark, sf_dir).select("id", u.alias("u"), (108.0 * (F.col("won").cast("int") - rating.expected(F.col("ra"), F.col("rb"), 1670.0))).alias("d"))
    return rows.select("id", "u.expected_a", F.round("d", 1).alias("change_a"), "u.upset")


@query(WITH + " SELECT player_id, round(CASE WHEN d > 60 THEN 1500 + (rating - 1500) * exp(-0.05 * (d - 60) / 365) ELSE rating END, 3) AS rating, round(CASE WHEN match_count < 30 THEN 1 + 0.5 * (1 - match_count / 30.0) ELSE 1 END * CASE WHEN d > 180 THEN 1.3 ELSE 1 END, 6) AS boost, round(rating - 1670 * log10(0.4 / 0.6), 3) AS for_60 FROM (SELECT player_id, CAST(rating AS DOUBLE) AS rating, match_count, date_diff('day', last_match_date, DATE '2001-08-01') AS d FROM st)")
def decay_and_boost(spark, sf_dir):
    rows = store.states(spark, sf_dir).select("player_id", F.col("rating").cast("double").alias("rating"), "match_count", F.datediff(F.lit("2001-08-01").cast("date"), "last_match_date").alias("d"))
    return rows.select("player_id", F.round(rating.decayed(F.col("rating"), F.col("d")), 3).alias("rating"), F.round(rating.k_boost(F.col("match_count"), F.col("d")), 6).alias("boost"), F.round(rating.rating_for_probability(F.lit(0.6), F.col("rating"), 1670.0), 3).alias("for_60"))


@query(WITH + " SELECT m.id, a.rating AS elo_pre_player_a, b.rating AS elo_pre_player_b FROM m LEFT JOIN st AS a ON a.player_id = player_a_id AND a.player_id % 5 <> 0 LEFT JOIN st AS b ON b.player_id = player_b_id AND b.player_id % 5 <> 0 WHERE status IN ('upcoming', 'scheduled') AND winner_id IS NULL AND (player_a_id % 7 = 0 OR player_b_id % 7 = 0)")
def refreshed_snapshots(spark, sf_dir):
    states = store.states(spark, sf_dir).where("player_id % 5 <> 0")
    touched = store.players(spark, sf_dir).where("id % 7 = 0").select(F.col("id").alias("player_id"))
    return rating.refresh_snapshots(store.matches(spark, sf_dir), states, touched)


#: The fold as a recursion over the players' histories: ``r`` holds each player's rating after so many matches, and a match is rated once both
#: players' ratings before it are there. ``format`` rounds the exact binary value, as the fold does.
_DECAY = "CASE WHEN {0}.days > 60 THEN exp(-0.05 * ({0}.days - 60) / 365) ELSE 1.0 END"
_BOOST = "greatest(1.0, least(3.0, CASE WHEN {0}.n < 30 THEN 1 + 0.5 * (1 - {0}.n / 30.0::DOUBLE) ELSE 1.0 END * CASE WHEN {0}.days > 180 THEN 1.3 ELSE 1.0 END))"
_FOLD = _SETS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT mt.*, tn.tour AS t_tour, tn.level AS t_level FROM mt LEFT JOIN ed ON mt.edition_id = ed.id LEFT JOIN tn ON ed.tournament_id = tn.id),
    mg AS (SELECT id, CASE WHEN score = 'W/O' OR ta + tb = 0 THEN 1.0 ELSE CAST(round_even(CAST(0.85 + 0.3 * ((CASE WHEN winner_id = player_a_id THEN ta - tb ELSE tb - ta END) / CAST(ta + tb AS DOUBLE)) AS DECIMAL(20, 12)), 4) AS DOUBLE) END AS margin FROM gw),
    f AS (SELECT s.id, t, player_a_id AS a, player_b_id AS b, match_date, coalesce(winner_id = player_a_id, false) AS won, coalesce(margin, 1.0) * CASE {_CODES} WHEN 'F' THEN 183.0 WHEN 'C' THEN 137.0 WHEN 'M' THEN 107.0 ELSE 116.0 END::DOUBLE AS k,
    CASE {_CODES} WHEN 'F' THEN 1241.0 WHEN 'C' THEN 1441.0 WHEN 'M' THEN 1809.0 ELSE 1428.0 END::DOUBLE AS s FROM s LEFT JOIN mg ON mg.id = s.id WHERE status IN ('completed', 'retired')),
    e AS (SELECT id, t, match_date, a AS pl, 0 AS side FROM f UNION ALL SELECT id, t, match_date, b, 1 FROM f),
    w AS (SELECT id, side, pl, row_number() OVER (PARTITION BY pl ORDER BY t, id) - 1 AS n, date_diff('day', last_value(match_date IGNORE NULLS) OVER (PARTITION BY pl ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), match_date) AS days FROM e),
    x AS (SELECT f.id, t, a, b, match_date, won::INTEGER AS won, s, wa.n AS na, wb.n AS nb, {_DECAY.format("wa")} AS da, {_DECAY.format("wb")} AS db, k * {_BOOST.format("wa")} AS ka, k * {_BOOST.format("wb")} AS kb FROM f JOIN w AS wa ON wa.id = f.id AND wa.side = 0 JOIN w AS wb ON wb.id = f.id AND wb.side = 1),
    r(pl, n, pre, post, p) USING KEY (pl, n) AS (SELECT DISTINCT pl, 0::BIGINT, NULL::DOUBLE, 1500.0::DOUBLE, NULL::DOUBLE FROM e UNION SELECT u.pl, u.n, format('{{:.2f}}', u.pre)::DOUBLE, format('{{:.2f}}', u.post)::DOUBLE, u.p FROM (
    SELECT unnest([{{'pl': a, 'n': na + 1, 'pre': ea, 'post': ea + ka * (won - p), 'p': p}}, {{'pl': b, 'n': nb + 1, 'pre': eb, 'post': eb + kb * (p - won), 'p': p}}]) AS u FROM (SELECT *, 1 / (1 + pow(10.0, (eb - ea) / s)) AS p FROM (
    SELECT x.*, 1500 + (ra.post - 1500) * da AS ea, 1500 + (rb.post - 1500) * db AS eb FROM x JOIN recurring.r AS ra ON ra.pl = x.a AND ra.n = x.na JOIN recurring.r AS rb ON rb.pl = x.b AND rb.n = x.nb LEFT JOIN recurring.r AS q ON q.pl = x.a AND q.n = x.na + 1 WHERE q.pl IS NULL)))),
    o AS (SELECT x.id, t, match_date, a, b, ra.pre AS pre_a, rb.pre AS pre_b, ra.post AS post_a, rb.post AS post_b, round(CASE WHEN won = 1 THEN ra.p ELSE 1 - ra.p END, 6) AS p_winner FROM x JOIN r AS ra ON ra.pl = a AND ra.n = na + 1 JOIN r AS rb ON rb.pl = b AND rb.n = nb + 1),
    h AS (SELECT a AS player_id, id, t, match_date, post_a AS post FROM o UNION ALL SELECT b, id, t, match_date, post_b FROM o)"""


@query(_FOLD + " SELECT id, pre_a, pre_b, post_a, post_b, p_winner FROM o")
def rating_rebuild(spark, sf_dir):
    """The production fold over all finished matches."""
    return rating.rebuild(star(spark, sf_dir)).select("id", "pre_a", "pre_b", "post_a", "post_b", F.round("p_winner", 6).alias("p_winner"))


@query(_FOLD + " SELECT player_id, arg_max(post, (t, id)) AS rating, count(*) AS match_count, arg_max(match_date, (t, id)) FILTER (match_date IS NOT NULL) AS last_match_date, max(t) AS last_temporal_order, max(post) AS career_peak FROM h GROUP BY player_id")
def rebuilt_states(spark, sf_dir):
    """States after a search's parameter set has taken the place of another."""
    at = lambda t: F.lit(t).cast("timestamp")
    old = spark.range(1).select(F.lit("old").alias("name"), F.lit('{"margin_base": 0.6}').alias("params"), F.lit(True).alias("is_active"), at("2024-01-01").alias("created_at"))
    sets = rating.activated(old, "found", rating.Params(), 0.66, 0.65, at("2024-02-01"))
    return rating.rebuilt_after_activation(star(spark, sf_dir), sets)[1]


@query(_FOLD + " SELECT player_id, arg_max(post, (t, id)) AS rating, count(*) AS match_count, arg_max(match_date, (t, id)) FILTER (match_date IS NOT NULL) AS last_match_date, max(t) AS last_temporal_order, max(post) AS career_peak FROM h GROUP BY player_id")
def rating_states(spark, sf_dir):
    rows = star(spark, sf_dir)
    return rating.states_after(rating.rebuild(rows), rows)


@query(_FOLD + " SELECT id, pre_a, pre_b, post_a, post_b FROM o")
def rating_incremental(spark, sf_dir):
    """Everything but the last hundredth in time as a first run, the rest and some late matches as a second."""
    rows = star(spark, sf_dir)
    early = (F.col("id") % 100 != 0) & (F.col("match_date") < F.lit("2001-06-01").cast("date"))
    first = durable(rating.rebuild(rows.where(early)))
    rated, _ = rating.update_ratings(rows, first, durable(rating.states_after(first, rows)))
    return rated.select("id", "pre_a", "pre_b", "post_a", "post_b")


@query(_FOLD + " SELECT id, pre_a, pre_b, post_a, post_b FROM o")
def rating_by_ids(spark, sf_dir):
    """The matches of the last months by their ids, from the states of a first run, without a look back."""
    rows = star(spark, sf_dir)
    late = F.col("match_date").isNull() | (F.col("match_date") >= F.lit("2001-06-01").cast("date"))
    first = durable(rating.rebuild(rows.where(~late)))
    rated, _ = rating.update_ratings(rows, first, durable(rating.states_after(first, rows)), ids=rows.where(late).select("id"))
    return rated.select("id", "pre_a", "pre_b", "post_a", "post_b")


@query(_FOLD + " SELECT p.id AS player_id, 199801010000000 AS as_of, arg_max(post, (t, h.id)) AS rating FROM p LEFT JOIN h ON h.player_id = p.id AND t < 199801010000000 GROUP BY p.id")
def rating_as_of(spark, sf_dir):
    rows = star(spark, sf_dir)
    points = store.players(spark, sf_dir).select(F.col("id").alias("player_id"), F.lit(199801010000000).alias("as_of"))
    return rating.rating_as_of(rating.rebuild(rows), rows, points)


@query(WITH + ", r AS (SELECT *, row_number() OVER (ORDER BY t, id) AS place, count(*) OVER () AS n FROM mt WHERE status IN ('completed', 'retired')) SELECT id, CASE WHEN place <= CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN place <= CAST(floor(n * (0.7 + 0.15)) AS BIGINT) THEN 'validation' ELSE 'test' END AS part FROM r")
def chronological_parts(spark, sf_dir):
    rows = matches.with_order(store.matches(spark, sf_dir)).where(F.col("status").isin("completed", "retired"))
    return rating.chronological_split(rows).select("id", "part")


@query()
def candidate_losses(spark, sf_dir):
    rows = star(spark, sf_dir)
    parts = rating.chronological_split(rows.where(F.col("status").isin("completed", "retired")))
    return rating.evaluate(rows, [rating.Params(), *rating.propose(3)], parts)


@query()
def parameter_search(spark, sf_dir):
    """Trials of a short search by Parzen estimators, with their validation losses."""
    rows = star(spark, sf_dir)
    parts = rating.chronological_split(rows.where(F.col("status").isin("completed", "retired")))
    return search.parzen_search(rows, durable(parts), trials=(8, 4, 4), batch=4, finalists=1)[2]


@query(_RATED + " SELECT round(-avg(ln(greatest(1e-7, least(1 - 1e-7, CASE WHEN won THEN 1 / (1 + pow(10, (rb - ra) / 1670)) ELSE 1 - 1 / (1 + pow(10, (rb - ra) / 1670)) END)))), 8) AS log_loss FROM r")
def log_loss(spark, sf_dir):
    p = rating.expected(F.col("ra"), F.col("rb"), 1670.0)
    return _with_states(spark, sf_dir).agg(F.round(rating.log_loss(F.when(F.col("won"), p).otherwise(1 - p)), 8).alias("log_loss"))
