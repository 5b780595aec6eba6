"""Queries over the match store: filters, joins, leaderboards, pages, table changes and ingestion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topspin.functions import domain, names
from topspin.operators import identity, ingest, matches, rankings, tables
from topspin.plans.registry import query
from topspin.sources import store
from topspin.sources.sinks import durable
from topspin.sources.store import WITH

TODAY = dt.date(2001, 8, 1)
STAR = WITH + ", s AS (SELECT mt.*, ed.tournament_id, ed.year, ed.surface AS ed_surface, tn.name AS t_name, tn.tour AS t_tour, tn.gender AS t_gender, tn.level AS t_level, tn.surface AS t_surface FROM mt LEFT JOIN ed ON mt.edition_id = ed.id LEFT JOIN tn ON ed.tournament_id = tn.id)"
GENDERS = STAR + ", u AS (SELECT player_a_id AS player_id, t_gender FROM s UNION ALL SELECT player_b_id, t_gender FROM s), g AS (SELECT player_id, count(*) FILTER (t_gender = 'men') AS men, count(*) FILTER (t_gender = 'women') AS women FROM u GROUP BY player_id)"


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.star(matches.with_order(store.matches(spark, sf_dir)), store.editions(spark, sf_dir), store.tournaments(spark, sf_dir))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias for each player out of both of the players' and suppliers' names."""
    own = store.players(spark, sf_dir).select(F.col("id").alias("player_id"), F.lower("name").alias("alias"), F.lit("atp").alias("source"))
    other = store.raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.lower("s_name").alias("alias"), F.lit("wta").alias("source"))
    return own.unionByName(other)


ALIASES = "al AS (SELECT id AS player_id, lower(name) AS alias, 'atp' AS source FROM p UNION ALL SELECT s_suppkey, lower(s_name), 'wta' FROM supplier)"


@query(GENDERS + """ SELECT st.player_id, p.name, p.nationality, st.rating, CAST(trunc(st.rating) AS INTEGER) AS shown_rating, st.match_count,
    row_number() OVER (ORDER BY st.rating DESC, p.name) AS rank FROM st JOIN g ON g.player_id = st.player_id AND g.men > g.women JOIN p ON p.id = st.player_id
    WHERE st.last_match_date >= DATE '2001-08-01' - 183 QUALIFY rank <= 50""")
def leaderboard_page(spark, sf_dir):
    genders = rankings.majority(rankings.gender_counts(star(spark, sf_dir)))
    board = rankings.leaderboard(store.states(spark, sf_dir), store.players(spark, sf_dir), genders, "men", TODAY)
    return rankings.top_ranked(board, 50)


@query(GENDERS + """, h AS (SELECT player_id, CASE WHEN men > women THEN 'men' WHEN women > men THEN 'women' END AS gender FROM g)
    SELECT gender, row_number() OVER (PARTITION BY gender ORDER BY rating DESC, name) AS rank, st.player_id, p.name, rating
    FROM st JOIN h ON h.player_id = st.player_id JOIN p ON p.id = st.player_id WHERE gender IS NOT NULL QUALIFY rank <= 20""")
def ranked_by_gender(spark, sf_dir):
    genders = rankings.majority(rankings.gender_counts(star(spark, sf_dir)))
    return rankings.ranked_by_gender(store.states(spark, sf_dir), store.players(spark, sf_dir), genders, 20)


@query(GENDERS + " SELECT player_id, men, women, CASE WHEN men > women THEN 'men' WHEN women > men THEN 'women' ELSE 'mixed' END AS gender FROM g")
def inferred_genders(spark, sf_dir):
    counts = rankings.gender_counts(star(spark, sf_dir))
    return counts.join(identity.infer_gender(counts), "player_id")


@query(WITH + " SELECT (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM p) AS players, (SELECT count(*) FROM ed) AS editions")
def store_counts(spark, sf_dir):
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1))
    a, b, c = one(store.matches(spark, sf_dir), "matches"), one(store.players(spark, sf_dir), "players"), one(store.editions(spark, sf_dir), "editions")
    return a.join(b, "k").join(c, "k").drop("k")


_SHOW = "id, player_a_id, player_b_id, round, status, match_date, t_name"


def _shown(rows):
    return rows.select("id", "player_a_id", "player_b_id", "round", "status", "match_date", "t_name")


def _filter_query(name: str, wanted: matches.MatchFilter, condition: str) -> None:
    def run(spark, sf_dir):
        return _shown(matches.filter_matches(star(spark, sf_dir), wanted, store.players(spark, sf_dir)))

    run.__name__ = name
    query(f"{STAR} SELECT {_SHOW} FROM s WHERE {condition}")(run)


_M = matches.MatchFilter
_filter_query("filter_statuses", _M(statuses=[" Completed", "unknown", "retired"]), "status IN ('completed', 'retired')")
_filter_query("filter_status_group", _M(statuses=["pending"]), "status IN ('upcoming', 'scheduled')")
_filter_query("filter_tours", _M(tours=["WTA_125", "ITF"]), "t_tour IN ('WTA 125', 'WTA_125', 'ITF')")
_filter_query("filter_genders", _M(genders=["women", "x"]), "t_gender = 'women'")
_filter_query("filter_surfaces", _M(surfaces=["Clay", "Grass"]), "ed_surface IN ('Clay', 'Grass') OR (ed_surface IS NULL AND t_surface IN ('Clay', 'Grass'))")
_filter_query("filter_levels_rounds", _M(levels=["Grand Slam", "ITF"], rounds=["QF", "SF"]), "t_level IN ('Grand Slam', 'ITF') AND round IN ('QF', 'SF')")
_filter_query("filter_head_to_head", _M(head_to_head=(3, 22)), "(player_a_id = 3 AND player_b_id = 22) OR (player_a_id = 22 AND player_b_id = 3)")
@query(STAR + """, x AS (SELECT id, player_a_id % 40 AS player_a_id, player_b_id % 40 AS player_b_id, round, status, match_date, t_name FROM s) SELECT * FROM x WHERE (player_a_id = 3 AND player_b_id = 22) OR (player_a_id = 22 AND player_b_id = 3)""")
def head_to_head_meetings(spark, sf_dir):
    """Two of forty players, who meet often."""
    rows = star(spark, sf_dir).withColumns({c: F.col(c) % 40 for c in ("player_a_id", "player_b_id")})
    return _shown(matches.filter_matches(rows, _M(head_to_head=(3, 22))))


_filter_query("filter_player", _M(player_id=7, player_name="ignored"), "player_a_id = 7 OR player_b_id = 7")
_filter_query("filter_player_name", _M(player_name="0_11"), "player_a_id IN (SELECT id FROM p WHERE name ILIKE '%0_11%') OR player_b_id IN (SELECT id FROM p WHERE name ILIKE '%0_11%')")
_filter_query("filter_tournament", _M(tournament="ameri"), "t_name ILIKE '%ameri%'")
_filter_query("filter_preset_year", _M(preset="1997"), "match_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
_filter_query("filter_preset_ytd", _M(preset="ytd", start="broken"), "match_date BETWEEN DATE '2001-01-01' AND DATE '2001-08-01'")
_filter_query("filter_dates", _M(preset="90d", start="1996-02-01", end="1996-05-31"), "match_date BETWEEN DATE '1996-02-01' AND DATE '1996-05-31'")


@query(STAR + f" SELECT {_SHOW} FROM s WHERE status IN ('completed', 'retired', 'walkover', 'default') ORDER BY match_date DESC NULLS LAST, t DESC NULLS LAST, id DESC LIMIT 25 OFFSET 25")
def match_page(spark, sf_dir):
    return _shown(matches.page(matches.filter_matches(star(spark, sf_dir), _M(statuses=["historical_default"])), matches.newest_first(), 25, 2))


_HOME = "(t_level = 'Grand Slam' OR t_tour IN ('ATP', 'WTA') OR (t_tour IN ('CHALLENGER', 'WTA 125') AND round IN ('SF', 'F')) OR (t_tour = 'ITF' AND round = 'F'))"


@query(STAR + f" SELECT {_SHOW} FROM s WHERE status IN ('upcoming', 'scheduled') AND {_HOME} ORDER BY coalesce(scheduled_date, match_date) ASC NULLS LAST, id LIMIT 10")
def home_upcoming(spark, sf_dir):
    return _shown(matches.upcoming(star(spark, sf_dir)))


@query(STAR + f" SELECT {_SHOW} FROM s WHERE status IN ('completed', 'retired', 'walkover', 'default') AND {_HOME} ORDER BY coalesce(match_date, scheduled_date) DESC NULLS LAST, id DESC LIMIT 10")
def home_latest(spark, sf_dir):
    return _shown(matches.latest(star(spark, sf_dir)))


@query(STAR + f" SELECT {_SHOW} FROM s WHERE {_HOME}")
def home_scope(spark, sf_dir):
    return _shown(star(spark, sf_dir).where(matches.home_scope()))


@query(STAR + """ SELECT s.id, coalesce(a.name, 'Unknown') AS player_a, coalesce(b.name, 'Unknown') AS player_b, coalesce(nullif(ed_surface, ''), t_surface) AS surface, round, status, score,
    regexp_replace(score, '(^| )([0-9]+)-([0-9]+)', '\\1\\3-\\2', 'g') AS flipped_score, strftime(coalesce(match_date, scheduled_date), '%d %b %Y') AS display_date,
    CAST(coalesce(year(coalesce(match_date, scheduled_date)), s.year) AS INTEGER) AS year, CASE WHEN winner_id = player_a_id THEN 'A' WHEN winner_id = player_b_id THEN 'B' END AS winner
    FROM s LEFT JOIN p AS a ON a.id = player_a_id LEFT JOIN p AS b ON b.id = player_b_id""")
def serialized_matches(spark, sf_dir):
    return matches.serialize(star(spark, sf_dir), store.players(spark, sf_dir))


@query()
def swapped_display(spark, sf_dir):
    rows = matches.with_order(store.matches(spark, sf_dir))
    return rows.select("id", matches.shown_swapped(F.col("id"), F.col("temporal_order")).alias("swapped"))


@query(WITH + " SELECT id, status IN ('completed', 'retired', 'walkover', 'default') AS is_completed, status = 'upcoming' AS is_upcoming, status = 'scheduled' AS is_scheduled, status IN ('upcoming', 'scheduled') AS is_pending FROM m")
def lifecycle_flags(spark, sf_dir):
    return matches.lifecycle(store.matches(spark, sf_dir)).select("id", "is_completed", "is_upcoming", "is_scheduled", "is_pending")


@query(WITH + f", {ALIASES}, f AS (SELECT id, name FROM p WHERE name ILIKE '%00012%' UNION SELECT p.id, p.name FROM al JOIN p ON p.id = al.player_id WHERE alias ILIKE '%00012%') SELECT id, name FROM f ORDER BY lower(name), id LIMIT 10")
def player_search(spark, sf_dir):
    return rankings.search_players(store.players(spark, sf_dir), aliases(spark, sf_dir), "00012")


@query(WITH + f""", {ALIASES}, n AS (SELECT player_id, count(*) AS aliases FROM al GROUP BY player_id), u AS (SELECT player_a_id AS id FROM m UNION ALL SELECT player_b_id FROM m),
    c AS (SELECT id, count(*) AS matches FROM u GROUP BY id) SELECT p.id, p.name, coalesce(n.aliases, 0) AS aliases, coalesce(c.matches, 0) AS matches, CAST(trunc(st.rating) AS INTEGER) AS rating
    FROM p LEFT JOIN n ON n.player_id = p.id LEFT JOIN c ON c.id = p.id LEFT JOIN st ON st.player_id = p.id""")
def player_details(spark, sf_dir):
    return rankings.player_details(store.players(spark, sf_dir), aliases(spark, sf_dir), store.matches(spark, sf_dir), store.states(spark, sf_dir))


@query(WITH + ", u AS (SELECT player_a_id AS player_id FROM m UNION ALL SELECT player_b_id FROM m UNION ALL SELECT winner_id FROM m WHERE winner_id IS NOT NULL) SELECT player_id, count(*) AS n FROM u GROUP BY player_id")
def weighted_match_counts(spark, sf_dir):
    return rankings.weighted_match_counts(store.matches(spark, sf_dir))


@query(WITH + ", u AS (SELECT player_a_id AS player_id, status FROM m UNION ALL SELECT player_b_id, status FROM m) SELECT player_id, count(*) AS n FROM u WHERE status IN ('completed', 'retired') GROUP BY player_id")
def finished_match_counts(spark, sf_dir):
    return rankings.status_match_counts(store.matches(spark, sf_dir), ("completed", "retired"))


@query(WITH + " SELECT round, count(*) AS n FROM m GROUP BY round")
def round_histogram(spark, sf_dir):
    return ingest.round_histogram(store.matches(spark, sf_dir)).select("round", "n")


# Sides, orders and dates


@query(WITH + " SELECT id, player_a_id AS player_id, player_b_id AS opponent_id, 'A' AS side FROM m UNION ALL SELECT id, player_b_id, player_a_id, 'B' FROM m")
def match_sides(spark, sf_dir):
    return matches.sides(store.matches(spark, sf_dir), "id")


@query(WITH + " SELECT id, t AS temporal_order, match_date AS decoded FROM mt")
def temporal_orders(spark, sf_dir):
    return matches.with_order(store.matches(spark, sf_dir)).select("id", "temporal_order", domain.order_date(F.col("temporal_order")).alias("decoded"))


_DATED = WITH + """, d AS (SELECT m.*, ed.start_date, ed.start_date + 13 AS end_date, max(match_date) OVER (PARTITION BY edition_id, round) AS sibling,
    CASE round WHEN 'F' THEN 1.0 WHEN 'SF' THEN 0.85 WHEN 'QF' THEN 0.7 WHEN 'R16' THEN 0.55 WHEN 'R32' THEN 0.4 WHEN 'R64' THEN 0.25 ELSE 0.15 END AS progress FROM m JOIN ed ON ed.id = edition_id)"""


@query(_DATED + " SELECT id, coalesce(match_date, scheduled_date, sibling, start_date + CAST(trunc(13 * progress) AS INTEGER)) AS effective_date, start_date + CAST(trunc(13 * progress) AS INTEGER) AS estimate FROM d")
def effective_dates(spark, sf_dir):
    ed = store.editions(spark, sf_dir).select(F.col("id").alias("edition_id"), "start_date", F.date_add("start_date", 13).alias("end_date"))
    rows = ingest.fill_dates(store.matches(spark, sf_dir).join(ed, "edition_id"))
    return rows.select("id", "effective_date", domain.round_date(F.col("start_date"), F.col("end_date"), F.col("round")).alias("estimate"))


@query(WITH + " SELECT id, edition_id, round, max(match_date) OVER (PARTITION BY edition_id, round) AS sibling_date FROM m")
def sibling_dates(spark, sf_dir):
    return ingest.sibling_dates(store.matches(spark, sf_dir)).select("id", "edition_id", "round", "sibling_date")


@query(WITH + """, u AS (SELECT id, t, player_a_id AS player_id, match_date FROM mt WHERE match_date IS NOT NULL UNION ALL SELECT id, t, player_b_id, match_date FROM mt WHERE match_date IS NOT NULL)
    SELECT id, player_id, row_number() OVER w - 1 AS played, CAST(date_diff('day', lag(match_date) OVER w, match_date) AS INTEGER) AS days FROM u WINDOW w AS (PARTITION BY player_id ORDER BY t, id)""")
def player_timeline(spark, sf_dir):
    rows = matches.sides(matches.with_order(store.matches(spark, sf_dir)).where("match_date IS NOT NULL"), "id", "temporal_order", "match_date")
    w = Window.partitionBy("player_id").orderBy("temporal_order", "id")
    return rows.select("id", "player_id", (F.row_number().over(w) - 1).cast("long").alias("played"), F.datediff("match_date", F.lag("match_date").over(w)).alias("days"))


# Changes to tables

_NEW = "n AS (SELECT id AS player_id, CAST(2000 AS DECIMAL(8, 2)) AS rating, CAST(1 AS INTEGER) AS match_count, CAST(NULL AS DATE) AS last_match_date FROM p WHERE id % 3 = 0 UNION ALL SELECT -1, 1, 1, NULL)"


def _new_states(spark, sf_dir):
    rows = store.players(spark, sf_dir).where("id % 3 = 0").selectExpr("id AS player_id")
    extra = spark.range(1).selectExpr("-1L AS player_id")
    own = rows.selectExpr("player_id", "CAST(2000 AS DECIMAL(8, 2)) AS rating", "1 AS match_count", "CAST(NULL AS DATE) AS last_match_date")
    return own.unionByName(extra.selectExpr("player_id", "CAST(1 AS DECIMAL(8, 2)) AS rating", "1 AS match_count", "CAST(NULL AS DATE) AS last_match_date"))


@query(WITH + f", {_NEW} SELECT * FROM st WHERE player_id NOT IN (SELECT player_id FROM n) UNION ALL SELECT * FROM n")
def upsert_states(spark, sf_dir):
    return tables.upsert(store.states(spark, sf_dir), _new_states(spark, sf_dir), "player_id")


@query(WITH + f", {_NEW} SELECT st.player_id, coalesce(n.rating, st.rating) AS rating, st.match_count, CASE WHEN n.player_id IS NOT NULL THEN n.last_match_date ELSE st.last_match_date END AS last_match_date FROM st LEFT JOIN n ON n.player_id = st.player_id")
def bulk_update(spark, sf_dir):
    return tables.update(store.states(spark, sf_dir), _new_states(spark, sf_dir), "player_id", ["rating", "last_match_date"])


@query(WITH + " SELECT player_id, CASE WHEN match_count < 10 THEN NULL ELSE rating END AS rating, match_count, last_match_date FROM st")
def set_where(spark, sf_dir):
    return tables.set_where(store.states(spark, sf_dir), F.col("match_count") < 10, {"rating": F.lit(None).cast("decimal(8,2)")})


@query(WITH + " SELECT * FROM st WHERE NOT coalesce(last_match_date < DATE '2001-01-01', false)")
def delete_where(spark, sf_dir):
    return tables.delete_where(store.states(spark, sf_dir), F.col("last_match_date") < F.lit(dt.date(2001, 1, 1)))


@query(WITH + " SELECT id, CASE WHEN player_a_id % 10 = 9 THEN player_a_id - 1 ELSE player_a_id END AS player_a_id, CASE WHEN player_b_id % 10 = 9 THEN player_b_id - 1 ELSE player_b_id END AS player_b_id, CASE WHEN winner_id % 10 = 9 THEN winner_id - 1 ELSE winner_id END AS winner_id FROM m")
def remap_players(spark, sf_dir):
    redirects = store.players(spark, sf_dir).where("id % 10 = 9").selectExpr("id AS from_id", "id - 1 AS to_id")
    return tables.remap(store.matches(spark, sf_dir), redirects, ["player_a_id", "player_b_id", "winner_id"]).select("id", "player_a_id", "player_b_id", "winner_id")


@query(WITH + " SELECT * FROM m WHERE id IN (SELECT min(id) FROM m GROUP BY edition_id, round, draw_position)")
def dedupe_slots(spark, sf_dir):
    return tables.first_by(store.matches(spark, sf_dir), ["edition_id", "round", "draw_position"], [F.col("id")])


@query(WITH + " SELECT id, name, height_cm FROM p WHERE (height_cm IS NULL OR wta_id IS NULL) AND atp_id IS NOT NULL AND id > 100 ORDER BY id LIMIT 200")
def missing_profiles_page(spark, sf_dir):
    rows = store.players(spark, sf_dir).where(tables.any_missing(["height_cm", "wta_id"]) & F.col("atp_id").isNotNull())
    return tables.keyset_page(rows, "id", 100, 200).select("id", "name", "height_cm")


@query(WITH + " SELECT id, name, coalesce(height_cm, CASE WHEN id % 2 = 0 THEN 180 END) AS height_cm FROM p")
def fill_profiles(spark, sf_dir):
    found = store.players(spark, sf_dir).where("id % 2 = 0").selectExpr("id", "180 AS height_cm")
    return tables.fill_null(store.players(spark, sf_dir), found, "id", ["height_cm"]).select("id", "name", "height_cm")


@query()
def source_fingerprints(spark, sf_dir):
    return tables.fingerprint(store.matches(spark, sf_dir), ["edition_id", "round"], ["id", "player_a_id", "player_b_id", "score"])


# Ingestion

_RESULTS = "r AS (SELECT id, CASE WHEN id % 2 = 0 THEN external_id END AS external_id, edition_id, round, player_b_id AS player_a_id, player_a_id AS player_b_id, match_date, winner_id, score FROM m WHERE status IN ('completed', 'retired'))"


def _results(spark, sf_dir):
    rows = store.matches(spark, sf_dir).where(F.col("status").isin("completed", "retired"))
    return rows.select("id", F.when(F.col("id") % 2 == 0, F.col("external_id")).alias("external_id"), "edition_id", "round", F.col("player_b_id").alias("player_a_id"), F.col("player_a_id").alias("player_b_id"), "match_date", "winner_id", "score")


@query(WITH + f""", {_RESULTS}, k AS (SELECT edition_id, round, least(player_a_id, player_b_id) AS low, greatest(player_a_id, player_b_id) AS high, min(id) AS id FROM m GROUP BY ALL),
    x AS (SELECT external_id, min(id) AS id FROM m WHERE external_id IS NOT NULL GROUP BY external_id)
    SELECT r.id, coalesce(x.id, k.id) AS match_id FROM r LEFT JOIN x ON x.external_id = r.external_id
    LEFT JOIN k ON k.edition_id = r.edition_id AND k.round = r.round AND k.low = least(player_a_id, player_b_id) AND k.high = greatest(player_a_id, player_b_id)""")
def match_results(spark, sf_dir):
    return ingest.match_results(_results(spark, sf_dir), store.matches(spark, sf_dir)).select("id", "match_id")


@query(WITH + f", {_RESULTS}, k AS (SELECT *, coalesce(external_id, edition_id || '|' || round || '|' || least(player_a_id, player_b_id) || '|' || greatest(player_a_id, player_b_id) || '|' || coalesce(CAST(match_date AS VARCHAR), '')) AS key FROM r) SELECT min(id) AS id FROM k GROUP BY key")
def dedupe_results(spark, sf_dir):
    return ingest.dedupe_results(_results(spark, sf_dir), F.col("id")).select("id")


@query(WITH + """, o AS (SELECT *, CASE round WHEN 'R128' THEN 3 WHEN 'R64' THEN 4 WHEN 'R32' THEN 5 WHEN 'R16' THEN 7 WHEN 'QF' THEN 8 WHEN 'SF' THEN 9 ELSE 10 END AS place FROM m),
    f AS (SELECT edition_id, max(place) AS furthest FROM o WHERE status IN ('completed', 'retired') GROUP BY edition_id)
    SELECT o.id, o.edition_id, o.round FROM o JOIN f ON f.edition_id = o.edition_id WHERE status IN ('upcoming', 'scheduled') AND furthest - place > 2""")
def stale_pending(spark, sf_dir):
    return ingest.stale_pending(store.matches(spark, sf_dir))


@query(WITH + """, w AS (SELECT edition_id, CASE round WHEN 'R128' THEN 'R64' WHEN 'R64' THEN 'R32' WHEN 'R32' THEN 'R16' WHEN 'R16' THEN 'QF' WHEN 'QF' THEN 'SF' WHEN 'SF' THEN 'F' END AS nr,
    CAST(ceil(draw_position / 2.0) AS INTEGER) AS pos, draw_position % 2 = 1 AS odd, winner_id, id FROM m WHERE winner_id IS NOT NULL),
    q AS (SELECT edition_id, nr, pos, arg_max(CASE WHEN odd THEN winner_id END, CASE WHEN odd THEN id END) AS a, arg_max(CASE WHEN NOT odd THEN winner_id END, CASE WHEN NOT odd THEN id END) AS b FROM w WHERE nr IS NOT NULL GROUP BY edition_id, nr, pos)
    SELECT edition_id, nr AS round, pos AS draw_position, a AS player_a_id, b AS player_b_id FROM q WHERE a <> b AND NOT EXISTS (SELECT 1 FROM m WHERE m.edition_id = q.edition_id AND m.round = q.nr AND m.draw_position = q.pos)""")
def propagate_winners(spark, sf_dir):
    return ingest.propagate(store.matches(spark, sf_dir)).select("edition_id", "round", "draw_position", "player_a_id", "player_b_id")


@query(WITH + """ SELECT edition_id, round, count(draw_position) AS slots, count(DISTINCT draw_position) AS different,
    count(*) FILTER (draw_position < 1 OR draw_position > CASE round WHEN 'R128' THEN 64 WHEN 'R64' THEN 32 WHEN 'R32' THEN 16 WHEN 'R16' THEN 8 WHEN 'QF' THEN 4 WHEN 'SF' THEN 2 ELSE 1 END) AS out_of_range, true AS known_round FROM m GROUP BY edition_id, round""")
def validate_draws(spark, sf_dir):
    return ingest.validate_draw(store.matches(spark, sf_dir))


@query(WITH + """, e AS (SELECT id, edition_id, round, draw_position, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 < 3 THEN player_b_id ELSE player_a_id + 1 END AS a, CASE WHEN id % 6 < 3 THEN player_a_id ELSE player_b_id END AS b, id % 8 = 1 AS bye FROM m WHERE id % 4 <> 2),
    h AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY edition_id, round, draw_position ORDER BY CASE WHEN status IN ('upcoming', 'scheduled') THEN 0 WHEN status = 'cancelled' THEN 2 ELSE 1 END, id DESC) = 1)
    SELECT e.edition_id, e.round, e.draw_position, h.id AS match_id, CASE WHEN bye THEN 'bye' WHEN a IS NULL OR b IS NULL THEN 'undecided' WHEN h.id IS NULL THEN 'create'
    WHEN h.status IN ('completed', 'retired', 'walkover', 'default', 'cancelled') THEN 'preserve'
    WHEN (a = h.player_a_id AND b = h.player_b_id) OR (b = h.player_a_id AND a = h.player_b_id) THEN CASE WHEN h.external_id IS NULL THEN 'fill' ELSE 'keep' END ELSE 'replace' END AS action
    FROM e LEFT JOIN h ON h.edition_id = e.edition_id AND h.round = e.round AND h.draw_position = e.draw_position""")
def draw_actions(spark, sf_dir):
    stored = store.matches(spark, sf_dir)
    i = F.col("id") % 6
    entries = stored.where("id % 4 <> 2").select("edition_id", "round", "draw_position", F.when(i == 0, None).when(i < 3, F.col("player_b_id")).otherwise(F.col("player_a_id") + 1).alias("player_a_id"), F.when(i < 3, F.col("player_a_id")).otherwise(F.col("player_b_id")).alias("player_b_id"), (F.col("id") % 8 == 1).alias("is_bye"))
    return ingest.draw_actions(entries, stored)


@query(WITH + """, f AS (SELECT upper(external_id) AS x, max(scheduled_date + 1) AS d FROM m WHERE external_id IS NOT NULL GROUP BY 1)
    SELECT m.id, coalesce(f.d, m.scheduled_date) AS scheduled_date, 'Centre' AS court, CASE WHEN m.status = 'upcoming' AND coalesce(f.d, m.scheduled_date) IS DISTINCT FROM m.scheduled_date THEN 'scheduled' ELSE m.status END AS status
    FROM m JOIN f ON f.x = upper(m.external_id) WHERE m.status IN ('upcoming', 'scheduled')""")
def schedule_updates(spark, sf_dir):
    rows = store.matches(spark, sf_dir)
    fixtures = rows.where("external_id IS NOT NULL").select(F.lower("external_id").alias("external_id"), F.date_add("scheduled_date", 1).alias("scheduled_date"), F.lit("Centre").alias("court"))
    return ingest.schedule_updates(rows, fixtures)


_EVENTS = "e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN ts END AS start FROM events)"


@query(f"WITH {_EVENTS} SELECT event_id, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS kind FROM e")
def carried_forward(spark, sf_dir):
    rows = store.raw(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    return ingest.carried_forward(rows, "user_id", "event_id", "kind").select("event_id", "kind")


@query(f"""WITH {_EVENTS}, a AS (SELECT *, last_value(start IGNORE NULLS) OVER w AS anchor, count(start) OVER w AS run FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, anchor + INTERVAL 2 HOUR * (row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1) AS estimated FROM a""")
def followed_by_times(spark, sf_dir):
    rows = store.raw(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("start"))
    return ingest.followed_by(rows, "user_id", "event_id", "start").select("event_id", "estimated")


# The work queue: events stand for tasks

_QUEUE = """q AS (SELECT event_id AS id, event_type AS task_type, props AS task_params, CAST(1 + user_id % 10 AS INTEGER) AS priority, ts AS created_at,
    CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'completed' ELSE 'failed' END AS status, CAST(event_id % 4 AS INTEGER) AS attempts, CASE WHEN event_id % 2 = 0 THEN ts END AS next_retry_at FROM events)"""
_NOW = dt.datetime(2024, 1, 15)


def queue(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "retry", "in_progress", "completed", "failed")]), (F.col("event_id") % 5 + 1).cast("int"))
    return store.raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("task_type"), F.col("props").alias("task_params"), (1 + F.col("user_id") % 10).cast("int").alias("priority"), F.col("ts").alias("created_at"),
        status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("next_retry_at"),
    )


def _now():
    return F.lit(_NOW.isoformat(sep=" ")).cast("timestamp_ntz")


_READY = "status IN ('pending', 'retry') AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-15')"


@query(f"WITH {_QUEUE} SELECT id, task_type, priority FROM q WHERE {_READY} ORDER BY priority, created_at, id LIMIT 1")
def next_task(spark, sf_dir):
    return ingest.next_task(queue(spark, sf_dir), _now()).select("id", "task_type", "priority")


@query(f"WITH {_QUEUE} SELECT status, count(*) AS n, round(avg(attempts), 1) AS mean_attempts, count(*) FILTER ({_READY}) AS ready FROM q GROUP BY status")
def queue_report(spark, sf_dir):
    return ingest.queue_report(queue(spark, sf_dir), _now())


@query(f"WITH {_QUEUE} SELECT id, CASE WHEN id % 7 = 0 THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN id % 7 <> 0 THEN status WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'retry' END AS status, CASE WHEN id % 7 = 0 AND attempts + 1 < 3 THEN TIMESTAMP '2024-01-15' + INTERVAL 5 MINUTE * CAST(pow(2, attempts) AS INTEGER) ELSE next_retry_at END AS next_retry_at FROM q")
def failed_tasks(spark, sf_dir):
    rows = queue(spark, sf_dir)
    return ingest.failed(rows, rows.where("id % 7 = 0"), _now()).select("id", "attempts", "status", "next_retry_at")


@query(f"WITH {_QUEUE}, t AS (SELECT DISTINCT task_type, task_params FROM q WHERE id % 2 = 1) SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.task_type = t.task_type AND q.task_params = t.task_params AND status IN ('pending', 'retry', 'in_progress'))")
def enqueue_new(spark, sf_dir):
    rows = queue(spark, sf_dir)
    return ingest.enqueue(rows, rows.where("id % 2 = 1").select("task_type", "task_params"))


@query(f"""WITH {_QUEUE}, t AS (SELECT DISTINCT task_type, task_params || CASE WHEN id % 3 = 0 THEN CAST(id % 50 AS VARCHAR) ELSE '' END AS task_params FROM q WHERE id % 2 = 1)
    SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.task_type = t.task_type AND q.task_params = t.task_params AND status IN ('pending', 'retry', 'in_progress'))""")
def enqueued_tasks(spark, sf_dir):
    """A third of the tasks has parameters that no active one has; they come several times, and go in once."""
    rows = queue(spark, sf_dir)
    params = F.concat("task_params", F.when(F.col("id") % 3 == 0, (F.col("id") % 50).cast("string")).otherwise(""))
    return ingest.enqueue(rows, rows.where("id % 2 = 1").select("task_type", params.alias("task_params")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def json_path_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return store.raw(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (k >= 50)).select("event_id", k.alias("k"))


@query(WITH + ", x AS (SELECT DISTINCT tournament_id, year + 1 AS year FROM ed UNION SELECT tournament_id, year FROM ed) SELECT count(*) AS editions FROM x")
def editions_after_ingest(spark, sf_dir):
    ed = store.editions(spark, sf_dir)
    ed = tables.first_by(ed, ["tournament_id", "year"], [F.col("id")])
    return ingest.get_or_create_editions(ed, ed.select("tournament_id", (F.col("year") + 1).alias("year"))).agg(F.count("*").alias("editions"))


# Identity



@query("SELECT c_custkey AS from_id, c_custkey - c_custkey % 16 AS to_id FROM customer WHERE c_custkey % 16 <> 0")
def merge_chains(spark, sf_dir):
    redirects = store.players(spark, sf_dir).where("id % 16 <> 0").selectExpr("id AS merge_id", "id - 1 AS keep_id")
    return identity.merge_targets(redirects)


@query(GENDERS + """, b AS (SELECT player_id, CASE WHEN men >= women THEN 'women' ELSE 'men' END AS new_gender FROM g WHERE men > 0 AND women > 0)
    SELECT s.id, 'A' AS side, b.player_id, b.new_gender FROM s JOIN b ON b.player_id = s.player_a_id AND s.t_gender = b.new_gender UNION ALL
    SELECT s.id, 'B', b.player_id, b.new_gender FROM s JOIN b ON b.player_id = s.player_b_id AND s.t_gender = b.new_gender""")
def split_mixed(spark, sf_dir):
    rows = star(spark, sf_dir)
    return identity.split_mixed(rows, rankings.gender_counts(rows))


def _person_names(spark, sf_dir):
    """Two words out of a document for each document: names in four languages."""
    # the first two words of three letters or more, without a split of the whole text
    first, second = F.regexp_extract("text", r"\p{L}{3,}+", 0), F.regexp_extract("text", r"(?s)\p{L}{3,}+.*?(\p{L}{3,}+)", 1)
    rows = store.raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", first, F.substring(second, 1, 4)).alias("name"))
    return rows.withColumn("name", names.normalize_name(F.col("name")))


@query()
def duplicate_pairs(spark, sf_dir):
    return identity.duplicate_pairs(_person_names(spark, sf_dir))


@query()
def duplicate_suggestions(spark, sf_dir):
    return identity.suggestions(_person_names(spark, sf_dir))


@query("""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda x: length(x) > 2) AS w FROM documents), n AS (SELECT id, trim(strip_accents(lower(concat_ws(' ', w[1], substr(w[2], 1, 4))))) AS name FROM w),
    s AS (SELECT name, min(id) AS id FROM n GROUP BY name), t AS (SELECT id, unnest(string_split(name, ' ')) AS x FROM s),
    g AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3))) AS g FROM t WHERE x <> ''), c AS (SELECT id, count(*) AS n FROM g GROUP BY id),
    p AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS k FROM g AS a JOIN g AS b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
    SELECT left_id, right_id, k / CAST(x.n + y.n - k AS DOUBLE) AS similarity FROM p JOIN c AS x ON x.id = left_id JOIN c AS y ON y.id = right_id WHERE k / CAST(x.n + y.n - k AS DOUBLE) >= 0.6""")
def trigram_pairs(spark, sf_dir):
    rows = _person_names(spark, sf_dir).select("id", "name")
    spelt = rows.groupBy("name").agg(F.min("id").alias("id"))
    return identity.trigram_matches(spelt, spelt, 0.6).where("left_id < right_id")


@query()
def resolved_names(spark, sf_dir):
    rows = durable(_person_names(spark, sf_dir))
    known = rows.where("id % 2 = 0").select("id", "name", F.concat(F.lit("A"), F.col("id")).alias("atp_id"), F.lit(None).cast("string").alias("wta_id"))
    incoming = rows.where("id % 2 = 1").select("id", "name", F.lit("atp").alias("source_key"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("A"), F.col("id") - 1)).alias("external_id"), F.lit(None).cast("string").alias("gender"))
    own = known.select(F.col("id").alias("player_id"), F.col("name").alias("alias"), F.lit("atp").alias("source"))
    return identity.resolve(incoming, known, own)


