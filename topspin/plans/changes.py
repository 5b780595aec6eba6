"""Queries of the write side: review decisions, merges, draws, results, schedules, editions, the task queue, places, levels and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from topspin.functions import domain
from topspin.operators import bracket, geo, identity, ingest, matches, rankings, rating, tables
from topspin.plans.registry import query
from topspin.plans.relational import _QUEUE, _now, queue
from topspin.schema import ROUND_ORDER
from topspin.sources import store
from topspin.sources.sinks import durable
from topspin.sources.store import WITH

# Identity


def _review(spark, sf_dir):
    rows = store.players(spark, sf_dir)
    source = F.when(F.col("id") % 2 == 0, "atp").otherwise("wta")
    return rows.select("id", F.lower("name").alias("name"), source.alias("source"), F.concat(F.lit("X"), F.col("id")).alias("external_id"), F.lit("pending").alias("status"), F.lit(None).cast("long").alias("resolved_player_id"))


@query(WITH + " SELECT id, CASE id % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'new_player' WHEN 2 THEN 'ignored' ELSE 'pending' END AS status, CASE WHEN id % 4 = 0 THEN id + 1 END AS matched_to FROM p")
def reviewed_items(spark, sf_dir):
    items = _review(spark, sf_dir)
    i = F.col("id") % 4
    decisions = items.select("id", F.when(i == 0, "match").when(i == 1, "create").when(i == 2, "ignore").otherwise("match").alias("action"), F.when(i == 0, F.col("id") + 1).alias("player_id"))
    done, _, _ = identity.resolve_review(items, decisions, store.players(spark, sf_dir), identity.empty_aliases(spark))
    return done.select("id", "status", F.when(F.col("status") == "matched", F.col("resolved_player_id")).alias("matched_to"))


@query(WITH + " SELECT p.id, p.atp_id, coalesce(p.wta_id, CASE WHEN p.id % 4 = 2 THEN 'X' || CAST(p.id - 1 AS VARCHAR) END) AS wta_id FROM p UNION ALL SELECT NULL, 'created ' || CAST(count(*) AS VARCHAR), NULL FROM p WHERE id % 4 = 3")
def reviewed_players(spark, sf_dir):
    """Review items of the second source, matched to the next player or made anew."""
    items = _review(spark, sf_dir).where("source = 'wta'")
    decisions = items.select("id", F.when(F.col("id") % 4 == 1, "match").otherwise("create").alias("action"), F.when(F.col("id") % 4 == 1, F.col("id") + 1).alias("player_id"))
    old = store.players(spark, sf_dir)
    _, players, _ = identity.resolve_review(items, decisions, old, identity.empty_aliases(spark))
    made = players.join(old.select("id"), "id", "left_anti").agg(F.lit(None).cast("long").alias("id"), F.concat(F.lit("created "), F.count("*")).alias("atp_id"), F.lit(None).cast("string").alias("wta_id"))
    return players.join(old.select("id"), "id", "left_semi").select("id", "atp_id", "wta_id").unionByName(made)


@query(WITH + " SELECT id, coalesce(atp_id, 'T' || CAST(id AS VARCHAR)) AS atp_id, wta_id FROM p")
def cross_tour_ids(spark, sf_dir):
    found = store.players(spark, sf_dir).select("id", F.concat(F.lit("T"), F.col("id")).alias("atp_id"), F.lit(None).cast("string").alias("wta_id"))
    return identity.link_ids(store.players(spark, sf_dir), found.unionByName(found)).select("id", "atp_id", "wta_id")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS c, CASE o_orderkey % 2 WHEN 0 THEN 'men' ELSE 'women' END AS gender FROM orders),
    k AS (SELECT c_custkey AS c, CASE c_custkey % 6 WHEN 0 THEN 'men' WHEN 2 THEN 'women' END AS own FROM customer WHERE c_custkey % 2 = 0),
    f AS (SELECT r.*, k.c IS NOT NULL AND (own IS NULL OR own = gender) AS stored FROM r LEFT JOIN k ON k.c = r.c)
    SELECT id AS in_id, CASE WHEN stored THEN c END AS player_id, CASE WHEN NOT stored THEN min(id) FILTER (NOT stored) OVER (PARTITION BY c) END AS made_by,
           CASE WHEN NOT stored AND id = min(id) FILTER (NOT stored) OVER (PARTITION BY c) THEN 'created' ELSE 'matched' END AS status FROM f""")
def resolved_in_order(spark, sf_dir):
    """Records of players without similar names, half of whom are stored: who isn't, or is of another gender, is created by the first record and met by the others."""
    gender = F.when(F.col("id") % 6 == 0, "men").when(F.col("id") % 6 == 2, "women")
    known = store.players(spark, sf_dir).where("id % 2 = 0").select("id", F.concat(F.lit("x "), F.md5(F.col("id").cast("string"))).alias("name"), F.lit(None).cast("string").alias("atp_id"), F.lit(None).cast("string").alias("wta_id"))
    incoming = store.raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("x "), F.md5(F.col("o_custkey").cast("string"))).alias("name"), F.lit("atp").alias("source_key"), F.lit(None).cast("string").alias("external_id"), F.when(F.col("o_orderkey") % 2 == 0, "men").otherwise("women").alias("gender"))
    done = identity.resolve(incoming, known, identity.empty_aliases(spark), known.select(F.col("id").alias("player_id"), gender.alias("gender")))
    return done.select("in_id", F.when(F.col("made_by").isNull(), F.col("player_id")).alias("player_id"), "made_by", "status")


_MERGED = ", d AS (SELECT id AS merge_id, id - id % 10 AS keep_id FROM p WHERE id % 10 > 6 AND id - id % 10 IN (SELECT id FROM p))"


def _merges(spark, sf_dir):
    rows = store.players(spark, sf_dir)
    kept = rows.select(F.col("id").alias("keep_id"))
    return rows.where("id % 10 > 6").selectExpr("id AS merge_id", "id - id % 10 AS keep_id").join(kept, "keep_id", "left_semi")


@query(WITH + _MERGED + """, g AS (SELECT keep_id, arg_min(p.atp_id, p.id) FILTER (p.atp_id IS NOT NULL) AS atp_id, arg_min(p.wta_id, p.id) FILTER (p.wta_id IS NOT NULL) AS wta_id FROM d JOIN p ON p.id = merge_id GROUP BY keep_id)
    SELECT p.id, coalesce(p.atp_id, g.atp_id) AS atp_id, coalesce(p.wta_id, g.wta_id) AS wta_id, g.keep_id IS NOT NULL AS needs_recompute FROM p LEFT JOIN g ON g.keep_id = p.id WHERE p.id NOT IN (SELECT merge_id FROM d)""")
def merged_profiles(spark, sf_dir):
    players, _ = identity.merge_profiles(_merges(spark, sf_dir), store.players(spark, sf_dir))
    return players.select("id", "atp_id", "wta_id", "needs_recompute")


@query(WITH + _MERGED + " SELECT d.keep_id, d.merge_id, p.name AS merged_name FROM d JOIN p ON p.id = d.merge_id")
def merge_audit(spark, sf_dir):
    return identity.merge_profiles(_merges(spark, sf_dir), store.players(spark, sf_dir))[1]


@query(WITH + _MERGED + """, s AS (SELECT id, [id, id + 1, id + 2] AS l FROM p), e AS (SELECT id, unnest([1, 2, 3]) AS k, unnest(l) AS pid FROM s), u AS (SELECT e.id, k, coalesce(d.keep_id, pid) AS pid FROM e LEFT JOIN d ON d.merge_id = pid),
    f AS (SELECT id, pid, min(k) AS k FROM u GROUP BY id, pid) SELECT id, string_agg(CAST(pid AS VARCHAR), ' ' ORDER BY k) AS suggested FROM f GROUP BY id""")
def merged_queue(spark, sf_dir):
    items = _review(spark, sf_dir).withColumn("suggested", F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2))
    return identity.merge_queue(_merges(spark, sf_dir), items).select("id", F.array_join("suggested", " ").alias("suggested"))


@query(WITH + _MERGED + """, t AS (SELECT p.id, coalesce(d.keep_id, p.id) AS to_id FROM p LEFT JOIN d ON d.merge_id = p.id)
    SELECT m.id, a.to_id AS player_a_id, b.to_id AS player_b_id, w.to_id AS winner_id, m.id % 9 = 0 OR a.to_id IN (SELECT keep_id FROM d) OR b.to_id IN (SELECT keep_id FROM d) AS elo_needs_recompute
    FROM m LEFT JOIN t AS a ON a.id = player_a_id LEFT JOIN t AS b ON b.id = player_b_id LEFT JOIN t AS w ON w.id = winner_id""")
def merged_matches(spark, sf_dir):
    rows = store.matches(spark, sf_dir).select("id", "player_a_id", "player_b_id", "winner_id", (F.col("id") % 9 == 0).alias("elo_needs_recompute"))
    known = store.players(spark, sf_dir).select(F.lit(None).cast("long").alias("player_id"), F.col("name").alias("alias"), F.lit("x").alias("source")).limit(0)
    return identity.merge_players(_merges(spark, sf_dir), rows, known, store.states(spark, sf_dir))[0]


@query(WITH + _MERGED + """, x AS (SELECT id AS player_id, 'name ' || CAST(id // 10 AS VARCHAR) AS alias, CASE WHEN id % 2 = 0 THEN 'atp' ELSE 'wta' END AS source FROM p), y AS (SELECT coalesce(keep_id, player_id) AS player_id, alias, source FROM x LEFT JOIN d ON d.merge_id = x.player_id)
    SELECT min(player_id) AS player_id, alias, source FROM y GROUP BY alias, source""")
def merged_aliases(spark, sf_dir):
    """Aliases of merged players go to those who stay; of one alias and source the least player's stays."""
    known = store.players(spark, sf_dir).select(F.col("id").alias("player_id"), F.concat(F.lit("name "), F.floor(F.col("id") / 10).cast("string")).alias("alias"), F.when(F.col("id") % 2 == 0, "atp").otherwise("wta").alias("source"))
    return identity.merge_players(_merges(spark, sf_dir), store.matches(spark, sf_dir), known, store.states(spark, sf_dir))[1]


@query(WITH + _MERGED + " SELECT player_id FROM st WHERE player_id NOT IN (SELECT merge_id FROM d)")
def merged_states(spark, sf_dir):
    known = store.players(spark, sf_dir).select(F.lit(None).cast("long").alias("player_id"), F.col("name").alias("alias"), F.lit("x").alias("source")).limit(0)
    return identity.merge_players(_merges(spark, sf_dir), store.matches(spark, sf_dir), known, store.states(spark, sf_dir))[2].select("player_id")


_SIDES = """, z AS (SELECT m.*, tn.gender FROM m JOIN ed ON ed.id = edition_id JOIN tn ON tn.id = tournament_id), s AS (SELECT player_a_id AS pid, gender FROM z UNION ALL SELECT player_b_id, gender FROM z),
    c AS (SELECT pid, count(*) FILTER (gender = 'men') AS men, count(*) FILTER (gender = 'women') AS women FROM s GROUP BY pid), g AS (SELECT pid, CASE WHEN men >= women THEN 'women' ELSE 'men' END AS other FROM c WHERE men > 0 AND women > 0)"""


def _split_up(spark, sf_dir):
    rows = store.matches(spark, sf_dir)
    events = matches.star(rows, store.editions(spark, sf_dir), store.tournaments(spark, sf_dir))
    players = store.players(spark, sf_dir)
    return identity.apply_split(events, rankings.gender_counts(events), rows, players, identity.empty_aliases(spark), store.states(spark, sf_dir))


@query(WITH + _SIDES + """ SELECT z.id, CASE WHEN a.pid IS NULL THEN player_a_id END AS player_a_id, CASE WHEN b.pid IS NULL THEN player_b_id END AS player_b_id,
    CASE WHEN winner_id = player_a_id AND a.pid IS NOT NULL THEN 'a' WHEN winner_id = player_b_id AND b.pid IS NOT NULL THEN 'b' WHEN winner_id IS NOT NULL THEN 'old' END AS winner FROM z LEFT JOIN g AS a ON a.pid = player_a_id AND a.other = gender LEFT JOIN g AS b ON b.pid = player_b_id AND b.other = gender""")
def split_matches(spark, sf_dir):
    """Matches after players of two genders have been split; sides of new players are null, as their ids are hashes."""
    done = _split_up(spark, sf_dir)[0]
    old = store.players(spark, sf_dir).select(F.col("id").alias("_id"))
    for side in ("a", "b", "w"):
        column = "winner_id" if side == "w" else f"player_{side}_id"
        done = done.join(old.withColumnRenamed("_id", f"_{side}"), F.col(column) == F.col(f"_{side}"), "left")
    winner = F.when(F.col("winner_id").isNull(), None).when(F.col("_w").isNotNull(), "old").when(F.col("winner_id") == F.col("player_a_id"), "a").otherwise("b")
    return done.select("id", F.col("_a").alias("player_a_id"), F.col("_b").alias("player_b_id"), winner.alias("winner"))


@query(WITH + _SIDES + " SELECT upper(p.name[1]) || '. ' || upper(p.name[1]) || lower(substr(p.name, 2)) AS name, p.nationality, p.height_cm, g.other AS new_gender FROM g JOIN p ON p.id = g.pid")
def split_profiles(spark, sf_dir):
    """The players that splits have made: initial and last name, and what was known of the person."""
    _, players, aliases, _ = _split_up(spark, sf_dir)
    made = players.join(aliases.select(F.col("player_id").alias("id"), F.split("source", "_")[1].alias("new_gender")), "id")
    return made.where("atp_id IS NULL AND wta_id IS NULL").select("name", "nationality", "height_cm", "new_gender")


@query(WITH + " SELECT id, CASE id % 4 WHEN 0 THEN 'jonathan x' || CAST(id AS VARCHAR) WHEN 1 THEN 'j. x' || CAST(id AS VARCHAR) ELSE 'bo x' || CAST(id AS VARCHAR) END AS name FROM p")
def repaired_names(spark, sf_dir):
    """Abbreviated names with full aliases of which one fits best, and others that have none."""
    key = F.col("id").cast("string")
    players = store.players(spark, sf_dir).select("id", F.when(F.col("id") % 4 < 2, F.concat(F.lit("j. x"), key)).otherwise(F.concat(F.lit("bo x"), key)).alias("name"))
    forms = F.when(F.col("id") % 4 == 0, F.array(F.concat(F.lit("jon x"), key), F.concat(F.lit("jonathan x"), key), F.concat(F.lit("alexander x"), key), F.concat(F.lit("j. x"), key))).otherwise(F.array(F.concat(F.lit("other y"), key)))
    return identity.repaired_names(players, players.select(F.col("id").alias("player_id"), F.explode(forms).alias("alias")))


# Ingestion

_RANK = "CASE WHEN status IN ('upcoming', 'scheduled') THEN 0 WHEN status = 'cancelled' THEN 2 ELSE 1 END"
_SLOTS = f", h AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY edition_id, round, draw_position ORDER BY {_RANK}, id DESC) = 1)"
#: For each slot an entry: its players turned, others, a bye, with the external id of a later match, others with its own external id, with a result; and a slot that isn't stored.
_ENTRIES = _SLOTS + """, l AS (SELECT *, lead(external_id, 3) OVER (PARTITION BY edition_id ORDER BY id) AS later FROM m),
    e AS (SELECT h.edition_id, h.round, h.draw_position, CASE h.id % 6 WHEN 0 THEN h.player_b_id WHEN 1 THEN h.player_a_id + 1 WHEN 4 THEN h.player_a_id + 1 ELSE h.player_a_id END AS a,
            CASE h.id % 6 WHEN 0 THEN h.player_a_id WHEN 2 THEN NULL ELSE h.player_b_id END AS b, h.id % 6 = 2 AS bye,
            CASE h.id % 6 WHEN 3 THEN later WHEN 4 THEN h.external_id WHEN 1 THEN 'dup_' || CAST(h.id % 40 AS VARCHAR) ELSE 'new_' || CAST(h.id AS VARCHAR) END AS ext,
            CASE WHEN h.id % 6 = 5 THEN h.player_b_id END AS w, CASE WHEN h.id % 6 = 5 THEN '6-1 6-1' WHEN h.id % 6 = 4 THEN ' ' END AS score, h.id % 33 AS seed
          FROM h JOIN l ON l.id = h.id
          UNION ALL SELECT edition_id, round, draw_position + 1000, player_a_id, player_b_id, false, 'more_' || CAST(id AS VARCHAR), NULL, NULL, NULL FROM h)"""
_ROUND = "CASE round " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in ROUND_ORDER.items()) + " END"
_APPLIED = f"""{_ENTRIES}, x AS (SELECT edition_id, external_id AS ext, min(id) AS id FROM m WHERE external_id IS NOT NULL GROUP BY ALL),
    j AS (SELECT e.*, h.id AS sid, least(a, b) = least(h.player_a_id, h.player_b_id) AND greatest(a, b) = greatest(h.player_a_id, h.player_b_id) AS same, x.id AS xid, {_ROUND.replace('CASE round', 'CASE e.round')} AS place
          FROM e LEFT JOIN h ON h.edition_id = e.edition_id AND h.round = e.round AND h.draw_position = e.draw_position LEFT JOIN x ON x.edition_id = e.edition_id AND x.ext = e.ext
          WHERE NOT bye AND b IS NOT NULL AND (h.id IS NULL OR h.status IN ('upcoming', 'scheduled'))),
    r AS (SELECT *, CASE WHEN NOT same THEN sid END AS gone, coalesce(xid, CASE WHEN same THEN sid END) AS target, ext IS NOT NULL AND row_number() OVER (PARTITION BY edition_id, ext ORDER BY place, draw_position) > 1 AS again FROM j),
    u AS (SELECT * FROM r WHERE NOT again AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY CASE WHEN xid IS NULL THEN 1 ELSE 0 END, place, draw_position) = 1),
    n AS (SELECT * FROM r WHERE NOT again AND target IS NULL)"""
_MADE = "SELECT edition_id, round, draw_position, a AS player_a_id, b AS player_b_id, CASE WHEN w IS NULL THEN 'upcoming' ELSE 'completed' END AS status, w AS winner_id, score, ext AS external_id, seed AS player_a_seed FROM n"


def _draw(spark, sf_dir):
    rows = store.matches(spark, sf_dir)
    later = rows.select("id", F.lead("external_id", 3).over(Window.partitionBy("edition_id").orderBy("id")).alias("later"))
    held = ingest.slot_rows(rows).join(later, "id")
    i, id_ = F.col("id") % 6, F.col("id").cast("string")
    a = F.when(i == 0, F.col("player_b_id")).when(i.isin(1, 4), F.col("player_a_id") + 1).otherwise(F.col("player_a_id"))
    b = F.when(i == 0, F.col("player_a_id")).when(i == 2, F.lit(None)).otherwise(F.col("player_b_id"))
    ext = F.when(i == 3, F.col("later")).when(i == 4, F.col("external_id")).when(i == 1, F.concat(F.lit("dup_"), (F.col("id") % 40).cast("string"))).otherwise(F.concat(F.lit("new_"), id_))
    own = held.select(
        *ingest.SLOT, a.alias("player_a_id"), b.alias("player_b_id"), (i == 2).alias("is_bye"), ext.alias("external_id"), F.when(i == 5, F.col("player_b_id")).alias("winner_id"),
        F.when(i == 5, "6-1 6-1").when(i == 4, " ").alias("score"), (F.col("id") % 33).alias("player_a_seed"),
    )
    more = held.select("edition_id", "round", (F.col("draw_position") + 1000).alias("draw_position"), "player_a_id", "player_b_id", F.lit(False).alias("is_bye"), F.concat(F.lit("more_"), id_).alias("external_id"))
    return own.unionByName(more, allowMissingColumns=True)


def _applied(spark, sf_dir, overwrite):
    rows = store.matches(spark, sf_dir).withColumn("player_a_seed", F.when(F.col("id") % 5 == 0, F.col("id")))
    done = ingest.apply_draw(rows, _draw(spark, sf_dir), overwrite=overwrite)
    return done.select(*ingest.SLOT, "player_a_id", "player_b_id", "status", "winner_id", "score", "external_id", "player_a_seed")


@query(WITH + f"""{_APPLIED} SELECT m.edition_id, m.round, m.draw_position, m.player_a_id, m.player_b_id, CASE WHEN m.id IN (SELECT gone FROM r WHERE gone IS NOT NULL) THEN 'cancelled' ELSE m.status END AS status, m.winner_id, m.score,
    coalesce(m.external_id, u.ext) AS external_id, coalesce(CASE WHEN m.id % 5 = 0 THEN m.id END, u.seed) AS player_a_seed FROM m LEFT JOIN u ON u.target = m.id UNION ALL {_MADE}""")
def applied_draw(spark, sf_dir):
    """Every match after a draw that only fills what is missing."""
    return _applied(spark, sf_dir, overwrite=False)


@query(WITH + f"""{_APPLIED} SELECT m.edition_id, m.round, m.draw_position, coalesce(u.a, m.player_a_id) AS player_a_id, coalesce(u.b, m.player_b_id) AS player_b_id,
    CASE WHEN u.target IS NOT NULL THEN CASE WHEN u.w IS NULL THEN 'upcoming' ELSE 'completed' END WHEN m.id IN (SELECT gone FROM r WHERE gone IS NOT NULL) THEN 'cancelled' ELSE m.status END AS status,
    CASE WHEN u.target IS NULL THEN m.winner_id ELSE u.w END AS winner_id, CASE WHEN u.target IS NULL THEN m.score ELSE u.score END AS score,
    coalesce(u.ext, m.external_id) AS external_id, CASE WHEN u.target IS NOT NULL THEN u.seed WHEN m.id % 5 = 0 THEN m.id END AS player_a_seed FROM m LEFT JOIN u ON u.target = m.id UNION ALL {_MADE}""")
def overwritten_draw(spark, sf_dir):
    """Every match after a draw whose entries hold."""
    return _applied(spark, sf_dir, overwrite=True)


_NEXT = "CASE round WHEN 'R128' THEN 'R64' WHEN 'R64' THEN 'R32' WHEN 'R32' THEN 'R16' WHEN 'R16' THEN 'QF' WHEN 'QF' THEN 'SF' WHEN 'SF' THEN 'F' END"


@query(WITH + _SLOTS + f""", b AS (SELECT edition_id, round, draw_position, player_a_id AS w, 0 AS id FROM h WHERE id % 6 = 2), w AS (SELECT edition_id, round, draw_position, winner_id AS w, id FROM m WHERE winner_id IS NOT NULL UNION ALL SELECT * FROM b),
    f AS (SELECT edition_id, {_NEXT} AS round, CAST(ceil(draw_position / 2) AS INTEGER) + 0 AS draw_position, draw_position % 2 AS odd, w, id FROM w),
    g AS (SELECT edition_id, round, draw_position, arg_max(w, id) FILTER (odd = 1) AS player_a_id, arg_max(w, id) FILTER (odd = 0) AS player_b_id FROM f WHERE round IS NOT NULL GROUP BY edition_id, round, draw_position)
    SELECT * FROM g WHERE player_a_id <> player_b_id AND NOT EXISTS (SELECT 1 FROM m WHERE m.edition_id = g.edition_id AND m.round = g.round AND m.draw_position = g.draw_position)""")
def advanced_byes(spark, sf_dir):
    return ingest.propagate(store.matches(spark, sf_dir), _draw(spark, sf_dir))


@query(WITH + """, r AS (SELECT *, edition_id || '|' || round || '|' || least(player_a_id, player_b_id) || '|' || greatest(player_a_id, player_b_id) AS pair FROM m), k AS (SELECT * FROM r WHERE status IN ('completed', 'retired') AND id % 2 = 0)
    SELECT id, status, winner_id, score, external_id FROM m""")
def results_of_history(spark, sf_dir):
    """Results that are read again for what is stored change nothing without ``update_existing``."""
    rows = store.matches(spark, sf_dir)
    results = rows.where("status IN ('completed', 'retired') AND id % 2 = 0").withColumns({"score": F.lit("6-0 6-0"), "winner_id": F.col("player_b_id"), "external_id": F.concat(F.lit("again_"), F.col("id"))})
    return ingest.ingest_results(rows, results, F.col("id"), update_existing=False).select("id", "status", "winner_id", "score", "external_id")


@query(WITH + """, r AS (SELECT *, edition_id + 1000 AS e, edition_id || '|' || round || '|' || least(player_a_id, player_b_id) || '|' || greatest(player_a_id, player_b_id) || '|' || coalesce(CAST(match_date AS VARCHAR), '') AS key FROM m WHERE status IN ('completed', 'retired')),
    k AS (SELECT * FROM r WHERE id IN (SELECT min(id) FROM r GROUP BY key)), x AS (SELECT edition_id, status FROM m UNION ALL SELECT e, CASE WHEN score = 'W/O' THEN 'walkover' WHEN score LIKE '%RET' THEN 'retired' ELSE 'completed' END FROM k)
    SELECT edition_id, status, count(*) AS n FROM x GROUP BY edition_id, status""")
def ingested_results(spark, sf_dir):
    """The finished matches once more, as results of editions that have none yet."""
    rows = store.matches(spark, sf_dir)
    results = rows.where("status IN ('completed', 'retired')").withColumns({"edition_id": F.col("edition_id") + 1000, "external_id": F.lit(None).cast("string")})
    return ingest.ingest_results(rows, results, F.col("id")).groupBy("edition_id", "status").agg(F.count("*").alias("n"))


_PAIRS = ", b AS (SELECT *, least(player_a_id, player_b_id) AS low, greatest(player_a_id, player_b_id) AS high FROM m), f AS (SELECT edition_id, round, low, high, max(scheduled_date + 1) AS d, min(id) AS id FROM b GROUP BY edition_id, round, low, high)"


@query(WITH + _PAIRS + " SELECT m.id, coalesce(d, scheduled_date) AS scheduled_date, 'Centre' AS court, CASE WHEN status = 'upcoming' AND coalesce(d, scheduled_date) IS DISTINCT FROM scheduled_date THEN 'scheduled' ELSE status END AS status FROM m JOIN f ON f.id = m.id WHERE status IN ('upcoming', 'scheduled')")
def schedule_by_pair(spark, sf_dir):
    """Fixtures whose ids no match has, with the players in the other order."""
    rows = store.matches(spark, sf_dir)
    fixtures = rows.select(F.concat(F.lit("none_"), F.col("id")).alias("external_id"), F.date_add("scheduled_date", 1).alias("scheduled_date"), F.lit("Centre").alias("court"), "edition_id", "round", F.col("player_b_id").alias("player_a_id"), F.col("player_a_id").alias("player_b_id"))
    return ingest.schedule_updates(rows, fixtures)


@query(WITH + " SELECT m.id, a.atp_id AS player_a_external_id, 'own' AS player_b_external_id FROM m LEFT JOIN p AS a ON a.id = player_a_id")
def fixture_ids(spark, sf_dir):
    players = store.players(spark, sf_dir)
    name = lambda s: players.select(F.col("id").alias(f"player_{s}_id"), F.col("name").alias(f"player_{s}"))
    fixtures = store.matches(spark, sf_dir).select("id", "player_a_id", "player_b_id").join(name("a"), "player_a_id").join(name("b"), "player_b_id", "left")
    fixtures = fixtures.withColumns({"player_a_external_id": F.lit(None).cast("string"), "player_b_external_id": F.lit("own")})
    found = ingest.with_player_ids(fixtures, players.select(F.col("name").alias("alias"), F.col("id").alias("player_id")), players.select(F.col("id").alias("player_id"), F.col("atp_id").alias("external_id")))
    return found.select("id", "player_a_external_id", "player_b_external_id")


@query(WITH + " SELECT name AS code, tour, g.gender, (id % 2 = 0 AND g.gender = 'men') OR (id % 2 = 1 AND g.gender = 'women') AS known FROM tn, (VALUES ('men'), ('women')) AS g(gender)")
def claimed_tournaments(spark, sf_dir):
    rows = store.tournaments(spark, sf_dir).select("id", F.col("name").alias("code"), "tour", F.when(F.col("id") % 2 == 1, F.col("gender")).alias("gender"))
    seen = rows.select("code", "tour", F.explode(F.array(F.lit("women"), F.lit("men"))).alias("gender"))
    return ingest.claimed_tournaments(rows, seen).select("code", "tour", "gender", F.col("id").between(0, 4).alias("known"))


@query(WITH + ", l AS (SELECT tournament_id, year FROM ed GROUP BY ALL) SELECT ed.id, start_date, start_date + CASE tournament_id WHEN 0 THEN 14 WHEN 1 THEN 9 ELSE 7 END AS end_date FROM ed")
def dated_editions(spark, sf_dir):
    rows = store.editions(spark, sf_dir).withColumn("end_date", F.lit(None).cast("date"))
    levels = store.tournaments(spark, sf_dir).select(F.col("id").alias("tournament_id"), "level")
    seen = rows.select("tournament_id", "year", "start_date", "end_date").join(levels, "tournament_id")
    return ingest.dated_editions(rows, seen).select("id", "start_date", "end_date")


@query(f"WITH {_QUEUE} SELECT id, CASE id % 5 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'pending' WHEN 2 THEN 'completed' ELSE status END AS status, CASE id % 5 WHEN 0 THEN attempts + 1 WHEN 1 THEN 0 ELSE attempts END AS attempts, CASE WHEN id % 5 <> 1 THEN next_retry_at END AS next_retry_at FROM q WHERE NOT (id % 5 = 3 AND status IN ('pending', 'retry'))")
def queue_transitions(spark, sf_dir):
    rows = queue(spark, sf_dir)
    of = lambda k: rows.where(F.col("id") % 5 == k).select("id")
    rows = ingest.cancelled(ingest.completed(ingest.reset(ingest.started(rows, of(0), _now()), of(1)), of(2), _now()), of(3))
    return rows.select("id", "status", "attempts", "next_retry_at")


# Places, levels, ranges

_CITIES = "t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN '  ' || lower(n_name) || ' ' WHEN 2 THEN 'no such' ELSE n_name END AS city, CASE WHEN c_custkey % 8 = 3 THEN 'known' END AS country, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(f"WITH {_CITIES} SELECT id, city, coalesce(country, CASE WHEN city <> 'no such' THEN r_name END) AS country, CASE WHEN city <> 'no such' THEN substr(r_name, 1, 3) END AS country_code FROM t")
def backfilled_countries(spark, sf_dir):
    nation, region = store.raw(spark, sf_dir, "nation"), store.raw(spark, sf_dir, "region")
    named = store.raw(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.col("c_custkey") % 4
    rows = named.select(F.col("c_custkey").alias("id"), F.when(i == 1, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).when(i == 2, "no such").otherwise(F.col("n_name")).alias("city"), F.when(F.col("c_custkey") % 8 == 3, "known").alias("country"), F.lit(None).cast("string").alias("country_code"))
    cities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("value"))
    countries = region.select(F.col("r_name").alias("name"), F.substring("r_name", 1, 3).alias("value"))
    return geo.backfill_countries(rows, cities, countries)


@query(f"WITH {_CITIES} SELECT city, count(*) AS n FROM t WHERE city = 'no such' GROUP BY city")
def unmapped_cities(spark, sf_dir):
    nation = store.raw(spark, sf_dir, "nation")
    rows = store.raw(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.when(F.col("c_custkey") % 4 == 2, "no such").otherwise(F.col("n_name")).alias("city"))
    return geo.unmapped_cities(rows, nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value")))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'Masters 1000' WHEN 1 THEN 'Grand Slam' WHEN 2 THEN 'Masters 1000' WHEN 3 THEN 'ATP 500' WHEN 4 THEN 'ATP Finals' WHEN 5 THEN 'ATP 500' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Challenger' ELSE 'ATP 250' END END AS level FROM orders""")
def detected_levels(spark, sf_dir):
    i = F.col("o_orderkey") % 7
    rows = store.raw(spark, sf_dir, "orders")
    banner = F.when(i == 0, "/img/Events_Banner_1000.png").when(i == 1, "/img/plain.png")
    code = F.when(i == 1, "Wimbledon").when(i == 2, "madrid").when(i == 3, "queen-s-club").otherwise("somewhere")
    return rows.select(F.col("o_orderkey").alias("id"), domain.detected_level(banner, code, F.when(i == 4, "/x/nextgen").otherwise("/x"), F.when(i == 5, "card atp-500").otherwise("card"), F.col("o_orderkey") % 2 == 0).alias("level"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(2000 + o_orderkey % 25 AS VARCHAR) WHEN 1 THEN array_to_string(list_reverse(range(2000, 2001 + o_orderkey % 25)), ' ') END AS years FROM orders")
def year_ranges(spark, sf_dir):
    k, last = F.col("o_orderkey") % 3, 2000 + F.col("o_orderkey") % 25
    text = F.when(k == 0, last.cast("string")).when(k == 1, F.concat(F.lit("2000-"), last.cast("string"))).otherwise("soon")
    return store.raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(domain.years_of(text), " ").alias("years"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'ATP CHALLENGER WTA WTA_125 ITF_MEN ITF_WOMEN' WHEN 1 THEN 'ATP WTA' ELSE '' END AS tours FROM nation")
def tour_lists(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    text = F.when(k == 1, "wta, XYZ ,atp").when(k == 2, "none")
    return store.raw(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(domain.tours_of(text), " ").alias("tours"))


# Splits of the optimiser

_DONE = ", r AS (SELECT id, match_date, row_number() OVER (ORDER BY t, id) AS place, count(*) OVER () AS n, max(match_date) OVER () AS last FROM mt WHERE status IN ('completed', 'retired'))"


def _split_sql(start: str) -> str:
    return WITH + _DONE + f""", s AS (SELECT *, {start} AS start FROM r), c AS (SELECT *, greatest(start + 20, least(start + CAST(floor((n - start) * 0.7) AS BIGINT), n - 40)) AS a, greatest(start + 40, least(start + CAST(floor((n - start) * 0.85) AS BIGINT), n - 20)) AS b FROM s)
    SELECT id, CASE WHEN place <= start THEN 'warm-up' WHEN place <= a THEN 'train' WHEN place <= b THEN 'validation' ELSE 'test' END AS part FROM c"""


def _split(spark, sf_dir, mode):
    rows = matches.with_order(store.matches(spark, sf_dir)).where(F.col("status").isin("completed", "retired"))
    return rating.evaluation_split(rows, mode).select("id", "part")


@query(_split_sql("0"))
def split_by_order(spark, sf_dir):
    return _split(spark, sf_dir, "temporal_order")


@query(_split_sql("(SELECT min(place) - 1 FROM r WHERE match_date >= last - 360)"))
def split_by_date(spark, sf_dir):
    return _split(spark, sf_dir, "match_date")


@query(_split_sql("(SELECT min(place) - 1 FROM r WHERE match_date >= last - 1825)"))
def split_by_years(spark, sf_dir):
    return _split(spark, sf_dir, "recent_years_ratio")


@query(WITH + " SELECT id, match_date FROM m WHERE match_date >= DATE '1999-01-01'")
def matches_since(spark, sf_dir):
    return rating.since(store.matches(spark, sf_dir), F.lit("1999-01-01").cast("date")).select("id", "match_date")


_DRAWN = f"b AS ({store.BRACKETS.format(orders='orders')})"


@query(f"""WITH {_DRAWN}, r AS (SELECT * FROM b WHERE round IN ('R16', 'QF')), n AS (SELECT d, round, p, CASE WHEN round = 'QF' OR NOT bye THEN a END AS a, b AS y, won FROM r WHERE round = 'QF' OR NOT bye)
    SELECT d AS edition_id, round, CAST(p AS INTEGER) AS draw_position, 'ab ' || md5('p' || CAST(d * 16 + a AS VARCHAR)) AS player_a, 'ab ' || md5('p' || CAST(d * 16 + y AS VARCHAR)) AS player_b, CASE WHEN round = 'R16' THEN 'completed' ELSE 'upcoming' END AS status,
           CASE WHEN round = 'R16' THEN 'ab ' || md5('p' || CAST(d * 16 + won AS VARCHAR)) END AS winner, CASE WHEN round = 'QF' THEN 'draw_2024_c' || CAST(d AS VARCHAR) || '_QF_' || CAST(p AS VARCHAR) ELSE '2024_C' || CAST(d AS VARCHAR) || '_R16_' || least('X' || CAST(d * 16 + a AS VARCHAR), 'X' || CAST(d * 16 + y AS VARCHAR)) || '_' || greatest('X' || CAST(d * 16 + a AS VARCHAR), 'X' || CAST(d * 16 + y AS VARCHAR)) END AS external_id FROM n""")
def ingested_draw(spark, sf_dir):
    """First rounds of brackets, by names of which every other one is known: the players who are missing, the matches, and the next round from winners and byes."""
    rows = durable(store.brackets(spark, sf_dir).where("round = 'R16'"))
    number = lambda c: F.col("d") * 16 + F.col(c)
    name = lambda n: F.concat(F.lit("ab "), F.md5(F.concat(F.lit("p"), n.cast("string"))))
    lone = F.col("bye")
    a = F.when(lone, number("won")).otherwise(number("a"))
    scraped = rows.select(
        F.col("d").alias("edition_id"), "round", F.col("p").cast("int").alias("draw_position"), name(a).alias("player_a"), F.concat(F.lit("X"), a).alias("player_a_external_id"), F.lit(None).cast("int").alias("player_a_seed"),
        F.when(~lone, name(number("b"))).alias("player_b"), F.when(~lone, F.concat(F.lit("X"), number("b"))).alias("player_b_external_id"), F.lit(None).cast("int").alias("player_b_seed"),
        F.when(~lone, name(number("won"))).alias("winner"), F.when(~lone, "6-1 6-1").alias("score"), lone.alias("is_bye"), F.lit("atp").alias("source"),
    )
    scraped = durable(scraped)
    known = scraped.where("draw_position % 2 = 0").select(F.xxhash64("player_a").alias("id"), F.col("player_a").alias("name"))
    known = known.withColumns({"atp_id": F.lit(None).cast("string"), "wta_id": F.lit(None).cast("string")})
    editions = scraped.select(F.col("edition_id").alias("id"), F.concat(F.lit("c"), "edition_id").alias("code"), F.lit(2024).alias("year"), F.lit("2024-01-01").cast("date").alias("start_date"), F.lit("2024-01-08").cast("date").alias("end_date")).distinct()
    empty = spark.createDataFrame([], "id long, edition_id long, round string, draw_position int, player_a_id long, player_b_id long, status string, winner_id long, score string, external_id string, match_date date")
    done, players, _ = bracket.ingest_draw(empty, scraped, known, identity.empty_aliases(spark), editions)
    for c, to in (("player_a_id", "player_a"), ("player_b_id", "player_b"), ("winner_id", "winner")):
        done = done.join(players.select(F.col("id").alias(c), F.col("name").alias(to)), c, "left")
    return done.select("edition_id", "round", "draw_position", "player_a", "player_b", "status", "winner", "external_id")
