"""Queries of the scalar library: names, texts, rounds, levels, dates, keys and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from topspin.functions import dates, domain, names, scores
from topspin.operators import ingest
from topspin.plans.registry import query
from topspin.sources import store
from topspin.sources.store import WITH

#: Forms in which sources write a name; ``w`` holds its two words. The same in both dialects.
_NAME = "CASE event_id % 5 WHEN 0 THEN upper(b) || ', ' || a WHEN 1 THEN '(' || CAST(event_id % 9 + 1 AS VARCHAR(9)) || ') ' || a || ' ' || b WHEN 2 THEN substr(a, 1, 1) || '. ' || b || ' [WC]' WHEN 3 THEN a || '  ' || b || ' Jr.' ELSE a || ' de ' || b END"
_E = f"w AS (SELECT event_id, 'Name' || chr(CAST(97 + user_id % 26 AS INT)) AS a, 'Last' || chr(CAST(97 + event_id % 26 AS INT)) AS b FROM events), n AS (SELECT event_id, {_NAME} AS name FROM w)"


def _names(spark, sf_dir):
    rows = store.raw(spark, sf_dir, "events").selectExpr("event_id", "'Name' || chr(CAST(97 + user_id % 26 AS INT)) AS a", "'Last' || chr(CAST(97 + event_id % 26 AS INT)) AS b")
    return rows.selectExpr("event_id", f"{_NAME} AS name")


@query(f"""WITH {_E}, l AS (SELECT event_id, lower(name) AS x FROM n), t AS (SELECT event_id, CASE WHEN x LIKE '%,%' THEN trim(split_part(x, ',', 2)) || ' ' || trim(split_part(x, ',', 1)) ELSE x END AS x FROM l)
    SELECT event_id, trim(regexp_replace(regexp_replace(x, ' jr\\.$', ''), '\\s+', ' ', 'g')) AS name FROM t""")
def normalized_names(spark, sf_dir):
    return _names(spark, sf_dir).select("event_id", names.normalize_name(F.col("name")).alias("name"))


@query(f"""WITH {_E} SELECT event_id, CASE WHEN regexp_matches(name, '^\\([0-9]+\\)') THEN regexp_extract(name, '^\\([0-9]+\\)\\s*(.+)$', 1) ELSE trim(replace(name, ' [WC]', '')) END AS name,
    CASE WHEN regexp_matches(name, '^\\([0-9]+\\)') THEN CAST(regexp_extract(name, '^\\(([0-9]+)\\)', 1) AS INTEGER) END AS seed FROM n""")
def split_seeds(spark, sf_dir):
    return _names(spark, sf_dir).select("event_id", names.split_seed(F.col("name")).alias("s")).select("event_id", "s.name", "s.seed")


@query(f"""WITH {_E}, x AS (SELECT event_id, lower(a || ' ' || b) AS f, lower(a || ' de ' || b) AS g, lower(substr(a, 1, 1) || '. ' || b) AS h FROM w)
    SELECT event_id, split_part(f, ' ', 2) AS last_f, 'de ' || split_part(f, ' ', 2) AS last_g, 'n' || 'l' AS initials, false AS short_f, true AS short_h FROM x""")
def name_parts(spark, sf_dir):
    rows = store.raw(spark, sf_dir, "events").selectExpr("event_id", "'name' || chr(CAST(97 + user_id % 26 AS INT)) AS a", "'last' || chr(CAST(97 + event_id % 26 AS INT)) AS b")
    f, g, h = (F.concat(*x) for x in (("a", F.lit(" "), "b"), ("a", F.lit(" de "), "b"), (F.substring("a", 1, 1), F.lit(". "), "b")))
    return rows.select("event_id", names.last_name(f).alias("last_f"), names.last_name(g).alias("last_g"), names.initials(f).alias("initials"), names.is_abbreviated(f).alias("short_f"), names.is_abbreviated(h).alias("short_h"))


@query("SELECT doc_id, strip_accents(lower(trim(substr(text, 1, 40)))) AS plain FROM documents WHERE lang IN ('fr', 'es') AND NOT contains(substr(text, 1, 40), ',') AND NOT contains(substr(text, 1, 40), chr(10))")
def accents_stripped(spark, sf_dir):
    head = F.substring("text", 1, 40)
    rows = store.raw(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "es") & ~head.contains(",") & ~head.contains("\n"))
    return rows.select("doc_id", names._plain(head).alias("plain"))


@query("SELECT s_suppkey, s_name, round(jaro_winkler_similarity(lower(s_name), lower(c_name)), 6) AS similarity FROM supplier JOIN customer ON c_custkey = s_suppkey")
def jaro_winkler_names(spark, sf_dir):
    from pyspark.sql import types as T

    score = F.pandas_udf(lambda a, b: a.combine(b, names.jaro_winkler), T.DoubleType())
    s, c = store.raw(spark, sf_dir, "supplier"), store.raw(spark, sf_dir, "customer")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select("s_suppkey", "s_name", F.round(score(F.lower("s_name"), F.lower("c_name")), 6).alias("similarity"))


@query()
def name_similarity(spark, sf_dir):
    rows = _names(spark, sf_dir).select("event_id", names.normalize_name(F.col("name")).alias("name"))
    other = rows.select((F.col("event_id") + 1).alias("event_id"), F.col("name").alias("other"))
    return rows.join(other, "event_id").select("event_id", F.round(names.compare_names("name", "other"), 6).alias("score"))


@query(f"""WITH {_E}, l AS (SELECT event_id, lower(name) AS x FROM n), t AS (SELECT event_id, CASE WHEN x LIKE '%,%' THEN trim(split_part(x, ',', 2)) || ' ' || trim(split_part(x, ',', 1)) ELSE x END AS x FROM l),
    f AS (SELECT event_id, trim(regexp_replace(regexp_replace(x, ' jr\\.$', ''), '\\s+', ' ', 'g')) AS name FROM t), v AS (SELECT event_id, name, string_split(name, ' ') AS w FROM f)
    SELECT DISTINCT event_id, unnest(CASE WHEN len(w) < 2 THEN [name] ELSE [name, w[1][1] || ' ' || w[-1], w[-1], w[-1] || ' ' || w[1], w[-1] || ' ' || array_to_string(w[:-2], ' ')] END) AS variant FROM v""")
def search_variants(spark, sf_dir):
    rows = _names(spark, sf_dir).select("event_id", names.normalize_name(F.col("name")).alias("name"))
    return rows.select("event_id", F.explode(names.search_variants(F.col("name"))).alias("variant"))


_ROUND = "CASE o_orderkey % 10 WHEN 0 THEN 'Finals -' WHEN 1 THEN 'Semi-Finals' WHEN 2 THEN 'Quarterfinals' WHEN 3 THEN 'Round of 16' WHEN 4 THEN 'Round Robin' WHEN 5 THEN '1st Round' WHEN 6 THEN 'Q2' WHEN 7 THEN 'Qualifying Final' WHEN 8 THEN 'Round of 128' ELSE 'other' END"


@query(f"SELECT o_orderkey, {_ROUND} AS raw, CASE o_orderkey % 10 WHEN 0 THEN 'F' WHEN 1 THEN 'SF' WHEN 2 THEN 'QF' WHEN 3 THEN 'R16' WHEN 4 THEN 'RR' WHEN 5 THEN 'R64' WHEN 6 THEN 'Q2' WHEN 7 THEN 'Q3' WHEN 8 THEN 'R128' ELSE 'OTHER' END AS round FROM orders")
def normalized_rounds(spark, sf_dir):
    rows = store.raw(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_ROUND} AS raw")
    return rows.select("o_orderkey", "raw", domain.normalize_round(F.col("raw")).alias("round"))


_SURFACE = "CASE o_orderkey % 5 WHEN 0 THEN ' Indoor HARD' WHEN 1 THEN 'Red Clay' WHEN 2 THEN 'grass' WHEN 3 THEN 'Carpet (i)' ELSE '?' END"
_LEVEL = "CASE o_orderkey % 8 WHEN 0 THEN 'GS' WHEN 1 THEN 'Masters' WHEN 2 THEN '500 series' WHEN 3 THEN '250' WHEN 4 THEN 'W125' WHEN 5 THEN 'CH 90' WHEN 6 THEN 'Future' ELSE 'tour' END"
_TOURK = "CASE o_custkey % 4 WHEN 0 THEN 'atp' WHEN 1 THEN 'wta' WHEN 2 THEN 'itf' ELSE 'challenger' END"


@query(f"""WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS s, o_orderkey % 8 AS l, {_TOURK} AS tour FROM orders) SELECT o_orderkey,
    CASE s WHEN 1 THEN 'Clay' WHEN 2 THEN 'Grass' WHEN 3 THEN 'Carpet' ELSE 'Hard' END AS surface,
    CASE l WHEN 0 THEN 'Grand Slam' WHEN 1 THEN CASE WHEN tour = 'atp' THEN 'Masters 1000' ELSE 'WTA 1000' END WHEN 2 THEN CASE WHEN tour = 'atp' THEN 'ATP 500' ELSE 'WTA 500' END WHEN 3 THEN CASE WHEN tour = 'atp' THEN 'ATP 250' ELSE 'WTA 250' END
    WHEN 4 THEN 'WTA 125' WHEN 5 THEN 'Challenger' WHEN 6 THEN 'ITF' ELSE CASE tour WHEN 'itf' THEN 'ITF' WHEN 'challenger' THEN 'Challenger' WHEN 'atp' THEN 'ATP 250' ELSE 'WTA 250' END END AS level FROM x""")
def normalized_surfaces_levels(spark, sf_dir):
    rows = store.raw(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_SURFACE} AS s", f"{_LEVEL} AS l", f"{_TOURK} AS tour")
    return rows.select("o_orderkey", domain.normalize_surface(F.col("s")).alias("surface"), domain.normalize_level(F.col("l"), F.col("tour")).alias("level"))


@query("""WITH x AS (SELECT p_partkey, p_size AS n, CAST(p_partkey % 64 + 1 AS INTEGER) AS pos FROM part) SELECT p_partkey, CASE WHEN n <= 1 THEN 'R128' WHEN n <= 2 THEN 'F' WHEN n <= 4 THEN 'SF' WHEN n <= 8 THEN 'QF' WHEN n <= 16 THEN 'R16' WHEN n <= 32 THEN 'R32' WHEN n <= 64 THEN 'R64' ELSE 'R128' END AS first_round,
    CAST(ceil(pos / 2.0) AS INTEGER) AS next_position, 2 * pos - 1 AS top, 2 * pos AS bottom FROM x""")
def bracket_arithmetic(spark, sf_dir):
    rows = store.raw(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 64 + 1).cast("int").alias("pos"))
    f = domain.feeders(F.col("pos"))
    return rows.select("p_partkey", domain.first_round(F.col("p_size")).alias("first_round"), domain.next_position(F.col("pos")).alias("next_position"), f[0].alias("top"), f[1].alias("bottom"))


@query(WITH + " SELECT id, upper(CAST(1996 AS VARCHAR) || '_t' || edition_id || '_' || round || '_' || least(player_a_id, player_b_id) || '_' || greatest(player_a_id, player_b_id)) AS external_id, CASE round WHEN 'F' THEN NULL WHEN 'SF' THEN 'F' WHEN 'QF' THEN 'SF' WHEN 'R16' THEN 'QF' WHEN 'R32' THEN 'R16' WHEN 'R64' THEN 'R32' ELSE 'R64' END AS next_round FROM m")
def external_ids(spark, sf_dir):
    key = domain.external_id(F.lit(1996), F.concat(F.lit("t"), F.col("edition_id")), F.col("round"), F.col("player_a_id"), F.col("player_b_id"))
    return store.matches(spark, sf_dir).select("id", key.alias("external_id"), domain.next_round(F.col("round")).alias("next_round"))


@query(WITH + " SELECT id, CASE level WHEN 'Grand Slam' THEN DATE '1996-01-15' WHEN 'WTA 1000' THEN DATE '1996-01-10' ELSE DATE '1996-01-08' END AS end_date, CASE tour WHEN 'ATP' THEN 'men' WHEN 'CHALLENGER' THEN 'men' WHEN 'WTA' THEN 'women' WHEN 'WTA 125' THEN 'women' END AS gender FROM tn")
def tournament_facts(spark, sf_dir):
    none = F.lit(None).cast("string")
    return store.tournaments(spark, sf_dir).select("id", domain.edition_end(F.lit("1996-01-01").cast("date"), F.col("level")).alias("end_date"), domain.tournament_gender(F.col("tour"), none, F.col("name")).alias("gender"))


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(o_orderdate) <= 20)
    SELECT o_orderkey, d AS start, d + 6 AS "end", d AS header, (CASE WHEN o_orderkey % 24 < 10 THEN '0' ELSE '' END) || (o_orderkey % 24) || ':05' AS clock FROM x""")
def parsed_dates(spark, sf_dir):
    rows = store.raw(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).where(F.dayofmonth("d") <= 20)
    text = F.concat(F.date_format("d", "d"), F.lit(" – "), F.date_format(F.date_add("d", 6), "d MMMM, yyyy"))
    header = F.concat(F.date_format("d", "EEE, dd MMMM, yyyy"), F.lit("Day (3)"))
    hour = (F.col("o_orderkey") % 24).cast("int")
    clock = F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.lit(":05 "), F.when(hour < 12, "AM").otherwise("PM"))
    span = dates.date_range(text)
    return rows.select("o_orderkey", span["start"].alias("start"), span["end"].alias("end"), dates.day_header(header).alias("header"), dates.clock(clock).alias("clock"))


@query(WITH + " SELECT id, name, start_date <= DATE '1996-01-05' AND CASE WHEN id % 2 = 0 THEN start_date + 1 ELSE start_date + 7 END >= DATE '1996-01-03' AS inside FROM ed")
def tournaments_in_window(spark, sf_dir):
    rows = store.editions(spark, sf_dir).withColumn("end_date", F.when(F.col("id") % 2 == 0, F.date_add("start_date", 1)))
    day = lambda x: F.lit(x).cast("date")
    return rows.select("id", "name", ingest.in_window(F.col("start_date"), F.col("end_date"), day("1996-01-03"), day("1996-01-05")).alias("inside"))


@query("SELECT r_regionkey, lower(replace(r_name, ' ', '-')) AS slug, CAST(5 * pow(2, r_regionkey) AS BIGINT) AS wait FROM region")
def slugs_and_waits(spark, sf_dir):
    return store.raw(spark, sf_dir, "region").select("r_regionkey", domain.slug(F.col("r_name")).alias("slug"), domain.retry_minutes(F.col("r_regionkey") + 1).alias("wait"))


@query("WITH h AS (SELECT r_name, CAST('0x' || substr(sha256(r_name), 1, 16) AS UBIGINT) AS u FROM region) SELECT r_name, CAST(CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE u END AS BIGINT) AS key FROM h")
def lock_keys(spark, sf_dir):
    return store.raw(spark, sf_dir, "region").select("r_name", domain.lock_key(F.col("r_name")).alias("key"))


@query("""WITH x AS (SELECT c_custkey, lower(c_name) AS a, lower(s_name) AS b FROM customer JOIN supplier ON s_suppkey = c_custkey),
    g AS (SELECT c_custkey, list_distinct(list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3))) AS t, side FROM (SELECT c_custkey, unnest(string_split(a, '#')) AS w, 'a' AS side FROM x UNION ALL SELECT c_custkey, unnest(string_split(b, '#')), 'b' FROM x)),
    f AS (SELECT c_custkey, side, list_distinct(flatten(list(t))) AS t FROM g GROUP BY c_custkey, side)
    SELECT p.c_custkey, round(len(list_intersect(p.t, q.t)) / CAST(len(p.t) + len(q.t) - len(list_intersect(p.t, q.t)) AS DOUBLE), 6) AS similarity FROM f AS p JOIN f AS q ON p.c_custkey = q.c_custkey AND p.side = 'a' AND q.side = 'b'""")
def trigram_similarity(spark, sf_dir):
    s, c = store.raw(spark, sf_dir, "supplier"), store.raw(spark, sf_dir, "customer")
    rows = c.join(s, F.col("s_suppkey") == F.col("c_custkey")).select("c_custkey", names.trigrams(F.col("c_name")).alias("a"), names.trigrams(F.col("s_name")).alias("b"))
    return rows.select("c_custkey", F.round(names.trigram_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INTEGER) % 7 AS q FROM lineitem)
    SELECT k, n, CASE q WHEN 0 THEN '6-7(4) 6-3' WHEN 1 THEN '7-6(10) 6-3' WHEN 2 THEN '76-6 6-3' WHEN 3 THEN '-6 6-3' ELSE CAST(q AS VARCHAR) || '-6 6-3' END AS compressed,
           CASE WHEN q = 0 THEN '' ELSE '7-6(5) ' || CAST(q AS VARCHAR) || '-1' END AS items, CASE WHEN q % 2 = 0 THEN '6-7(3)' ELSE '6-' || CAST(q AS VARCHAR) END AS cells FROM x""")
def built_scores(spark, sf_dir):
    """Scores put together from what the sources show of each side's sets."""
    q = (F.col("l_quantity").cast("int") % 7).alias("q")
    rows = store.raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), q)
    q = F.col("q")
    first = F.when(q == 0, "64").when(q == 1, "7").when(q == 2, "76").when(q == 3, "").otherwise(q.cast("string"))
    other = F.when(q == 0, "7").when(q == 1, "610").otherwise("6")
    items = F.when(q == 0, F.array(F.lit("7"), F.lit("6"), F.lit("1"))).otherwise(F.array(F.lit("7"), F.concat(q.cast("string"), F.lit("")), F.lit("6(5)"), F.lit(""), F.lit("1")))
    cell = lambda games, points: F.array(F.struct(games.alias("games"), points.alias("points")))
    even = q % 2 == 0
    return rows.select(
        "k", "n", scores.compressed_score(F.array(first, F.lit("6")), F.array(other, F.lit("3"), F.lit("9"))).alias("compressed"), scores.item_score(items).alias("items"),
        scores.cell_score(cell(F.lit("6"), F.when(even, "3")), cell(F.when(even, "7").otherwise(q.cast("string")), F.lit(None).cast("string"))).alias("cells"),
    )
