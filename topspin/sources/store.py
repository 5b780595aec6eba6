"""The match store over the driver's tables.

``orders`` stand for matches, ``customer`` for players, ``nation`` for editions and ``region`` for tournaments. Each stand-in is
a projection of its table, so filters and column selections still reach the scan. The same expressions are valid in
Spark and in the oracle's dialect; what is tested are the operators on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATCH = {
    "id": "o_orderkey",
    "player_a_id": "o_custkey",
    "player_b_id": "(o_custkey * 7 + o_orderkey) % {n}",
    "edition_id": "o_orderkey % 25",
    "status": "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'retired' WHEN o_orderkey % 5 = 0 THEN 'scheduled' WHEN o_orderkey % 11 = 0 THEN 'cancelled' ELSE 'upcoming' END",
    "winner_id": "CASE WHEN o_orderstatus IN ('F', 'P') THEN CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE (o_custkey * 7 + o_orderkey) % {n} END END",
    "round": "CASE o_orderkey % 7 WHEN 0 THEN 'F' WHEN 1 THEN 'SF' WHEN 2 THEN 'QF' WHEN 3 THEN 'R16' WHEN 4 THEN 'R32' WHEN 5 THEN 'R64' ELSE 'R128' END",
    "match_date": "CASE WHEN o_orderkey % 13 = 0 OR o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "scheduled_date": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "score": "CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderkey % 23 = 0 THEN 'W/O' WHEN o_orderstatus = 'P' THEN '6-4 2-' || CAST(o_orderkey % 3 AS VARCHAR(9)) || ' RET'"
    " WHEN o_orderkey % 2 = 0 THEN '6-' || CAST(o_orderkey % 5 AS VARCHAR(9)) || ' 7-6(' || CAST(o_orderkey % 6 AS VARCHAR(9)) || ')'"
    " ELSE '3-6 6-' || CAST(o_orderkey % 5 AS VARCHAR(9)) || ' 5-7' END",
    "draw_position": "CAST(o_orderkey % 64 + 1 AS INT)",
    "external_id": "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'draw_' || CAST(o_orderkey AS VARCHAR(20)) ELSE 'res_' || CAST(o_orderkey AS VARCHAR(20)) END",
}
EDITION = {
    "id": "CAST(n_nationkey AS BIGINT)",
    "tournament_id": "CAST(n_regionkey AS BIGINT)",
    "year": "1995 + n_nationkey % 7",
    "surface": "CASE n_nationkey % 4 WHEN 1 THEN 'Clay' WHEN 2 THEN 'Grass' END",
    "start_date": "CAST('1996-01-01' AS DATE)",
    "name": "n_name",
}
TOURNAMENT = {
    "id": "CAST(r_regionkey AS BIGINT)",
    "name": "r_name",
    "tour": "CASE r_regionkey WHEN 0 THEN 'ATP' WHEN 1 THEN 'WTA' WHEN 2 THEN 'CHALLENGER' WHEN 3 THEN 'ITF' ELSE 'WTA 125' END",
    "gender": "CASE r_regionkey % 2 WHEN 0 THEN 'men' ELSE 'women' END",
    "level": "CASE r_regionkey WHEN 0 THEN 'Grand Slam' WHEN 1 THEN 'WTA 1000' WHEN 2 THEN 'Challenger' WHEN 3 THEN 'ITF' ELSE 'WTA 125' END",
    "surface": "CASE r_regionkey % 2 WHEN 0 THEN 'Hard' ELSE 'Clay' END",
}
PLAYER = {
    "id": "c_custkey",
    "name": "c_name",
    "nationality": "CAST(c_nationkey AS BIGINT)",
    "atp_id": "CASE WHEN c_custkey % 2 = 0 THEN 'A' || CAST(c_custkey AS VARCHAR(20)) END",
    "wta_id": "CASE WHEN c_custkey % 3 = 0 THEN 'W' || CAST(c_custkey AS VARCHAR(20)) END",
    "height_cm": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(160 + c_custkey % 40 AS INT) END",
}
#: A rating state for each player, as a former run would have left it.
STATE = {
    "player_id": "c_custkey",
    "rating": "CAST(1500 + floor(c_acctbal) / 20.0 AS DECIMAL(8, 2))",
    "match_count": "CAST(c_custkey % 50 AS INT)",
    "last_match_date": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST('2001-08-01' AS DATE) - CAST(c_custkey % 400 AS INT) END",
}


def _table(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str], **values: object) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*[f"{text.format(**values)} AS {column}" for column, text in columns.items()])


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches between two different players; the number of players comes from the table's footer."""
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    return _table(spark, sf_dir, "orders", MATCH, n=n).where("player_a_id <> player_b_id")


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation", EDITION)


def tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region", TOURNAMENT)


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer", PLAYER)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer", STATE)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first(q: str) -> str:
    return f"(2 * (({q}) - 1) + (d + ({q})) % 2)"


def _second(p: str) -> str:
    return _first(f"2 * ({p}) - 1 + (d + 3 * ({p})) % 2")


def _third(p: str) -> str:
    return _second(f"2 * ({p}) - 1 + (d + 5 * ({p})) % 2")


_SIDES = {s: f"CASE round WHEN 'R16' THEN 2 * (p - 1) + {k} WHEN 'QF' THEN {_first(f'2 * p - 1 + {k}')} WHEN 'SF' THEN {_second(f'2 * p - 1 + {k}')} ELSE {_third(f'1 + {k}')} END" for s, k in (("a", 0), ("b", 1))}
_WON = f"CASE round WHEN 'R16' THEN {_first('p')} WHEN 'QF' THEN {_second('p')} WHEN 'SF' THEN {_third('p')} ELSE {_third('1 + d % 2')} END"
#: Brackets of 16 players over the keys of orders: draw ``d``, ``round``, position ``p``, and the players and winner as numbers from 0. A fifth of the first round are byes.
BRACKETS = f"""SELECT *, {_SIDES['a']} AS a, {_SIDES['b']} AS b, {_WON} AS won, round = 'R16' AND (d + p) % 5 = 0 AS bye FROM (
    SELECT *, CASE WHEN j < 8 THEN 'R16' WHEN j < 12 THEN 'QF' WHEN j < 14 THEN 'SF' ELSE 'F' END AS round, CASE WHEN j < 8 THEN j + 1 WHEN j < 12 THEN j - 7 WHEN j < 14 THEN j - 11 ELSE 1 END AS p FROM (
    SELECT o_orderkey AS id, CAST(floor(o_orderkey / 15) AS BIGINT) AS d, o_orderkey % 15 AS j FROM {{orders}}))"""


def brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BRACKETS.format(orders="{orders}"), orders=raw(spark, sf_dir, "orders"))


def by_page(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by page, in a given number of partitions: a scan has few tasks for narrow rows and adaptive execution would join small ones, and pages that are costly to read would be left to a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def brackets_by_page(rows: DataFrame) -> DataFrame:
    """``rows`` of ``brackets()`` dealt by draw."""
    return by_page(rows, "d")


def _cte(name: str, table: str, columns: dict[str, str], n: str = "") -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{text.format(n=n)} AS {column}" for column, text in columns.items()) + f" FROM {table})"


_ORDER = " ".join(f"WHEN '{r}' THEN {o}" for r, o in (("F", 70), ("SF", 60), ("QF", 50), ("R16", 40), ("R32", 30), ("R64", 20), ("R128", 10)))
#: Common table expressions of the stand-ins for oracles; ``mt`` is ``m`` with the temporal order ``t``.
WITH = "WITH " + ", ".join([
    _cte("m0", "orders", MATCH, "(SELECT count(*) FROM customer)"),
    "m AS (SELECT * FROM m0 WHERE player_a_id <> player_b_id)",
    f"mt AS (SELECT *, coalesce(CAST(strftime(match_date, '%Y%m%d') AS BIGINT), 99991231) * 10000000 + edition_id % 100000 * 100 + CASE round {_ORDER} END AS t FROM m)",
    _cte("ed", "nation", EDITION), _cte("tn", "region", TOURNAMENT), _cte("p", "customer", PLAYER), _cte("st", "customer", STATE),
])
