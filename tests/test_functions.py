import datetime as dt

import pytest
from pyspark.sql import functions as F

from topspin.functions import dates, domain, names, scores


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


SCORES = [
    ("6-4 6-3", 2, "A", "completed", None), ("6-4 4-6 7-5", 3, "A", "completed", None), ("6-4 2-1 RET", 2, "A", "retired", 2), ("6-4 2-1 ret.", 2, "A", "retired", 2), ("6-4 2-1 Ret", 2, "A", "retired", 2),
    ("W/O", 0, "A", "walkover", None), ("w.o.", 0, "A", "walkover", None), ("walkover", 0, "A", "walkover", None), ("DEF", 0, "A", "default", None), ("7-6(4) 6-7(5) 6-4 3-6 7-5", 5, "A", "completed", None),
    ("4-6 3-6", 2, "B", "completed", None), ("3-2 RET", 1, "A", "retired", 1), ("6-0 6-0", 2, "A", "completed", None), ("3-6 (ret)", 1, "B", "retired", 1), ("2-2 retired", 1, "A", "retired", 1),
]


@pytest.mark.parametrize(("text", "n", "winner", "status", "last"), SCORES)
def test_scores(spark, text, n, winner, status, last):
    p = one(spark, text, scores.parse_score(F.col("x")).alias("p")).p
    assert (len(p.sets), p.winner, p.status, p.retirement_set) == (n, winner, status, last)


def test_score_details(spark):
    assert [one(spark, t, scores.parse_score(F.col("x")).alias("p")).p for t in (None, "", "not a score", "RET")] == [None] * 4
    p = one(spark, "7-6(5) 6-7(9-11) 6-4 [10-8]", scores.parse_score(F.col("x")).alias("p"), scores.display(scores.parse_score(F.col("x"))).alias("d"), scores.to_structured(scores.parse_score(F.col("x"))).alias("s"))
    assert [(s.a, s.b, s.tb_a, s.tb_b, s.is_tiebreak, s.is_super) for s in p.p.sets] == [(7, 6, 7, 5, True, False), (6, 7, 9, 11, True, False), (6, 4, None, None, False, False), (10, 8, None, None, False, True)]
    assert p.d == "7-6(5) 6-7(9) 6-4 10-8" and p.s[0].tb_b == 5 and p.s[3].retired is None
    q = one(spark, "6-4 2-1 RET", scores.to_structured(scores.parse_score(F.col("x"))).alias("s"), scores.flip(F.lit("6-4 6-7(5) RET")).alias("f"), scores.unfinished_last_set(F.lit("6-4 2-1")).alias("u"), scores.unfinished_last_set(F.lit("6-4 6-1")).alias("v"))
    assert [s.retired for s in q.s] == [None, True] and q.f == "4-6 7-6(5) RET" and q.u and not q.v
    m = one(spark, "6-0 6-0", scores.margin_multiplier(scores.to_structured(scores.parse_score(F.col("x"))), F.lit(True)).alias("a"), scores.margin_multiplier(scores.to_structured(scores.parse_score(F.lit("W/O"))), F.lit(True)).alias("b"))
    assert (m.a, m.b) == (1.15, 1.0)


def test_names(spark):
    def norm(x):
        return one(spark, x, names.normalize_name(F.col("x")).alias("n")).n

    assert [norm(x) for x in ("Novak DJOKOVIC", "Garbiñe Muguruza", "Jiří Veselý", "SWIATEK, Iga", "Pete Sampras Jr.", "  Novak    Djokovic  ", "", None)] == ["novak djokovic", "garbine muguruza", "jiri vesely", "iga swiatek", "pete sampras", "novak djokovic", "", ""]
    s = names.name_similarity
    assert s("novak djokovic", "novak djokovic") == 1 and s("", "") == 0 and s("x", "") == 0
    assert s("novak djokovic", "n djokovic") > 0.85 and s("novak djokovic", "rafael nadal") < 0.6 and 0.6 < s("novak djokovic", "marko djokovic") < 0.95 and s("novak djokovic", "djokovic novak") > 0.8
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and names.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-6) and names.jaro_winkler("abc", "xyz") == 0
    assert names.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13) and names.partial_ratio("abcd", "xxabcdyy") == 1
    last = lambda x: one(spark, x, names.last_name(F.col("x")).alias("n")).n
    assert [last(x) for x in ("juan martin del potro", "anna-lena friedsam", "madonna", "")] == ["del potro", "friedsam", "madonna", ""]
    short = lambda x: one(spark, x, names.is_abbreviated(F.col("x")).alias("n")).n
    assert [short(x) for x in ("j. pegula", "j pegula", "jessica pegula", "pegula")] == [True, True, False, False]
    seed = lambda x: tuple(one(spark, x, names.split_seed(F.col("x")).alias("n")).n)
    assert [seed(x) for x in ("(1) Novak Djokovic", "[2] Carlos Alcaraz", "Novak Djokovic (1)", "John Doe [WC]", "Jane Doe (Q)")] == [("Novak Djokovic", 1), ("Carlos Alcaraz", 2), ("Novak Djokovic", 1), ("John Doe", None), ("Jane Doe", None)]
    assert one(spark, "novak djokovic", names.search_variants(F.col("x")).alias("n")).n == ["djokovic", "djokovic novak", "n djokovic", "novak djokovic"]
    assert one(spark, "cat", names.trigrams(F.col("x")).alias("n")).n == ["  c", " ca", "cat", "at "]


def test_dates(spark):
    d = dt.date
    span = lambda x: tuple(one(spark, x, dates.date_range(F.col("x")).alias("r")).r)
    assert span("1 - 7 January, 2024") == (d(2024, 1, 1), d(2024, 1, 7))
    assert span("29 January – 4 February, 2024") == (d(2024, 1, 29), d(2024, 2, 4))
    assert span("30 December, 2023 - 7 January, 2024") == (d(2023, 12, 30), d(2024, 1, 7))
    assert span("29 December - 4 January, 2024") == (d(2023, 12, 29), d(2024, 1, 4))
    assert span("nonsense") == (None, None)
    assert tuple(one(spark, "30 Dec to 05 Jan 2024", dates.span_with_to(F.col("x")).alias("r")).r) == (d(2023, 12, 30), d(2024, 1, 5))
    assert [one(spark, x, dates.day_header(F.col("x")).alias("r")).r for x in ("Sun, 11 January, 2026Day (9)", "Monday 12 January 2026", "x")] == [d(2026, 1, 11), d(2026, 1, 12), None]
    assert [one(spark, x, dates.clock(F.col("x")).alias("r")).r for x in ("2:05 PM", "12:30 am", "09.15", "14:00", "x")] == ["14:05", "00:30", "09:15", "14:00", None]
    assert one(spark, "2024-01-05", dates.schedule_time(F.col("x"), F.lit("2:05 PM")).alias("r")).r == dt.datetime(2024, 1, 5, 14, 5)
    assert one(spark, "2024-13-05", dates.typed_date(F.col("x")).alias("r")).r is None


def test_domain(spark):
    t = one(spark, "x", domain.temporal_order(F.lit(dt.date(2024, 1, 28)), F.lit(23456), F.lit("F")).alias("t"), domain.temporal_order(F.lit(None).cast("date"), F.lit(None).cast("int"), F.lit("?")).alias("n"))
    assert t.t == 202401282345670 and t.n == 999912310000000
    d = one(spark, "x", domain.order_date(F.lit(t.t)).alias("a"), domain.order_date(F.lit(t.n)).alias("b"), domain.round_date(F.lit(dt.date(2024, 1, 15)), F.lit(dt.date(2024, 1, 28)), F.lit("SF")).alias("c"))
    assert (d.a, d.b, d.c) == (dt.date(2024, 1, 28), None, dt.date(2024, 1, 26))
    code = lambda a, b: one(spark, a, domain.level_code(F.col("x"), F.lit(b)).alias("c")).c
    assert [code(*x) for x in (("ITF $15K", "ITF"), ("Grand Slam", "WTA"), ("WTA 125", None), ("ITF W25", "ITF"), ("ATP 500", "ATP"))] == ["A", "WG", "WC", "WF", "A"]
    size = lambda n: one(spark, "x", domain.first_round(F.lit(n)).alias("c")).c
    assert [size(n) for n in (128, 96, 64, 32, 48, 2, 1, 300)] == ["R128", "R128", "R64", "R32", "R64", "F", "R128", "R128"]
    g = one(spark, "ITF_women", domain.tour_of_key(F.col("x")).alias("t"), domain.expected_gender(F.col("x")).alias("g"), domain.title(F.lit("juan martin DEL potro")).alias("n"), domain.expected_matches(F.lit("QF")).alias("m"), domain.previous_round(F.lit("F")).alias("p"))
    assert (tuple(g.t), g.g, g.n, g.m, g.p) == (("ITF", "women"), "women", "Juan Martin del Potro", 4, "SF")
