"""Normalisers, bracket arithmetic and keys of the domain as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from topspin.schema import LEVEL_CODES, MAIN_DRAW, RATING_K, RATING_S, ROUND_MATCHES, ROUND_ORDER, ROUND_PROGRESS


def chain(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first case that holds."""
    out = reduce(lambda acc, case: acc.when(*case), cases[1:], F.when(*cases[0]))
    return out.otherwise(otherwise)


def look_up(table: dict, key: Column) -> Column:
    """A constant table as a map literal; null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def _has(text: Column, *parts: str) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in parts])


def normalize_round(name: Column) -> Column:
    """Round code of a source's name for it; rules are tried in order, what fits none is upper-cased."""
    t = F.regexp_replace(F.trim(F.lower(name)), r"[ \-]+$", "")
    return chain(
        (t.startswith("final") | (t == "f"), "F"),
        ((t == "sf") | _has(t, "semi"), "SF"),
        ((t == "qf") | _has(t, "quarter"), "QF"),
        (_has(t, "16"), "R16"),
        (_has(t, "32"), "R32"),
        (_has(t, "64"), "R64"),
        (_has(t, "128"), "R128"),
        ((t == "rr") | _has(t, "round robin"), "RR"),
        (_has(t, "q1", "1st round qualifying"), "Q1"),
        (_has(t, "q2", "2nd round qualifying"), "Q2"),
        (_has(t, "q3", "3rd round qualifying"), "Q3"),
        (_has(t, "qual") & _has(t, "final"), "Q3"),
        (_has(t, "1st round", "first round"), "R64"),
        (_has(t, "2nd round", "second round"), "R32"),
        (_has(t, "3rd round", "third round"), "R16"),
        (_has(t, "4th round", "fourth round"), "QF"),
        otherwise=F.upper(name),
    )


def normalize_surface(name: Column) -> Column:
    t = F.lower(F.trim(name))
    return chain((_has(t, "hard"), "Hard"), (_has(t, "clay"), "Clay"), (_has(t, "grass"), "Grass"), (_has(t, "carpet"), "Carpet"), otherwise="Hard")


def normalize_level(name: Column, tour: Column) -> Column:
    t, men = F.lower(F.trim(name)), tour == "atp"
    own = lambda a, b: F.when(men, a).otherwise(b)
    return chain(
        (_has(t, "grand slam", "gs"), "Grand Slam"),
        (_has(t, "1000", "masters"), own("Masters 1000", "WTA 1000")),
        (_has(t, "500"), own("ATP 500", "WTA 500")),
        (_has(t, "250"), own("ATP 250", "WTA 250")),
        (_has(t, "125"), "WTA 125"),
        (_has(t, "ch"), "Challenger"),
        (_has(t, "itf", "future"), "ITF"),
        (tour == "itf", "ITF"),
        (tour == "challenger", "Challenger"),
        otherwise=own("ATP 250", "WTA 250"),
    )


def level_code(level: Column, tour: Column) -> Column:
    """Code of a level, with a W in front for women: tour WTA, or a level that starts with WTA or ITF W."""
    base = F.coalesce(look_up(LEVEL_CODES, level), F.lit("A"))
    women = (F.upper(F.coalesce(tour, F.lit(""))) == "WTA") | level.startswith("WTA") | level.startswith("ITF W")
    return F.when(F.coalesce(women, F.lit(False)), F.concat(F.lit("W"), base)).otherwise(base)


def base_code(code: Column) -> Column:
    return F.regexp_replace(code, "^W", "")


def k_factor(code: Column) -> Column:
    return F.coalesce(look_up(RATING_K, base_code(code)), F.lit(RATING_K["A"]))


def s_factor(code: Column) -> Column:
    return F.coalesce(look_up(RATING_S, base_code(code)), F.lit(RATING_S["A"]))


def round_order(code: Column) -> Column:
    return F.coalesce(look_up(ROUND_ORDER, code), F.lit(0))


def temporal_order(date: Column, edition: Column, code: Column) -> Column:
    """``YYYYMMDD * 10**7 + edition % 100000 * 100 + round``; no date is the end of 9999."""
    day = F.coalesce(F.date_format(date, "yyyyMMdd").cast("long"), F.lit(99991231))
    return day * 10_000_000 + F.coalesce(edition, F.lit(0)).cast("long") % 100_000 * 100 + round_order(code)


def order_date(order: Column) -> Column:
    """The date in a temporal order; null for the years from 9999 on and for what is no date."""
    day = F.floor(order / 10_000_000).cast("long")
    return F.when(day < 99_990_000, F.try_to_date(day.cast("string"), "yyyyMMdd"))


def round_date(start: Column, end: Column, code: Column) -> Column:
    """The day of a round, from the tournament's dates; half-way for an unknown round."""
    progress = F.coalesce(look_up(ROUND_PROGRESS, code), F.lit(0.5))
    return F.date_add(start, (F.datediff(end, start) * progress).cast("int"))


def edition_end(start: Column, level: Column) -> Column:
    """Estimated last day: two weeks for a Grand Slam, nine days for a 1000, else a week."""
    return F.date_add(start, chain((level == "Grand Slam", 14), (level.isin("Masters 1000", "WTA 1000"), 9), otherwise=7).cast("int"))


def next_round(code: Column) -> Column:
    return look_up(dict(zip(MAIN_DRAW, MAIN_DRAW[1:], strict=False)), code)


def previous_round(code: Column) -> Column:
    return look_up(dict(zip(MAIN_DRAW[1:], MAIN_DRAW, strict=False)), code)


def next_position(position: Column) -> Column:
    return F.ceil(position / 2).cast("int")


def feeders(position: Column) -> Column:
    return F.array((position * 2 - 1).cast("int"), (position * 2).cast("int"))


def first_round(draw_size: Column) -> Column:
    """First round of a draw of that size, rounded up to a power of two; R128 for any other."""
    power = F.when(draw_size > 1, F.pow(F.lit(2), F.ceil(F.log2(draw_size)))).otherwise(1).cast("int")
    return F.coalesce(look_up({2 * n: r for r, n in ROUND_MATCHES.items()}, power), F.lit("R128"))


def expected_matches(code: Column) -> Column:
    return look_up(ROUND_MATCHES, code)


def tour_of_key(key: Column) -> Column:
    """``struct<tour, gender>`` of a source's tour key."""
    k = F.lower(key)
    tour = chain((k.isin("atp", "challenger", "wta", "wta_125"), F.upper(k)), otherwise="ITF")
    gender = chain((k.isin("wta", "wta_125", "itf_women"), "women"), otherwise="men")
    return F.struct(tour.alias("tour"), gender.alias("gender"))


def expected_gender(source: Column) -> Column:
    """Gender that a source's players have; null where it has both."""
    s = F.lower(source)
    return chain((s.isin("atp", "challenger", "itf_men"), "men"), (s.isin("wta", "wta_125", "itf_women"), "women"))


def tournament_gender(tour: Column, code: Column, name: Column) -> Column:
    """Gender by tour, else by the start of the code, else by the name; null if nothing tells."""
    t = F.upper(tour)
    return chain(
        (t.isin("ATP", "CHALLENGER"), "men"), (t.isin("WTA", "WTA_125", "WTA 125"), "women"),
        (F.lower(code).startswith("m-"), "men"), (F.lower(code).startswith("w-"), "women"),
        (name.rlike(r"(?i)^\s*m\d{2,3}"), "men"), (name.rlike(r"(?i)^\s*w\d{2,3}"), "women"),
    )


def external_id(year: Column, tournament: Column, code: Column, a: Column, b: Column) -> Column:
    """``year_tournament_round_a_b`` with the smaller player id first, upper case; null if a part is missing."""
    return F.upper(F.concat(year.cast("string"), F.lit("_"), tournament, F.lit("_"), code, F.lit("_"), F.least(a, b), F.lit("_"), F.greatest(a, b)))


def pair_key(a: Column, b: Column) -> Column:
    """The same for both orders of two players."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def lock_key(name: Column) -> Column:
    """First eight bytes of the SHA-256, as a signed number."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, -10).cast("long")


def retry_minutes(attempts: Column) -> Column:
    """Five minutes, doubled with each attempt after the first."""
    return (5 * F.pow(F.lit(2), attempts - 1)).cast("long")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[ _]+", "-")


def title(name: Column) -> Column:
    """Words with a capital letter, but particles behind the first."""
    small = F.array(*[F.lit(p) for p in ("de", "del", "van", "von", "da", "di", "la", "le")])
    return F.array_join(F.transform(F.split(F.trim(F.lower(name)), r"\s+"), lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.initcap(w))), " ")


#: Parts of banners, addresses and classes that tell a level, and well-known tournaments by level. Fixed values.
LEVEL_MARKS = {"grandslam": "Grand Slam", "1000": "Masters 1000", "500": "ATP 500", "250": "ATP 250", "challenger": "Challenger", "nextgen": "ATP Finals", "finals": "ATP Finals"}
GRAND_SLAMS = ("australian-open", "roland-garros", "wimbledon", "us-open")
MASTERS = ("indian-wells", "miami", "monte-carlo", "madrid", "rome", "canada", "cincinnati", "shanghai", "paris")
ATP_500 = ("rotterdam", "rio-de-janeiro", "acapulco", "dubai", "barcelona", "washington", "hamburg", "tokyo", "beijing", "vienna", "basel", "queen-s-club", "halle")
#: Tours in the order in which they are gone through. Fixed values.
TOUR_ORDER = ("ATP", "CHALLENGER", "WTA", "WTA_125", "ITF_MEN", "ITF_WOMEN")


def level_mark(*texts: Column) -> Column:
    """The level of the first mark, in their order, that any of the texts holds."""
    return F.coalesce(*[F.when(F.array_contains(F.array(*[F.coalesce(F.lower(t).contains(mark), F.lit(False)) for t in texts]), True), level) for mark, level in LEVEL_MARKS.items()])


def known_level(code: Column) -> Column:
    low = F.lower(code)
    return chain((low.isin(*GRAND_SLAMS), "Grand Slam"), (low.isin(*MASTERS), "Masters 1000"), (low.isin(*ATP_500), "ATP 500"))


def detected_level(banner: Column, code: Column, address: Column, classes: Column, challenger: Column) -> Column:
    """Level by the banner, else by the tournament's code, else by address or classes, else the tour's default."""
    return F.coalesce(level_mark(banner), known_level(code), level_mark(address, classes), F.when(challenger, "Challenger").otherwise("ATP 250"))


def years_of(text: Column) -> Column:
    """Years of ``2024`` or ``2020-2024``, newest first; null for anything else, none for a range that runs backwards."""
    parts = F.regexp_extract(text, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 1).try_cast("int"), F.regexp_extract(text, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 2).try_cast("int")
    last = F.coalesce(parts[1], parts[0])
    return F.when(parts[0].isNull(), None).when(last < parts[0], F.array().cast("array<int>")).otherwise(F.sequence(last, F.least(parts[0], last), F.lit(-1)))


def tours_of(text: Column) -> Column:
    """Known tours among those listed, in the order in which they are gone through; all of them without a list."""
    wanted = F.transform(F.split(F.upper(text), ","), F.trim)
    every = F.array(*[F.lit(t) for t in TOUR_ORDER])
    return F.when(F.coalesce(text, F.lit("")) == "", every).otherwise(F.filter(every, lambda t: F.array_contains(wanted, t)))
