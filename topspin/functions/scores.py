"""Score strings as columns: parsing, winners, margins and display. All of it is built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SET = r"^(\d+)-(\d+)(?:\((\d+)(?:-(\d+))?\))?$"
#: Endings that tell of a retirement; the first that fits is taken off. Fixed values.
_RETIRED = (r"(?i)\s*ret\.?\s*$", r"(?i)\s*retired\.?\s*$", r"(?i)\s*r\.?\s*$", r"(?i)\s*\(ret\)\.?\s*$")
_WALKOVER, _DEFAULT = ("w/o", "wo", "walkover", "w.o.", "w.o"), ("def", "default", "def.")


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` mentions it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def is_walkover(score: Column) -> Column:
    return F.lower(F.trim(score)).isin(*_WALKOVER)


def is_default(score: Column) -> Column:
    return F.lower(F.trim(score)).isin(*_DEFAULT)


def is_retired(score: Column) -> Column:
    return F.array_contains(F.array(*[score.rlike(p) for p in _RETIRED]), True)


def set_tokens(score: Column) -> Column:
    """The tokens of a score that are sets; everything else is dropped."""

    def without_ending(text: Column) -> Column:
        out = F.when(text.rlike(_RETIRED[0]), F.regexp_replace(text, _RETIRED[0], ""))
        for p in _RETIRED[1:]:
            out = out.when(text.rlike(p), F.regexp_replace(text, p, ""))
        return out.otherwise(text)

    text = bind(F.trim(score), without_ending)
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"\[(\d+-\d+)\]", "$1")), r"\s+"), lambda t: t.rlike(_SET))


def _set(token: Column) -> Column:
    def of(n: Column) -> Column:
        a, b, first, second = (F.get(n, F.lit(k)) for k in range(4))
        other = F.greatest(F.lit(7), first + 2)
        tie = first.isNotNull()
        tb_a = F.when(second.isNotNull() | (a <= b), first).otherwise(other)
        tb_b = F.when(second.isNotNull(), second).when(a > b, first).otherwise(other)
        return F.struct(
            a.alias("a"), b.alias("b"), F.when(tie, tb_a).alias("tb_a"), F.when(tie, tb_b).alias("tb_b"),
            tie.alias("is_tiebreak"), (~tie & ((a >= 10) | (b >= 10))).alias("is_super"),
        )

    return bind(F.transform(F.split(token, r"\D+"), lambda x: x.try_cast("int")), of)


def sets(score: Column) -> Column:
    """``array<struct<a, b, tb_a, tb_b, is_tiebreak, is_super>>``; empty for a walkover, a default and what isn't a score."""
    return F.transform(set_tokens(score), _set)


def sets_won(parsed: Column, by_a: bool) -> Column:
    return F.size(F.filter(parsed, lambda s: (s["a"] > s["b"]) if by_a else (s["b"] > s["a"])))


def winner(parsed: Column, retired: Column) -> Column:
    """A or B: two sets and more than the other; after a retirement who leads in sets, then in the last set, then A. Else null."""

    def of(x: Column) -> Column:
        a, b, last = x["a"], x["b"], x["last"]
        led = F.when(a > b, "A").when(b > a, "B").when(last["a"] > last["b"], "A").when(last["b"] > last["a"], "B").otherwise("A")
        return F.when((a >= 2) & (a > b), "A").when((b >= 2) & (b > a), "B").when(x["retired"] & last.isNotNull(), led)

    return bind(F.struct(sets_won(parsed, True).alias("a"), sets_won(parsed, False).alias("b"), F.try_element_at(parsed, F.lit(-1)).alias("last"), retired.alias("retired")), of)


def parse_score(score: Column) -> Column:
    """``struct<sets, winner, status, retirement_set>``, null where ``score`` is null, empty or no score."""

    def of(x: Column) -> Column:
        parsed, none = x["sets"], F.lit(None).cast("int")
        flat = F.struct(F.slice(parsed, 1, 0).alias("sets"), F.lit("A").alias("winner"), F.when(x["walkover"], "walkover").otherwise("default").alias("status"), none.alias("retirement_set"))
        played = F.struct(parsed.alias("sets"), winner(parsed, x["retired"]).alias("winner"), F.when(x["retired"], "retired").otherwise("completed").alias("status"), F.when(x["retired"], F.size(parsed)).alias("retirement_set"))
        return F.when(x["walkover"] | x["default"], flat).when(F.size(parsed) > 0, played)

    return bind(F.struct(sets(score).alias("sets"), is_walkover(score).alias("walkover"), is_default(score).alias("default"), is_retired(F.trim(score)).alias("retired")), of)


def to_structured(parsed: Column) -> Column:
    """The stored form of a parsed score: ``array<struct<a, b, tb_a, tb_b, retired>>``."""
    return bind(parsed, lambda p: F.transform(p["sets"], lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["tb_a"].alias("tb_a"), s["tb_b"].alias("tb_b"), F.when((p["status"] == "retired") & (p["retirement_set"] == i + 1), True).alias("retired"))))


def display(parsed: Column) -> Column:
    """A parsed score as text; a tie-break shows the loser's points."""

    def of(p: Column) -> Column:
        tie = lambda s: F.when(s["is_tiebreak"], F.concat(F.lit("("), F.least(s["tb_a"], s["tb_b"]).cast("string"), F.lit(")"))).otherwise("")
        text = F.array_join(F.transform(p["sets"], lambda s: F.concat(s["a"].cast("string"), F.lit("-"), s["b"].cast("string"), tie(s))), " ")
        return F.when(p["status"] == "walkover", "W/O").when(p["status"] == "default", "DEF").when(p["status"] == "retired", F.concat(text, F.lit(" RET"))).otherwise(text)

    return bind(parsed, of)


def flip(score: Column) -> Column:
    """A score seen from the other side, set by set; the points of a tie-break stay."""
    return F.array_join(F.transform(F.split(score, r"\s+"), lambda t: F.regexp_replace(t, r"^(\d+)-(\d+)(\(\d+\))?$", "$2-$1$3")), " ")


def games(structured: Column, of_a: bool) -> Column:
    side = "a" if of_a else "b"
    return F.aggregate(structured, F.lit(0), lambda acc, s: acc + F.coalesce(s[side], F.lit(0)))


def dominance(structured: Column, winner_is_a: Column) -> Column:
    """Games won less games lost by the winner, over all games; a half without games."""

    def of(x: Column) -> Column:
        won, lost = F.when(winner_is_a, x["a"]).otherwise(x["b"]), F.when(winner_is_a, x["b"]).otherwise(x["a"])
        return F.when(F.coalesce(x["a"] + x["b"], F.lit(0)) == 0, 0.5).otherwise((won - lost) / (x["a"] + x["b"]))

    return bind(F.struct(games(structured, True).alias("a"), games(structured, False).alias("b")), of)


def margin_multiplier(structured: Column, winner_is_a: Column, base: float = 0.85, scale: float = 0.3) -> Column:
    """``base + dominance * scale`` within 0.5 and 2, half-even at four places; 1 without a score."""
    exact = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.lit(base) + dominance(structured, winner_is_a) * scale))
    return F.when(F.coalesce(F.size(structured), F.lit(0)) <= 0, 1.0).otherwise(F.bround(exact.cast("decimal(20,12)"), 4).cast("double"))


def unfinished_last_set(score: Column) -> Column:
    """Whether the last set of a score stands below six games on both sides: a retirement that isn't marked."""
    last = F.try_element_at(F.split(F.trim(score), r"\s+"), F.lit(-1))
    a, b = (F.regexp_extract(last, r"^(\d+)-(\d+)", k).try_cast("int") for k in (1, 2))
    return F.coalesce((a < 6) & (b < 6), F.lit(False))


def compressed_sets(score: Column) -> Column:
    """Sets in which a tie-break's points stand right behind the games (``64 7-64``): games are the first digit of each side."""
    return F.transform(F.split(F.trim(score), r"\s+"), lambda t: F.regexp_replace(t, r"^(\d)-?(\d)(\d*)$", "$1-$2"))


def _sets(a: Column, b: Column, one: Callable[[Column, Column], Column]) -> Column:
    """The sets that both sides have, joined by blanks."""
    n = F.least(F.size(a), F.size(b))
    return F.array_join(F.transform(F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b")), lambda x: one(x["a"], x["b"])), " ")


def compressed_score(a: Column, b: Column) -> Column:
    """A score of two lists of cells in which a lost tie-break's points stand right behind the games (``64`` against ``7``: 6-7(4)); cells without a digit stay as they are."""

    def one(x: Column, y: Column) -> Column:
        return bind(F.struct(x.alias("x"), y.alias("y"), *[F.regexp_replace(c, r"\D", "").alias(n) for c, n in ((x, "a"), (y, "b"))]), cells)

    def cells(of: Column) -> Column:
        x, y, da, db = (of[n] for n in ("x", "y", "a", "b"))
        lost = lambda own, other: own.rlike(r"^6\d+$") & (other == "7")
        points = lambda own: F.concat(F.lit("("), F.substr(own, F.lit(2)), F.lit(")"))
        return (
            F.when((da == "") | (db == ""), F.concat(x, F.lit("-"), y)).when(lost(da, db), F.concat(F.lit("6-7"), points(da)))
            .when(lost(db, da), F.concat(F.lit("7-6"), points(db))).otherwise(F.concat(da, F.lit("-"), db))
        )

    return _sets(a, b, one)


def item_score(items: Column) -> Column:
    """A score of result items: first one side's sets, then the other's; games are a cell's first character, a tie-break stands in brackets. Empty where the sides can't be told apart."""
    points = lambda x: F.regexp_extract(x, r"\((\d+)\)", 1)
    tie = lambda x, y: F.when(points(x) != "", points(x)).when(points(y) != "", points(y))
    one = lambda x, y: F.concat(F.substring(x, 1, 1), F.lit("-"), F.substring(y, 1, 1), F.coalesce(F.concat(F.lit("("), tie(x, y), F.lit(")")), F.lit("")))

    def told(full: Column) -> Column:
        half = (F.size(full) / 2).cast("int")
        return F.when((F.size(full) > 0) & (F.size(full) % 2 == 0), _sets(F.slice(full, F.lit(1), half), F.slice(full, half + 1, half), one)).otherwise("")

    return bind(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != ""), told)


def cell_score(a: Column, b: Column) -> Column:
    """A score of two lists of table cells ``games`` or ``games tiebreak`` (as structs ``games``, ``points``): the points of the first side that shows some."""
    one = lambda x, y: F.concat(x["games"], F.lit("-"), y["games"], F.coalesce(F.concat(F.lit("("), F.coalesce(x["points"], y["points"]), F.lit(")")), F.lit("")))
    return _sets(a, b, one)
