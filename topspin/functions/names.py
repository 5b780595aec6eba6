"""Names as columns. Accents and similarity need Python (Arrow batches); all else is built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topspin.schema import LIKELY_MATCH

PARTICLES = ("de", "del", "van", "von", "da", "di", "la", "le")
#: Name suffixes in the order in which they are taken off, each at most once. Fixed values.
SUFFIXES = (" jr.", " jr", " sr.", " sr", " iii", " ii", " iv")


@F.pandas_udf(T.StringType())
def _plain(names: pd.Series) -> pd.Series:
    """Lower case without combining marks; pure ASCII needs no decomposition."""
    low = names.str.lower().str.strip()
    return low.map(lambda n: n if n is None or n.isascii() else "".join(c for c in unicodedata.normalize("NFD", n) if unicodedata.category(c) != "Mn"))


def normalize_name(name: Column) -> Column:
    """Lower case without accents, ``last, first`` turned, suffixes off, single blanks; null counts as empty."""
    out = _plain(F.coalesce(name, F.lit("")))
    comma = F.instr(out, ",")
    out = F.when(comma > 0, F.concat(F.trim(F.substr(out, comma + 1)), F.lit(" "), F.trim(F.substr(out, F.lit(1), comma - 1)))).otherwise(out)
    for suffix in SUFFIXES:
        out = F.regexp_replace(out, suffix.replace(".", r"\.") + "$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def initials(normalized: Column) -> Column:
    return F.array_join(F.transform(tokens(normalized), lambda t: F.substring(t, 1, 1)), "")


def is_abbreviated(normalized: Column) -> Column:
    """Two words or more, the first a single letter but for dots."""
    return normalized.rlike(r"^\S\.* \S")


def last_name(normalized: Column) -> Column:
    """The last word, with the particle before it if there are three words or more."""
    words = tokens(normalized)
    last, before = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2))
    return F.when(F.size(words) == 0, "").when((F.size(words) >= 3) & before.isin(*PARTICLES), F.concat_ws(" ", before, last)).otherwise(last)


def search_variants(normalized: Column) -> Column:
    """The full name, initial and last word, last word, and both turned orders, without repeats, sorted."""
    words = tokens(normalized)
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    rest = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    more = F.array(normalized, F.concat_ws(" ", F.substring(first, 1, 1), last), last, F.concat_ws(" ", last, first), F.concat_ws(" ", last, rest))
    return F.array_sort(F.array_distinct(F.when(F.size(words) >= 2, more).otherwise(F.array(normalized))))


def split_seed(name: Column) -> Column:
    """``struct<name, seed>``: a number in brackets before or behind the name; entry marks such as [WC] go."""
    before, behind = r"^[\(\[](\d+)[\)\]]\s*(.+)$", r"^(.+?)\s*[\(\[](\d+)[\)\]]$"
    clean = F.trim(F.regexp_replace(name, r"(?i)\s*[\(\[](?:WC|Q|LL|PR|SE|ALT)[\)\]]", ""))
    seed = F.when(name.rlike(before), F.regexp_extract(name, before, 1)).when(name.rlike(behind), F.regexp_extract(name, behind, 2)).try_cast("int")
    own = F.when(name.rlike(before), F.trim(F.regexp_extract(name, before, 2))).when(name.rlike(behind), F.trim(F.regexp_extract(name, behind, 1))).otherwise(clean)
    return F.struct(own.alias("name"), seed.alias("seed"))


def trigrams(text: Column) -> Column:
    """The different trigrams of a text's words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all of both; 0 where neither has any."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with Winkler's bonus of a tenth for each of up to four equal first letters (from 0.7 on)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, found = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                found.append(x)
                break
    if not found:
        return 0.0
    m = len(found)
    moved = sum(x != y for x, y in zip(found, (y for y, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for y in b:
        u = state & where.get(y, 0)
        state = (state + u | state - u) & full
    return (full & ~state).bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Share of letters that need neither be put in nor taken out."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one that is no longer than it."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 1.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    letters = set(short)
    return max((indel_ratio(short, w) for w in windows if w and (w[0] in letters or w[-1] in letters)), default=0.0)


def name_similarity(a: str, b: str) -> float:
    """The best of Jaro-Winkler, sorted-word and partial ratio of two normalised names, plus 0.15 if one first name is the
    initial of the other and the last words are equal; equal names have 1, an empty one 0."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    left, right = a.split(), b.split()
    best = max(jaro_winkler(a, b), indel_ratio(" ".join(sorted(left)), " ".join(sorted(right))), partial_ratio(a, b))
    if len(left) >= 2 and len(right) >= 2 and left[-1] == right[-1]:
        x, y = left[0].rstrip("."), right[0].rstrip(".")
        if (len(x) == 1 and y.startswith(x)) or (len(y) == 1 and x.startswith(y)):
            best += 0.15
    return min(1.0, best)


@F.pandas_udf(T.DoubleType())
def compare_names(a: pd.Series, b: pd.Series) -> pd.Series:
    """``name_similarity`` of normalised names; null counts as empty."""
    return pd.Series([name_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])


def same_person(a: Column, b: Column, threshold: float = LIKELY_MATCH) -> Column:
    """Whether two normalised names are that similar."""
    return compare_names(a, b) >= threshold


def first_name(normalized: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_element_at(tokens(normalized), F.lit(1)), F.lit("")), r"\.+$", "")


def fuller(short: Column, full: Column) -> Column:
    """Whether ``full`` is what ``short`` abbreviates: the same last name, and a first name that starts with its initial."""
    return is_abbreviated(short) & ~is_abbreviated(full) & (last_name(short) == last_name(full)) & first_name(full).startswith(first_name(short))
