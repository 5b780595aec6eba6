"""Draw pages and player elements.

A draw page shows a bracket as nested boxes: a column for each round, a box for each match, from top to bottom. A helper gives the boxes' raw texts; rounds,
ids, seeds, byes and the check of feeders are expressions and joins on the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topspin.functions import domain, names
from topspin.sources.layouts import _classed, _empty_as_null, _text
from topspin.sources.pages import Node, between_markers, extract, match_rows, parse


def _boxes(root: Node) -> list[tuple]:
    out = []
    for column in _classed(root, "draw"):
        header = _text(_classed(column, "draw-header"))
        if header is None:
            continue
        for position, box in enumerate(_classed(column, "draw-item"), 1):
            items = list(_classed(box, "stats-item"))[:2]
            if len(items) < 2:
                continue
            row = [header, position]
            for item in items:
                info = next(_classed(item, "player-info"), None)
                label = next(_classed(info, "name"), None) if info is not None else None
                link = next(label.find("a"), None) if label is not None else None
                sets = [[s.text() for s in x.find("span")] for scores in _classed(item, "scores") for x in _classed(scores, "score-item")]
                row += [
                    link.text() if link is not None else "Bye" if label is not None and "bye" in label.text().lower() else None, link.attrs.get("href") if link is not None else None,
                    _text(label.find("span")) if label is not None else None, link is not None and next(_classed(info, "winner"), None) is not None, "|".join(",".join(s) for s in sets if s and s[0]),
                ]
            out.append(tuple(row))
    return out


def draw_page(pages: DataFrame, **columns: str) -> DataFrame:
    """The boxes of draw pages: ``round``, ``draw_position`` (from 1, top down), both players with id and seed, ``winner`` (their name), ``score`` and ``is_bye``.

    The player of a bye stands first. Boxes without a player are left out, but count as positions. The score has what both sides show of each set, with the loser's points of a tie-break.
    """
    side = lambda s: f"label_{s} string, href_{s} string, note_{s} string, won_{s} boolean, sets_{s} string"
    rows = extract(pages, _boxes, f"header string, draw_position int, {side('a')}, {side('b')}", **columns)
    bye_a, bye_b = (F.coalesce(F.lower(f"label_{s}") == "bye", F.lit(False)) for s in "ab")
    for s in "ab":
        rows = rows.withColumns({
            f"player_{s}": F.initcap(f"label_{s}"), f"player_{s}_external_id": _empty_as_null(F.upper(F.regexp_extract(f"href_{s}", r"/players/[^/]+/([a-zA-Z0-9]+)/", 1))),
            f"player_{s}_seed": _empty_as_null(F.regexp_extract(f"note_{s}", r"\((\d+)\)", 1)).try_cast("int"), f"list_{s}": F.filter(F.split(F.coalesce(f"sets_{s}", F.lit("")), r"\|"), lambda x: x != ""),
        })
    part = lambda x, k: F.try_element_at(F.split(x, ","), F.lit(k))

    def one_set(pair):
        a, b = pair["list_a"], pair["list_b"]
        ties = F.array_compact(F.array(part(a, 2).try_cast("int"), part(b, 2).try_cast("int")))
        return F.concat(part(a, 1), F.lit("-"), part(b, 1), F.when(F.size(ties) > 0, F.concat(F.lit("("), F.array_min(ties).cast("string"), F.lit(")"))).otherwise(""))

    both = F.filter(F.arrays_zip("list_a", "list_b"), lambda p: p["list_a"].isNotNull() & p["list_b"].isNotNull())
    bye = bye_a | bye_b
    swap = lambda c: F.when(bye_a, F.col(c.format("b"))).otherwise(F.col(c.format("a")))
    only = lambda c: F.when(~bye, F.col(c))
    rows = rows.where(bye | F.col("label_a").isNotNull() | F.col("label_b").isNotNull())
    return rows.select(
        rows.columns[0], domain.normalize_round(F.col("header")).alias("round"), "draw_position", *[swap(f"player_{{}}{c}").alias(f"player_a{c}") for c in ("", "_external_id", "_seed")],
        *[only(f"player_b{c}").alias(f"player_b{c}") for c in ("", "_external_id", "_seed")], F.when(bye, None).when(F.col("won_a"), F.col("player_a")).when(F.col("won_b"), F.col("player_b")).alias("winner"),
        _empty_as_null(F.when(~bye, F.array_join(F.transform(both, one_set), " "))).alias("score"), bye.alias("is_bye"),
    )


def fed(entries: DataFrame, page: str = "page_id") -> DataFrame:
    """``entries`` of ``draw_page()`` with ``next_round``, ``next_position`` and ``fits``: whether who comes on (winner or bye) stands on the right side of the next slot. Odd slots feed the first side.

    ``fits`` is null while nobody comes on or the next slot's side is open. A lone player of a first round whose next slot has that player is a bye, too.
    """
    following = entries.select(page, F.col("round").alias("next_round"), F.col("draw_position").alias("next_position"), F.col("player_a").alias("_a"), F.col("player_b").alias("_b"))
    # parsed pages are larger than Spark takes them to be from their source: shuffled, as a broadcast of them would pass through the driver
    following = following.hint("shuffle_hash")
    rows = entries.withColumns({"next_round": domain.next_round(F.col("round")), "next_position": domain.next_position(F.col("draw_position")).cast("int")})
    rows = rows.join(following, [page, "next_round", "next_position"], "left")
    there = F.when(F.col("draw_position") % 2 == 1, F.col("_a")).otherwise(F.col("_b"))
    first = Window.partitionBy(page)
    depth = F.min(domain.round_order(F.col("round"))).over(first)
    alone = F.coalesce("player_a", "player_b")
    lone = (F.col("player_a").isNull() != F.col("player_b").isNull()) & (there == alone) & (domain.round_order(F.col("round")) == depth)
    rows = rows.withColumn("is_bye", F.col("is_bye") | F.coalesce(lone, F.lit(False)))
    on = F.when(F.col("is_bye"), alone).otherwise(F.col("winner"))
    return rows.withColumn("fits", there == on).select(*entries.columns, "next_round", "next_position", "fits")


def _titled(root: Node, title: str) -> list[tuple]:
    out = []
    for n in root.walk():
        if title in n.attrs.get("class", "").split():
            out.append((n.text(), *[None] * 6))
        elif n.tag == "table" and "match-table" in n.attrs.get("class", ""):
            holder = Node("", {}, None)
            holder.children.append(n)
            out += [(None, *row) for row in match_rows(holder)]
    return out


def round_tables(pages: DataFrame, title: str = "tournament-draw__round-title", **columns: str) -> DataFrame:
    """Match tables of pages that only tell the round by headings in between: each belongs to the last heading before it, wherever both are nested. Tables before the first heading are left out."""
    side = "player_a string, player_b string, player_a_external_id string, player_b_external_id string, winner string, score string"
    rows = extract(pages, lambda root: _titled(root, title), f"heading string, {side}", **columns)
    page = rows.columns[0]
    rows = between_markers(rows, page, "position", F.col("heading").isNotNull())
    heads = rows.where("heading IS NOT NULL").select(page, "section", domain.normalize_round(F.col("heading")).alias("round"))
    tables = rows.where("heading IS NULL AND player_a IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy(page, "section").orderBy("position")))
    return tables.join(heads, [page, "section"]).select(page, "round", "place", *[c.split()[0] for c in side.split(", ")])


# Player elements

PERSON = "name string, external_id string, nationality string, seed int, profile_url string"
Person = tuple[str, str | None, str | None, int | None, str | None]


def _whole(url: str | None, site: str) -> str | None:
    return url if url is None or url.startswith("http") else site + url


def _linked(element: Node, path: str, number: str, site: str) -> tuple[Node, str | None, str | None] | None:
    link = next((a for a in element.find("a") if path in a.attrs.get("href", "")), None)
    if link is None:
        return None
    href = link.attrs.get("href", "")
    found = re.search(number, href)
    return link, found[1] if found else None, _whole(href, site)


def _turned(name: str) -> str:
    last, comma, first = name.partition(",")
    return f"{first.strip()} {last.strip()}" if comma else name


def _atp(element: Node) -> Person | None:
    link = next((a for a in element.find("a") if re.search("player|name", a.attrs.get("class", ""), re.I)), None) or next((a for a in element.find("a") if "/players/" in a.attrs.get("href", "")), None)
    if link is None:
        return _plain(element)
    href = link.attrs.get("href", "")
    number = re.search(r"/players/[^/]+/([A-Z0-9]+)", href)
    flag = next((i for i in element.find("img") if re.search("flag|country", i.attrs.get("class", ""), re.I)), None)
    country = None
    if flag is not None:
        code = re.search(r"flag-([A-Z]{3})", flag.attrs.get("class", ""), re.I)
        country = code[1].upper() if code else flag.attrs.get("alt", "")[:3].upper() or None
    seed = re.search(r"\d+", next((n.text() for n in element.walk() if re.search("seed", n.attrs.get("class", ""), re.I)), ""))
    return link.text(), number[1] if number else None, country, int(seed[0]) if seed else None, _whole(href, "https://www.atptour.com")


def _wta(element: Node) -> Person | None:
    found = _linked(element, "/players/", r"/players/[^/]+/(\d+)", "https://www.wtatennis.com")
    return (found[0].text(), found[1], None, None, found[2]) if found else _plain(element)


def _itf(element: Node) -> Person | None:
    found = _linked(element, "/player/", r"/player/(\d+)/", "https://www.itftennis.com")
    if not found:
        plain = _plain(element)
        return (_turned(plain[0]), *plain[1:]) if plain else None
    country = next((n.text() for n in element.walk() if re.search("nationality|country", n.attrs.get("class", ""), re.I)), "")
    return _turned(found[0].text()), found[1], country.upper() if len(country) == 3 and country.isalpha() else None, None, found[2]


def _odds(element: Node) -> Person | None:
    text = re.sub(r"\s*\d+\.\d+\s*$", "", element.text())
    return (text, None, None, None, None) if text else None


def _plain(element: Node) -> Person | None:
    text = element.text()
    return (text, None, None, None, None) if text else None


def _generic(element: Node) -> Person | None:
    link = next(element.find("a"), None)
    return (link.text(), None, None, None, link.attrs.get("href")) if link is not None and link.text() else _plain(element)


#: How to read a player element, by its source; sources that aren't here are read by links and text.
EXTRACTORS: dict[str, Callable[[Node], Person | None]] = {"atp": _atp, "wta": _wta, "itf": _itf, "sportsbet": _odds}


def person(html: str | None, source: str | None) -> Person | None:
    return EXTRACTORS.get((source or "").lower(), _generic)(parse(html))


@F.udtf(returnType=PERSON)
class PlayerElement:
    """``player_element(html, source)`` for ``LATERAL``: the player that an element tells of, or no row."""

    def eval(self, html: str | None, source: str | None) -> Iterator[Person]:
        found = person(html, source)
        if found:
            yield found


def register(spark: SparkSession) -> None:
    """Make ``player_element`` known to SQL."""
    spark.udtf.register("player_element", PlayerElement)


def player_elements(elements: DataFrame, id_column: str = "id", html_column: str = "html", source_column: str = "source") -> DataFrame:
    """``(id_column, source, name, external_id, nationality, seed, profile_url, name_seed)``: players of elements of any sources; a seed in the name counts where there is no other."""
    register(elements.sparkSession)
    elements.select(F.col(id_column).alias("id"), F.col(html_column).alias("html"), F.col(source_column).alias("source")).createOrReplaceTempView("player_element_rows")
    rows = elements.sparkSession.sql("SELECT e.id, e.source, p.* FROM player_element_rows e, LATERAL player_element(e.html, e.source) p")
    split = names.split_seed(F.col("name"))
    return rows.select(F.col("id").alias(id_column), "source", split["name"].alias("name"), "external_id", "nationality", F.coalesce("seed", split["seed"]).alias("seed"), "profile_url")
