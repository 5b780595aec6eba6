"""Tables out of the page layouts of the sources: archives, results by day, calendars, event lists and orders of play.

A small helper finds a page's elements and gives their raw texts; ids, dates, rounds, levels and filters are expressions on the rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topspin.functions import dates, domain, names
from topspin.functions.scores import parse_score
from topspin.sources.pages import Node, extract


def _classed(root: Node, name: str, tag: str | None = None) -> Iterator[Node]:
    todo = root.children[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            marks = x.attrs.get("class")
            if marks and name in marks and tag in (None, x.tag) and name in marks.split():
                yield x
            todo += x.children[::-1]


def _text(nodes: Iterator[Node]) -> str | None:
    first = next(nodes, None)
    return first.text() if first is not None else None


def _attr(nodes: Iterator[Node], name: str) -> str | None:
    first = next(nodes, None)
    return first.attrs.get(name) if first is not None else None


def _empty_as_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def _archive(root: Node) -> list[tuple]:
    out = []
    for listing in _classed(root, "tournament-list"):
        for events in _classed(listing, "events", "ul"):
            for entry in (c for c in events.children if isinstance(c, Node) and c.tag == "li"):
                out.append((_attr(_classed(entry, "results", "a"), "href"), _attr(_classed(entry, "tournament__profile", "a"), "href"), _text(_classed(entry, "name", "span")), _text(_classed(entry, "venue", "span")), _text(_classed(entry, "Date", "span")), _attr(_classed(entry, "events_banner", "img"), "src")))
    return out


def archive_tournaments(pages: DataFrame, **columns: str) -> DataFrame:
    """Tournaments of an archive page: ``code``, ``number``, ``name``, ``location``, ``level``, ``start_date``, ``end_date``; entries without an address that names one are left out."""
    rows = extract(pages, _archive, "results string, profile string, label string, venue string, days string, banner string", **columns)
    part = lambda k: F.coalesce(_empty_as_null(F.regexp_extract("results", r"/scores/archive/([^/]+)/(\d+)/", k)), _empty_as_null(F.regexp_extract("profile", r"/tournaments/([^/]+)/(\d+)/", k)))
    days = dates.date_range(F.col("days"))
    rows = rows.withColumns({"code": part(1), "number": part(2)}).where(F.col("code").isNotNull())
    return rows.select(
        rows.columns[0], "position", "code", "number", F.coalesce("label", F.initcap(F.replace("code", F.lit("-"), F.lit(" ")))).alias("name"), F.coalesce(F.regexp_replace("venue", r"[\s|]+$", ""), F.lit("")).alias("location"),
        F.coalesce(domain.level_mark(F.col("banner")), F.lit("ATP 250")).alias("level"), days["start"].alias("start_date"), days["end"].alias("end_date"),
    )


def _results(root: Node) -> list[tuple]:
    """Matches with the day they stand under, or without one where the page has no days."""
    days = []
    for day in _classed(root, "tournament-day"):
        header = day.parent
        after = iter([])
        if header is not None and header.parent is not None:
            siblings = header.parent.children
            after = (n for n in siblings[siblings.index(header) + 1 :] if isinstance(n, Node) and "atp_accordion-content" in n.attrs.get("class", "").split())
        content = next(after, None)
        if content is not None:
            days.append((day.text(), content))
    out = []
    for day, content in days or [(None, root)]:
        for match in _classed(content, "match"):
            people = [next(n.find("a"), None) for n in _classed(match, "name")][:2]
            if len(people) < 2 or None in people:
                continue
            sets = [[s.text() for s in item.find("span")] for item in _classed(match, "score-item")]
            half = len(sets) // 2
            score = " ".join(f"{a[0]}-{b[0]}" + (f"({min(a[1:] + b[1:], key=int)})" if all(x.isdigit() for x in a[1:] + b[1:]) and a[1:] + b[1:] else "") for a, b in zip(sets[:half], sets[half:], strict=False) if a and b and a[0] and b[0])
            header = next(_classed(match, "match-header"), None)
            out.append((day, _text(header.find("span")) if header is not None else None, people[0].text(), people[1].text(), people[0].attrs.get("href"), people[1].attrs.get("href"), score, _text(_classed(match, "match-cta"))))
    return out


def results_by_day(pages: DataFrame, **columns: str) -> DataFrame:
    """Results of a page: date, round, both players with seed and id, score and status; the winner stands first. Byes are left out; a match without a score is a walkover."""
    rows = extract(pages, _results, "day string, header string, label_a string, label_b string, href_a string, href_b string, score string, note string", **columns)
    rows = rows.where((F.lower("label_a") != "bye") & (F.lower("label_b") != "bye"))
    person = {f"p_{s}": names.split_seed(F.col(f"label_{s}")) for s in "ab"}
    ids = {f"player_{s}_id": _empty_as_null(F.upper(F.regexp_extract(f"href_{s}", r"/players/[^/]+/([a-zA-Z0-9]+)/", 1))) for s in "ab"}
    note, scored = F.lower(F.coalesce("note", F.lit(""))), F.coalesce("score", F.lit("")) != ""
    status = domain.chain((note.contains("w/o") | note.contains("walkover") | ~scored, "walkover"), (note.contains("ret"), "retired"), otherwise="completed")
    rows = rows.withColumns(person | ids)
    return rows.select(
        rows.columns[0], "position", dates.day_header(F.col("day")).alias("match_date"), domain.normalize_round(F.col("header")).alias("round"), F.initcap("p_a.name").alias("player_a"), F.initcap("p_b.name").alias("player_b"),
        F.col("p_a.seed").alias("seed_a"), F.col("p_b.seed").alias("seed_b"), "player_a_id", "player_b_id", F.when(scored, F.col("score")).otherwise("W/O").alias("score"), status.alias("status"),
    )


def _cards(root: Node) -> list[tuple]:
    out = []
    for card in root.find("li"):
        href = next((a.attrs["href"] for a in card.find("a") if "/tournaments/" in a.attrs.get("href", "")), None)
        if card.attrs.get("data-fav-id") and card.attrs.get("data-fav-name") and href:
            alt = next((i.attrs["alt"].strip() for i in card.find("img") if "alt" in i.attrs), None)
            out.append((card.attrs["data-fav-id"], card.attrs["data-fav-name"], href, alt, _text(card.find(mark="surface")), _text(card.find(mark="location")), next((t.attrs["date-time"] for t in card.find("time") if "date-time" in t.attrs), None)))
    return out


def calendar_cards(pages: DataFrame, year: int, **columns: str) -> DataFrame:
    """Tournaments of a calendar page of that year; those of other years that such a page also shows are left out."""
    rows = extract(pages, _cards, "number string, name string, href string, alt string, ground string, place string, start string", **columns)
    long, short = r"/tournaments/\d+/([^/]+)/(\d+)", r"/tournaments/([a-z][a-z0-9-]+)(?:/|$)"
    code = F.coalesce(_empty_as_null(F.regexp_extract("href", long, 1)), _empty_as_null(F.regexp_extract("href", short, 1)))
    season = F.when(F.col("href").rlike(long), F.regexp_extract("href", long, 2).try_cast("int")).otherwise(year)
    rows = rows.withColumns({"code": code, "year": season}).where(F.col("code").isNotNull() & (F.col("year") == year))
    return rows.select(
        rows.columns[0], "position", "code", "number", "name", F.coalesce(_empty_as_null(F.col("alt")), F.lit("WTA 250")).alias("level"),
        domain.normalize_surface(F.coalesce("ground", F.lit("Hard"))).alias("surface"), F.coalesce("place", F.lit("")).alias("location"), F.try_to_date("start", "yyyy-MM-dd").alias("start_date"), "year",
    )


def _event_rows(root: Node) -> list[tuple]:
    out = []
    for row in root.find("tr"):
        days = next((s.text() for d in _classed(row, "date", "td") for s in _classed(d, "date", "span")), None)
        for a in row.find("a"):
            if "/tournament/" in a.attrs.get("href", ""):
                out.append((a.attrs["href"], _text(_classed(a, "short")) or a.text(), days))
    return out


def event_list(pages: DataFrame, **columns: str) -> DataFrame:
    """Tournaments of a list of events: ``code``, ``name``, ``prize`` (the number behind M or W in name or code), ``start_date``, ``end_date``."""
    rows = extract(pages, _event_rows, "href string, label string, days string", **columns)
    rows = rows.withColumn("code", F.try_element_at(F.filter(F.split("href", "/"), lambda x: x != ""), F.lit(-1)))
    prize = F.coalesce(*[_empty_as_null(F.regexp_extract(c, r"[MW](\d+)", 1)) for c in ("label", "code")]).try_cast("int")
    days = dates.span_with_to(F.col("days"))
    return rows.select(rows.columns[0], "position", "code", F.coalesce(_empty_as_null(F.col("label")), F.col("code")).alias("name"), prize.alias("prize"), days["start"].alias("start_date"), days["end"].alias("end_date"))


def _order(root: Node) -> list[tuple]:
    """Matches of an order of play with their court, start and kind, in page order."""
    out = []
    for court in _classed(root, "court"):
        name = _text(_classed(court, "court-name"))
        for match in (n for n in _classed(court, "tennis-match")):
            people = [n.text() for n in _classed(match, "player")][:2]
            out.append((name, _text(_classed(match, "time")), match.attrs.get("class", ""), people[0] if people else None, people[1] if len(people) > 1 else None))
    return out


def order_of_play(pages: DataFrame, hours: int = 2, **columns: str) -> DataFrame:
    """Singles of an order of play: ``court``, players and ``start`` in hours of the day.

    A match ``followed by`` another starts two hours after it; doubles take their time too, but aren't told.
    """
    rows = extract(pages, _order, "court string, time string, classes string, player_a string, player_b string", **columns)
    key = rows.columns[0]
    known = F.split(dates.clock(F.col("time")), ":")
    rows = rows.withColumn("known", known[0].cast("int") + known[1].cast("int") / 60)
    window = Window.partitionBy(key, "court").orderBy("position")
    rows = rows.withColumn("anchor", F.last("known", ignorenulls=True).over(window)).withColumn("run", F.count("known").over(window))
    place = F.row_number().over(Window.partitionBy(key, "court", "run").orderBy("position")) - 1
    rows = rows.withColumn("start", F.col("anchor") + place * hours)
    return rows.where(F.col("classes").contains("-LS")).select(key, "position", "court", "player_a", "player_b", "start")


def checked(results: DataFrame) -> DataFrame:
    """``results`` whose scores can be read, or that need none."""
    return results.where((F.col("score") == "W/O") | (F.size(parse_score(F.col("score"))["sets"]) > 0))


def _schedule(root: Node) -> list[tuple]:
    """Blocks of a daily schedule: the group they stand in, where and when, the round, and the names and addresses of each side."""
    groups: dict[int, int] = {}
    for number, group in enumerate(_classed(root, "content-group")):
        for n in group.walk():
            groups[id(n)] = number
    out = []
    for block in _classed(root, "schedule", "div"):
        if next(_classed(block, "schedule-header"), None) is None:
            continue
        stamp = next(_classed(block, "schedule-location-timestamp"), None)
        teams = []
        for people in itertools.islice(_classed(block, "schedule-players"), 1):
            for mark in ("player", "opponent"):
                team = next(_classed(people, mark), None)
                links = [a for name in _classed(team, "name") for a in name.find("a")] if team is not None else []
                teams.append((links[0].text(), links[0].attrs.get("href", "")) if len(links) == 1 else (None, None))
        (a, href_a), (b, href_b) = teams if len(teams) == 2 else ((None, None), (None, None))
        court, time = (_text(stamp.find("strong")), _text(_classed(stamp, "matchtime"))) if stamp is not None else (None, None)
        attr = block.attrs.get
        out.append((groups.get(id(block), -1), court, attr("data-matchdate"), attr("data-datetime"), attr("data-suffix"), time or attr("data-displaytime"), _text(_classed(block, "schedule-type")), a, b, href_a, href_b))
    return out


def daily_schedule(pages: DataFrame, hours: int = 2, **columns: str) -> DataFrame:
    """Singles of a daily schedule: ``court``, ``round``, both players with ids, ``scheduled_date`` and ``scheduled_time``.

    Only a group's first block may tell the court. A match that is ``followed by`` another starts two hours after the one before it on its court, on whatever day; doubles take their
    time too, but aren't told.
    """
    rows = extract(pages, _schedule, "part int, place string, day string, stamp string, suffix string, time string, kind string, player_a string, player_b string, href_a string, href_b string", **columns)
    key = rows.columns[0]
    rows = rows.withColumn("court", F.last("place", ignorenulls=True).over(Window.partitionBy(key, "part").orderBy("position")))
    stamp = F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss"))
    told = F.coalesce(dates.clock(F.col("time")), dates.clock(F.regexp_replace("time", r"(?i)^\D*(\d{1,2})\s*([ap]m)", "$1:00 $2")))
    rows = rows.withColumns({"clock": F.coalesce(told, F.date_format(stamp, "HH:mm")), "date": F.coalesce("day", F.when(told.isNull(), F.date_format(stamp, "yyyy-MM-dd")))})
    after = F.lower(F.concat_ws(" ", "suffix", "time")).contains("followed by")
    rows = rows.withColumns({"after": after, "start": F.try_to_timestamp(F.concat_ws(" ", "date", "clock"), F.lit("yyyy-MM-dd HH:mm"))})
    by_court = Window.partitionBy(key, "court").orderBy("position")
    known = F.col("court").isNotNull() & F.col("start").isNotNull()
    rows = rows.withColumn("anchor", known & (~F.col("after") | (F.count(F.when(known, 1)).over(by_court) == 1)))
    rows = rows.withColumns({"run": F.count_if("anchor").over(by_court), "from": F.last(F.when(F.col("anchor"), F.col("start")), ignorenulls=True).over(by_court)})
    later = F.count_if(F.col("after") & ~F.col("anchor")).over(Window.partitionBy(key, "court", "run").orderBy("position"))
    moved = F.col("court").isNotNull() & F.col("after") & ~F.col("anchor") & (F.col("run") > 0)
    rows = rows.withColumn("estimate", F.when(moved, F.col("from") + F.make_interval(hours=(later * hours).cast("int"))))
    ids = {f"player_{s}_external_id": _empty_as_null(F.upper(F.regexp_extract(f"href_{s}", r"/players/[^/]+/([a-zA-Z0-9]+)", 1))) for s in "ab"}
    rows = rows.withColumns(ids).where(F.col("player_a").isNotNull() & F.col("player_b").isNotNull())
    return rows.select(
        key, "position", "court", domain.normalize_round(F.col("kind")).alias("round"), "player_a", "player_b", *ids,
        F.coalesce(F.date_format("estimate", "yyyy-MM-dd"), "date").alias("scheduled_date"), F.coalesce(F.date_format("estimate", "HH:mm"), "clock").alias("scheduled_time"),
    )


def _first_of(root: Node, *tests: Callable[[Node], bool]) -> Node | None:
    return next((n for n in root.walk() if any(t(n) for t in tests)), None)


def _has(*names: str) -> Callable[[Node], bool]:
    return lambda n: not set(names).isdisjoint(n.attrs.get("class", "").split())


def _info(root: Node) -> list[tuple]:
    title = _first_of(root, lambda n: n.tag == "h1", _has("tournament-title", "hero-title"))
    ground = _first_of(root, lambda n: "surface" in n.attrs.get("class", ""), lambda n: n.tag == "span" and n.parent is not None and _has("info-area")(n.parent))
    place = _first_of(root, _has("location", "tournament-location", "info-area"))
    pairs = [[s.text() for s in li.find("span")] for side in ("td_left", "td_right") for ul in _classed(root, side, "ul") for li in ul.find("li")]
    pairs = [(p[0].lower(), p[1]) for p in pairs if len(p) >= 2]
    surface = ground.text() if ground is not None else next((v for k, v in pairs if "surface" in k), None)
    location = place.text() if place is not None else next((v for k, v in pairs if "location" in k or "city" in k), None)
    banner = _first_of(root, _has("events_banner", "tourney-badge"), lambda n: n.tag == "img" and "banner" in n.attrs.get("src", ""))
    return [(title.text() if title is not None else None, surface, location, banner.attrs.get("src", "") if banner is not None else None, root.text())]


def tournament_info(pages: DataFrame, code_column: str = "code", **columns: str) -> DataFrame:
    """A tournament's page: ``name``, ``level``, ``surface``, ``location``; ``code_column`` tells the tournament.

    The level is the banner's; without a banner that of the page's words, unless the tournament is one that is known.
    """
    rows = extract(pages, _info, "title string, ground string, place string, banner string, words string", **columns)
    key = rows.columns[0]
    code = F.col(code_column)
    rows = rows.join(pages.select(key, code), key)
    first, words = domain.detected_level(F.lit(None).cast("string"), code, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)), F.lower("words")
    said = domain.chain(
        (words.contains("grand slam"), "Grand Slam"), (words.contains("masters 1000") | words.contains("atp masters"), "Masters 1000"), (words.contains("atp 500"), "ATP 500"),
        (words.contains("challenger") & (first == "ATP 250"), "Challenger"),
    )
    level = F.when(F.col("banner").isNotNull(), F.coalesce(domain.level_mark(F.col("banner")), first)).otherwise(F.coalesce(said, first))
    return rows.select(
        key, F.coalesce(_empty_as_null(F.col("title")), F.initcap(F.replace(code, F.lit("-"), F.lit(" ")))).alias("name"), level.alias("level"),
        domain.normalize_surface(F.coalesce("ground", F.lit("Hard"))).alias("surface"), F.coalesce("place", F.lit("")).alias("location"),
    )


def _old_archive(root: Node) -> list[tuple]:
    out = []
    for row in (n for n in root.walk() if _has("tourney-result", "tournament-row")(n)):
        href = next((a.attrs["href"] for a in row.find("a") if re.search("/scores/archive/|/tournaments/", a.attrs.get("href", ""))), None)
        named = lambda *names, row=row: (n := _first_of(row, _has(*names))) and n.text()
        title = _first_of(row, _has("tourney-title", "tournament-name"), lambda n: n.tag in ("h3", "h4"))
        ground = _first_of(row, _has("tourney-details"), lambda n: "surface" in n.attrs.get("class", ""))
        banner = _first_of(row, lambda n: n.tag == "img")
        if href:
            out.append((href, title.text() if title is not None else None, named("tourney-location", "location"), ground.text() if ground is not None else None, named("tourney-dates", "dates"), banner.attrs.get("src", "") if banner is not None else None, row.attrs.get("class", "")))
    return out


def old_archive(pages: DataFrame, challenger: bool = False, **columns: str) -> DataFrame:
    """Tournaments of an archive page of the older layout, whose dates are written year first: the columns of ``archive_tournaments()`` and ``surface``."""
    rows = extract(pages, _old_archive, "href string, title string, place string, ground string, days string, banner string, classes string", **columns)
    whole, short = r"/scores/archive/([^/]+)/(\d+)/\d+/results", r"/(?:scores/archive|tournaments)/([^/]+)"
    code = F.coalesce(_empty_as_null(F.regexp_extract("href", whole, 1)), _empty_as_null(F.regexp_extract("href", short, 1)))
    day = lambda k: F.try_to_date(F.regexp_replace(F.try_element_at(F.regexp_extract_all("days", F.lit(r"(\d{4}[-./]\d{2}[-./]\d{2})"), F.lit(1)), F.lit(k)), "[./]", "-"), "yyyy-MM-dd")
    rows = rows.withColumn("code", code).where(F.col("code").isNotNull())
    return rows.select(
        rows.columns[0], "position", "code", _empty_as_null(F.regexp_extract("href", whole, 2)).alias("number"), F.coalesce("title", F.initcap(F.replace("code", F.lit("-"), F.lit(" ")))).alias("name"), F.coalesce("place", F.lit("")).alias("location"),
        domain.detected_level(F.col("banner"), F.col("code"), F.col("href"), F.col("classes"), F.lit(challenger)).alias("level"), domain.normalize_surface(F.coalesce("ground", F.lit("Hard"))).alias("surface"), day(1).alias("start_date"), day(2).alias("end_date"),
    )


def _labelled(root: Node) -> list[tuple]:
    out = []
    for details in _classed(root, "personal_details", "div"):
        out += [(spans[0], spans[1]) for li in details.find("li") if len(spans := [s.text() for s in li.find("span")]) >= 2]
    for block in _classed(root, "profile-bio__info-block", "div"):
        label, value = _text(_classed(block, "profile-bio__info-title")), _text(_classed(block, "profile-bio__info-content"))
        if label is not None and value is not None:
            out.append((label, value))
    return out


def profile_fields(pages: DataFrame, **columns: str) -> DataFrame:
    """A player's page by its labelled fields: ``birth_date`` (behind the age), ``height_cm``, ``turned_pro_year``, ``hand``, ``backhand`` and ``nationality`` (the country, else the end of the birthplace)."""
    rows = extract(pages, _labelled, "label string, value string", **columns)
    key = rows.columns[0]
    of = lambda label: F.max_by(F.when(F.col("label") == label, F.col("value")), F.when(F.col("label") == label, F.col("position")))
    each = rows.groupBy(key).agg(*[of(n).alias(n) for n in ("Age", "Height", "Turned pro", "Plays", "Country", "Birthplace")])
    part = lambda c, form: _empty_as_null(F.regexp_extract(c, form, 1))
    plays, metres = F.lower("Plays"), part("Height", r"\((\d+\.\d+)m\)").try_cast("double")
    found = each.select(
        key, F.try_to_date(part("Age", r"\((\d{4}/\d{2}/\d{2})\)"), "yyyy/MM/dd").alias("birth_date"), F.coalesce(part("Height", r"\((\d+)cm\)").try_cast("int"), F.round(metres * 100).cast("int")).alias("height_cm"),
        part("Turned pro", r"(\d{4})").try_cast("int").alias("turned_pro_year"), domain.chain((plays.contains("right"), "Right"), (plays.contains("left"), "Left")).alias("hand"),
        domain.chain((plays.contains("two-handed"), "Two-Handed"), (plays.contains("one-handed"), "One-Handed")).alias("backhand"),
        F.coalesce(_empty_as_null(F.col("Country")), F.when(F.col("Birthplace").contains(","), _empty_as_null(F.trim(F.regexp_extract("Birthplace", r"([^,]*)$", 1))))).alias("nationality"),
    )
    return pages.select(key).distinct().join(found, key, "left")
