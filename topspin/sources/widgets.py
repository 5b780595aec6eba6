"""Draws and schedules made of widgets: a block for each match with two team parts, in containers for rounds or courts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topspin.functions import dates, domain
from topspin.functions.scores import compressed_score
from topspin.sources.layouts import _classed, _empty_as_null, _text
from topspin.sources.pages import Node, extract

_SIDE = "label_{0} string, href_{0} string, flag_{0} string, seeding_{0} string, cells_{0} string, won_{0} boolean"


def _team(team: Node | None, kind: str) -> tuple:
    """Name, address, flag, seeding, cells of sets and whether it is the winner."""
    if team is None:
        return None, None, None, None, "", False
    link = next((a for wrapper in _classed(team, "player-wrapper") for a in wrapper.find("a")), None) if kind == "drawsheet" else team
    names = [_text(_classed(link, f"{kind}-widget__{part}-name")) for part in ("first", "last")] if link is not None else []
    name = " ".join(names) if names and None not in names else link.text() if link is not None else None
    flag = next((m[1] for n in team.walk() if (m := re.search(r"itf-flags--(\w+)", n.attrs.get("class", "")))), None)
    cells = "|".join(s.text() for s in _classed(team, f"{kind}-widget__score"))
    return name or None, link.attrs.get("href") if link is not None else None, flag, _text(_classed(team, f"{kind}-widget__seeding")), cells, "is-winner" in team.attrs.get("class", "").split()


def _draw(root: Node) -> list[tuple]:
    out = []
    for container in _classed(root, "drawsheet-round-container"):
        title = _text(_classed(container, "drawsheet-round-container__round-title"))
        for place, widget in enumerate(_classed(container, "drawsheet-widget"), 1):
            teams = [next(_classed(widget, f"drawsheet-widget__team-info--team-{k}"), None) for k in (1, 2)]
            if None not in teams:
                out.append((title, place, _text(_classed(widget, "drawsheet-widget__winner-status-desc")), *_team(teams[0], "drawsheet"), *_team(teams[1], "drawsheet")))
    return out


def _seed(column: str) -> Column:
    return _empty_as_null(F.regexp_extract(column, r"\[(\d+)\]", 1)).try_cast("int")


def draw_widgets(pages: DataFrame, **columns: str) -> DataFrame:
    """Slots of draws made of widgets: ``round``, ``draw_position``, both players with id, nationality and seed, ``winner``, ``score``, ``status`` and ``is_bye``.

    Cells hold tie-breaks compressed (see ``compressed_score()``). A winner without a score is a walkover; a slot without winner, score and note is ``upcoming``.
    """
    rows = extract(pages, _draw, f"title string, draw_position int, note string, {_SIDE.format('a')}, {_SIDE.format('b')}", **columns)
    bye = F.coalesce(F.lower("label_a") == "bye", F.lit(False)) | F.coalesce(F.lower("label_b") == "bye", F.lit(False))
    cells = {f"sets_{s}": F.split(f"cells_{s}", r"\|") for s in "ab"}
    rows = rows.withColumns(cells | {"is_bye": bye, "played": ~bye & ((F.regexp_replace("cells_a", r"\|", "") != "") | (F.regexp_replace("cells_b", r"\|", "") != ""))})
    winner = F.when(F.col("is_bye"), None).when(F.col("won_a"), F.col("label_a")).when(F.col("won_b"), F.col("label_b"))
    note = F.lower("note")
    status = domain.chain(
        (F.col("is_bye"), "bye"), (note.contains("ret"), "retired"), (note.contains("walkover") | note.contains("w/o"), "walkover"), (note.contains("default"), "default"),
        (note.isNull() & ~F.col("played") & winner.isNotNull(), "walkover"), (note.isNull() & ~F.col("played"), "upcoming"), otherwise="completed",
    )
    people = []
    for s in "ab":
        number = _empty_as_null(F.regexp_extract(f"href_{s}", r"/players/[^/]+/(\d+)/", 1))
        people += [F.col(f"label_{s}").alias(f"player_{s}"), number.alias(f"player_{s}_external_id"), F.col(f"flag_{s}").alias(f"player_{s}_nationality"), _seed(f"seeding_{s}").alias(f"player_{s}_seed")]
    score = F.when(F.col("played"), compressed_score(F.col("sets_a"), F.col("sets_b"))).when((status == "walkover") & F.col("note").isNull(), "W/O")
    return rows.select(rows.columns[0], domain.normalize_round(F.col("title")).alias("round"), "draw_position", *people, winner.alias("winner"), score.alias("score"), status.alias("status"), "is_bye")


def _schedule(root: Node) -> list[tuple]:
    out = []
    for container in _classed(root, "orderop-widget-container"):
        court = _text(_classed(container, "orderop-widget-container__court-name"))
        for widget in _classed(container, "orderop-widget"):
            teams = [next(_classed(widget, f"orderop-widget__team-info--team-{k}"), None) for k in (1, 2)]
            told = (_text(_classed(widget, f"orderop-widget__{part}")) for part in ("date", "start-time", "round-details"))
            double = next(_classed(widget, "orderop-widget__team-doubles"), None) is not None
            out.append((court, *told, double, *_team(teams[0], "orderop"), *_team(teams[1], "orderop")))
    return out


def schedule_widgets(pages: DataFrame, hours: int = 2, **columns: str) -> DataFrame:
    """Singles of an order of play made of widgets: ``court``, ``round``, both players with seed, ``scheduled_date`` and ``scheduled_time``; a match that is followed by another starts two hours after it, doubles included."""
    rows = extract(pages, _schedule, f"court string, day string, time string, details string, double boolean, {_SIDE.format('a')}, {_SIDE.format('b')}", **columns)
    key = rows.columns[0]
    day = F.coalesce(dates.day_header(F.col("day")), F.lit(None).cast("date"))
    rows = rows.withColumns({"day": day, "clock": dates.clock(F.col("time")), "after": F.coalesce(F.lower("time").contains("followed by"), F.lit(False))})
    start = F.try_to_timestamp(F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), "clock"), F.lit("yyyy-MM-dd HH:mm"))
    by_court = Window.partitionBy(key, "court").orderBy("position")
    rows = rows.withColumn("anchor", F.when(~F.col("after") & F.col("day").isNotNull() & F.col("clock").isNotNull(), start))
    rows = rows.withColumns({"from": F.last("anchor", ignorenulls=True).over(by_court), "run": F.count("anchor").over(by_court)})
    later = F.count_if("after").over(Window.partitionBy(key, "court", "run").orderBy("position"))
    estimate = F.when(F.col("after"), F.col("from") + F.make_interval(hours=(later * hours).cast("int")))
    rows = rows.withColumn("estimate", estimate).where(~F.col("double") & F.col("label_a").isNotNull() & F.col("label_b").isNotNull())
    details = F.trim(F.regexp_replace("details", "(Men|Women)'s Singles", ""))
    return rows.select(
        key, "position", "court", F.when(F.coalesce(details, F.lit("")) == "", "R32").otherwise(domain.normalize_round(details)).alias("round"), F.col("label_a").alias("player_a"), _seed("seeding_a").alias("player_a_seed"),
        F.col("label_b").alias("player_b"), _seed("seeding_b").alias("player_b_seed"), F.coalesce(F.date_format("estimate", "yyyy-MM-dd"), F.date_format("day", "yyyy-MM-dd")).alias("scheduled_date"),
        F.coalesce(F.date_format("estimate", "HH:mm"), "clock").alias("scheduled_time"),
    )
