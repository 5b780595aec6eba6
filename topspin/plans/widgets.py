"""Queries over draws and schedules made of widgets, built out of the driver's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from topspin.plans.registry import query
from topspin.plans.sources import _NAMES, _text
from topspin.sources import store, widgets
from topspin.sources.sinks import durable

_B = f"b AS ({store.BRACKETS.format(orders='orders')})"


@query(f"""WITH {_B} SELECT d AS page_id, round, CAST(p AS INTEGER) AS draw_position, CASE WHEN bye AND won <> a THEN 'Bye' ELSE 'F' || CAST(a AS VARCHAR) || ' L' END AS player_a, CASE WHEN NOT (bye AND won <> a) THEN CAST(800 + a AS VARCHAR) END AS player_a_external_id,
    CASE WHEN NOT (bye AND won <> a) THEN 'ESP' END AS player_a_nationality, CASE WHEN NOT (bye AND won <> a) AND a % 4 = 0 THEN CAST(a + 1 AS INTEGER) END AS player_a_seed, CASE WHEN bye AND won <> b THEN 'Bye' ELSE 'F' || CAST(b AS VARCHAR) || ' L' END AS player_b,
    CASE WHEN bye THEN NULL WHEN round = 'F' AND d % 4 = 3 THEN NULL ELSE 'F' || CAST(won AS VARCHAR) || ' L' END AS winner,
    CASE WHEN bye OR (round = 'F' AND d % 4 = 3) THEN NULL WHEN round = 'SF' AND d % 4 = 1 THEN 'W/O' WHEN won = a THEN '6-3 7-6(5)' ELSE '3-6 6-7(5)' END AS score,
    CASE WHEN bye THEN 'bye' WHEN round = 'F' AND d % 4 = 3 THEN 'upcoming' WHEN round = 'SF' AND d % 4 = 1 THEN 'walkover' WHEN round = 'QF' AND d % 4 = 2 THEN 'retired' ELSE 'completed' END AS status, bye AS is_bye FROM b""")
def draw_widgets(spark, sf_dir):
    """Brackets with byes, walkovers, retirements and a last match that is still to come."""
    rows = durable(store.brackets(spark, sf_dir))
    open_, given = (F.col("round") == "F") & (F.col("d") % 4 == 3), (F.col("round") == "SF") & (F.col("d") % 4 == 1)

    def team(name, k):
        own = F.col(name)
        absent = F.col("bye") & (F.col("won") != own)
        number = own.cast("string")
        link = F.when(absent, "<a>Bye</a>").otherwise(_text('<a href="/en/players/x/', (800 + own).cast("string"), '/country/"><span class="drawsheet-widget__first-name">F', number, '</span><span class="drawsheet-widget__last-name">L</span></a>'))
        flag = F.when(absent, "").otherwise(_text('<span class="drawsheet-widget__nationality"><i class="itf-flags itf-flags--ESP"></i></span>', F.when(own % 4 == 0, _text('<b class="drawsheet-widget__seeding">[', (own + 1).cast("string"), "]</b>")).otherwise("")))
        cell = lambda x: f'<span class="drawsheet-widget__score">{x}</span>'
        cells = F.when(F.col("bye") | open_ | given, cell("") + cell("")).when(F.col("won") == own, cell(6) + cell(7)).otherwise(cell(3) + cell("65"))
        won = F.when(~F.col("bye") & ~open_ & (F.col("won") == own), " is-winner").otherwise("")
        return _text(f'<div class="drawsheet-widget__team-info drawsheet-widget__team-info--team-{k}', won, '"><div class="player-wrapper">', link, "</div>", flag, cells, "</div>")

    note = F.when((F.col("round") == "QF") & (F.col("d") % 4 == 2) & ~F.col("bye"), '<p class="drawsheet-widget__winner-status-desc">Retired</p>').otherwise("")
    box = _text('<div class="drawsheet-widget">', team("a", 1), team("b", 2), note, "</div>")
    boxes = store.brackets_by_page(rows).select("d", "round", F.struct("p", box.alias("box")).alias("box")).groupBy("d", "round").agg(F.array_join(F.transform(F.array_sort(F.collect_list("box")), lambda x: x["box"]), "").alias("boxes"))
    name = F.coalesce(*[F.when(F.col("round") == r, n) for r, n in _NAMES.items()])
    part = _text('<div class="drawsheet-round-container"><h2 class="drawsheet-round-container__round-title">', name, "</h2>", F.col("boxes"), "</div>")
    pages = boxes.groupBy(F.col("d").alias("page_id")).agg(F.array_join(F.sort_array(F.collect_list(part)), "").alias("html"))
    found = widgets.draw_widgets(pages)
    return found.select("page_id", "round", "draw_position", "player_a", "player_a_external_id", "player_a_nationality", "player_a_seed", "player_b", "winner", "score", "status", "is_bye")


@query("""SELECT n_nationkey AS page_id, 'Court' AS court, CASE WHEN k = 0 THEN 'QF' ELSE 'R32' END AS round, 'A' || CAST(k AS VARCHAR) || ' X' AS player_a, 'B' || CAST(n_nationkey AS VARCHAR) || ' Y' AS player_b, CASE WHEN k = 0 THEN 3 END AS player_a_seed,
    '2026-03-0' || CASE WHEN k = 2 THEN '3' ELSE '2' END AS scheduled_date, CASE WHEN k = 0 THEN '22:00' ELSE '02:00' END AS scheduled_time FROM nation, (VALUES (0), (2)) AS t(k)""")
def schedule_widgets(spark, sf_dir):
    """A start, a double that follows it and a single that follows both, past midnight."""
    def widget(k, time, details, double=False):
        team = lambda side, first, last: _text(f'<div class="orderop-widget__team-info--team-{side}">', F.lit('<i class="orderop-widget__team-doubles"></i>') if double else "", '<span class="orderop-widget__first-name">', first, f'</span><span class="orderop-widget__last-name">{last}</span>', '<b class="orderop-widget__seeding">[3]</b>' if k == 0 and side == 1 else "", "</div>")
        return _text(f'<div class="orderop-widget"><p class="orderop-widget__date">Monday 02 March 2026</p><p class="orderop-widget__start-time">{time}</p><p class="orderop-widget__round-details">{details}</p>', team(1, F.lit(f"A{k}"), "X"), team(2, _text("B", F.col("n_nationkey").cast("string")), "Y"), "</div>")

    html = _text('<div class="orderop-widget-container"><h3 class="orderop-widget-container__court-name">Court</h3>', widget(0, "Starting at 22:00", "Men's Singles Quarterfinals"), widget(1, "Followed by", "Doubles", True), widget(2, "Followed by", "Men's Singles"), "</div>")
    rows = store.raw(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id"), html.alias("html"))
    return widgets.schedule_widgets(rows).select("page_id", "court", "round", "player_a", "player_b", "player_a_seed", "scheduled_date", "scheduled_time")
