import datetime as dt

from topspin.sources import layouts

DDL = "page_id long, html string"


def test_archive(spark):
    html = """<div class="tournament-list"><ul class="events"><li><a class="results" href="/en/scores/archive/brisbane/339/2024/results">R</a><img class="events_banner" src="/x/250.png">
    <span class="name">Brisbane</span><span class="venue">Brisbane, Australia | </span><span class="Date">30 December, 2023 - 7 January, 2024</span></li>
    <li><a class="tournament__profile" href="/en/tournaments/monte-carlo/410/overview">P</a><img class="events_banner" src="events_banner_1000.png"></li><li><span class="name">None</span></li></ul></div>"""
    rows = layouts.archive_tournaments(spark.createDataFrame([(1, html), (2, None), (3, "<ul class='events'><li>")], DDL)).orderBy("position").collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("brisbane", "339", "Brisbane", "Brisbane, Australia", "ATP 250", dt.date(2023, 12, 30), dt.date(2024, 1, 7)),
        ("monte-carlo", "410", "Monte Carlo", "", "Masters 1000", None, None),
    ]


MATCH = """<div class="match"><div class="match-header"><span>{round}</span></div><div class="name"><a href="/en/players/x/{a}/overview">{na}</a></div><div class="name"><a href="/en/players/y/b222/overview">{nb}</a></div>
<div class="score-item"><span>6</span></div><div class="score-item"><span>7</span><span>7</span></div><div class="score-item"><span>4</span></div><div class="score-item"><span>6</span><span>5</span></div><div class="match-cta">{note}</div></div>"""


def test_results_by_day_and_flat(spark):
    one = MATCH.format(round="Semifinals - ", a="a111", na="IGA SWIATEK (1)", nb="jessica pegula", note="H2H")
    html = f"""<div><div class="atp_accordion-header"><h4 class="tournament-day">Sun, 11 January, 2026Day (9)</h4></div><div class="atp_accordion-content">{one}{MATCH.format(round="Final", a="c", na="A", nb="Bye", note="")}</div></div>"""
    flat = MATCH.format(round="Final", a="c333", na="A B", nb="C D", note="Ret.") + '<div class="match"><div class="name"><a>E F</a></div><div class="name"><a>G H</a></div></div>'
    rows = [tuple(r) for r in layouts.results_by_day(spark.createDataFrame([(1, html), (2, flat)], DDL)).orderBy("page_id", "position").collect()]
    assert rows[0] == (1, 0, dt.date(2026, 1, 11), "SF", "Iga Swiatek", "Jessica Pegula", 1, None, "A111", "B222", "6-4 7-6(5)", "completed")
    assert rows[1][2:4] == (None, "F") and rows[1][-1] == "retired" and rows[2][-2:] == ("W/O", "walkover") and len(rows) == 3
    assert layouts.checked(layouts.results_by_day(spark.createDataFrame([(1, html), (2, flat)], DDL))).count() == 3


def test_calendar_events_and_order_of_play(spark):
    card = '<li data-fav-id="{n}" data-fav-name="N"><a href="/tournaments/{h}">x</a><img alt="WTA 1000"><p class="card-surface">Red clay</p><p class="card-location">Rome</p><time date-time="2024-05-06">6 May</time></li>'
    html = card.format(n="1", h="709/rome/2024") + card.format(n="2", h="709/rome/2023") + card.format(n="3", h="us-open") + "<li data-fav-id='4'></li>"
    got = [(r.code, r.number, r.level, r.surface, r.location, r.start_date) for r in layouts.calendar_cards(spark.createDataFrame([(1, html)], DDL), 2024).orderBy("position").collect()]
    assert got == [("rome", "1", "WTA 1000", "Clay", "Rome", dt.date(2024, 5, 6)), ("us-open", "3", "WTA 1000", "Clay", "Rome", dt.date(2024, 5, 6))]
    table = '<table><tr><td class="date"><span class="date">30 Dec to 05 Jan 2025</span></td><td><a href="/en/tournament/w35-nairobi/ken/2025/w-itf-ken-01/"><span class="short">W35 Nairobi</span></a></td></tr></table>'
    row = layouts.event_list(spark.createDataFrame([(1, table)], DDL)).first()
    assert (row.code, row.name, row.prize, row.start_date, row.end_date) == ("w-itf-ken-01", "W35 Nairobi", 35, dt.date(2024, 12, 30), dt.date(2025, 1, 5))
    play = '<div class="court"><h3 class="court-name">Centre</h3>' + "".join(f'<div class="tennis-match js-{k}"><span class="time">{t}</span><p class="player">{a}</p><p class="player">Z</p></div>' for k, t, a in (("x-LS", "Starting at 11:30 AM", "A"), ("x-LD", "Followed by", "B"), ("x-LS", "Followed by", "C"), ("x-LS", "Not before 7.00 pm", "D"))) + "</div>"
    got = [(r.court, r.player_a, r.start) for r in layouts.order_of_play(spark.createDataFrame([(1, play)], DDL)).orderBy("position").collect()]
    assert got == [("Centre", "A", 11.5), ("Centre", "C", 15.5), ("Centre", "D", 19.0)]
