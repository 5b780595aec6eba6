"""Fixed values of the domain: statuses, rounds, levels and rating constants."""

from __future__ import annotations

#: Match statuses and their groups. Fixed values.
STATUSES = ("upcoming", "scheduled", "completed", "retired", "walkover", "default", "cancelled")
STATUS_GROUPS = {
    "upcoming": ("upcoming", "scheduled"),
    "pending": ("upcoming", "scheduled"),
    "historical_default": ("completed", "retired", "walkover", "default"),
    "terminal": ("completed", "retired", "walkover", "default", "cancelled"),
    "all": STATUSES,
}
#: What the production fold and the optimiser's fold take for finished.
RATED, RATED_FAST = ("completed", "retired", "walkover", "default"), ("completed", "retired")

#: Order, share of the tournament that has passed, and matches of each round. Fixed values.
ROUND_ORDER = {"Q1": 1, "Q2": 2, "Q3": 3, "R128": 10, "R64": 20, "R32": 30, "RR": 35, "R16": 40, "QF": 50, "SF": 60, "F": 70}
ROUND_PROGRESS = {"Q1": 0.0, "Q2": 0.05, "Q3": 0.1, "R128": 0.15, "R64": 0.25, "R32": 0.4, "RR": 0.5, "R16": 0.55, "QF": 0.7, "SF": 0.85, "F": 1.0}
ROUND_MATCHES = {"R128": 64, "R64": 32, "R32": 16, "R16": 8, "QF": 4, "SF": 2, "F": 1}
MAIN_DRAW = ("R128", "R64", "R32", "R16", "QF", "SF", "F")

#: K and S by the code of a level; the women's code has a W in front and the same values. Fixed values.
RATING_K = {"F": 183.0, "C": 137.0, "A": 108.0, "M": 107.0, "G": 116.0}
RATING_S = {"F": 1241.0, "C": 1441.0, "A": 1670.0, "M": 1809.0, "G": 1428.0}
#: Code of each level; any other is A. Fixed values.
LEVEL_CODES = {
    "Grand Slam": "G",
    "Masters 1000": "M", "WTA 1000": "M", "ATP Finals": "M", "WTA Finals": "M",
    "ATP 500": "A", "WTA 500": "A", "ATP 250": "A", "WTA 250": "A",
    "Challenger": "C", "ATP Challenger": "C", "WTA 125": "C",
    "ITF": "F", "Future": "F", "ITF M25": "F", "ITF M15": "F", "ITF W25": "F", "ITF W15": "F",
}
#: Other spellings of tours in filters. Fixed values.
TOUR_ALIASES = {"CHALLENGER": ("CHALLENGER", "ATP_CHALLENGER", "Challenger"), "ATP_CHALLENGER": ("CHALLENGER", "ATP_CHALLENGER", "Challenger"), "WTA_125": ("WTA_125", "WTA 125")}
#: Matching thresholds. Fixed values.
AUTO_MATCH, STRONG_MATCH, LIKELY_MATCH, SUGGEST = 0.98, 0.95, 0.90, 0.85
