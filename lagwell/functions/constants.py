"""Fixed values that results depend on: result groups, lookup tables, weights, caps.

Everything in this module is data, not logic; the values must not change.
"""

# Plate-appearance results, by group.
HITS = ["Single", "Double", "Triple", "Home Run"]
EXTRA_BASE_HITS = ["Double", "Triple", "Home Run"]
STRIKEOUTS = ["Strikeout", "Strikeout Double Play"]
WALKS = ["Walk", "Intent Walk"]
FIP_FREE_BASES = ["Walk", "Hit By Pitch"]
ON_BASE = [
    "Single", "Double", "Triple", "Home Run", "Walk", "Intent Walk",
    "Hit By Pitch", "Field Error", "Catcher Interference",
]

# Bases credited per result; anything else counts 0.
BASES = {
    "Single": 1, "Double": 2, "Triple": 3, "Home Run": 4, "Walk": 1,
    "Intent Walk": 1, "Hit By Pitch": 1, "Field Error": 1,
    "Catcher Interference": 1,
}

# Pitch-call descriptions and one-letter codes.
SWINGING_STRIKE_CALLS = ["Swinging Strike", "Swinging Strike (Blocked)", "Missed Bunt"]
FOUL_CALLS = ["Foul", "Foul Tip", "Foul Bunt"]
SWING_CODES = ["S", "W", "T", "F", "X", "D", "E", "L", "M"]
CONTACT_CODES = ["F", "X", "T", "D", "E"]
MISS_CODES = ["S", "W", "T"]
CALLED_CODE = "C"

# Zone numbers.
IN_ZONE = list(range(1, 10))
OUT_ZONE = [11, 12, 13, 14]
EDGE_ZONE = [1, 2, 3, 4, 6, 7, 8, 9]

# Park factor by venue, 100 when absent.
PARK_FACTORS = {
    "1": 103, "3": 96, "4": 102, "5": 100, "7": 98, "10": 97, "12": 103,
    "14": 101, "15": 97, "17": 102, "19": 98, "20": 100, "21": 96,
    "22": 102, "28": 97, "31": 100, "32": 97, "34": 100, "36": 98,
    "2392": 100, "2394": 99, "2395": 97, "2508": 102,
}
PARK_DEFAULT = 100.0

# Shrinkage sample sizes, league fallbacks, formula constants.
PLATOON_K = {
    "k_rate": 50, "bb_rate": 120, "obp": 150, "obp_allowed": 150, "iso": 200,
    "tb_rate": 150, "whiff_rate": 75,
}
LEAGUE_DEFAULTS = {"k_rate": 0.220, "bb_rate": 0.085, "hr_rate": 0.034}
WOBA = {"bb": 0.69, "singles": 0.89, "doubles": 1.27, "triples": 1.62, "hr": 2.10}
FIP_CONSTANT = 3.10
PYTHAGOREAN_EXPONENT = 1.83
RULE_CHANGE_DATE = "2023-03-30"

# Upper caps of per-game pitching rates.
RATE_CAPS = {
    "era": 27.0, "whip": 9.0, "k9": 27.0, "bb9": 27.0, "hr9": 9.0,
    "k_per_ip": 3.0, "bb_per_ip": 3.0, "hr_per_ip": 1.0, "h_per_ip": 4.0,
    "er_per_ip": 3.0,
}

# Game types kept, season left out, tags of the hand pivots.
GAME_TYPES = ["R", "F", "D", "L", "W"]
EXCLUDED_SEASON = 2020
PITCHER_HAND_TAGS = {"L": "vs_lhp", "R": "vs_rhp"}
BATTER_HAND_TAGS = {"L": "vs_lhb", "R": "vs_rhb", "S": "vs_switch"}
