"""Policy: thresholds, limits and names. Callers may pass their own values; these are the defaults."""

# Fixed values, equal to those of the engine whose results are matched.
TICKRATE = 64
BUY_EVAL_SECONDS = 5
MIN_ROUND_SECONDS = 10
ROUND_CLOCK_S = 115
ECO_MAX = 5_000
SEMI_MAX = 16_250
PISTOL_ROUNDS = (1, 13)
SMOKE_FALLBACK_S = 20
MOLLY_FALLBACK_S = 7
TRACK_MAX_DISTANCE = 300.0
TRACK_MAX_TICKS = 144
TRACK_GAP_TICKS = 128
PATH_STEP = 4
RECALL_CAP = 1500
MOMENT_GAP_S = 2
MAX_ACTIVE_UTILITY = 10
UTILITY_GATE = 400.0
UTILITY_RADIUS = 250.0
DEFAULT_TOLERANCE = 300.0
DEFAULT_LIMIT = 50
HISTOGRAM_BIN_S = 10
HISTOGRAM_BINS = 12
ROSTER_SIZE = 10
MAX_NODES = 254
GEODESIC_CAP = 4000.0
RASTER_CELL = 16
RASTER_LAYERS = 3
RASTER_LAYER_GAP = 64.0
DILATION_ROUNDS = 80
RASTER_MARGIN = 2
#: Sides (dx, dy) to which a cell gives its layers, in order.
RASTER_SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1))
MAP_PREFIXES = ("de_", "cs_")
ACTIVE_MAPS = ("de_ancient", "de_anubis", "de_cache", "de_dust2", "de_inferno", "de_mirage", "de_nuke")
LEGACY_MAPS = ("de_overpass",)
#: Recorded names that say nothing about who plays.
GENERIC_NAMES = ("unknown", "ct", "t", "terrorists", "counter-terrorists")
FINGERPRINT_BYTES = 4 << 20
CT_REASONS = ("t_killed", "bomb_defused", "time_ran_out")
T_REASONS = ("ct_killed", "bomb_exploded")
BUYS = ("eco", "semi", "full", "pistol")
#: Side numbers in recordings.
T_SIDE, CT_SIDE = 2, 3
PRIMARY_WEAPONS = {
    "AK-47": "ak47", "M4A4": "m4a1", "M4A1-S": "m4a1_silencer", "FAMAS": "famas", "Galil AR": "galilar", "AUG": "aug",
    "SG 553": "sg556", "AWP": "awp", "SSG 08": "ssg08", "SCAR-20": "scar20", "G3SG1": "g3sg1", "MAC-10": "mac10",
    "MP9": "mp9", "MP7": "mp7", "MP5-SD": "mp5sd", "UMP-45": "ump45", "P90": "p90", "PP-Bizon": "bizon", "Nova": "nova",
    "XM1014": "xm1014", "Sawed-Off": "sawedoff", "MAG-7": "mag7", "M249": "m249", "Negev": "negev",
}
SECONDARY_WEAPONS = {
    "USP-S": "usp_silencer", "P2000": "hkp2000", "Glock-18": "glock", "P250": "p250", "Five-SeveN": "fiveseven",
    "Tec-9": "tec9", "CZ75-Auto": "cz75a", "Dual Berettas": "elite", "Desert Eagle": "deagle", "R8 Revolver": "revolver",
    "Zeus x27": "taser",
}
NO_SHOT = ("flashbang", "smokegrenade", "hegrenade", "molotov", "incgrenade", "decoy", "c4")

#: Two costs closer than this are equal.
EXACT = 1e-6
