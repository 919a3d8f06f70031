"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tacgrid import params as P

REASONS = (*P.CT_REASONS, *P.T_REASONS)


def buy_class(spend: Column, eco: int = P.ECO_MAX, semi: int = P.SEMI_MAX) -> Column:
    return F.when(spend <= eco, "eco").when(spend <= semi, "semi").otherwise("full")


def round_buy(is_pistol: Column, buy: Column) -> Column:
    """A pistol round overrides the class; unknown classes count as full."""
    return F.when(is_pistol, "pistol").when(buy.isin("eco", "semi", "full"), buy).otherwise("full")


def side_of(team: Column) -> Column:
    number = team.cast("string").try_cast("int")
    return F.when(number == P.CT_SIDE, "CT").when(number == P.T_SIDE, "T")


def reason_of(value: Column) -> Column:
    return F.when(value.isin(*REASONS), value)


def site_of(zone: Column) -> Column:
    """A zone named after a bomb site is A if it has a capital A anywhere, else B."""
    return F.when(zone.contains("Bombsite"), F.when(zone.contains("A"), "A").otherwise("B"))


def round_second(ticks: Column, floor: bool = True) -> Column:
    sec = F.bround(ticks / P.TICKRATE).cast("int")
    return F.greatest(F.lit(0), sec) if floor else sec


def clock_left(sec: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(P.ROUND_CLOCK_S) - sec)


def quantise16(x: Column) -> Column:
    return F.greatest(F.least(F.bround(x), F.lit(32767.0)), F.lit(-32768.0)).cast("short")


def quantise8(x: Column, cap: int = 255) -> Column:
    """Truncates, then clamps to 0..cap."""
    return F.greatest(F.least(F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)), F.lit(cap)), F.lit(0)).cast("short")


def quantise_yaw(degrees: Column) -> Column:
    return F.bround(F.pmod(degrees, F.lit(360.0)) / 360.0 * 255.0).cast("short")


def token(nodes: Column, size: int = 5) -> list[Column]:
    """The size smallest known nodes in ascending order, padded with nulls."""
    kept = F.slice(F.array_sort(F.filter(nodes, lambda n: n.isNotNull())), 1, size)
    return [F.get(kept, k) for k in range(size)]


def thin_path(path: Column, step: int = P.PATH_STEP) -> Column:
    """Every step-th sample and always the last."""
    return F.filter(path, lambda _, i: (i % step == 0) | (i == F.size(path) - 1))


def last_of(items: Column, names: dict[str, str]) -> Column:
    """The last item that has a name in names, as that name."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(known, F.try_element_at(F.filter(items, lambda i: i.isin(*names)), F.lit(-1)))


def inventory(items: Column) -> Column:
    """primary, secondary, flashes and flags of a list of item names; the taser fills the second slot only if it is empty."""
    guns = {k: v for k, v in P.SECONDARY_WEAPONS.items() if v != "taser"}
    count = lambda name: F.size(F.filter(items, lambda i: i == name))
    return F.struct(
        last_of(items, P.PRIMARY_WEAPONS).alias("primary"),
        F.coalesce(last_of(items, guns), F.when(count("Zeus x27") > 0, "taser")).alias("secondary"),
        F.least(count("Flashbang"), F.lit(3)).alias("flashes"),
        (count("Smoke Grenade") > 0).alias("smoke"),
        (count("High Explosive Grenade") > 0).alias("he"),
        ((count("Molotov") > 0) | (count("Incendiary Grenade") > 0)).alias("molly"),
        (count("Decoy Grenade") > 0).alias("decoy"),
    )


def has_bomb(items: Column) -> Column:
    return F.exists(items, lambda i: i.contains("C4"))


def first_teams(names: Column) -> list[Column]:
    """The first two of the distinct trimmed names that aren't blank."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")))
    return [F.get(clean, 0), F.get(clean, 1)]


def teams_from_file(name: Column) -> list[Column]:
    """The teams of a file named <a>-vs-<b>-m<digit>...; nulls if it isn't."""
    pattern = r"(?i)^(.+?)-vs-(.+?)-m\d"
    part = lambda k: F.replace(F.nullif(F.regexp_extract(name, pattern, k), F.lit("")), F.lit("-"), F.lit(" "))
    return [part(1), part(2)]


def part_of_file(name: Column) -> tuple[Column, Column]:
    """(prefix in lower case, number) of <prefix>-p<number>.dem; nulls for others."""
    pattern = r"(?i)^(.*)-p(\d+)\.dem$"
    return F.lower(F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))), F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).cast("int")


def side_names(ct_team: Column, team_a: Column, team_b: Column, ct_core: Column, t_core: Column) -> tuple[Column, Column]:
    """Names by side: T is the other team, if CT is one of the two; a core's label goes first."""
    t_team = F.when(ct_team == team_a, team_b).when(ct_team == team_b, team_a)
    return F.coalesce(ct_core, ct_team), F.coalesce(t_core, t_team)


def tidy_name(name: Column) -> Column:
    """Collapsed white space; null unless 1 to 60 characters are left."""
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(F.char_length(clean).between(1, 60), clean)


def valid_player(steam_id: Column) -> Column:
    return steam_id.rlike("^[0-9]{17}$") & (steam_id != "0" * 17)


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def clock(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), (s % 60).cast("int"))


def pair_cost(geo: Column, dx: Column, dy: Column, same_level: Column | None = None) -> Column:
    straight = F.hypot(dx, dy)
    return F.greatest(geo, straight if same_level is None else F.when(same_level, straight).otherwise(0.0))


def lerp_yaw(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc."""
    return F.pmod(a + (F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0) * t, F.lit(360.0))


def inside_polygon(x: Column, y: Column, corners: Column | list[tuple[float, float]]) -> Column:
    """Even-odd rule. corners: array of struct(x, y), or the places of a polygon that all rows share, whose edges become plain arithmetic."""
    if not isinstance(corners, Column):
        over = lambda a, b: (F.lit(a[1]) > y) != (F.lit(b[1]) > y)
        at = lambda a, b: F.lit(b[0] - a[0]) * (y - a[1]) / F.lit(b[1] - a[1]) + a[0]
        edges = [(a, b) for a, b in zip(corners, (corners[-1], *corners[:-1]), strict=True) if a[1] != b[1]]
        return sum((F.when(over(a, b) & (x < at(a, b)), 1).otherwise(0) for a, b in edges), F.lit(0)) % 2 == 1
    n = F.size(corners)

    def crosses(i: Column) -> Column:
        a, b = F.get(corners, i), F.get(corners, (i + n - 1) % n)
        over = (a["y"] > y) != (b["y"] > y)
        return F.when(over, F.when(x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(over, b["y"] - a["y"]) + a["x"], 1).otherwise(0)).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def world_to_pixel(x: Column, y: Column, origin_x: float, origin_y: float, scale: float) -> tuple[Column, Column]:
    return (x - origin_x) / scale, (F.lit(origin_y) - y) / scale


def pixel_to_world(px: Column, py: Column, origin_x: float, origin_y: float, scale: float) -> tuple[Column, Column]:
    return px * scale + origin_x, F.lit(origin_y) - py * scale
