"""Tile packing, distances and the small field languages of transport rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Areas (left, bottom, width, height) without globals, and with wilderness globals only. Fixed values of the data format.
NO_GLOBALS = [(2944, 3760, 448, 448), (2944, 10155, 518, 221)]
WILDERNESS_GLOBALS = [(2944, 3680, 448, 448), (2944, 10075, 518, 301)]
#: Order of diary tiers.
TIERS = ("Easy", "Medium", "Hard", "Elite")


def pack_tile(x: Column, y: Column, plane: Column) -> Column:
    """x in bits 0-14, y in 15-29, plane in 30-31, as BIGINT; wider values wrap."""
    b = lambda c: c.cast("long")
    return b(x).bitwiseAND(F.lit(32767)).bitwiseOR(F.shiftleft(b(y).bitwiseAND(F.lit(32767)), 15)).bitwiseOR(F.shiftleft(b(plane).bitwiseAND(F.lit(3)), 30))


def tile_x(tile: Column) -> Column:
    return tile.bitwiseAND(F.lit(32767))


def tile_y(tile: Column) -> Column:
    return F.shiftright(tile, 15).bitwiseAND(F.lit(32767))


def tile_plane(tile: Column) -> Column:
    return F.shiftright(tile, 30).bitwiseAND(F.lit(3))


def coordinate_text(x: Column, y: Column, plane: Column) -> Column:
    return F.concat_ws("/", x.cast("string"), y.cast("string"), plane.cast("string"))


def in_range(x: Column, y: Column, plane: Column) -> Column:
    return x.between(0, 32767) & y.between(0, 32767) & plane.between(0, 3)


def chebyshev_flat(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.greatest(F.abs(ax - bx), F.abs(ay - by))


def chebyshev(ax: Column, ay: Column, ap: Column, bx: Column, by: Column, bp: Column) -> Column:
    """Null between planes."""
    return F.when(ap == bp, chebyshev_flat(ax, ay, bx, by))


def add_cost(a: Column, b: Column) -> Column:
    """Null when either is null, ``b`` is negative or the sum overflows."""
    return F.when(b >= 0, F.try_add(a, b))


def weighted_priority(g: Column, w: Column, h: Column) -> Column:
    """g + round-half-even(w * h)."""
    return g + F.bround(w * h).cast("long")


def parse_tile(text: Column) -> Column:
    """"x y plane" as a packed tile; null unless there are exactly three whole numbers."""
    parts = F.split(F.trim(text), r"\s+")
    n = [F.try_element_at(parts, F.lit(i)).try_cast("long") for i in (1, 2, 3)]
    return F.when(F.size(parts) == 3, pack_tile(*n))


def parse_coordinate(text: Column) -> Column:
    """Whole numbers parted by spaces or commas; null if any part is none."""
    parts = F.filter(F.split(F.trim(text), r"[\s,]+"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("long"))
    return F.when((F.size(parts) > 0) & F.forall(numbers, lambda v: v.isNotNull()), numbers)


def duration(text: Column, teleport: Column) -> Column:
    """Default 0; at least 1 for teleports."""
    return F.greatest(F.when(teleport, F.lit(1)).otherwise(F.lit(0)).cast("long"), F.coalesce(text.try_cast("long"), F.lit(0).cast("long")))


def consumable(text: Column) -> Column:
    return F.coalesce(text.isin("T", "yes", "YES"), F.lit(False))


def parse_skills(text: Column) -> Column:
    """"75 Construction;83 Farming" as (level, skill); malformed pieces are dropped, skill names may hold spaces."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    good = F.filter(pieces, lambda p: p.rlike(r"^-?\d+\s+\S"))
    return F.transform(good, lambda p: F.struct(F.regexp_extract(p, r"^(-?\d+)", 1).cast("int").alias("level"), F.regexp_extract(p, r"^-?\d+\s+(.*)$", 1).alias("skill")))


def parse_quests(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")


def parse_vars(text: Column) -> Column:
    """"4070=1;55@20" as (id, op, value); the first of = > < & @ that occurs parts a piece; other forms are dropped."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    good = F.filter(pieces, lambda p: p.rlike(r"^\d+[=><&@]\d+$"))
    part = lambda p, i: F.regexp_extract(p, r"^(\d+)([=><&@])(\d+)$", i)
    return F.transform(good, lambda p: F.struct(part(p, 1).cast("long").alias("id"), part(p, 2).alias("op"), part(p, 3).cast("long").alias("value")))


def parse_items(text: Column) -> Column:
    """Alternatives of conjunctions of (name, quantity): upper case, white space out, ``|`` binds least, then ``&``. Null when empty; a
    malformed term is an error."""
    clean = F.regexp_replace(F.upper(text), r"\s", "")

    def term(t: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit("malformed item term: "), t)).cast("string")
        checked = F.when(t.rlike(r"^[^=]+=-?\d+$"), t).otherwise(bad)
        return F.struct(F.regexp_extract(checked, r"^([^=]+)=", 1).alias("name"), F.regexp_extract(checked, r"=(-?\d+)$", 1).cast("long").alias("qty"))

    return F.when(clean != "", F.transform(F.split(clean, r"\|"), lambda alt: F.transform(F.split(alt, "&"), term)))


def capability(x: Column, y: Column) -> Column:
    """Which global transports a tile may activate, by half-open rectangles that ignore the plane."""
    inside = lambda areas: F.lit(False) if not areas else inside(areas[1:]) | ((x >= areas[0][0]) & (x < areas[0][0] + areas[0][2]) & (y >= areas[0][1]) & (y < areas[0][1] + areas[0][3]))
    return F.when(inside(NO_GLOBALS), "NoGlobals").when(inside(WILDERNESS_GLOBALS), "WildernessGlobals").otherwise("AllGlobals")


def label(display: Column, kind: Column) -> Column:
    return F.when(F.coalesce(display, F.lit("")) == "", kind).otherwise(display)


def distance_tag(distance: Column, same_plane: Column) -> Column:
    return F.when(~same_plane | (distance >= 1000), "cross-world").when(distance >= 400, "long").when(distance >= 100, "regional").otherwise("local")


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the first UTF-16 unit of every character."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    unit = lambda i: F.conv(F.substring(F.hex(F.encode(F.substr(text, i, F.lit(1)), "UTF-16BE")), 1, 4), 16, 10).cast("long")
    return F.aggregate(F.transform(places, unit), F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c.cast("long")) * 16777619 % 4294967296)


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))
