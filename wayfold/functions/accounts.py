"""What accounts need beyond a transport's own requirements: item variants, houses, planted trees and the special failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: Fixed values of the data format: the item ids that a symbolic name stands for, its first one first.
ITEM_IDS = {
    "AIR_RUNE": [556, 4695, 4696, 4697],
    "ASTRAL_RUNE": [9075],
    "AXE": [1351, 1349, 1353, 1361, 1355, 1357, 1359, 6739, 23673, 23279, 13241, 20011],
    "BANANA": [1963],
    "BLOOD_RUNE": [565],
    "BROWN_APRON": [1757, 20208, 9780, 9781, 9782],
    "CAPESLOT": [4513, 4515],
    "CLIMBING_BOOTS": [3105, 23413],
    "COINS": [995],
    "CROSSBOW": [837, 767, 8880, 10156, 9174, 9177, 9179, 9181, 9183, 9185, 21902, 21012, 4734, 4938, 4937, 4936, 4935, 4934, 11785, 26374],
    "DUSTY_KEY": [1590],
    "EARTH_RUNE": [557, 4696, 4698, 4699],
    "ECTO_TOKEN": [4278],
    "FIRE_RUNE": [554, 4697, 4694, 4699],
    "GLARIALS_AMULET": [1718],
    "GLOWING_FUNGUS": [4075],
    "HEADSLOT": [4514, 4516],
    "LAW_RUNE": [563],
    "MACHETE": [975, 6313, 6315, 6317],
    "MAX_CAPE": [13280, 13342, 13329, 21186, 24134, 13331, 13333, 13335, 13337, 20760, 21285, 21284, 24133, 21776, 24232, 21780, 24233, 21784, 24234, 21898, 24135, 24855, 27363, 27365, 28902, 28906],
    "MAX_HOOD": [13281, 13330, 13332, 13334, 13336, 13338, 20764, 21282, 21778, 21782, 21786, 21900, 24857, 27366, 28904],
    "MAZE_KEY": [1542],
    "MIND_RUNE": [558],
    "MITH_GRAPPLE": [9418],
    "NATURE_RUNE": [561],
    "PICKAXE": [1265, 1267, 1269, 12297, 1273, 1271, 1275, 11920, 23680, 23276, 20014, 12797, 23677, 25376, 30351, 13243],
    "ROPE": [954],
    "SHANTAY_PASS": [1854],
    "SKAVID_MAP": [2376],
    "SOUL_RUNE": [566],
    "WATER_RUNE": [555, 4695, 4698, 4694],
}
#: The house's rectangle (inclusive) and the tile where one arrives; the places of planted trees (inclusive).
HOUSE, LANDING = (1856, 2047, 5696, 5767), (1923, 5709, 0)
TREES = [("PortSarimTree", 3058, 3062, 3256, 3260), ("EtceteriaTree", 2611, 2615, 3855, 3860), ("BrimhavenTree", 2800, 2804, 3201, 3205), ("HosidiusTree", 1691, 1695, 3540, 3544), ("FarmingGuildTree", 1251, 1255, 3748, 3752)]

def item_ids(name: Column) -> Column:
    """Ids that an item name stands for; digits are the id itself, other unknown names an error."""
    known = F.create_map(*(x for k, v in ITEM_IDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    error = F.raise_error(F.concat(F.lit("unknown item: "), name)).cast("array<int>")
    return F.when(name.rlike("^[0-9]+$"), F.array(name.try_cast("int"))).otherwise(F.coalesce(F.try_element_at(known, name), error))


def inside_house(tile: Column) -> Column:
    x, y = S.tile_x(tile), S.tile_y(tile)
    return F.coalesce(x.between(HOUSE[0], HOUSE[1]) & y.between(HOUSE[2], HOUSE[3]), F.lit(False))


def landing() -> Column:
    return S.pack_tile(*(F.lit(v) for v in LANDING))


def planted_tree(tile: Column) -> Column:
    """Name of the planted tree at a tile; null elsewhere."""
    x, y = S.tile_x(tile), S.tile_y(tile)
    out = F.lit(None).cast("string")
    for name, x0, x1, y0, y1 in reversed(TREES):
        out = F.when(x.between(x0, x1) & y.between(y0, y1), name).otherwise(out)
    return out


def special_failures(kind: Column, object_info: Column, display_info: Column, origin: Column, destination: Column, account: Column) -> Column:
    """Messages of what an account lacks for a transport beyond its listed requirements: planted trees, then the house, then the kind's own
    rule. ``account`` is a struct of ``trees`` (names), ``fairy_rings``, ``staff``, ``lumbridge_elite``, ``house_fairy_ring``, ``house_spirit_tree``,
    ``house_obelisk``, ``glory``, ``xerics``, ``digsite``, ``mythical``, ``box`` (0 none, 1 fancy, 2 ornate), ``all_portals`` and ``portals``."""
    say = lambda unless, text: F.when(~unless, text if isinstance(text, Column) else F.lit(text))
    order = F.array(*(F.lit(t[0]) for t in TREES))
    asked = F.array_compact(F.array(planted_tree(origin), planted_tree(destination)))
    trees = F.filter(order, lambda t: F.array_contains(asked, t) & ~F.array_contains(account["trees"], t))
    planted = F.when(kind == "SPIRIT_TREE", F.transform(trees, lambda t: F.concat(F.lit("Player-planted spirit tree is not available: "), t))).otherwise(F.array().cast("array<string>"))
    house = F.when(inside_house(origin) | inside_house(destination), F.when(kind == "FAIRY_RING", say(account["house_fairy_ring"], "POH fairy ring is not built")).when(kind == "SPIRIT_TREE", say(account["house_spirit_tree"], "POH spirit tree is not built")).when(kind == "WILDERNESS_OBELISK", say(account["house_obelisk"], "POH obelisk is not built")))
    has = lambda text: object_info.contains(text)
    box = (
        F.when(has("Amulet of Glory") & ~account["glory"], "Mounted amulet of glory is not built").when(has("Xeric's Talisman") & ~account["xerics"], "Mounted Xeric's talisman is not built")
        .when(has("Digsite Pendant") & ~account["digsite"], "Mounted Digsite pendant is not built").when(has("Mythical cape") & ~account["mythical"], "Mounted mythical cape is not built")
        .when(has("Basic") & (account["box"] == 0), "Basic jewellery box is not built").when(has("Ornate") & (account["box"] < 2), "Ornate jewellery box is not built").when(has("Fancy") & (account["box"] < 1), "Fancy jewellery box is not built")
    )
    ring = F.when(~account["fairy_rings"], "Fairy rings are not unlocked").otherwise(say(account["lumbridge_elite"] | account["staff"], "Fairy rings require a Dramen or Lunar staff"))
    portal = say(account["all_portals"] | F.array_contains(account["portals"], display_info), "POH portal is not built")
    own = F.when(kind == "FAIRY_RING", ring).when(kind == "TELEPORTATION_BOX", box).when(kind == "TELEPORTATION_PORTAL_POH", portal)
    return F.concat(planted, F.array_compact(F.array(house, own)))
