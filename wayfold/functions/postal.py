"""Postal words as fixed values, and the comparison form of address lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street types with their abbreviations and spellings.
STREET_TYPES = {
    "alley": "aly", "aly": "aly",
    "avenue": "ave", "ave": "ave", "av": "ave", "aven": "ave",
    "boulevard": "blvd", "blvd": "blvd", "boul": "blvd", "blv": "blvd",
    "circle": "cir", "cir": "cir", "circ": "cir", "crcl": "cir",
    "court": "ct", "ct": "ct", "crt": "ct",
    "cove": "cv", "cv": "cv",
    "drive": "dr", "dr": "dr", "drv": "dr", "driv": "dr",
    "expressway": "expy", "expy": "expy",
    "highway": "hwy", "hwy": "hwy", "hiway": "hwy",
    "lane": "ln", "ln": "ln",
    "parkway": "pkwy", "pkwy": "pkwy", "pky": "pkwy", "parkwy": "pkwy", "pkway": "pkwy",
    "place": "pl", "pl": "pl", "plc": "pl",
    "plaza": "plz", "plz": "plz",
    "road": "rd", "rd": "rd",
    "square": "sq", "sq": "sq",
    "street": "st", "st": "st", "str": "st", "strt": "st",
    "terrace": "ter", "ter": "ter", "terr": "ter", "tce": "ter",
    "trail": "trl", "trl": "trl", "trails": "trl",
    "way": "way", "wy": "way",
}
# Directions.
DIRECTIONS = {
    "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw",
    "southeast": "se", "southwest": "sw", "no": "n", "so": "s",
}
# Words before a unit.
UNIT_WORDS = ("apt", "apartment", "suite", "ste", "unit", "un", "#", "no.")
# Words of place names and their abbreviations.
PLACE_WORDS = {
    "saint": "st", "mount": "mt", "fort": "ft", "heights": "hts", "junction": "jct", "springs": "spgs",
    "north": "n", "south": "s", "east": "e", "west": "w", "lake": "lk", "point": "pt", "grand": "gr",
    "port": "prt", "new": "nw", "park": "pk", "beach": "bch", "falls": "fls", "creek": "crk",
}
# Letters with marks and the plain ones.
MARKED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"

#: Words of a street line in the form they are compared in.
LINE_WORDS = {**{k: v for k, v in STREET_TYPES.items() if k != v}, **DIRECTIONS, **dict.fromkeys((u for u in UNIT_WORDS if u != "no."), "unit")}
CITY_WORDS = {"saint": "st", "mount": "mt", "fort": "ft", "heights": "hts", "junction": "jct", "springs": "spgs"}


def _mapped(text: Column, words: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(table[t], t)), " ")


def _plain(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def line_form(line: Column) -> Column:
    """A street line without case, marks, punctuation and abbreviations; null stays null."""
    spaced = F.regexp_replace(F.regexp_replace(_plain(line), "#", " # "), r"[^a-z0-9#/-]+", " ")
    return _mapped(F.trim(spaced), LINE_WORDS)


def city_form(city: Column) -> Column:
    """A place name in the form it is compared in; null becomes empty."""
    spaced = F.regexp_replace(_plain(F.coalesce(city, F.lit(""))), r"[^a-z0-9]+", " ")
    return _mapped(F.trim(spaced), CITY_WORDS)

# Slips in address words and what they mean.
SLIPS = {
    "stret": "street", "streeet": "street", "srteet": "street", "avenu": "avenue", "avnue": "avenue", "aveneu": "avenue", "raod": "road",
    "rode": "road", "boulevrd": "boulevard", "bouleverd": "boulevard", "dirve": "drive", "drve": "drive", "lnae": "lane", "laen": "lane",
    "crcle": "circle", "cirlce": "circle", "plaec": "place", "pkway": "parkway", "aparment": "apartment", "apartmnt": "apartment", "siute": "suite",
}
