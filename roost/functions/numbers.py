"""Number columns read out of listing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roost.functions.text import WB, WE, WS, let, not_blank

_DECIMAL = rf"^{WS}*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?{WS}*\z"

# Room words in order of preference.
ROOM_LABELS = [
    "habitaciones", "habitacion", "dormitorios", "dormitorio", r"habs\.", "habs", r"hab\.", "hab",
    "rooms", "room", "dorm",
]
ROOMS = (
    rf"(?i)(?<![0-9])(?:[0-9]{{3}})*?([0-9]{{1,3}})(?![0-9]){WS}*"
    rf"(?>{'|'.join(ROOM_LABELS)})(?![A-Za-z])"
)
_ROOM_HEADS = "(?=[hHdDrR][aAoO][bBrRoO])(?:[hH][aA][bB]|[dD][oO][rR][mM]|[rR][oO][oO][mM])"
GROUND_FLOOR = rf"(?iu){WB}(?:bajo|ground floor){WE}"
FLOOR = r"(?iu)([0-9]{1,3})[ªa]?[ \t]{0,8}planta"
FLOOR_LOOSE = rf"(?iu)([0-9]+)[ªa]?{WS}*planta"


def parse_price(c: Column) -> Column:
    """All digits of the text as one number; null when there is none."""
    return not_blank(F.regexp_replace(c, "[^0-9]", "")).try_cast("double")


def parse_number(c: Column) -> Column:
    """Text to a finite number; `,` or `.` before a closing three-digit group is dropped."""
    cleaned = F.regexp_replace(c, rf"[,.](?=[0-9]{{3}}{WE})", "")
    return F.when(cleaned.rlike(_DECIMAL), F.trim(F.regexp_replace(cleaned, WS, "")).try_cast("double"))


def parse_rooms(c: Column) -> Column:
    """Number in front of the first room word."""
    # what a room word begins with is looked for first: few texts without rooms hold it
    return let(c, lambda text: F.when(text.rlike(_ROOM_HEADS), not_blank(F.regexp_extract(text, ROOMS, 1)).try_cast("double")))


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def _floor_of(chars: Column, pattern: str, kind: str) -> Column:
    def one(item: Column) -> Column:
        return F.when(item.rlike(GROUND_FLOOR), F.lit("0")).otherwise(not_blank(F.regexp_extract(item, pattern, 1)))

    return F.get(F.filter(F.transform(chars, one), lambda x: x.isNotNull()), F.lit(0)).try_cast(kind)


def extract_floor(chars: Column) -> Column:
    """Floor of the first feature text that names one; ground floor is 0."""
    return _floor_of(chars, FLOOR, "int")


def extract_floor_loose(chars: Column) -> Column:
    """As ``extract_floor`` with any blanks and any digits, used by the relax test."""
    return _floor_of(chars, FLOOR_LOOSE, "double")


def floor_label(chars: Column) -> Column:
    return F.get(F.filter(chars, lambda x: x.rlike("(?i)planta")), F.lit(0))


def format_price(price: Column, locale: Column) -> Column:
    """Whole euros in the reader's convention.

    Spanish writes the amount first, groups only from five digits and puts a no-break
    space before the sign; English puts the sign first.
    """
    rounded = F.round(price, 0)
    grouped = F.format_number(rounded, 0)
    spanish = F.concat(
        F.when(F.abs(rounded) < 10000, F.regexp_replace(grouped, ",", "")).otherwise(F.translate(grouped, ",", ".")),
        F.lit("\u00a0€"),
    )
    is_es = locale == "es"
    return (
        F.when(price.isNull(), F.when(is_es, "Precio no disponible").otherwise("Price unavailable"))
        .when(is_es, spanish)
        .otherwise(F.concat(F.lit("€"), grouped))
    )


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
