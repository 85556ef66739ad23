"""Word lists, patterns and limits that results depend on."""

from __future__ import annotations

from roost.functions.text import WB, WE

PORTALS = [
    "pisos", "fotocasa", "tucasa", "idealista", "habitaclia", "yaencontre", "milanuncios",
    "globaliza", "hogaria", "spainhouses", "pisocompartido", "enalquiler", "nuroa",
]
PROPERTY_TYPES = ["flat", "house", "office", "land"]

# Order in which portals are searched when the request names none; the last two list
# rentals of flats and houses only.
DEFAULT_SOURCES = [
    "pisos", "habitaclia", "tucasa", "fotocasa", "yaencontre", "milanuncios", "globaliza",
    "hogaria", "spainhouses", "nuroa",
]
RENT_ONLY_SOURCES = ["pisocompartido", "enalquiler"]

# Order of the status report.
STATUS_ORDER = DEFAULT_SOURCES + RENT_ONLY_SOURCES + ["idealista"]
PORTAL_URLS = {
    "pisos": "https://www.pisos.com",
    "habitaclia": "https://www.habitaclia.com",
    "tucasa": "https://www.tucasa.com",
    "fotocasa": "https://www.fotocasa.es",
    "yaencontre": "https://www.yaencontre.com",
    "milanuncios": "https://www.milanuncios.com",
    "globaliza": "https://www.globaliza.com",
    "hogaria": "https://www.hogaria.net",
    "spainhouses": "https://www.spainhouses.net",
    "nuroa": "https://www.nuroa.es",
    "pisocompartido": "https://www.pisocompartido.com",
    "enalquiler": "https://www.enalquiler.com",
    "idealista": "https://www.idealista.com",
}

# Request bounds.
MAX_LOCATIONS = 5
MAX_QUERY_LENGTH = 2_000
MAX_TEXT_LENGTH = 200
MAX_HINTS = 10
MAX_TAGS = 20
MAX_SOURCES = 13
MAX_PER_LOCATION = 50
MAX_RESULTS = 200
DEFAULT_PER_LOCATION = 20
DEFAULT_RESULTS = 40
MAX_SEARCH_TASKS = 28
DISCOVERY = "__discovery__"

# Property types by words, tried in order on lower-case text.
TYPE_WORDS = [
    ("flat", "piso|flat|apart|atico|duplex|loft"),
    ("house", "casa|house|chalet|villa|adosad|paread|rural"),
    ("office", "oficina|office|despacho"),
    ("land", "suelo|land|solar|terreno|plot|finca rustica|finca rústica"),
]

# Feature patterns, also used by the light score.
LIGHT = r"(?iu)(?:luz natural|natural light|luminos[oa]s?|bright|well[- ]lit|solead[oa])"
EXTERIOR = rf"(?iu){WB}(?:exterior|outside[- ]facing|toda exterior|todo exterior){WE}"
WINDOWS = r"(?iu)(?:ventanales?|large windows|big windows)"
ORIENTATION = r"(?iu)(?:orientaci[oó]n|south[- ]facing|east[- ]facing|west[- ]facing)"
RENOVATION_TEXT = r"(?iu)(?:reform|renov|renovar)"
TAG_PATTERNS = [
    ("natural_light", LIGHT),
    ("exterior", EXTERIOR),
    ("large_windows", WINDOWS),
    ("good_orientation", ORIENTATION),
    ("nature", r"(?iu)(?:naturaleza|nature|entorno natural|rural|monta(?:n|ñ)a|bosque|countryside)"),
    ("views", r"(?iu)(?:vistas|views?|panor[aá]m)"),
    ("retreat", r"(?iu)(?:retiro|retreat)"),
    ("renovation", r"(?iu)(?:reforma|renov)"),
]


def lower_pattern(pattern: str) -> str:
    """A case-insensitive pattern of lower-case words, for text that is lower-cased already."""
    return pattern.removeprefix("(?iu)")


LIGHT_TAGS = ["natural_light", "exterior", "large_windows", "good_orientation"]

# Pages that refuse automated reading.
BOT_BLOCK = (
    r"(?iu)pardon our interruption"
    r"|as you were browsing something about your browser made us think you were a bot"
    r"|enable javascript(?: and cookies)?|access denied|forbidden|datadome"
    r"|sentimos la interrupci[oó]n|complete the captcha below|interruption-message"
)

ERROR_CODES = {
    "MISSING_API_KEY": "A required connector credential is unavailable.",
    "AUTH_REJECTED": "A source rejected connector authentication.",
    "UPSTREAM_RATE_LIMIT": "A source is temporarily rate limited.",
    "UPSTREAM_SCHEMA_CHANGED": "A source returned an unsupported response.",
    "UPSTREAM_BLOCKED": "A source blocked automated access.",
    "UPSTREAM_UNAVAILABLE": "A source is temporarily unavailable.",
}
# Errors a status probe may meet without failing.
PROBE_ERRORS = ["UPSTREAM_BLOCKED", "UPSTREAM_RATE_LIMIT", "UPSTREAM_UNAVAILABLE"]

MISSING_LOCATION_WARNING = (
    "No `city` or `locations[]` provided. Discovery search is disabled when `strict_constraints=true`."
)
MISSING_LOCATION_ACTION = (
    "Model action required: choose candidate cities/towns and retry with `locations[]` (recommended 3-5, hard max 5)."
)
MISSING_LOCATION_RETRY = (
    "Send `locations[]` (recommended 3-5, hard max 5) or a single `city` and call the tool again."
)
CONTEXT_ONLY_WARNING = "`query_text` is contextual only. In strict structured mode, geography must be explicit."
NO_SOURCE_WARNING = "No source portals selected."

# City centres for the map (latitude, longitude).
CITY_CENTRES = {
    "valencia": (39.4699, -0.3763),
    "madrid": (40.4168, -3.7038),
    "barcelona": (41.3874, 2.1686),
    "sevilla": (37.3891, -5.9845),
    "malaga": (36.7213, -4.4214),
    "bilbao": (43.263, -2.935),
    "alicante": (38.3452, -0.481),
    "granada": (37.1773, -3.5986),
    "ronda": (36.7423, -5.1671),
    "cangas de onis": (43.3506, -5.1266),
    "albarracin": (40.4077, -1.4447),
    "cudillero": (43.5637, -6.1451),
    "grazalema": (36.7582, -5.3661),
}
