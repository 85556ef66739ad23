"""Steps shared by the portal layouts: block splitting, field patterns, derived fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost import rules, schema
from roost.functions.numbers import parse_number, round_half_up
from roost.functions.text import WE, all_matches, first_match, let, not_blank, says, slugify, strip_tags
from roost.functions.urls import absolute_url, url_path

PAGE_KEYS = ["portal", "crawl_location", "page_no", "path", "fetched_at", "requested_type"]
NO_TEXTS = "array<string>"


# -- patterns -------------------------------------------------------------------------

def open_tag(tag: str, name: str, attr: str = "class") -> str:
    """An opening tag up to the closing quote of an attribute that contains ``name``."""
    return rf"""<{tag}[^>]*{attr}=["'][^"']*{name}[^"']*["']"""


def inner(tag: str, name: str, attr: str = "class") -> str:
    """Content of an element whose attribute contains ``name``."""
    return rf"(?i){open_tag(tag, name, attr)}[^>]*>((?s:.*?))</{tag}>"


def attr_of(tag: str, name: str, wanted: str) -> str:
    """Value of a later attribute of a tag whose class contains ``name``."""
    return rf"""(?i){open_tag(tag, name)}[^>]*{wanted}=["']([^"']+)["']"""


def text_of(block: Column, *patterns: str, default: Column | str | None = "") -> Column:
    """Visible text of the first pattern that matches (an empty capture still counts)."""
    found = [first_match(block, p) for p in patterns]
    if default is not None:
        found.append(default if isinstance(default, Column) else F.lit(default))
    return strip_tags(F.coalesce(*found))


def attribute(tag: Column, name: str) -> Column:
    """Last value of an attribute in an opening tag."""
    values = all_matches(tag, rf"""(?i)(?<![-A-Za-z0-9_:.]){name}=(["'])((?s:.*?))\1""", 2)
    return F.try_element_at(values, F.lit(-1))


# -- blocks ---------------------------------------------------------------------------

def split_at(html: Column, start: str) -> Column:
    """Blocks that run from one start tag to the next, or to the end of the page."""
    return F.filter(F.split(html, f"(?i)(?={start})"), lambda b: b.rlike(f"(?i)^{start}"))


def explode_blocks(pages: DataFrame, blocks: Column, *extra: Column) -> DataFrame:
    """One row per block. The outer form keeps Spark from splitting every page twice (once
    for an inferred filter on the array size)."""
    return pages.select(*PAGE_KEYS, *extra, F.posexplode_outer(blocks).alias("block_no", "block")).filter("block IS NOT NULL")


# -- derived fields -------------------------------------------------------------------

def city_or_place(city: Column) -> Column:
    """City text, else the place the page was fetched for."""
    return F.coalesce(city, F.col("crawl_location"), F.lit("Unknown"))


def slug_id(path: Column, url: Column) -> Column:
    """Last resort id: the path as a slug, else a digest of the link."""
    return F.coalesce(
        not_blank(F.translate(slugify(path), "-", "_")),
        F.concat(F.lit("anon_"), F.xxhash64(url).cast("string")),
    )


def page_path(url: Column) -> Column:
    return F.coalesce(not_blank(url_path(url)), F.when(url.isNotNull(), F.lit("/")))


def full_url(link: Column, base: str) -> Column:
    """Absolute link with lower-case host and at least ``/`` as its path."""
    parts = r"(?i)^(https?)://([^/?#]+)([^?#]*)([\s\S]*)\z"

    def normal(url: Column) -> Column:
        path = F.regexp_extract(url, parts, 3)
        rebuilt = F.concat(
            F.lower(F.regexp_extract(url, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(url, parts, 2)),
            F.when(path == "", "/").otherwise(path), F.regexp_extract(url, parts, 4),
        )
        return F.when(url.rlike(parts), rebuilt).otherwise(url)

    return let(absolute_url(link, base), normal)


def title_words(token: Column, separator: str) -> Column:
    """``san_juan`` -> ``San Juan``; only first letters change."""
    words = F.filter(F.split(token, separator), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " "
    )


def infer_type(text: Column) -> Column:
    """First property type whose words occur in the text."""

    def pick(low: Column) -> Column:
        out = F.when(says(low, rules.TYPE_WORDS[0][1]), rules.TYPE_WORDS[0][0])
        for name, words in rules.TYPE_WORDS[1:]:
            out = out.when(says(low, words), name)
        return out

    return let(F.lower(text), pick)


def type_by(text: Column, cases: list[tuple[str, str]]) -> Column:
    """First type whose pattern occurs in the text; null when none does."""
    out = F.when(text.rlike(cases[0][0]), cases[0][1])
    for pattern, name in cases[1:]:
        out = out.when(text.rlike(pattern), name)
    return out


def infer_tags(text: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    def pick(low: Column) -> Column:
        hits = [F.when(says(low, rules.lower_pattern(p)), F.lit(t)) for t, p in patterns or rules.TAG_PATTERNS]
        return F.array_compact(F.array(*hits))

    return let(F.lower(text), pick)


BATHROOMS = rf"(?iu)([0-9]+)\s*bañ(?:o|os){WE}"
BATHROOMS_OPEN = r"(?iu)([0-9]+)\s*bañ(?:o|os)"
AREA = r"(?iu)([0-9]+(?:[.,][0-9]+)?)\s*m(?:2(?![A-Za-z0-9_])|²(?=[A-Za-z0-9_]))"
AREA_OPEN = r"(?iu)([0-9]+(?:[.,][0-9]+)?)\s*m(?:2|²)"
AREA_SIGN = r"(?iu)([0-9]+(?:[.,][0-9]+)?)\s*m²"


def bathrooms_in(text: Column, pattern: str = BATHROOMS) -> Column:
    return parse_number(first_match(text, pattern))


def area_in(text: Column, pattern: str = AREA) -> Column:
    return parse_number(F.replace(first_match(text, pattern), F.lit("."), F.lit("")))


def number_text(c: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def measure_chars(rooms: Column | None = None, bathrooms: Column | None = None, area: Column | None = None) -> Column:
    parts = []
    if rooms is not None:
        parts.append(F.concat(number_text(rooms), F.lit(" habs.")))
    if bathrooms is not None:
        parts.append(F.concat(number_text(bathrooms), F.lit(" baños")))
    if area is not None:
        parts.append(F.concat(round_half_up(area).cast("string"), F.lit(" m²")))
    return F.array_compact(F.array(*parts))


def office_capacity(property_type: Column, area: Column) -> Column:
    return F.when((property_type == "office") & area.isNotNull(), F.greatest(F.lit(1.0), F.floor(area / 2.5).cast("double")))


def one_image(url: Column) -> Column:
    return F.when(url.isNotNull(), F.array(url)).otherwise(F.array().cast(NO_TEXTS))


_OPTIONAL = ["capacity_people", "price_raw", "bathrooms", "area_m2", "lat", "lon", "raw"]


def finish(rows: DataFrame, portal: str, canonical: Column | None = None, tier: Column | None = None) -> DataFrame:
    """Canonical listing rows from a portal's field columns, plus ``page_no`` and ``tier``."""
    have = set(rows.columns)
    kinds = {f.name: f.dataType for f in schema.LISTING.fields}
    fixed = {
        "canonical_id": canonical if canonical is not None else F.concat(F.lit(f"{portal}-"), F.col("portal_listing_id")),
        "portal": F.lit(portal),
        "last_seen_at": F.col("fetched_at"),
        "seq": F.col("page_no").cast("bigint") * 1_000_000 + F.col("block_no"),
        "source_path": F.col("source_path") if "source_path" in have else page_path(F.col("url")),
    }
    columns = []
    for name, kind in kinds.items():
        if name in fixed:
            value = fixed[name]
        elif name in _OPTIONAL and name not in have:
            value = F.lit(None)
        else:
            value = F.col(name)
        columns.append(value.cast(kind).alias(name))
    return rows.select(
        *columns, F.col("page_no"), F.col("path").alias("page_path"), (tier if tier is not None else F.lit(0)).cast("int").alias("tier")
    ).filter("portal_listing_id IS NOT NULL AND url IS NOT NULL")
