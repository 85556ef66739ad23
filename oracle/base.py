"""Shared SQL: the property view and the saved searches, by rule from the tables."""

from __future__ import annotations

from roost import rules


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def slug(x: str, joiner: str = "_") -> str:
    inner = f"lower(strip_accents({x}))"
    if joiner == "-":
        inner = f"regexp_replace({inner}, '[''’]', '', 'g')"
    return f"trim(regexp_replace({inner}, '[^a-z0-9]+', '{joiner}', 'g'), '{joiner}')"


PORTAL = f"{sql_list(rules.PORTALS)}[(o_orderkey % 13 + 1)::INT]"

LISTING = f"""
listing AS (
  SELECT {PORTAL} || '-' || o_orderkey AS canonical_id,
         {PORTAL} AS portal,
         o_orderkey::VARCHAR AS portal_listing_id,
         CASE WHEN o_orderkey % 10 = 3 THEN 'HTTPS://Shared.Example/Ref/' || o_custkey || '/?from=' || {PORTAL}
              WHEN o_orderkey % 23 = 0 THEN 'http://www.' || {PORTAL} || '.example/inmueble/' || o_orderkey
              ELSE 'https://user@www.' || {PORTAL} || '.example/inmueble/' || o_orderkey END AS url,
         CASE WHEN o_orderkey % 10 = 3 THEN 'shared.example/ref/' || o_custkey
              ELSE 'www.' || {PORTAL} || '.example/inmueble/' || o_orderkey END AS url_key,
         coalesce(p_name || ' ' || p_brand, '') AS title,
         CASE WHEN o_orderkey % 19 = 0 THEN 'Elsewhere'
              WHEN o_custkey % 6 = 3 THEN 'Centro (' || n_name || ')'
              WHEN o_custkey % 6 = 4 THEN ''
              WHEN o_custkey % 6 = 5 THEN 'San ' || n_name || ' Alto'
              ELSE n_name END AS city,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price_eur,
         CASE WHEN o_custkey % 11 <> 0 THEN (o_custkey % 7)::DOUBLE END AS rooms,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'flat' WHEN 'HOUSEHOLD' THEN 'house'
              WHEN 'MACHINERY' THEN 'office' WHEN 'AUTOMOBILE' THEN 'land' END AS property_type,
         (o_orderkey % 12)::INT AS n_images,
         o_orderdate AS last_seen_at,
         coalesce(text, '') || ' ' ||
           ['Piso exterior con mucha luz natural.', 'Ventanales y orientación sur, ático LUMINOSO.',
            'Casa para reformar cerca del bosque.', 'Oficina interior.',
            'Retiro rural con vistas a la montaña.', ''][(o_orderkey % 6 + 1)::INT] AS description,
         CASE o_orderkey % 5 WHEN 0 THEN ['natural_light', 'exterior'] WHEN 1 THEN ['Views']
              WHEN 2 THEN ['renovation', 'nature'] ELSE []::VARCHAR[] END AS tags,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN (o_custkey % 40)::DOUBLE END AS capacity_people,
         '/venta/pisos-' || lower(n_name) || '_capital_zona_urbana/' AS source_path,
         CASE WHEN o_custkey % 11 <> 0 THEN [(o_custkey % 7) || ' habs.'] ELSE []::VARCHAR[] END ||
           CASE WHEN n_nationkey % 5 = 0 THEN []::VARCHAR[]
                WHEN o_orderkey % 9 = 0 THEN ['Bajo'] ELSE [(o_orderkey % 9) || 'ª planta'] END AS chars,
         CASE WHEN n_nationkey % 5 <> 0 THEN (o_orderkey % 9)::INT END AS floor_no,
         CASE WHEN o_orderkey % 4 = 0 THEN 36.0::DOUBLE + (o_orderkey % 700)::DOUBLE / 100 END AS lat,
         CASE WHEN o_orderkey % 4 = 0 THEN -9.0::DOUBLE + (o_custkey % 1200)::DOUBLE / 100 END AS lon,
         n_name AS crawl_location,
         o_orderkey AS seq, o_orderkey, o_custkey, n_nationkey
  FROM orders
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT l_orderkey, min(l_linenumber::BIGINT * 100000000000 + l_partkey) % 100000000000 AS first_part
             FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = first_part
  LEFT JOIN documents ON doc_id = o_orderkey // 15
)"""


def searches(source: str, search_id: str) -> str:
    return f"""
search AS (
  SELECT {search_id} AS search_id,
         CASE WHEN k % 2 = 0 THEN 'es' ELSE 'en' END AS locale,
         CASE k % 3 WHEN 1 THEN 'buy' WHEN 2 THEN 'rent' END AS transaction_type,
         CASE c_mktsegment WHEN 'BUILDING' THEN ['flat', 'house'] WHEN 'MACHINERY' THEN ['office']
              ELSE []::VARCHAR[] END AS property_types,
         k % 6 AS mode, n_name AS place, 'NATION_' || ((c_nationkey + 1) % 25) AS other_place,
         coalesce(k % 6 = 5, false) AS nearby,
         CASE WHEN k % 4 > 0 THEN (k % 4)::INT END AS min_rooms,
         CASE WHEN k % 7 = 3 AND c_mktsegment = 'MACHINERY' THEN 10 END AS min_capacity,
         CASE WHEN k % 5 > 0 THEN 150000 + (n % 8) * 50000 END AS max_price,
         CASE WHEN k % 3 = 1 THEN 2 END AS min_floor,
         k % 3 = 2 AS no_ground, k % 5 = 1 AS prefer_exterior,
         k % 6 NOT IN (3, 5) AS strict, k % 2 = 1 AS renovation_ok,
         CASE k % 4 WHEN 0 THEN ['natural_light', 'views'] WHEN 1 THEN ['Renovation'] ELSE []::VARCHAR[] END AS wanted,
         k % 7 = 0 AS explicit,
         CASE WHEN k % 2 = 0 THEN (5 + k % 40)::INT ELSE 20 END AS cap_place,
         CASE WHEN k % 3 > 0 THEN (10 + k % 100)::INT ELSE 40 END AS cap_total
  FROM {source}
)"""


SEARCH = searches(
    """(SELECT c_nationkey, c_mktsegment, n_name, min(c_custkey) AS k, count(*) AS n
        FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)""",
    "'s-' || c_nationkey || '-' || lower(c_mktsegment)",
)

# Places of a search: (loc_pos, location, key, hints, requested).
PLACE = f"""
place AS (
  SELECT search_id, 0 AS loc_pos, place AS location,
         CASE WHEN mode = 0 THEN ['Centro', 'Alto'] WHEN mode = 1 THEN ['Centro'] WHEN mode = 2 THEN ['Alto']
              ELSE []::VARCHAR[] END AS hints
  FROM search WHERE mode IN (0, 1, 2, 5)
  UNION ALL
  SELECT search_id, 1, other_place, []::VARCHAR[] FROM search WHERE mode = 1
  UNION ALL
  SELECT search_id, 0, '{rules.DISCOVERY}', []::VARCHAR[] FROM search WHERE mode = 3
),
source_list AS (
  SELECT search_id,
         CASE WHEN explicit THEN ['pisos', 'nuroa', 'idealista']
              WHEN coalesce(transaction_type = 'rent', true)
                   AND (len(property_types) = 0 OR list_has_any(property_types, ['flat', 'house']))
              THEN {sql_list(rules.DEFAULT_SOURCES + rules.RENT_ONLY_SOURCES)}
              ELSE {sql_list(rules.DEFAULT_SOURCES)} END AS portals
  FROM search
),
task AS (
  SELECT s.*, p.loc_pos, p.location, p.hints, x.src_pos - 1 AS src_pos, l.portals[x.src_pos] AS portal,
         p.location = '{rules.DISCOVERY}' AS discovery,
         CASE WHEN p.location = '{rules.DISCOVERY}' THEN s.cap_total ELSE s.cap_place END AS cap,
         (SELECT count(*) FROM place q WHERE q.search_id = s.search_id) AS n_places
  FROM search s JOIN place p USING (search_id) JOIN source_list l USING (search_id),
       LATERAL (SELECT unnest(range(1, len(l.portals) + 1)) AS src_pos) x
)"""

EXT = r"(?i)(^|[^A-Za-z0-9_])(exterior|outside[- ]facing|toda exterior|todo exterior)([^A-Za-z0-9_]|$)"
PREPARED = f"""
prepared AS (
  SELECT *, {norm('city')} AS city_norm, {norm('title')} AS title_norm,
         regexp_matches(description, '(?i)(luz natural|natural light|luminos[oa]s?|bright|well[- ]lit|solead[oa])') AS light_text,
         regexp_matches(description, '{EXT}') AS exterior_text,
         regexp_matches(description, '(?i)(ventanales?|large windows|big windows)') AS window_text,
         regexp_matches(description, '(?i)(orientaci[oó]n|south[- ]facing|east[- ]facing|west[- ]facing)') AS orientation_text,
         regexp_matches(description, '(?i)(reform|renov|renovar)') AS renovation_text,
         {norm("city || ' ' || title || ' ' || description || ' ' || array_to_string(chars, ' ') || ' ' || source_path")} AS search_text
  FROM listing
)"""

_CITY_HIT = (
    "(CASE WHEN city_norm <> '' THEN contains(' ' || city_norm || ' ', ' ' || c_norm || ' ') "
    "ELSE contains(source_path, c_slug || '_capital') END)"
)


def _scored(source: str, floor: str = "min_floor", tail: str = "") -> str:
    """Score and reasons of candidate rows in ``source``."""
    light = "list_has_any(wanted, ['natural_light', 'exterior', 'large_windows', 'good_orientation'])"
    hit = f"(NOT discovery AND {_CITY_HIT})"
    tags = "list_filter(wanted, lambda t: list_contains(list_transform(tags, lambda u: lower(u)), lower(t)))"
    hints = f"list_filter(hints, lambda h: contains(' ' || search_text || ' ', ' ' || lower(h) || ' '))"
    priced = "(coalesce(max_price, 0) <> 0 AND coalesce(price_eur, 0) <> 0)"
    roomy = "(coalesce(min_rooms, 0) <> 0 AND coalesce(rooms, 0) <> 0 AND rooms >= min_rooms)"
    parts = [
        (hit, "20", "'City exact match'"),
        (f"(NOT discovery AND NOT {_CITY_HIT} AND nearby)", "8", "'Nearby towns accepted'"),
        (priced, "greatest(0, least(15, floor((1 - price_eur / max_price) * 15 + 0.5)))", "'Within budget'"),
        (roomy, "least(10, (rooms - min_rooms) * 2 + 4)", "'Rooms requirement satisfied'"),
        ("(min_capacity IS NOT NULL AND capacity_people IS NOT NULL)", "8", "'Capacity requirement satisfied'"),
        (f"len({tags}) > 0", f"4 * len({tags})", f"'Tag matches: ' || array_to_string({tags}, ', ')"),
        (f"len({hints}) > 0", f"least(12, 5 * len({hints}))",
         f"'Location hint match: ' || array_to_string({hints}[1:3], ', ')"),
        ("true", "least(4, n_images // 2)", None),
        ("min_rooms IS NULL AND rooms IS NOT NULL", "least(3, greatest(0, rooms - 2))", None),
        (f"({light} AND floor_no >= 5)", "6", "'High floor (' || floor_no || 'ª) supports natural light'"),
        (f"({light} AND exterior_text)", "6", "'Exterior layout mention'"),
        (f"({light} AND light_text)", "5", "'Natural light / bright description'"),
        (f"({light} AND window_text)", "4", "'Large windows mention'"),
        (f"({light} AND orientation_text)", "4", "'Orientation signal present'"),
        ("(prefer_exterior AND exterior_text)", "5", "'Exterior preference satisfied'"),
        (f"(floor_no >= {floor})", "2", "'Floor requirement satisfied (' || floor_no || 'ª)'"),
        ("(renovation_ok AND renovation_text)", "3", "'Renovation-friendly description'"),
    ]
    total = " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)::DOUBLE" for c, p, _ in parts)
    reasons = ", ".join(f"CASE WHEN {c} THEN {r} END" for c, _, r in parts if r)
    return (
        f"SELECT * EXCLUDE (sc), greatest(0, least(100, sc))::INT AS score FROM (SELECT *, 45 + {total} AS sc, "
        f"list_filter([{reasons}], lambda r: r IS NOT NULL) AS why FROM {source}) {tail}"
    )


ORDER = (
    "score DESC, coalesce(price_eur, 9007199254740991) ASC, coalesce(rooms, -1) DESC, last_seen_at DESC, canonical_id ASC"
)

_BASE = f"""
  (max_price IS NULL OR CASE WHEN price_eur IS NULL THEN NOT strict ELSE price_eur <= max_price END)
  AND (min_rooms IS NULL OR CASE WHEN rooms IS NULL THEN NOT strict ELSE rooms >= min_rooms END)
  AND (min_capacity IS NULL OR coalesce(capacity_people >= min_capacity, false))
  AND (len(property_types) = 0 OR CASE WHEN property_type IS NULL THEN NOT strict
       ELSE list_contains(property_types, property_type) END)
  AND (discovery OR nearby OR {_CITY_HIT})"""

_FLOOR = """
  (NOT (no_ground AND coalesce(floor_no = 0, false))
   AND (min_floor IS NULL OR CASE WHEN floor_no IS NULL THEN NOT strict ELSE floor_no >= min_floor END))"""

# Per-task pick with the relaxed floor rule, exact duplicate removal and W1 positions.
PICK = f"""
matched AS (
  SELECT t.*, p.*, {norm("CASE WHEN t.discovery THEN '' ELSE t.location END")} AS c_norm,
         {slug("CASE WHEN t.discovery THEN '' ELSE t.location END")} AS c_slug
  FROM task t JOIN prepared p ON p.portal = t.portal AND (t.discovery OR p.crawl_location = t.location)
),
passing AS (SELECT *, {_FLOOR} AS floor_pass FROM matched WHERE {_BASE}),
scored AS ({_scored('passing')}),
stats AS (
  SELECT search_id, loc_pos, src_pos, count(*) AS candidates, count(floor_no) AS with_floor FROM matched GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY search_id, loc_pos, src_pos, floor_pass ORDER BY {ORDER}) AS task_rank,
         count(*) FILTER (floor_pass) OVER (PARTITION BY search_id, loc_pos, src_pos) AS n_pass
  FROM scored
),
picked AS (
  SELECT r.* FROM ranked r JOIN stats USING (search_id, loc_pos, src_pos)
  WHERE task_rank <= cap
    AND (floor_pass OR (n_pass = 0 AND (min_floor IS NOT NULL OR no_ground) AND with_floor = 0))
),
first_seen AS (
  SELECT *, bool_or(NOT floor_pass) OVER (PARTITION BY search_id) AS any_relaxed FROM picked
  QUALIFY row_number() OVER (PARTITION BY search_id, portal, portal_listing_id ORDER BY loc_pos, src_pos, task_rank) = 1
),
positioned AS (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY {ORDER}, loc_pos, src_pos, task_rank) AS pos,
         list_filter(list_distinct(string_split(title_norm, ' ')), lambda w: length(w) >= 3 AND w NOT IN
           ('venta','alquiler','piso','pisos','casa','casas','chalet','apartamento','apartamentos','en','de','del','la','el','con')) AS tokens
  FROM first_seen
)"""

# Greedy keep-first collapse, one position per step over all searches.
COLLAPSE = """
fold AS (
  SELECT search_id, 0::BIGINT AS pos,
         []::STRUCT(pos BIGINT, u VARCHAR, c VARCHAR, p DOUBLE, r DOUBLE, t VARCHAR, w VARCHAR[])[] AS kept
  FROM (SELECT DISTINCT search_id FROM positioned)
  UNION ALL
  SELECT f.search_id, x.pos,
         CASE WHEN len(list_filter(f.kept, lambda e: e.u = x.url_key OR (
                (e.c = '' OR x.city_norm = '' OR contains(e.c, x.city_norm) OR contains(x.city_norm, e.c))
                AND coalesce(abs(e.p - x.price_eur) <= greatest(5000, floor(least(e.p, x.price_eur) * 0.05::DOUBLE + 0.5)), true)
                AND coalesce(abs(e.r - x.rooms) <= 1, true)
                AND e.t <> '' AND x.title_norm <> ''
                AND (e.t = x.title_norm OR (least(len(e.w), len(x.tokens)) > 0 AND
                     len(list_intersect(e.w, x.tokens))::DOUBLE / least(len(e.w), len(x.tokens)) >= 0.9::DOUBLE))))) > 0
              THEN f.kept
              ELSE list_append(f.kept, {'pos': x.pos, 'u': x.url_key, 'c': x.city_norm, 'p': x.price_eur, 'r': x.rooms,
                                        't': x.title_norm, 'w': x.tokens}) END
  FROM fold f JOIN positioned x ON x.search_id = f.search_id AND x.pos = f.pos + 1
),
collapsed AS (
  SELECT search_id, pos AS n_in, len(kept) AS total, pos - len(kept) AS removed, kept
  FROM fold QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY pos DESC) = 1
),
survivor AS (
  SELECT p.* FROM positioned p JOIN (SELECT search_id, unnest(kept).pos AS pos FROM collapsed) k USING (search_id, pos)
)"""

RESULT = f"""
rescored AS (
  {_scored("(SELECT * EXCLUDE (score, why) FROM survivor)",
           "CASE WHEN n_places = 1 AND any_relaxed THEN NULL ELSE min_floor END")}
),
slotted AS (
  SELECT *, row_number() OVER (PARTITION BY search_id, loc_pos ORDER BY {ORDER}, src_pos, task_rank) AS place_rank FROM rescored
),
result AS (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY
      CASE WHEN n_places > 1 AND place_rank = 1 THEN loc_pos ELSE 5 END, {ORDER}, loc_pos, src_pos, task_rank) AS result_rank
  FROM slotted QUALIFY result_rank <= cap_total
)"""


def query(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + select


SEARCH_CTES = (LISTING, SEARCH, PLACE, PREPARED, PICK, COLLAPSE, RESULT)
