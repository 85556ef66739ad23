"""SQL twin of every registered query that plain SQL can state."""

from __future__ import annotations

from oracle import base as b
from roost import rules
from roost.registry import RANK_CRITERIA

ORACLES: dict[str, str] = {}


def add(name: str, *ctes: str, select: str) -> None:
    ORACLES[name] = b.query(*ctes, select=select)


FOUND = (b.LISTING, b.SEARCH, b.PLACE, b.PREPARED, b.PICK)

# -- search -----------------------------------------------------------------------------
add(
    "search_results", *b.SEARCH_CTES,
    select="SELECT search_id, result_rank, canonical_id, score::BIGINT AS score, array_to_string(why, ' | ') AS why, location FROM result",
)
NOTE = (
    "'Auto-relaxed floor filters for ' || portal || ' in ' || location || ' because ' || candidates || ' candidates lacked floor metadata.'"
)
COVERAGE = f"""
coverage AS (
  SELECT t.search_id, t.loc_pos, t.src_pos, t.location, t.portal, coalesce(s.candidates, 0) AS candidates,
         coalesce(r.returned, 0) AS returned, CASE WHEN r.relaxed THEN {NOTE.replace('portal', 't.portal').replace('location', 't.location')} END AS relax_note
  FROM task t LEFT JOIN stats s USING (search_id, loc_pos, src_pos)
  LEFT JOIN (SELECT search_id, loc_pos, src_pos, count(*) AS returned, bool_or(NOT floor_pass) AS relaxed FROM picked GROUP BY ALL) r
    USING (search_id, loc_pos, src_pos)
)"""
add(
    "search_coverage", *FOUND, COVERAGE,
    select="SELECT search_id, loc_pos::BIGINT AS loc_pos, src_pos::BIGINT AS src_pos, location, portal, candidates, returned, relax_note FROM coverage",
)
add(
    "search_diagnostics", *FOUND, b.COLLAPSE, COVERAGE,
    select=f"""
SELECT s.search_id, CASE WHEN mode = 4 THEN 'missing_locations' ELSE 'run' END AS status,
  coalesce(c.total, 0)::BIGINT AS total_candidates, least(coalesce(c.total, 0), s.cap_total)::BIGINT AS returned_count,
  CASE WHEN mode = 4 THEN '{rules.MISSING_LOCATION_WARNING} | {rules.MISSING_LOCATION_ACTION}' ELSE array_to_string(
    CASE WHEN mode IN (1, 2) THEN ['Executed multi-location search across 2 requested locations (' || (CASE WHEN mode = 1 THEN 2 ELSE 1 END)
           || ' search locations) and ' || len(l.portals) || ' sources.']
         WHEN mode = 3 THEN ['No city/locations provided; running discovery search across ' || len(l.portals) || ' sources because strict_constraints=false.']
         ELSE []::VARCHAR[] END
    || coalesce(n.notes, []::VARCHAR[])
    || CASE WHEN c.removed > 0 THEN ['Deduplicated ' || c.removed || ' near-identical listings before ranking.'] ELSE []::VARCHAR[] END, ' | ') END AS connector_warnings,
  CASE WHEN mode = 4 THEN '{rules.CONTEXT_ONLY_WARNING}' ELSE array_to_string(
    CASE WHEN explicit THEN ['Explicit sources were provided (3). Coverage is restricted to selected portals; omit sources for default broad aggregation.'] ELSE []::VARCHAR[] END
    || CASE WHEN mode = 1 THEN ['Normalized location ''' || place || ' - Centro'' to ''' || place || ''' for portal compatibility (district-level matching is applied during rerank).']
            WHEN mode = 2 THEN ['Normalized location ''' || place || ' – Alto'' to ''' || place || ''' for portal compatibility (district-level matching is applied during rerank).']
            ELSE []::VARCHAR[] END, ' | ') END AS request_warnings,
  CASE WHEN mode = 4 THEN '' WHEN mode = 3 THEN '{rules.DISCOVERY}' WHEN mode = 1 THEN place || ' | ' || other_place ELSE place END AS locations_searched,
  s.cap_total::BIGINT AS max_results_total
FROM search s JOIN source_list l USING (search_id) LEFT JOIN collapsed c USING (search_id)
LEFT JOIN (SELECT search_id, list(relax_note ORDER BY loc_pos, src_pos) AS notes FROM coverage WHERE relax_note IS NOT NULL GROUP BY search_id) n USING (search_id)""",
)
add(
    "search_action_required", b.SEARCH,
    select=f"SELECT search_id, 'MISSING_LOCATIONS' AS code, '{rules.MISSING_LOCATION_WARNING}' AS message, '{rules.MISSING_LOCATION_RETRY}' AS retry_hint FROM search WHERE mode = 4",
)
_PLACE_NORM, _PLACE_SLUG = b.norm("location"), b.slug("location")
add(
    "search_city_scope", b.LISTING, b.SEARCH, b.PLACE,
    f"""
named AS (SELECT portal, {b.norm('city')} AS city_norm, source_path FROM listing),
wanted AS (SELECT DISTINCT portal, location, discovery, {_PLACE_NORM} AS c_norm, {_PLACE_SLUG} AS c_slug FROM task),
counted AS (
  SELECT w.portal, w.location, count(*) AS n FROM wanted w JOIN named l ON l.portal = w.portal AND (w.discovery OR
    CASE WHEN city_norm <> '' THEN contains(' ' || city_norm || ' ', ' ' || c_norm || ' ') ELSE contains(source_path, c_slug || '_capital') END)
  GROUP BY ALL
)""",
    select="SELECT search_id, loc_pos::BIGINT AS loc_pos, src_pos::BIGINT AS src_pos, coalesce(n, 0) AS candidates FROM task LEFT JOIN counted USING (portal, location)",
)
add(
    "search_plan", b.SEARCH, b.PLACE,
    select="""SELECT search_id, loc_pos::BIGINT AS loc_pos, location, src_pos::BIGINT AS src_pos, portal, cap::BIGINT AS cap,
       array_to_string(hints, ' | ') AS hints FROM task""",
)
_r = RANK_CRITERIA
ONE = f"""
one AS (
  SELECT p.*, 'nation 3' AS c_norm, 'nation_3' AS c_slug, false AS discovery, false AS nearby, false AS strict, false AS no_ground,
         {_r['min_rooms']} AS min_rooms, NULL::INT AS min_capacity, {_r['max_price_eur']} AS max_price, {_r['min_floor']} AS min_floor,
         {b.sql_list(_r['tags'])} AS wanted, {b.sql_list(_r['location_hints'])} AS hints, []::VARCHAR[] AS property_types,
         true AS prefer_exterior, true AS renovation_ok FROM prepared p
),
kept AS (SELECT * FROM one WHERE {b._BASE} AND {b._FLOOR}),
scored_one AS ({b._scored('kept')})"""
add(
    "rank_one_search", b.LISTING, b.PREPARED, ONE,
    select="SELECT canonical_id, score::BIGINT AS score, array_to_string(why, ' | ') AS why FROM scored_one",
)

# -- cleaning ---------------------------------------------------------------------------
BLANKS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANKS}', ' ', 'g'), ' ')"


def decode(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        x = f"regexp_replace({x}, '(?i)&{name};', '{char}', 'g')"
    return x


_TEXT = collapse(decode("regexp_replace(html, '<[^>]*(>|$)', ' ', 'g')"))
add("page_text", select=f"SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM (SELECT page_id, {_TEXT} AS t FROM pages)")
ORACLES["page_text"] = f"SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM (SELECT page_id, {_TEXT} AS t FROM pages)"
_BOT = rules.BOT_BLOCK.replace("(?iu)", "(?i)")
ORACLES["page_links"] = rf"""
SELECT page_id, lower(regexp_replace(host || path, '/+$', '')) AS url_key,
  CASE WHEN scheme = 'https' THEN 'https://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END || rest END AS safe_url,
  regexp_replace(lower(host), '^www\.', '') AS domain, regexp_matches(html, '{_BOT}') AS bot_blocked
FROM (SELECT page_id, html, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
      regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^https?://[^?#]*(.*)$', 1) AS rest FROM pages)"""
ORACLES["document_text"] = f"""
SELECT doc_id, md5(n) AS norm_md5, md5(s) AS slug_md5, length(n)::BIGINT AS n_chars
FROM (SELECT doc_id, {b.norm('text')} AS n, {b.slug('text', '-')} AS s FROM documents)"""


def infer_type(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({x}), '{w}') THEN '{t}'" for t, w in rules.TYPE_WORDS)
    return f"CASE {cases} END"


def infer_tags(x: str, beach: bool = False) -> str:
    out = []
    for tag, pattern in rules.TAG_PATTERNS:
        p = b.EXT if tag == "exterior" else pattern.replace("(?iu)", "(?i)").replace("(?:", "(")
        if beach and tag == "nature":
            p = p.replace("|countryside)", "|countryside|beachfront)")
        out.append(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{tag}' END")
    return f"array_to_string(list_filter([{', '.join(out)}], lambda t: t IS NOT NULL), ' | ')"


_D = collapse(decode("regexp_replace(description, '<[^>]*(>|$)', ' ', 'g')"))
SAFE = """CASE WHEN o_orderkey % 10 = 3 THEN 'https://shared.example/Ref/' || o_custkey || '/?from=' || portal
     WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'https://www.' || portal || '.example/inmueble/' || o_orderkey END"""


def grouped(x: str, sep: str) -> str:
    return f"regexp_replace(format('{{:,}}', {x}), ',', '{sep}', 'g')"


add(
    "cleaned_listings", b.LISTING,
    f"cleaned AS (SELECT *, {_D} AS d, floor(price_eur)::BIGINT AS p FROM listing)",
    select=f"""
SELECT canonical_id, {b.norm('title')} AS title_norm, p::DOUBLE AS price_eur, rooms,
  CASE WHEN list_contains(chars, 'Bajo') THEN 0 WHEN n_nationkey % 5 <> 0 THEN (o_orderkey % 9)::INT END AS floor_no,
  {infer_type("title || ' ' || d")} AS property_type, {infer_tags("title || ' ' || d")} AS tags, url_key, {SAFE} AS safe_url,
  CASE WHEN o_orderkey % 10 = 3 THEN 'shared.example' ELSE portal || '.example' END AS domain,
  CASE WHEN p IS NULL THEN 'Precio no disponible' WHEN p < 10000 THEN p || chr(160) || '€' ELSE {grouped('p', '.')} || chr(160) || '€' END AS price_es,
  CASE WHEN p IS NULL THEN 'Price unavailable' ELSE '€' || {grouped('p', ',')} END AS price_en
FROM cleaned""",
)

# settled in turns: dropped beside an earlier kept row, kept when all earlier conflicting rows are dropped
add(
    "collapse_listings", b.LISTING,
    f"""
numbered AS (
  SELECT canonical_id, price_eur, rooms, url_key, {b.norm('city')} AS c, {b.norm('title')} AS t,
         row_number() OVER (ORDER BY coalesce(price_eur, 9007199254740991), coalesce(rooms, -1) DESC, last_seen_at DESC, canonical_id, seq) AS pos
  FROM listing
),
item AS (
  SELECT *, list_filter(list_distinct(string_split(t, ' ')), lambda w: length(w) >= 3 AND w NOT IN
           ('venta','alquiler','piso','pisos','casa','casas','chalet','apartamento','apartamentos','en','de','del','la','el','con')) AS w FROM numbered
),
word AS (SELECT pos, unnest(w) AS x FROM item),
shared AS (SELECT a.pos AS p, b.pos AS q, count(*) AS n FROM word a JOIN word b ON a.x = b.x AND a.pos < b.pos GROUP BY ALL),
alike AS (
  SELECT p, q FROM shared JOIN item a ON a.pos = p JOIN item b ON b.pos = q WHERE n::DOUBLE / least(len(a.w), len(b.w)) >= 0.9::DOUBLE
  UNION SELECT a.pos, b.pos FROM item a JOIN item b ON a.t = b.t AND a.t <> '' AND a.pos < b.pos
),
clash AS MATERIALIZED (
  SELECT p, q FROM alike JOIN item a ON a.pos = p JOIN item b ON b.pos = q
  WHERE (a.c = '' OR b.c = '' OR contains(a.c, b.c) OR contains(b.c, a.c)) AND coalesce(abs(a.rooms - b.rooms) <= 1, true)
    AND coalesce(abs(a.price_eur - b.price_eur) <= greatest(5000, floor(least(a.price_eur, b.price_eur) * 0.05::DOUBLE + 0.5)), true)
  UNION SELECT a.pos, b.pos FROM item a JOIN item b ON a.url_key = b.url_key AND a.pos < b.pos
),
walk AS (
  SELECT pos, CASE WHEN pos IN (SELECT q FROM clash) THEN 'open' ELSE 'kept' END AS state, 0 AS turn FROM item
  UNION ALL
  SELECT pos, state, turn FROM (
    SELECT w.pos, w.turn + 1 AS turn, CASE WHEN w.state <> 'open' THEN w.state WHEN bool_or(e.state = 'kept') THEN 'dropped'
                                           WHEN bool_or(e.state = 'open') THEN 'open' ELSE 'kept' END AS state
    FROM walk w LEFT JOIN clash c ON c.q = w.pos AND w.state = 'open' LEFT JOIN walk e ON e.pos = c.p GROUP BY w.pos, w.turn, w.state
  ) WHERE (SELECT count(*) FROM walk WHERE state = 'open') > 0
),
final AS (SELECT pos FROM walk WHERE state = 'kept' AND turn = (SELECT max(turn) FROM walk))""",
    select="SELECT canonical_id, price_eur, rooms FROM item JOIN final USING (pos)",
)

# -- extraction -------------------------------------------------------------------------
FULL_TITLE = "title || CASE WHEN rooms IS NOT NULL THEN ', ' || rooms::INT || ' habs.' ELSE '' END"
URLS = {
    "pisos": "'https://www.pisos.com/comprar/inmueble-' || o_orderkey || '/'",
    "habitaclia": "'https://www.habitaclia.com/x-i' || o_orderkey || '.htm'",
    "tucasa": "'https://www.tucasa.com/x?id=' || o_orderkey",
    "fotocasa": "'https://www.fotocasa.es/es/comprar/vivienda/' || replace(lower(crawl_location), '_', '-') || '/zona/' || o_orderkey || '/d'",
    "yaencontre": "'https://www.yaencontre.com/venta/x/' || o_orderkey",
    "milanuncios": "'https://www.milanuncios.com/venta-de-inmuebles/x-' || o_orderkey || '.htm'",
    "idealista": "'https://www.idealista.com/inmueble/' || o_orderkey || '/'",
    "globaliza": "'https://www.globaliza.com/inmueble/' || o_orderkey",
    "hogaria": "'https://www.hogaria.net/venta/x_' || o_orderkey || '.aspx'",
    "spainhouses": "'https://www.spainhouses.net/es/x-' || o_orderkey || '.html'",
    "pisocompartido": "'https://www.pisocompartido.com/anuncio/' || o_orderkey || '/'",
    "enalquiler": "'https://www.enalquiler.com/x_' || o_orderkey || '.html'",
    "nuroa": "'https://www.nuroa.es/go/' || o_orderkey",
}
_BOTH = "ft || ' ' || d"
_PISOS_TYPE = (
    f"CASE WHEN regexp_matches(lower({_BOTH}), 'piso|flat|apart|atico') THEN 'flat' "
    f"WHEN regexp_matches(lower({_BOTH}), 'casa|house|chalet|villa|adosada|pareada') THEN 'house' "
    f"WHEN regexp_matches(lower({_BOTH}), 'oficina|office') THEN 'office' "
    f"WHEN regexp_matches(lower({_BOTH}), 'suelo|land|solar|terreno|plot') THEN 'land' END"
)
for portal in rules.PORTALS:
    kind = {"habitaclia": infer_type("ft"), "fotocasa": infer_type("ft"), "pisos": _PISOS_TYPE}.get(portal, infer_type(_BOTH))
    tags = {
        "habitaclia": infer_tags("ft"), "fotocasa": infer_tags("ft"), "tucasa": infer_tags("d"), "pisos": infer_tags("d", True),
    }.get(portal, infer_tags(_BOTH))
    described = {"habitaclia": "ft", "fotocasa": "''"}.get(portal, "d")
    city = {
        "habitaclia": "crawl_location",
        "fotocasa": "'Nation ' || regexp_extract(crawl_location, '[0-9]+')",
        "tucasa": f"{collapse(chr(39).join(['regexp_replace(shown, ', ' *' + chr(92) + '([^)]*' + chr(92) + ') *', ', ', ' ', ', ', 'g', ')']))}",
    }.get(portal, "shown")
    # an empty heading: some layouts name the listing after its id, one skips the card
    fallback = {"fotocasa": "'Vivienda ' || o_orderkey"}.get(
        portal,
        "'Inmueble ' || o_orderkey" if portal in ("habitaclia", "milanuncios", "spainhouses", "idealista", "tucasa", "yaencontre") else "''",
    )
    heading = f"coalesce(nullif({collapse(FULL_TITLE)}, ''), {fallback})"
    skipped = "WHERE ft <> ''" if portal == "pisos" else ""
    add(
        f"extract_{portal}", b.LISTING,
        f"""src AS (SELECT *, {heading} AS ft, {collapse('description')} AS d,
            CASE WHEN city = '' THEN crawl_location ELSE city END AS shown FROM listing WHERE portal = '{portal}')""",
        select=f"""
SELECT canonical_id, crawl_location, {URLS[portal]} AS url, ft AS title, {city} AS city, floor(price_eur)::DOUBLE AS price_eur,
  rooms, {kind} AS property_type, md5({described}) AS description_md5, {tags} AS tags FROM src {skipped}""",
    )

# however deep a list lies, its listings are those of the flat page
ORACLES["extract_nested_lists"] = ORACLES["extract_tucasa"]

add(
    "adapter_caps", b.LISTING,
    f"""src AS (
  SELECT *, o_orderkey // 6500 + 1 AS page_no, CASE WHEN portal = 'milanuncios' THEN 6 ELSE 8 END AS max_pages,
         contains({b.norm("CASE WHEN city = '' THEN crawl_location ELSE city END")}, {b.norm('crawl_location')}) AS hit
  FROM listing WHERE portal IN ('milanuncios', 'spainhouses')
),
page AS (
  SELECT portal, crawl_location, page_no, coalesce(sum(count(*)) OVER (PARTITION BY portal, crawl_location ORDER BY page_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM src WHERE page_no <= max_pages GROUP BY portal, crawl_location, page_no
),
capped AS (
  SELECT s.* FROM src s JOIN page p USING (portal, crawl_location, page_no) WHERE before < 20
  QUALIFY row_number() OVER (PARTITION BY s.portal, s.crawl_location ORDER BY CASE WHEN s.portal = 'spainhouses' AND NOT hit THEN 1 ELSE 0 END, seq) <= 20
),
flagged AS (SELECT *, bool_or(hit) OVER (PARTITION BY portal, crawl_location) AS any_hit FROM capped)""",
    select="SELECT canonical_id, crawl_location, NOT any_hit AS broadened FROM flagged WHERE hit OR NOT any_hit",
)

# -- page outcomes ----------------------------------------------------------------------
_POLICY_ROWS = ", ".join(
    f"({i}, '{name}', {p.max_requests}, {p.blocked and str(list(p.blocked)) or '[]::INT[]'}, '{p.server_error}', {p.not_found}, "
    f"{repr((p.error_page or '').replace('(?iu)', '(?i)').replace('(?![A-Za-z0-9_])', '([^A-Za-z0-9_]|$)')) if 0 else chr(39) + (p.error_page or '').replace('(?iu)', '(?i)').replace('(?![A-Za-z0-9_])', '([^A-Za-z0-9_]|$)').replace(chr(39), chr(39) * 2) + chr(39)}, "
    f"'{p.error_page_class}', {p.counts_unavailable}, {('NULL' if p.empty_is_error is None else chr(39) + p.empty_is_error + chr(39))}, {b.sql_list(p.fail_fast) + '::VARCHAR[]'})"
    for i, (name, p) in ((rules.PORTALS.index(n), (n, pol)) for n, pol in __import__('roost.operators.outcomes', fromlist=['POLICIES']).POLICIES.items())
)
from roost.operators.outcomes import CHALLENGE  # noqa: E402

_CH = " ".join(f"WHEN portal = '{k}' THEN regexp_matches(html, '{v.replace('(?iu)', '(?i)')}')" for k, v in CHALLENGE.items())
FETCHED = f"""
policy AS (SELECT * FROM (VALUES {_POLICY_ROWS}) t(pos, portal, max_requests, blocked, server_error, has_404, error_page, error_class, counts_down, empty_code, fast)),
fetched AS (
  SELECT portal, 'Place ' || (page_id // 39) AS crawl_location, (page_id // 13) % 3 + 1 AS page_no, html,
         [200, 403, 429, 404, 503, 200, 401][((page_id // 39) % 7 + 1)::INT] AS status, policy.* EXCLUDE (portal, pos)
  FROM pages JOIN policy ON pos = page_id % 13
),
classed AS (
  SELECT *, CASE WHEN status = 429 THEN 'rate_limited' WHEN list_contains(blocked, status) THEN 'blocked'
    WHEN has_404 AND status = 404 THEN 'not_found' WHEN status >= 500 THEN server_error
    WHEN portal IN ('yaencontre', 'habitaclia') AND challenged THEN 'challenge' WHEN status < 200 OR status >= 300 THEN 'http_error'
    WHEN error_page <> '' AND regexp_matches(html, error_page) THEN error_class
    WHEN portal <> 'pisos' AND challenged THEN 'challenge' ELSE 'ok' END AS page_class
  FROM (SELECT *, CASE {_CH} ELSE regexp_matches(html, '{_BOT}') END AS challenged FROM fetched)
  WHERE page_no <= max_requests
)"""
add("page_classes", FETCHED, select="SELECT portal, crawl_location, page_no, page_class FROM classed")
add(
    "outcome_rollups", FETCHED,
    """rolled AS (
  SELECT portal, crawl_location, count(*) AS n, count(*) FILTER (page_class IN ('blocked', 'challenge')) AS n_blocked,
    count(*) FILTER (page_class = 'rate_limited') AS n_rate, count(*) FILTER (page_class = 'unavailable') AS n_down,
    arg_min(page_class, page_no) FILTER (list_contains(fast, page_class) AND (portal <> 'fotocasa' OR page_no = 1)) AS fatal,
    any_value(counts_down) AS counts_down, any_value(empty_code) AS empty_code FROM classed GROUP BY ALL
)""",
    select="""SELECT portal, crawl_location, CASE WHEN fatal = 'rate_limited' THEN 'UPSTREAM_RATE_LIMIT' WHEN fatal IN ('blocked', 'challenge') THEN 'UPSTREAM_BLOCKED'
    WHEN fatal = 'unavailable' THEN 'UPSTREAM_UNAVAILABLE'
    WHEN portal NOT IN ('habitaclia', 'fotocasa', 'pisos') AND n_rate = n THEN 'UPSTREAM_RATE_LIMIT'
    WHEN portal NOT IN ('habitaclia', 'fotocasa', 'pisos') AND n_blocked = n THEN 'UPSTREAM_BLOCKED'
    WHEN counts_down AND n_down = n THEN 'UPSTREAM_UNAVAILABLE' ELSE empty_code END AS error_code FROM rolled""",
)

# the newest fetch of every page of the fetch history
HISTORY = FETCHED[: FETCHED.index("fetched AS (")] + """history AS (
  SELECT portal, 'nation ' || ((page_id // 13) % 5) AS location_key, (page_id // 65) % 2 + 1 AS page_no, page_id AS fetch_id, html,
         (page_id * 37) % 101 AS hour, CASE WHEN (page_id // 13) % 5 = 0 THEN [403, 429, 503][(page_id % 3 + 1)::INT]
           ELSE [200, 403, 429, 404, 503, 200, 401][((page_id // 13 + page_id % 13 * 3) % 7 + 1)::INT] END AS status,
         policy.* EXCLUDE (portal, pos)
  FROM pages JOIN policy ON pos = page_id % 13
),
fetched AS (
  SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY portal, location_key, page_no ORDER BY hour DESC, fetch_id DESC) = 1
),
""" + FETCHED[FETCHED.index("classed AS (") :]
add("latest_pages", HISTORY, select="SELECT portal, location_key, page_no, fetch_id, page_class FROM classed")
READ = """
read AS (
  SELECT portal, location_key, count(*) AS n, count(*) FILTER (page_class IN ('blocked', 'challenge')) AS n_blocked,
    count(*) FILTER (page_class = 'rate_limited') AS n_rate, count(*) FILTER (page_class = 'unavailable') AS n_down,
    5 * count(*) FILTER (page_class = 'ok') AS n_listings,
    arg_min(page_class, page_no) FILTER (list_contains(fast, page_class) AND (portal <> 'fotocasa' OR page_no = 1)) AS fatal,
    any_value(counts_down) AS counts_down, any_value(empty_code) AS empty_code FROM classed GROUP BY portal, location_key
),
outcome AS (
  SELECT portal, location_key, n_listings, CASE WHEN fatal = 'rate_limited' THEN 'UPSTREAM_RATE_LIMIT'
    WHEN fatal IN ('blocked', 'challenge') THEN 'UPSTREAM_BLOCKED' WHEN fatal = 'unavailable' THEN 'UPSTREAM_UNAVAILABLE'
    WHEN n_listings > 0 THEN NULL
    WHEN portal NOT IN ('habitaclia', 'fotocasa', 'pisos') AND n_rate = n THEN 'UPSTREAM_RATE_LIMIT'
    WHEN portal NOT IN ('habitaclia', 'fotocasa', 'pisos') AND n_blocked = n THEN 'UPSTREAM_BLOCKED'
    WHEN counts_down AND n_down = n THEN 'UPSTREAM_UNAVAILABLE' ELSE empty_code END AS error_code FROM read
)"""
add("outcomes_incremental", HISTORY, READ, select="SELECT portal, location_key, error_code, n_listings::BIGINT AS n_listings FROM outcome")
add(
    "page_totals_incremental", HISTORY,
    select="""SELECT portal, location_key, page_class, count(*) AS n_pages, CASE WHEN page_class = 'ok' THEN 5 * count(*) ELSE 0 END::BIGINT AS n_listings
  FROM classed GROUP BY portal, location_key, page_class""",
)
OPENED = f"""
opened AS (
  SELECT t.*, o.error_code FROM task t LEFT JOIN outcome o ON o.portal = t.portal AND o.location_key = {b.norm('t.location')}
)"""
READ_PICK = b.PICK.replace("FROM task t JOIN prepared p", "FROM (SELECT * EXCLUDE (error_code) FROM opened WHERE error_code IS NULL) t JOIN prepared p")
READ_FOUND = (HISTORY, READ, b.LISTING, b.SEARCH, b.PLACE, OPENED, b.PREPARED, READ_PICK)
add(
    "search_with_outcomes", *READ_FOUND, b.COLLAPSE, b.RESULT,
    select="SELECT search_id, result_rank, canonical_id, score::BIGINT AS score FROM result",
)
add(
    "public_coverage", *READ_FOUND, COVERAGE,
    select="""SELECT search_id, c.loc_pos::BIGINT AS loc_pos, c.src_pos::BIGINT AS src_pos, c.location, c.portal,
  CASE WHEN o.error_code IS NULL THEN 'scrape' END AS source, candidates, returned, o.error_code,
  CASE o.error_code WHEN 'UPSTREAM_RATE_LIMIT' THEN 'A source is temporarily rate limited.'
    WHEN 'UPSTREAM_SCHEMA_CHANGED' THEN 'A source returned an unsupported response.'
    WHEN 'UPSTREAM_BLOCKED' THEN 'A source blocked automated access.'
    WHEN 'UPSTREAM_UNAVAILABLE' THEN 'A source is temporarily unavailable.' END AS public_message
  FROM coverage c JOIN opened o USING (search_id, loc_pos, src_pos)""",
)
add(
    "search_failures", HISTORY, READ, b.SEARCH, b.PLACE, OPENED,
    select="""SELECT search_id, arg_min(error_code, loc_pos * 100 + src_pos) AS error_code FROM opened
  GROUP BY search_id HAVING bool_and(error_code IS NOT NULL)""",
)

# -- presentation -----------------------------------------------------------------------
PUBLIC = f"""
public AS (
  SELECT *, {SAFE} AS safe_url, row_number() OVER (PARTITION BY search_id ORDER BY result_rank) AS card_pos
  FROM result WHERE {SAFE} IS NOT NULL
),
card AS (
  SELECT *, CASE WHEN o_orderkey % 10 = 3 THEN 'shared.example' ELSE portal || '.example' END AS source_domain,
    floor(price_eur + 0.5)::BIGINT AS p,
    list_filter([CASE WHEN rooms IS NOT NULL THEN rooms::INT || CASE WHEN locale = 'es' THEN ' hab.' ELSE ' rooms' END END,
      CASE WHEN n_nationkey % 5 <> 0 AND o_orderkey % 9 > 0 THEN (o_orderkey % 9) || 'ª planta' END, property_type], lambda x: x IS NOT NULL) AS facts,
    CASE WHEN n_images >= 1 THEN 'https://img.example/' || o_orderkey || '/1' END AS image_url
  FROM public WHERE card_pos <= 20
),
priced AS (
  SELECT *, CASE WHEN p IS NULL THEN CASE WHEN locale = 'es' THEN 'Precio no disponible' ELSE 'Price unavailable' END
    WHEN locale = 'es' THEN CASE WHEN p < 10000 THEN p::VARCHAR ELSE {grouped('p', '.')} END || chr(160) || '€'
    ELSE '€' || {grouped('p', ',')} END AS price FROM card
)"""
SHOWN = (*b.SEARCH_CTES, PUBLIC)
_CUT = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_EDGE = BLANKS
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(description, '{_CUT}', '', 'g'), '^{_EDGE}', ''), '{_EDGE}$', '')"
add(
    "public_rows", *SHOWN,
    select=f"""SELECT search_id, result_rank, safe_url AS url, title, least(12, n_images - CASE WHEN n_images >= 2 THEN 1 ELSE 0 END)::BIGINT AS n_images,
  md5(substring({_CLEAN}, 1, 2000)) AS description_md5, array_to_string(tags, ' | ') AS tags,
  CASE WHEN n_nationkey % 5 <> 0 AND o_orderkey % 9 > 0 THEN (o_orderkey % 9) || 'ª planta' END AS floor_label, lat FROM public""",
)
add(
    "result_cards", *SHOWN,
    select="""SELECT search_id, card_pos, canonical_id, source_domain, price, array_to_string(facts, ' | ') AS facts, image_url,
       lat AS latitude, lon AS longitude FROM priced""",
)
add(
    "result_markdown", *SHOWN,
    """lines AS (
  SELECT search_id, string_agg(card_pos || '. **[' || title || '](' || safe_url || ')**' || chr(10) || price || ' · ' || city
    || CASE WHEN len(facts) > 0 THEN ' · ' || array_to_string(facts, ' · ') ELSE '' END || ' · score ' || score || '/100' || chr(10)
    || CASE WHEN image_url IS NOT NULL THEN '![' || title || '](' || image_url || ')' || chr(10) ELSE '' END
    || CASE WHEN len(why) > 0 THEN CASE WHEN locale = 'es' THEN 'Por qué encaja: ' ELSE 'Why matched: ' END || array_to_string(why[1:3], '; ') || chr(10) ELSE '' END,
    chr(10) ORDER BY card_pos) AS body FROM priced GROUP BY search_id
)""",
    select="""SELECT search_id, CASE WHEN body IS NULL THEN CASE WHEN locale = 'es' THEN 'No se encontraron propiedades para generar tarjetas.' ELSE 'No properties found to build cards.' END
  ELSE CASE WHEN locale = 'es' THEN '### Vista rápida (tarjetas)' ELSE '### Quick property cards' END || chr(10) || body END AS markdown
FROM search LEFT JOIN lines USING (search_id)""",
)


def hashed(x: str) -> str:
    return (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)), "
        "lambda h, c: (h * 31 + c) % 4294967296)"
    )


POINT = f"""
hashes AS (SELECT *, {hashed('canonical_id')} AS h, {hashed("'spain'")} AS a FROM priced),
point AS (
  SELECT search_id, canonical_id, lat IS NOT NULL AND lon IS NOT NULL AS exact,
    coalesce(lat, (36.0::DOUBLE + ((a % 7000) / 7000.0::DOUBLE) * 7.7::DOUBLE) + (((h % 200) - 100) / 100.0::DOUBLE) * 0.012::DOUBLE) AS lat,
    coalesce(lon, (-9.2::DOUBLE + (((a // 7000) % 11000) / 11000.0::DOUBLE) * 12.0::DOUBLE) + ((((h // 200) % 200) - 100) / 100.0::DOUBLE) * 0.014::DOUBLE) AS lon
  FROM hashes
)"""
add("card_points", *SHOWN, POINT, select="SELECT search_id, canonical_id, exact, round(lat, 6) AS lat, round(lon, 6) AS lon FROM point")
add(
    "card_bounds", *SHOWN, POINT,
    select="""SELECT search_id, count(*) AS n_points, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat,
       round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon FROM point GROUP BY search_id""",
)
add(
    "portal_counts", *SHOWN, COVERAGE,
    """gave AS (SELECT search_id, count(DISTINCT portal) FILTER (candidates > 0 OR returned > 0) AS n FROM coverage GROUP BY search_id),
shown AS (SELECT search_id, count(DISTINCT source_domain) AS n_domains FROM card GROUP BY search_id)""",
    select="""SELECT search_id, coalesce(nullif(n, 0), n_domains, 0) AS portal_count FROM gave LEFT JOIN shown USING (search_id)""",
)

# -- status, planning, request log ------------------------------------------------------
ATTEMPT = f"""
attempt AS (
  SELECT portal, attempt, hits % 5 AS returned_count,
    CASE WHEN n_errors % 3 = 0 THEN 'UPSTREAM_BLOCKED' WHEN n_errors % 7 = 1 THEN 'UPSTREAM_RATE_LIMIT' END AS error_code
  FROM (SELECT {b.sql_list(rules.PORTALS)}[(user_id % 13 + 1)::INT] AS portal, (user_id % 3) + 1 AS attempt,
        count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (value > 40) AS hits FROM events GROUP BY ALL)
)"""
_LINKS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.PORTAL_URLS.items())
add(
    "probe_status", ATTEMPT,
    f"""probed AS (
  SELECT portal, arg_min(returned_count, attempt) FILTER (error_code IS NULL) AS returned FROM attempt WHERE attempt <= 2 GROUP BY portal
)""",
    select=f"""SELECT list_position({b.sql_list(rules.STATUS_ORDER)}, portal)::BIGINT AS position, portal, CASE portal {_LINKS} END AS portal_url,
  CASE WHEN returned IS NULL THEN 'blocked' WHEN returned > 0 THEN 'available' ELSE 'no_results' END AS state, coalesce(returned, 0)::BIGINT AS returned_count FROM probed""",
)
add(
    "probe_summary", ATTEMPT,
    select="""SELECT count(*) FILTER (error_code IS NULL) AS ok_count, count(*) FILTER (error_code IS NOT NULL) AS upstream_error_count,
       0::BIGINT AS failed_count FROM attempt""",
)
ORACLES["place_suggestions"] = """
SELECT city, name, province, nullif(location, 0) AS location, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY score DESC, quantity DESC, c_custkey) AS rn FROM (
    SELECT n_name AS city, c_custkey, CASE WHEN c_custkey % 5 = 0 THEN n_name ELSE n_name || ' ' || c_mktsegment END AS name,
      c_nationkey::DOUBLE AS province, (c_custkey % 50)::DOUBLE AS location, (c_custkey % 900)::DOUBLE AS quantity,
      CASE c_custkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 40 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 160 ELSE 70 END
        + least(40, (c_custkey % 900) // 20) AS score
    FROM customer JOIN nation ON n_nationkey = c_nationkey)) WHERE rn = 1"""
ORACLES["request_audit"] = """
WITH RECURSIVE log AS (
  SELECT event_id, event_type || '-' || (user_id % 10) AS key, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY event_type || '-' || (user_id % 10) ORDER BY ts, event_id) AS rn FROM events
),
walk AS (
  SELECT event_id, key, rn, t, t AS start, 1::BIGINT AS n FROM log WHERE rn = 1
  UNION ALL
  SELECT l.event_id, l.key, l.rn, l.t, CASE WHEN l.t >= w.start + 3600000000 THEN l.t ELSE w.start END,
         CASE WHEN l.t >= w.start + 3600000000 THEN 1 ELSE w.n + 1 END
  FROM walk w JOIN log l ON l.key = w.key AND l.rn = w.rn + 1
)
SELECT event_id, key, n AS n_in_window, n <= 1 AS allowed, greatest(0, 1 - n)::BIGINT AS remaining,
       greatest(1, ceil((start + 3600000000 - t) / 1000000.0))::BIGINT AS retry_after_seconds FROM walk"""

ORACLES["request_audit_default"] = """
WITH RECURSIVE log AS (
  SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '10.0.0.1' ELSE '10.1.0.' || (user_id % 200) END AS key, epoch_us(ts) // 100 AS t FROM events
),
times AS (SELECT DISTINCT key, t FROM log),
later AS (
  SELECT key, t, min(t) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 60000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM times
),
walk AS (
  SELECT key, min(t) AS start FROM times GROUP BY key
  UNION ALL
  SELECT l.key, l.after FROM walk w JOIN later l ON l.key = w.key AND l.t = w.start WHERE l.after IS NOT NULL
),
placed AS (
  SELECT l.event_id, l.key, l.t, max(w.start) OVER (PARTITION BY l.key ORDER BY l.t) AS start
  FROM log l LEFT JOIN walk w ON l.key = w.key AND l.t = w.start
),
seen AS (SELECT *, row_number() OVER (PARTITION BY key, start ORDER BY t, event_id) AS n FROM placed)
SELECT event_id, key, n AS n_in_window, n <= 12 AS allowed, greatest(0, 12 - n)::BIGINT AS remaining,
       greatest(1, ceil((start + 60000000 - t) / 1000000.0))::BIGINT AS retry_after_seconds FROM seen"""
