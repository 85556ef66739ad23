"""Text, number and URL columns; rate limit; status; plans of pages to fetch."""

import datetime as dt

from pyspark.sql import functions as F

from roost import rules, schema
from roost.functions import numbers as n
from roost.functions import text as t
from roost.functions import urls as u
from roost.operators import present, status
from roost.plans.crawl_plan import best_suggestions, crawl_plan, index_links, read_suggestion_rows
from roost.plans.search_plan import plan_requests, plan_tasks
from roost.streaming.rate_limit import client_key, rate_limit_audit, rate_limit_stream


def each(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text(spark):
    assert each(spark, ["<p>Piso &amp; ático</p><br>luminoso", "a <b", "&#x20AC;&#233;&#99999999;&amp;lt;&NBSP;x"], t.strip_tags) == [
        "Piso & ático luminoso", "a", "€é&#99999999;&lt; x"]
    assert each(spark, ["Náquera, L’Eliana ª", None], t.normalize_text) == ["naquera l eliana", None]
    assert each(spark, ["L’Eliana d'Or  x"], t.slugify) == ["leliana-dor-x"]
    assert each(spark, [["  A", "b", "a", "", "B "]], t.unique_strings, "array<string>") == [["A", "b"]]
    rooms = ["Piso con 3 habitaciones", "4 habs. y terraza", "Apartment with 2 rooms", "Dormitorio sin número", "Referencia 123roommate",
             "1234 habitaciones", "1 habitación", "5 habs.x"]
    assert each(spark, rooms, n.parse_rooms) == [3.0, 4.0, 2.0, None, None, 4.0, None, None]
    assert each(spark, ["349.000,50 €", "x"], n.parse_price) == [34900050.0, None]
    assert each(spark, ["349.000", "1,5", "12.5", " 80 ", "1.234.567"], n.parse_number) == [349000.0, None, 12.5, 80.0, 1234567.0]
    assert each(spark, [["a", "3ª planta"], ["ñbajo"], ["Bajo"], ["12345  planta"]], n.extract_floor, "array<string>") == [3, 0, 0, 345]
    es = each(spark, [320000.0, 1234.0, None], lambda c: n.format_price(c, F.lit("es")), "double")
    assert es == ["320.000\u00a0€", "1234\u00a0€", "Precio no disponible"]


def test_urls(spark):
    links = ["HTTPS://u:p@Www.X.com:443/A/b//?q=1#z", "http://x.y", "foo Bar "]
    assert each(spark, links, u.listing_url_key) == ["www.x.com/a/b", "x.y", "foo bar"]
    assert each(spark, links, u.safe_https_url) == ["https://www.x.com/A/b//?q=1#z", None, None]
    assert each(spark, links, u.domain_of) == ["x.com", "x.y", ""]
    assert each(spark, ["a%252Bb+c", "%zz"], lambda c: u.percent_decode(c, 5)) == ["a+b+c", "%zz"]


def test_map_points(spark):
    rows = [("s", "id", "Malilla (València)", None, None), ("s", "id2", "Nowhere", 10.0, 20.0), ("s", "id3", "Nowhere", None, None)]
    df = spark.createDataFrame(rows, "search_id string, canonical_id string, city string, latitude double, longitude double")
    got = {r.canonical_id: r for r in present.map_points(df).collect()}
    assert abs(got["id"].lat - 39.4699) <= 0.0121 and got["id2"].exact and (got["id2"].lat, got["id2"].lon) == (10.0, 20.0)
    assert abs(got["id3"].lat - 40.4979) <= 0.0121 and abs(got["id3"].lon + 4.11418) <= 0.0141
    assert each(spark, ["spain"], present.text_hash) == [109638089]


def test_status(spark):
    rows = [("pisos", 1, None, "UPSTREAM_BLOCKED"), ("pisos", 2, 4, None), ("nuroa", 1, None, "UPSTREAM_RATE_LIMIT"),
            ("nuroa", 2, None, "UPSTREAM_BLOCKED"), ("tucasa", 1, 0, None), ("hogaria", 1, None, "AUTH_REJECTED")]
    df = spark.createDataFrame(rows, "portal string, attempt int, returned_count bigint, error_code string")
    got = {r.portal: (r.state, r.returned_count) for r in status.portal_status(df).collect()}
    assert got == {"pisos": ("available", 4), "nuroa": ("blocked", 0), "tucasa": ("no_results", 0), "hogaria": ("failed", 0)}


def test_crawl_plan_and_links(spark):
    names = [f.name for f in schema.SEARCH.fields]
    req = [dict(search_id="r", city="Ronda", transaction_type="rent", property_types=["flat"], nearby_towns=True,
                sources=["pisos", "hogaria", "spainhouses", "enalquiler", "nuroa", "pisocompartido", "idealista"]),
           dict(search_id="b", city="Ronda", transaction_type="buy", sources=["enalquiler", "fotocasa", "milanuncios"])]
    df = spark.createDataFrame([{**dict.fromkeys(names), **r} for r in req], schema.SEARCH)
    got = {}
    for r in crawl_plan(plan_tasks(plan_requests(df))).orderBy("page_no").collect():
        got.setdefault((r.search_id, r.portal), []).append(r.path)
    assert got[("r", "hogaria")] == ["/alquiler-piso/malaga/ronda.aspx", "/alquiler-piso/malaga-33-1.aspx"]
    assert got[("r", "spainhouses")][:4] == ["/en/alquiler-pisos-ronda.html", "/en/alquiler-pisos-ronda/pagina-2.html",
                                             "/en/alquiler-pisos-ronda-malaga.html", "/en/alquiler-pisos-ronda-malaga/pagina-2.html"]
    assert got[("r", "enalquiler")] == [p for b in ("/alquiler-pisos-ronda-31-2-0-41961.html", "/alquiler-pisos-ronda-31-2-0.html") for p in (b, b + "?page=2")]
    assert got[("r", "pisos")] == ["/alquiler/pisos-ronda_capital_zona_urbana/", "/alquiler/pisos-ronda_capital/", "/alquiler/pisos-ronda/"]
    assert got[("r", "nuroa")] == ["/alquiler/piso-ronda", "/alquiler/piso-ronda?page=2"]
    assert got[("r", "idealista")] == ["/alquiler-pisos/ronda-ronda/", "/alquiler-pisos/ronda/"]
    assert ("b", "enalquiler") not in got and got[("b", "fotocasa")] == ["/es/comprar/viviendas/ronda/todas-las-zonas/l"]
    assert len(got[("b", "milanuncios")]) == 6 and got[("b", "milanuncios")][2] == "/venta-de-pisos-en-ronda/"
    pages = spark.createDataFrame([("alquiler/viviendas", '<a href="/alquiler/viviendas/malaga/ronda-centro/">x</a><a href="/alquiler/viviendas/rondal/">y</a><a href="/otros/ronda/">z</a>')],
                                  "operation_path string, html string")
    cities = spark.createDataFrame([("ronda",)], "city_slug string")
    assert [r.url for r in index_links(pages, cities).collect()] == ["https://www.tucasa.com/alquiler/viviendas/malaga/ronda-centro/"]


def test_suggestions(spark):
    payload = '{\u201csuggestions\u201d:\u00a0[{"type":"District","name":"Ronda","province":1,"quantity":900},{"type":"City","name":"Ronda","province":"31","location":41961,"quantity":40}]}'
    raw = spark.createDataFrame([("Ronda", payload), ("X", "bad")], "city string, payload string")
    best = best_suggestions(read_suggestion_rows(raw)).collect()
    assert [(r.city, r.province, r.location, r.score) for r in best] == [("Ronda", 31.0, 41961.0, 362)]


def log(spark):
    base = dt.datetime(2026, 1, 1)
    rows = [(i, "a", base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 59, 60, 61, 200, 1000])]
    return spark.createDataFrame(rows + [(100, "b", base)], "event_id bigint, key string, ts timestamp")


EXPECTED = {0: 1, 1: 2, 2: 3, 3: 4, 4: 1, 5: 2, 6: 1, 7: 1, 100: 1}


def test_rate_limit_batch(spark):
    rows = {r.event_id: r for r in rate_limit_audit(log(spark), limit=3).collect()}
    assert {k: r.n_in_window for k, r in rows.items()} == EXPECTED
    assert not rows[3].allowed and rows[3].remaining == 0 and rows[3].retry_after_seconds == 1 and rows[1].remaining == 1
    assert each(spark, [" 1.2.3.4 , 5", "", None], client_key) == ["1.2.3.4", "unknown", "unknown"]


def test_rate_limit_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    log(spark).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("event_id bigint, key string, ts timestamp").parquet(source)
    query = (rate_limit_stream(stream, limit=3).writeStream.format("memory").queryName("verdicts").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        query.processAllAvailable()
        rows = {r.event_id: r for r in spark.table("verdicts").collect()}
    finally:
        query.stop()
    assert {k: r.n_in_window for k, r in rows.items()} == EXPECTED and not rows[3].allowed


def test_word_patterns_are_found_as_words_with_the_same_answer(spark):
    words = [w for _, p in rules.TYPE_WORDS + rules.TAG_PATTERNS for w in p.removeprefix("(?iu)").replace("(?:", "").replace(")", "").split("|")]
    texts = [None, "", "Well-Lit", "luminosas", "panorám", "panoram", "montaña", "montana", "exteriores", "un exterior.", "xexterior",
             "outside-facing", "east facing", "views", "finca rústica", "toda exterior", *[f"a{w}b" for w in words], *[f"un {w[:-1]}" for w in words]]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    patterns = [rules.lower_pattern(p) for _, p in rules.TYPE_WORDS + rules.TAG_PATTERNS] + ["a+b", "x?", "(?:piso|[0-9])"]
    same = rows.select(*[t.says(F.lower("x"), p).eqNullSafe(F.lower("x").rlike(p)).alias(str(i)) for i, p in enumerate(patterns)])
    assert all(all(r) for r in same.collect())
    # plain words are no pattern any more: only the one pattern with word borders is left among the tags
    plan = rows.select(*[t.says(F.col("x"), rules.lower_pattern(p)).alias(n) for n, p in rules.TAG_PATTERNS])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1


def test_blanks_and_quick_patterns(spark):
    odd = [" ﻿ a  b\t", " \t ", "", "x", "　", "a  b\tc d ", None]
    assert each(spark, odd, t.trim_ws) == ["a  b", "", "", "x", "", "a  b\tc d", None]
    assert each(spark, odd, t.collapse_ws) == ["a b", "", "", "x", "", "a b c d", None]
    quick = t.quickly(rules.BOT_BLOCK)
    assert quick.startswith("(?=")
    pages = ["x PARDON our interruption", "enable javascript", "Sentimos la interrupciÓn", "acceſſ denied", "daſa", "forbid den", "", None]
    plain = each(spark, pages, lambda x: x.rlike(rules.BOT_BLOCK), "string")
    assert each(spark, pages, lambda x: x.rlike(quick), "string") == plain == [True, True, True, True, False, False, False, None]
    assert t.quickly(r"(?iu)a\s*b|cd") == r"(?iu)a\s*b|cd"


def test_lazy_captures_span_lines_and_symbols(spark):
    from roost.operators.portals import common as c

    pattern = c.inner("div", "txt")
    assert r"[\s\S]" not in pattern
    blocks = ['<DIV class="big txt">a\r\n \U0001f600<b>b</b></Div></div>', '<div class="txt">open', "<div class='txt'></div>"]
    assert each(spark, blocks, lambda b: t.first_match(b, pattern)) == ["a\r\n \U0001f600<b>b</b>", None, ""]


def test_spread_by_several_keys(spark):
    from roost.sources.views import spread

    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"))
    placed = spread(rows, "a", "b").select("a", "b", F.spark_partition_id().alias("p")).distinct()
    assert placed.count() == 77 and placed.select("p").distinct().count() > 1
