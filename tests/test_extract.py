"""Each portal layout on a small page of its own."""

import base64
import datetime as dt
import json

import pytest

from roost import schema
from roost.operators.extract import adapter_results, extract_listings, page_listings
from roost.operators.outcomes import outcome_rollup, page_outcomes
from roost.operators.portals.structured import api_listings

SEEN = dt.datetime(2026, 2, 25)


def page(portal, html, place="Valencia", page_no=1, path="/p", status=200, headers=None):
    return dict(portal=portal, crawl_location=place, path=path, page_no=page_no, http_status=status, html=html,
                fetched_at=SEEN, headers=headers)


@pytest.fixture(scope="module")
def extract(spark):
    def run(*pages):
        df = spark.createDataFrame(list(pages), schema.PAGE)
        rows = extract_listings(df, sorted({p["portal"] for p in pages})).orderBy("seq").collect()
        return [r.asDict() for r in rows]

    return run


def only(row, **expected):
    got = {k: row[k] for k in expected}
    assert got == expected


def test_habitaclia(extract):
    html = """<main><article class="x js-list-item y" data-id="77" data-href="/comprar-piso-en_centro-valencia-i77.htm?x=1"
      data-propertysubtype="FLAT"><a itemprop="name" href="/z">Piso en  <b>venta</b> &amp; luminoso</a>
      <img itemprop="image" data-src="no" src="//img.example/1.jpg"><span class="a font-2">320.000 €</span>
      <i data-hab="3" data-sup="90"></i> 2 baños</article>
      <article class="js-list-item" data-href="/casa-rural-sin-numero.htm"><a itemprop="name">Oficina 4 habs.</a></article>"""
    rows = extract(page("habitaclia", html))
    only(rows[0], canonical_id="habitaclia-77", title="Piso en venta & luminoso", price_eur=320000.0, rooms=3.0,
         property_type="flat", city="Valencia", image_urls=["https://img.example/1.jpg"],
         chars=["3 habs.", "2 baños", "90 m²"], source_path="/comprar-piso-en_centro-valencia-i77.htm",
         tags=["natural_light"], price_raw="320.000 €",
         description="Piso en venta & luminoso · 2 baños · 90 m²")
    only(rows[1], portal_listing_id="casa_rural_sin_numero_htm", rooms=4.0, property_type="office", price_eur=None)


def test_nuroa_redirect_and_image_index(extract):
    from urllib.parse import quote

    target = "https://www.pisos.com/comprar/piso-valencia-123/"
    link = "https://www.nuroa.es/r?redirectUrl=" + quote("https://x.example/go?url=" + quote(target, safe=""), safe="")
    html = f"""<div class="group nu_row a" id="nu_flat_9"><a class="nu_adlink" href="{link.replace('&', '&amp;')}">x</a>
      <h3 class="nu_list_title"><a href="#">Piso con 3 habitaciones</a></h3>
      <div class="nu_address_text"><span>Ruzafa</span>, Valencia</div>
      <meta itemprop="price" content="349.000"><div itemprop="description"><p>2 baños, 80 m2</p></div></div>
      <img id="ad-img-9" src="/a.jpg"><img id="ad-img-9" data-original="/b.jpg" src="no_image.png">"""
    row = extract(page("nuroa", html))[0]
    only(row, portal_listing_id="9", url=target, price_eur=349000.0, rooms=3.0, bathrooms=2.0, area_m2=80.0,
         property_type="flat", city="Ruzafa , Valencia", image_urls=["https://www.nuroa.es/b.jpg"],
         chars=["3 habs.", "2 baños", "80 m²"])


def test_spainhouses(extract):
    html = """<article class="property_block" data-position="5" data-href="/es/venta-casas-x.html?a=1&amp;b=2">
      <div class="title_1"><a>Chalet grande</a></div><span class="titleTail"> con jardín</span>
      <div class="title_2">Náquera</div><div class="features">4 habs. 2 baños 200 m²a</div>
      <div class="descTxt">Para reformar</div><span class="price">285.000</span>
      <img data-src="/pix.gif" class="slide-content"></article>"""
    row = extract(page("spainhouses", html))[0]
    only(row, portal_listing_id="5", url="https://www.spainhouses.net/es/venta-casas-x.html?a=1&b=2",
         title="Chalet grandecon jardín", city="Náquera", price_eur=285000.0, price_raw="285.000 €", rooms=4.0,
         bathrooms=2.0, area_m2=200.0, property_type="house", image_urls=[], tags=["renovation"])


def test_enalquiler(extract):
    html = """<ul><li id="property-31" class="propertyCard big"><a class="propertyCard__description--title" href="/alquiler_piso_valencia_31.html"><p>Piso</p></a>
      <span class="propertyCard__price--value">950 €</span><ul class="propertyCard__details"><li>2 habs</li><li>1 baño</li><li>70 m²</li></ul>
      <p class="propertyCard__description--txt">Exterior</p><div class="propertyCard__location"><p>Valencia</p></div>
      <source srcset="/i.webp"></li></ul>"""
    row = extract(page("enalquiler", html))[0]
    only(row, portal_listing_id="31", price_eur=950.0, rooms=2.0, bathrooms=1.0, area_m2=70.0, property_type="flat",
         city="Valencia", image_urls=["https://www.enalquiler.com/i.webp"], tags=["exterior"], capacity_people=None)


def test_milanuncios(extract):
    html = """<article class="ma-AdCardV2 q"><a class="ma-AdCardListingV2-TitleLink" href="/venta-de-locales-en-valencia/x-555.htm">.</a>
      <h2 class="ma-AdCardV2-title">Local céntrico</h2><span class="ma-AdLocation-text">Valencia</span>
      <span class="ma-AdPrice-value">120.000 €</span><span class="ma-AdTag-label">3 dorm.</span>
      <span class="ma-AdTag-label">100 m²</span><span class="ma-AdTag-label">3 DORM.</span></article>"""
    row = extract(page("milanuncios", html))[0]
    only(row, portal_listing_id="555", property_type="office", price_eur=120000.0, capacity_people=40.0,
         chars=["3 dorm.", "100 m²"], title="Local céntrico", rooms=3.0)


def test_globaliza(extract):
    html = """<li class="serp-snippet big ad"><a class="detail-redirection" href="/inmueble/AB-12?x">.</a>
      <h2 class="title">Piso bonito, Malilla, Valencia</h2><div class="price">99.000 €</div>
      <span class="rooms">3</span><span class="bathrooms">1</span><span class="areaBuilt">75 m2</span>
      <img src="/logo.png"><img data-lazy="//img.resemmedia.com/1.jpg"></li>"""
    row = extract(page("globaliza", html))[0]
    only(row, portal_listing_id="ab_12", city="Malilla", price_eur=99000.0, rooms=3.0,
         chars=["3 habs.", "1 baños", "75 m²"], image_urls=["https://img.resemmedia.com/1.jpg"], property_type="flat")


def test_hogaria_two_patterns_and_requested_type(spark):
    first = """<div class="item col-xs-4 col-lg-4 grid-group-item" x itemprop="offers"><a itemprop="url" href="/venta-piso/valencia/a_44.aspx">Vivienda</a>
      <p itemprop="price" content="150000">150.000</p><h3 class="h2ubicacion">Valencia</h3> 3 dorm. 2 baños 90 m²
      <img class="ltimagen" src="//i.example/x.jpg"><input type="hidden" name="listado$ctl01$codigo"></div>"""
    second = """<div class="item col-xs-4 col-lg-4 grid-group-item" itemprop="offers"><div><a itemprop="url" href="/zz/b_45.aspx">Nave</a></div></div>"""
    df = spark.createDataFrame([page("hogaria", first), page("hogaria", second, place="Madrid")], schema.PAGE)
    from pyspark.sql import functions as F

    rows = {r.portal_listing_id: r for r in extract_listings(df.withColumn("requested_type", F.lit("land")), ["hogaria"]).collect()}
    only(rows["44"].asDict(), property_type="flat", price_eur=150000.0, rooms=3.0, bathrooms=2.0, area_m2=90.0,
         image_urls=["https://i.example/x.jpg"])
    only(rows["45"].asDict(), property_type="land", city="Madrid", rooms=None)


def test_pisocompartido(extract):
    ld = json.dumps({"@graph": [{"@type": "Product", "description": "Cerca del <b>metro</b>", "image": "/p.jpg"},
                                {"@type": "Residence", "address": {"addressLocality": "Valencia"},
                                 "geo": {"latitude": "39.47", "longitude": -0.37}, "photo": [{"contentUrl": "/q.jpg"}]}]})
    html = f"""<div id="h88" class=" card"><a class="linkCard" href="/habitacion/88/">x</a><h6 class="textoTipo">Habitación  doble</h6>
      <span class="contPrecio">300 €/mes</span><i data-lazybg="/a.jpg"></i><i data-lazybg="/css/img/1x1.png"></i>
      <script type="application/ld+json">{ld}</script></div><div class="cCardsFooter">"""
    row = extract(page("pisocompartido", html))[0]
    only(row, portal_listing_id="88", city="Valencia", rooms=1.0, price_eur=300.0, lat=39.47, lon=-0.37,
         description="Cerca del metro", property_type="flat", chars=["1 hab.", "Habitación doble"],
         image_urls=[f"https://www.pisocompartido.com/{x}.jpg" for x in "apq"])


def listing_page(items, **extra):
    doc = {"@context": "x", "about": [{"wrap": {"@type": "ItemList", "itemListElement": items}}], **extra}
    return f'<script type="application/ld+json">{json.dumps(doc)}</script><script type="application/ld+json">{{oops</script>'


def test_tucasa(extract):
    items = [
        {"item": {"url": "/compra-venta/pisos-y-apartamentos/valencia/123456/", "name": "Piso 2 habs", "description": "Con <i>vistas</i>",
                  "image": ["a.jpg", 7], "offers": {"price": "199.000"},
                  "mainEntity": {"numberOfRooms": "3", "floorSize": {"value": "81.4"}, "address": {"addressLocality": "Valencia (Capital)"}}}},
        {"url": "/x?id=99", "name": "Ronda"}, 5,
    ]
    rows = extract(page("tucasa", listing_page(items)))
    only(rows[0], portal_listing_id="123456", price_eur=199000.0, rooms=3.0, city="Valencia", property_type="flat",
         image_urls=["a.jpg"], chars=["3 habs.", "81 m²"], tags=["views"], price_raw="199.000")
    only(rows[1], portal_listing_id="99", city="Ronda", price_eur=None)


def test_yaencontre_tiers(extract):
    state = {"results": {"currentPageItems": {"byId": {
        "b": {"item": {"url": "/venta/piso/inmueble-2", "reference": "REF-2", "title": "Casa", "price": "210.000", "rooms": 2, "area": 60,
                       "family": "penthouse", "address": {"qualifiedName": "Ruzafa, Valencia", "geoLocation": {"lat": 39.50095, "lon": -0.39581}},
                       "images": [{"slug": "/m/1.jpg"}, "https://i.example/2.jpg"]}},
        "10": {"item": {"url": "/venta/piso/inmueble-100000"}}}}}}
    atob = lambda x: base64.b64encode(json.dumps(x).encode()).decode()
    with_state = (f'<script>window.__INITIAL_STATE__ = JSON.parse(atob("{atob(state)}")); window.JHT = JSON.parse(atob("{atob({"MEDIA_URL": "https://media.example/x/"})}"))</script>'
                  + listing_page([{"url": "/ignored"}]))
    with_list = listing_page([{"item": {"url": "/venta/casa/inmueble-300001", "numberOfRooms": 4, "image": {"url": "//i.example/3.jpg"}}}])
    with_links = '<a href="/venta/piso/valencia/inmueble-400001">a</a><a href="/otros/inmueble-500001">b</a>'
    rows = extract(page("yaencontre", with_state, page_no=1), page("yaencontre", with_list, page_no=2), page("yaencontre", with_links, page_no=3))
    assert [r["portal_listing_id"] for r in rows] == ["100000", "ref_2", "300001", "400001"]
    only(rows[1], lat=39.50095, lon=-0.39581, price_eur=210000.0, rooms=2.0, property_type="flat", city="Ruzafa",
         image_urls=["https://media.example/m/1.jpg", "https://i.example/2.jpg"], chars=["2 habs.", "60 m²"])
    only(rows[2], rooms=4.0, image_urls=["https://i.example/3.jpg"], city="Valencia", chars=["4 habs."])
    only(rows[3], title="Inmueble 400001", rooms=None, tags=[])


def test_idealista_first_wins(extract):
    html = listing_page([{"item": {"url": "/inmueble/1/", "name": "Piso 3 habs 80 m²", "offers": {"price": 200000},
                                   "address": {"addressLocality": "Valencia"}}}]) + """
      <article><a href="/inmueble/1/">dup</a></article>
      <article><a href="/inmueble/2/">Oficina</a><p>100 m² diáfanos</p><address>Valencia</address><b>90.000 €</b></article>
      <li class="item"><h2>Casa</h2><a href="/inmueble/3">x</a></li>"""
    rows = extract(page("idealista", html))
    assert [(r["portal_listing_id"], r["title"]) for r in rows] == [("1", "Piso 3 habs 80 m²"), ("2", "Oficina"), ("3", "Casa")]
    only(rows[0], price_eur=200000.0, chars=["3 habs.", "80 m²"], capacity_people=None)
    only(rows[1], price_eur=90000.0, capacity_people=40.0, price_raw="90.000 €", chars=["100 m²"])


def test_fotocasa_detail_replaces_card(extract):
    search = """<article><a href="/es/comprar/vivienda/valencia-capital/piso/7/d?x=1"><h3><em>a</em><span>Piso en Ruzafa</span></h3></a>
       <img src="/c.jpg"> 250.000 € 3 habs</article>
       <article><a href="/es/comprar/vivienda/ronda/casa/8/d">.</a><h3>Casa</h3> 4 habs</article>"""
    detail = """<link rel="canonical" href="https://www.fotocasa.es/es/comprar/vivienda/valencia-capital/piso/7/d">
       <meta property="og:title" content="Piso &amp; terraza"><meta property="og:description" content="Exterior, 2 habs">
       <div class="re-DetailHeader-price">249.000 €</div>"""
    rows = {r["portal_listing_id"]: r for r in extract(
        page("fotocasa", search, path="/es/comprar/viviendas/valencia/todas-las-zonas/l"),
        page("fotocasa", detail, page_no=2, path="/es/comprar/vivienda/valencia-capital/piso/7/d"),
        page("fotocasa", "blocked", page_no=3, path="/es/comprar/vivienda/ronda/casa/8/d", status=403))}
    only(rows["7"], title="Piso & terraza", price_eur=249000.0, rooms=2.0, city="Valencia Capital", tags=["exterior"])
    only(rows["8"], title="Casa", rooms=4.0, property_type="house", city="Ronda")


CARD = """<div id="{id}" class="ad-preview x"><a href="/comprar/piso-{id}/" class="ad-preview__title">Piso {id}</a>
  <p class="p-sm ad-preview__subtitle">Valencia</p><span class="ad-preview__price">100.000 &euro;</span>
  <p class="ad-preview__char p-sm">3 habs.</p><p class="ad-preview__char p-sm">80 m²</p><p class="ad-preview__description">Reforma</p>
  <img src="https://fotos.imghs.net/a.jpg"><script></script> </div>"""


def test_pisos_cards_then_json(extract):
    ld = '<script type="application/ld+json">{"@id":"9_9.1","url":"/comprar/casa-9/","name":"Casa &amp; patio","numberOfRooms":"4"}</script>'
    rows = extract(page("pisos", CARD.format(id="5.1") + ld), page("pisos", ld, place="Madrid", page_no=2))
    assert [r["canonical_id"] for r in rows] == ["pisos-5_1", "pisos-9_9_1"]
    only(rows[0], price_eur=100000.0, price_raw="100.000 EUR", rooms=3.0, capacity_people=32.0, tags=["renovation"],
         image_urls=["https://fotos.imghs.net/a.jpg"], source_path="/p", chars=["3 habs.", "80 m²"])
    only(rows[1], title="Casa & patio", rooms=4.0, price_eur=None, property_type="house", chars=None)


def test_pisos_payload(spark):
    payload = {"data": {"results": [{"idInmueble": "12 3", "titulo": "Piso", "ciudad": "Valencia", "precio": 300000, "habitaciones": "3",
               "tipoInmueble": "Piso", "urlDetalle": "https://www.pisos.com/x/", "fotos": [{"url": "https://i.example/1.jpg"}, 4], "lat": "39.5", "lng": -0.3}, {}]}}
    df = spark.createDataFrame([("Valencia", 1, "/api", SEEN, json.dumps(payload))],
                               "crawl_location string, page_no int, path string, fetched_at timestamp, payload string")
    rows = api_listings(df).orderBy("seq").collect()
    only(rows[0].asDict(), canonical_id="pisos-12_3", price_eur=300000.0, rooms=3.0, property_type="flat", lat=39.5, lon=-0.3,
         image_urls=["https://i.example/1.jpg"], city="Valencia")
    only(rows[1].asDict(), portal_listing_id="2", title="Listing 2", url="https://www.pisos.com/inmueble/2/", city="Unknown")


def test_outcomes_and_rollup(spark):
    pages = [
        page("nuroa", "", status=403), page("nuroa", "<title>Error 404</title>", page_no=2, path="/q"),
        page("idealista", 'var dd={"cid":"abc"}', status=403), page("idealista", "captcha-delivery.com", page_no=2, headers={"x-dd-cid": "h1"}),
        page("habitaclia", "x", status=500), page("yaencontre", "<p>nothing</p>"),
        page("milanuncios", "Access denied"), page("spainhouses", "", status=429), page("pisos", "", status=429),
    ]
    df = spark.createDataFrame(pages, schema.PAGE)
    out = page_outcomes(df, page_listings(df, ["nuroa", "yaencontre", "milanuncios"]))
    classes = {(r.portal, r.page_no): r.page_class for r in out.collect()}
    assert classes[("nuroa", 1)] == "blocked" and classes[("nuroa", 2)] == "template"
    assert classes[("idealista", 2)] == "challenge" and classes[("yaencontre", 1)] == "no_cards"
    roll = {r.portal: r for r in outcome_rollup(out).collect()}
    assert roll["nuroa"].error_code == "UPSTREAM_UNAVAILABLE"
    assert roll["nuroa"].warnings == ["nuroa blocked path: /p", "nuroa error template on path: /q"]
    assert roll["idealista"].error_message == "idealista blocked automated access for all candidate paths (abc)."
    assert roll["idealista"].warnings[1] == "idealista anti-bot challenge on path: /p (cid=h1)"
    assert roll["habitaclia"].error_code == "UPSTREAM_UNAVAILABLE"
    assert roll["yaencontre"].error_code is None and roll["yaencontre"].warnings == ["yaencontre returned no parseable listings."]
    assert roll["milanuncios"].error_code == "UPSTREAM_BLOCKED"
    assert roll["spainhouses"].error_code == "UPSTREAM_RATE_LIMIT" and roll["pisos"].error_code == "UPSTREAM_RATE_LIMIT"


def cards(ids, city="Valencia"):
    return "".join(
        f"""<article class="ma-AdCardV2"><a class="ma-AdCardListingV2-TitleLink" href="/venta-de-pisos/x-{i}.htm">.</a>
        <span class="ma-AdLocation-text">{city}</span></article>""" for i in ids)


def test_adapter_caps_and_city_filter(spark):
    pages = [
        # 21 raw rows on the first page: later pages are ignored; cap to 20, then the city filter
        page("milanuncios", cards(range(1, 21), "Madrid") + cards([21])), page("milanuncios", cards([50]), page_no=2),
        # no match at all: all rows kept
        page("milanuncios", cards([1, 2], "Madrid"), place="Ronda"), page("milanuncios", cards([2, 3], "Ronda X"), place="Ronda", page_no=2),
    ]
    df = spark.createDataFrame(pages, schema.PAGE)
    rows = adapter_results(page_listings(df, ["milanuncios"])).collect()
    valencia = {r.portal_listing_id for r in rows if r.crawl_location == "Valencia"}
    assert valencia == {str(i) for i in range(1, 21)} and all(r.broadened for r in rows if r.crawl_location == "Valencia")
    assert [r.portal_listing_id for r in rows if r.crawl_location == "Ronda"] == ["3"]


def test_two_spellings_are_one_place(spark):
    rows = [
        ("pisos", "València", 1, "ok", 2, None, None),
        ("pisos", "Valencia", 2, "ok", 3, None, None),
        ("pisos", "Madrid", 1, "ok", 1, None, None),
    ]
    columns = "portal string, crawl_location string, page_no int, page_class string, n_listings long, warning string, challenge_id string"
    out = outcome_rollup(spark.createDataFrame(rows, columns)).collect()
    assert sorted((r.location_key, r.crawl_location, r.n_listings) for r in out) == [("madrid", "Madrid", 1), ("valencia", "Valencia", 5)]
