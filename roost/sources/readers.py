"""Scans of stored pages, payloads, requests and suggestions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roost import schema
from roost.operators.portals.structured import api_listings
from roost.plans.crawl_plan import read_suggestion_rows
from roost.plans.search_plan import split_requests


def read_pages(spark: SparkSession, path: str, portals: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Stored portal pages. In a table partitioned by ``portal`` the filter prunes folders."""
    pages = spark.read.schema(schema.PAGE).format(fmt).load(path)
    return pages.filter(F.col("portal").isin(portals)) if portals else pages


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").partitionBy("portal").parquet(path)


def read_api_payloads(spark: SparkSession, path: str, crawl_location: str | None = None) -> DataFrame:
    """Listing rows of stored API responses, one JSON document per file."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
    )
    return api_listings(
        docs.withColumns({"crawl_location": F.lit(crawl_location).cast("string"), "page_no": F.lit(1)})
    )


def read_searches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Saved searches as JSON lines: valid ones, and rejected ones with the fields at fault."""
    return split_requests(spark.read.schema(schema.SEARCH).json(path))


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """Place suggestions from JSON lines of ``city`` and ``payload``."""
    return read_suggestion_rows(spark.read.schema("city string, payload string").json(path))


# Rows shown for a portal that gave nothing.
_SEED = [
    ("fixture-1", "https://www.pisos.com/comprar/piso-valencia_capital_centre-4580701234_100500/",
     "Luminoso piso en Valencia centro", "Valencia", 320000.0, 3.0, "flat",
     ["https://st3.idealista.com/blur/WEB_LISTING-M/0/id.pro.es.image.master/sample1.jpg"],
     "Piso con potencial de reforma parcial y excelente ubicación.", ["renovation"], None),
    ("fixture-2", "https://www.pisos.com/comprar/chalet-naquera-4580709999_100500/",
     "Casa en entorno natural con vistas", "Náquera", 285000.0, 4.0, "house",
     ["https://st3.idealista.com/blur/WEB_LISTING-M/0/id.pro.es.image.master/sample2.jpg"],
     "Casa con vistas panorámicas en zona natural.", ["nature", "views", "retreat"], None),
    ("fixture-3", "https://www.pisos.com/comprar/oficina-valencia_capital-4580717777_100500/",
     "Oficina diáfana para equipos grandes", "Valencia", 410000.0, 1.0, "office", [],
     "Espacio apto para más de 50 puestos de trabajo.", ["office"], 60.0),
]


def seed_listings(spark: SparkSession, crawl_location: str = "Valencia", seen_at: dt.datetime | None = None) -> DataFrame:
    names = [f.name for f in schema.LISTING.fields]
    rows = []
    for i, (pid, url, title, city, price, rooms, kind, images, text, tags, people) in enumerate(_SEED):
        row = dict.fromkeys(names)
        row.update(
            canonical_id=f"pisos-{pid}", portal="pisos", portal_listing_id=pid, url=url, title=title, city=city,
            price_eur=price, rooms=rooms, property_type=kind, image_urls=images, description=text, tags=tags,
            capacity_people=people, crawl_location=crawl_location, seq=i, last_seen_at=seen_at or dt.datetime(2026, 1, 1),
        )
        rows.append(row)
    return spark.createDataFrame(rows, schema.LISTING)


def with_seed(listings: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed rows for portals that have no row of their own."""
    return listings.unionByName(seed.join(listings.select("portal").distinct(), "portal", "left_anti").select(listings.columns))
