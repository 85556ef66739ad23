"""A property view of the generic benchmark tables.

Orders play listings, customers play saved searches, documents give the long texts and
events the request log. All columns are derived by rule from the tables' keys, so the
view grows with them and has an exact SQL twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roost import rules, schema

SEGMENT_TYPE = {"BUILDING": "flat", "HOUSEHOLD": "house", "MACHINERY": "office", "AUTOMOBILE": "land"}
LINE_KEY = 100_000_000_000

# Feature sentences put behind the long text, by order key.
SENTENCES = [
    "Piso exterior con mucha luz natural.",
    "Ventanales y orientación sur, ático LUMINOSO.",
    "Casa para reformar cerca del bosque.",
    "Oficina interior.",
    "Retiro rural con vistas a la montaña.",
    "",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows over the whole cluster before heavy text work.

    The driver tables are single small files, and adaptive coalescing would leave their
    joins in one task. The partitioning also serves the joins on the keys that follow.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings, in the canonical schema."""
    first_line = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg((F.min(F.col("l_linenumber") * F.lit(LINE_KEY) + F.col("l_partkey")) % F.lit(LINE_KEY)).alias("p_partkey"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("p_title"))
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.floor(F.col("o_orderkey") / 15).alias("doc_id")
    )
    rows = (
        # first what is joined by the key that the orders are spread by: they stay where they are
        spread(orders, "o_orderkey")
        .join(first_line, "o_orderkey", "left")
        .join(part, "p_partkey", "left")
        .join(customer, "o_custkey")
        .join(nation, "n_nationkey")
        .join(documents, "doc_id", "left")
    )
    ok, ck, nk = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey")
    portal = _pick(rules.PORTALS, ok % 13)
    key = ok.cast("string")
    city_kind = ck % 6
    city = (
        F.when(ok % 19 == 0, F.lit("Elsewhere"))
        .when(city_kind == 3, F.concat(F.lit("Centro ("), F.col("n_name"), F.lit(")")))
        .when(city_kind == 4, F.lit(""))
        .when(city_kind == 5, F.concat(F.lit("San "), F.col("n_name"), F.lit(" Alto")))
        .otherwise(F.col("n_name"))
    )
    rooms = F.when(ck % 11 != 0, (ck % 7).cast("double"))
    floor_text = F.when(ok % 9 == 0, "Bajo").otherwise(F.concat((ok % 9).cast("string"), F.lit("ª planta")))
    chars = F.array_compact(
        F.array(
            F.when(rooms.isNotNull(), F.concat(rooms.cast("int").cast("string"), F.lit(" habs."))),
            F.when(nk % 5 != 0, floor_text),
        )
    )
    kind = F.create_map(*[F.lit(x) for pair in SEGMENT_TYPE.items() for x in pair])
    url = F.when(
        ok % 10 == 3, F.concat(F.lit("HTTPS://Shared.Example/Ref/"), ck.cast("string"), F.lit("/?from="), portal)
    ).otherwise(
        F.concat(F.when(ok % 23 == 0, "http://www.").otherwise("https://user@www."), portal, F.lit(".example/inmueble/"), key)
    )
    tag_kind = ok % 5
    tags = (
        F.when(tag_kind == 0, F.array(F.lit("natural_light"), F.lit("exterior")))
        .when(tag_kind == 1, F.array(F.lit("Views")))
        .when(tag_kind == 2, F.array(F.lit("renovation"), F.lit("nature")))
        .otherwise(F.array().cast("array<string>"))
    )
    images = F.transform(
        F.when(ok % 12 > 0, F.sequence(F.lit(1).cast("bigint"), ok % 12)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.concat(F.when(i == 2, "http://").otherwise("https://"), F.lit("img.example/"), key, F.lit("/"), i.cast("string")),
    )
    located = ok % 4 == 0
    return rows.select(
        F.concat(portal, F.lit("-"), key).alias("canonical_id"),
        portal.alias("portal"),
        key.alias("portal_listing_id"),
        url.alias("url"),
        F.coalesce("p_title", F.lit("")).alias("title"),
        city.alias("city"),
        F.when(ok % 17 != 0, F.col("o_totalprice")).alias("price_eur"),
        rooms.alias("rooms"),
        F.element_at(kind, F.col("c_mktsegment")).alias("property_type"),
        images.alias("image_urls"),
        F.col("o_orderdate").cast("timestamp").alias("last_seen_at"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick(SENTENCES, ok % 6)).alias("description"),
        tags.alias("tags"),
        F.when(F.col("c_mktsegment") == "MACHINERY", (ck % 40).cast("double")).alias("capacity_people"),
        F.concat(F.lit("/venta/pisos-"), F.lower("n_name"), F.lit("_capital_zona_urbana/")).alias("source_path"),
        chars.alias("chars"),
        F.lit(None).cast("string").alias("price_raw"),
        F.lit(None).cast("double").alias("bathrooms"),
        F.lit(None).cast("double").alias("area_m2"),
        F.when(located, F.lit(36.0) + (ok % 700).cast("double") / 100).alias("lat"),
        F.when(located, F.lit(-9.0) + (ck % 1200).cast("double") / 100).alias("lon"),
        F.lit(None).cast("string").alias("raw"),
        F.col("n_name").alias("crawl_location"),
        ok.alias("seq"),
    )


def _text_array(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def search_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved search per nation and customer segment."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    groups = (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.min("c_custkey").alias("k"), F.count("*").alias("n"))
        .join(nation, "c_nationkey")
    )
    return _as_searches(
        groups, F.concat(F.lit("s-"), F.col("c_nationkey").cast("string"), F.lit("-"), F.lower("c_mktsegment"))
    )


def customer_search_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved search per customer; many customers ask the same question."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_custkey") % 12).alias("k"), F.lit(3).cast("bigint").alias("n"))
        .join(nation, "c_nationkey")
    )
    return _as_searches(rows, F.concat(F.lit("c-"), F.col("c_custkey").cast("string")))


def _as_searches(groups: DataFrame, search_id: Column) -> DataFrame:
    k, n, name = F.col("k"), F.col("n"), F.col("n_name")
    mode = k % 6
    other = F.concat(F.lit("NATION_"), ((F.col("c_nationkey") + 1) % 25).cast("string"))
    none = F.lit(None)
    return groups.select(
        search_id.alias("search_id"),
        F.concat(F.lit("looking in "), name).alias("query_text"),
        F.when(k % 2 == 0, "es").otherwise("en").alias("locale"),
        F.when(k % 3 == 1, "buy").when(k % 3 == 2, "rent").alias("transaction_type"),
        F.when(F.col("c_mktsegment") == "BUILDING", _text_array(F.lit("flat"), F.lit("house")))
        .when(F.col("c_mktsegment") == "MACHINERY", _text_array(F.lit("office")))
        .alias("property_types"),
        F.when(mode.isin(0, 2, 5), name).alias("city"),
        F.when(mode == 1, _text_array(F.concat(name, F.lit(" - Centro")), other))
        .when(mode == 2, _text_array(name, F.concat(name, F.lit(" – Alto"))))
        .alias("locations"),
        F.when(mode == 0, _text_array(F.lit("Centro"), F.lit("Alto"), F.lit("centro "))).alias("location_hints"),
        F.when(mode == 5, F.lit(True)).alias("nearby_towns"),
        F.when(k % 4 > 0, k % 4).cast("int").alias("min_rooms"),
        F.when((k % 7 == 3) & (F.col("c_mktsegment") == "MACHINERY"), F.lit(10)).cast("int").alias("min_capacity_people"),
        F.when(k % 5 > 0, F.lit(150000) + (n % 8) * 50000).cast("bigint").alias("max_price_eur"),
        F.when(k % 3 == 1, F.lit(2)).cast("int").alias("min_floor"),
        F.when(k % 3 == 2, F.lit(True)).alias("exclude_ground_floor"),
        F.when(k % 5 == 1, F.lit(True)).alias("prefer_exterior"),
        F.when(mode.isin(3, 5), F.lit(False)).alias("strict_constraints"),
        F.when(k % 2 == 1, F.lit(True)).alias("renovation_ok"),
        F.when(k % 4 == 0, _text_array(F.lit("natural_light"), F.lit("views")))
        .when(k % 4 == 1, _text_array(F.lit("Renovation")))
        .alias("tags"),
        F.when(k % 7 == 0, _text_array(F.lit("pisos"), F.lit("nuroa"), F.lit("idealista"))).alias("sources"),
        F.when(k % 2 == 0, F.lit(5) + k % 40).cast("int").alias("per_location_limit"),
        F.when(k % 3 > 0, F.lit(10) + k % 100).cast("int").alias("max_results_total"),
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.SEARCH.fields])
