"""Portal status, smoke summary and public diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost import rules

MAX_ATTEMPTS = 2


def _by_name(values: dict[str, str], c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(table, c)


def portal_status(attempts: DataFrame) -> DataFrame:
    """Latest status per portal from probe attempts.

    ``attempts``: ``portal``, ``attempt`` (from 1), ``returned_count``, ``error_code``. The
    first attempt without an error decides; after two tolerated errors the portal counts
    as blocked, and any other error as failed.
    """
    used = attempts.filter(F.col("attempt") <= MAX_ATTEMPTS)
    ok = F.col("error_code").isNull()
    agg = used.groupBy("portal").agg(
        F.min_by(F.when(ok, F.col("returned_count")), F.when(ok, F.col("attempt"))).alias("returned"),
        F.min(F.when(ok, F.col("attempt"))).alias("first_ok"),
        F.min(F.when(~ok & ~F.col("error_code").isin(rules.PROBE_ERRORS), F.col("attempt"))).alias("first_bad"),
    )
    broken = F.col("first_bad").isNotNull() & (F.col("first_ok").isNull() | (F.col("first_bad") < F.col("first_ok")))
    state = (
        F.when(broken, "failed")
        .when(F.col("first_ok").isNull(), "blocked")
        .when(F.col("returned") > 0, "available")
        .otherwise("no_results")
    )
    order = F.array_position(F.array(*[F.lit(p) for p in rules.STATUS_ORDER]), F.col("portal"))
    return agg.select(
        order.cast("int").alias("position"),
        "portal",
        _by_name(rules.PORTAL_URLS, F.col("portal")).alias("portal_url"),
        state.alias("state"),
        F.when(state == "available", F.col("returned")).otherwise(F.lit(0)).cast("bigint").alias("returned_count"),
    )


def smoke_summary(attempts: DataFrame) -> DataFrame:
    """How many probes were fine, met a tolerated upstream error, or failed."""
    code = F.col("error_code")
    return attempts.agg(
        F.count_if(code.isNull()).alias("ok_count"),
        F.count_if(code.isin(rules.PROBE_ERRORS)).alias("upstream_error_count"),
        F.count_if(code.isNotNull() & ~code.isin(rules.PROBE_ERRORS)).alias("failed_count"),
    )


def portals_with_data(coverage: DataFrame, cards: DataFrame) -> DataFrame:
    """Per search: portals that gave candidates, else the distinct domains of its cards."""
    gave = coverage.groupBy("search_id").agg(
        F.countDistinct(F.when((F.col("candidates") > 0) | (F.col("returned") > 0), F.col("portal"))).alias("n_portals")
    )
    source = F.coalesce(F.nullif("source_domain", F.lit("")), F.nullif("portal", F.lit("")))
    shown = cards.groupBy("search_id").agg(F.countDistinct(source).alias("n_domains"))
    return gave.join(shown, "search_id", "full").select(
        "search_id",
        F.coalesce(F.nullif("n_portals", F.lit(0)), F.col("n_domains"), F.lit(0)).cast("bigint").alias("portal_count"),
    )


def public_diagnostics(coverage: DataFrame) -> DataFrame:
    """Coverage without internal error text; error codes get their public sentence."""
    return coverage.withColumn("public_message", _by_name(rules.ERROR_CODES, F.col("error_code"))).drop("error_message")


def merge_status(portals: DataFrame, status: DataFrame) -> DataFrame:
    """Portal list with the latest state by link; a portal without one keeps its own."""
    latest = status.select("portal_url", F.col("state").alias("_state"), F.col("returned_count").alias("_count"))
    return portals.join(latest, "portal_url", "left").select(
        *[c for c in portals.columns if c not in ("state", "returned_count")],
        F.coalesce("_state", "state").alias("state"),
        F.coalesce("_count", "returned_count").alias("returned_count"),
    )
