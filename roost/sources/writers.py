"""Sinks of results and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roost.operators.search import SearchOutput


def write_results(out: SearchOutput, path: str) -> None:
    """Results, coverage, diagnostics and failures as parquet tables under one folder.

    Rows are clustered by a hash of the search, not foldered by it: millions of searches
    would make millions of tiny folders.
    """
    for name in ("results", "coverage", "diagnostics", "failures", "action_required"):
        table: DataFrame = getattr(out, name)
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def write_responses(public: DataFrame, cards: DataFrame, diagnostics: DataFrame, path: str) -> None:
    """One JSON line per search: criteria, listings, cards, diagnostics.

    A search has at most 200 listings and 20 cards, so gathering them is bounded.
    """
    def gather(df: DataFrame, order: str, name: str) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c != "search_id"])
        items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), F.to_json(row).alias("row"))))
        return df.groupBy("search_id").agg(F.transform(items, lambda x: x["row"]).alias(name))

    rows = (
        diagnostics.select("search_id", F.to_json("criteria").alias("criteria"), F.to_json(F.struct("*")).alias("diagnostics"))
        .join(gather(public, "result_rank", "listings"), "search_id", "left")
        .join(gather(cards, "card_pos", "cards"), "search_id", "left")
    )
    rows.write.mode("overwrite").json(path)


def write_status(status: DataFrame, path: str) -> None:
    """Latest portal status: at most one row per portal, so one file."""
    status.coalesce(1).write.mode("overwrite").json(path)
