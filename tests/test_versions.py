"""Newest fetches: batches with late, equal and missing times against one recomputation, retries, a failed batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roost.operators.outcomes import outcome_rollup
from roost.operators.versions import PageVersions, latest_pages

ROW = (
    "portal string, crawl_location string, path string, page_no int, fetched_at timestamp, fetch_id bigint, page_class string, "
    "challenge_id string, n_listings bigint, warning string"
)


def fetches(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        page = rng.randrange(1, 3)
        found = rng.choice(["ok", "blocked", "rate_limited", "no_cards"])
        rows.append((
            rng.choice(["nuroa", "pisos", "idealista", None]), rng.choice(["Ronda", " RONDA", "Cádiz", "cadiz", None]),
            rng.choice([f"/p/{page}", f"/p/{page}", None]), page,
            rng.choice([None, dt.datetime(2026, 1, 1 + rng.randrange(9)), dt.datetime(2026, 1, 1 + rng.randrange(9))]), i, found,
            None, 3 if found == "ok" else 0, None if found == "ok" else found,
        ))
    return rows


def as_set(df):
    return {tuple(map(str, r)) for r in df.collect()}


KEPT = ["portal", "location_key", "path", "fetch_id", "page_class"]
ROLLED = ["portal", "location_key", "error_code", "n_listings", "warnings"]


def test_batches_equal_recomputation(spark, tmp_path):
    rows = fetches(1)
    store = PageVersions(spark, str(tmp_path / "s"), buckets=3)
    seen = []
    for batch, chosen in enumerate([rows[1::3], rows[0::3], [], rows[2::3]]):
        part = spark.createDataFrame(chosen, ROW)
        assert store.apply(batch, part)
        assert not store.apply(batch, part)
        seen += chosen
        whole = latest_pages(spark.createDataFrame(seen, ROW))
        assert as_set(store.current().select(*KEPT)) == as_set(whole.select(*KEPT))
    assert as_set(store.rollup().select(*ROLLED)) == as_set(outcome_rollup(whole).select(*ROLLED))
    counted = whole.groupBy("portal", "location_key", "page_class").agg(F.count("*"), F.sum("n_listings"))
    assert as_set(store.totals()) == as_set(counted)
    with pytest.raises(ValueError):
        store.apply(-1, part)


def test_late_fetch_changes_nothing_and_failed_batch_is_retried(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 1, n)
    one = lambda when, i, found: [("nuroa", "Ronda", "/a", 1, when, i, found, None, 0, None)]
    store = PageVersions(spark, str(tmp_path / "s"))
    store.apply(0, spark.createDataFrame(one(day(5), 1, "ok"), ROW))
    store.apply(1, spark.createDataFrame(one(day(4), 2, "blocked"), ROW))
    assert store.changes().count() == 1
    # a batch that stopped after its roll-up, before its changes, is not seen
    store.rollup().withColumn("error_code", F.lit("half")).write.parquet(f"{store.path}/rollup/batch=2")
    assert store.committed() == [0, 1] and store.rollup().first().error_code != "half"
    store.apply(2, spark.createDataFrame(one(day(6), 3, "blocked"), ROW))
    assert store.rollup().first().error_code == "UPSTREAM_BLOCKED"
    assert sorted((r.sign, r.fetch_id) for r in store.changes().collect()) == [(-1, 1), (1, 1), (1, 3)]
    assert [r.n_pages for r in store.totals().collect()] == [1]


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], ROW)
    store = PageVersions(spark, str(tmp_path / "s"))
    assert store.current().count() == 0 and store.apply(0, none)
    assert store.current().count() == 0 and store.rollup().count() == 0 and latest_pages(none).count() == 0
