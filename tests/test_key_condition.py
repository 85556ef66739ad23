"""Keys of picked listings as a condition where listings are read, and listing numbers written once."""

from pyspark.sql import functions as F

from roost.operators import prune, search
from roost.plans.search_plan import plan_requests, plan_tasks
from test_prune import listings, searches


def test_keys_are_tested_below_the_join_that_brings_texts(spark, tmp_path):
    spark.range(600).select(F.concat(F.lit("a-"), "id").alias("k"), "id").write.parquet(f"{tmp_path}/rows")
    spark.range(0, 600, 3).select("id", F.repeat(F.lit("word "), 50).alias("text")).write.parquet(f"{tmp_path}/texts")
    read = spark.read.parquet
    table = read(f"{tmp_path}/rows").join(read(f"{tmp_path}/texts").hint("merge"), "id", "left")
    table = table.select(F.lower("k").alias("canonical_id"), F.col("id").alias("seq"), "text")
    wanted = table.filter("seq % 50 = 7").select(*prune.ROW)
    for small_bytes in (0, 64 << 20):
        got = prune.rows_of_keys(table, wanted, 1, small_bytes)
        whole = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
        side = next(i for i, x in enumerate(whole) if "Join LeftOuter, (id#" in x)
        assert not any("scalar-subquery" in x for x in whole[:side]) and any("scalar-subquery" in x for x in whole[side:])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.filter("seq % 50 = 7").collect()))


def test_no_key_lets_no_row_through(spark):
    table = listings(spark, 50, 9)
    assert prune.rows_of_keys(table, table.filter("false").select(*prune.ROW), 1, 0).isEmpty()


def test_numbers_of_a_listing_are_written_once(spark, monkeypatch):
    written, stage = {}, search.stage

    def noting(df, name):
        written[name] = stage(df, name)
        return written[name]

    monkeypatch.setattr(search, "stage", noting)
    table = listings(spark, 200, 5).persist()
    tasks = plan_tasks(plan_requests(searches(spark)).withColumnRenamed("search_id", search.RUN), search.RUN)
    profile = search.profile_tasks(tasks)
    assert profile.located and profile.discovery
    _, stats, _ = search.staged_picks(table, tasks, profile, "crawl")
    assert written["numbers"].count() == 200 and "facts" not in written
    places = table.groupBy("portal", F.lower(F.translate("crawl_location", "ó", "o")).alias("location_key")).agg(F.count("*").alias("n"))
    counted = {(r.portal, r.location_key): r.candidates for r in stats.collect()}
    assert all(counted[r.portal, r.location_key] == r.n for r in places.collect())
    assert sum(n for (_, key), n in counted.items() if key == "__discovery__") == 200
