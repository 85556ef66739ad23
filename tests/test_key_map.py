"""Listings picked out by keys too many to be sent to all tasks: filtered where they are read, no text moved."""

from pyspark.sql import functions as F

from roost.operators import prune
from test_prune import listings, searches
from roost.operators import search
from roost.plans.search_plan import plan_requests, plan_tasks


def _plans(spark, monkeypatch, small_bytes):
    """The staged frames of read_signals by name, and the shuffles of their plans."""
    plans, stage = {}, prune.stage

    def noting(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(prune, "stage", noting)
    table = listings(spark, 400, 7)
    tasks = plan_tasks(plan_requests(searches(spark)).withColumnRenamed("search_id", search.RUN), search.RUN)
    some = prune.with_row_key(table).filter("price_eur > 200000").select(*prune.ROW)
    survivors = some.crossJoin(tasks.select(*search.TASK).limit(2))
    said = prune.read_signals(table, survivors, tasks, search.TASK, True, True, small_bytes)
    return plans, said, some


def test_many_keys_move_no_text(spark, monkeypatch):
    plans, said, some = _plans(spark, monkeypatch, 0)
    assert "LeftSemi" not in plans["signals"] and "strategy=broadcast" in plans["signals"]
    monkeypatch.undo()
    _, exact, _ = _plans(spark, monkeypatch, 64 << 20)
    assert exact.count() == some.distinct().count() and said.join(exact, prune.ROW, "left_semi").count() == exact.count()
    assert said.select(*exact.columns).join(exact.select(*prune.ROW), prune.ROW, "left_semi").exceptAll(exact).isEmpty()


def test_rows_that_share_no_bit_stay_out(spark):
    table = listings(spark, 400, 8).filter("seq is not null")
    wanted = table.filter(F.col("seq") % 40 == 0).select(*prune.ROW)
    got = prune.rows_of_keys(table, wanted, 1, 0)
    assert got.columns == table.columns
    assert sorted(r.canonical_id for r in got.collect()) == sorted(r.canonical_id for r in wanted.collect())
