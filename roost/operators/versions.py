"""Newest fetch of every stored page, at once and kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roost.functions.text import normalize_text
from roost.operators.outcomes import outcome_rollup
from roost.sources.staging import stage

PAGE = ["portal", "location_key", "path"]
_VERSION = (
    "page_key string, place_key string, bucket int, portal string, location_key string, path string, crawl_location string, "
    "page_no int, fetched_at timestamp, fetch_id bigint, page_class string, challenge_id string, n_listings bigint, warning string, "
    "since bigint"
)
_CHANGE = _VERSION + ", sign int, batch bigint"
_NAMES = [part.split()[0] for part in _VERSION.split(", ")]
_ROLLUP = (
    "portal string, crawl_location string, location_key string, source_kind string, warnings array<string>, error_code string, "
    "error_message string, n_listings bigint, batch bigint"
)


def latest_pages(pages: DataFrame) -> DataFrame:
    """The newest fetch of every page; spellings of a place with one normalised text are one place.

    ``pages``: ``portal``, ``crawl_location``, ``path``, ``fetched_at``, ``fetch_id`` and any others. Of two fetches at one time the
    larger ``fetch_id`` counts, a missing time or id is the oldest; missing portals, places and paths are values like others. Adds
    ``location_key``. The rank limit runs before the shuffle, so a page's old fetches in one task do not travel.
    """
    keyed = pages.withColumn("location_key", normalize_text(F.col("crawl_location")))
    newest = Window.partitionBy(*PAGE).orderBy(F.col("fetched_at").desc_nulls_last(), F.col("fetch_id").desc_nulls_last())
    return keyed.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def _digest(*names: str) -> Column:
    """One non-null text per combination of values, nulls included."""
    return F.md5(F.to_json(F.struct(*names)))


class PageVersions:
    """Newest page outcomes and their roll-up, kept by signed changes in a shared folder.

    A batch brings outcomes of fetched pages in any order. Where it holds a newer fetch than the one kept, the old row is taken
    back (sign -1) and the new one put in (sign +1); a late fetch changes nothing. Places with a change get a new roll-up row from
    their kept pages. Each batch has a folder in both tables; the marker
    of the one in ``changes``, written last, commits both. A committed batch
    applied again changes nothing, and one that failed half-way is overwritten by the retry. Batches have rising numbers
    and one writer.

    Changes are stored by place in ``buckets`` folders: a batch reads only those that its places fall into.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _folder(self, batch: int, table: str) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def committed(self) -> list[int]:
        """Numbers of the committed batches, rising."""
        fs, top = self._fs(f"{self.path}/changes")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        return [n for n in numbers if fs.exists(self._fs(f"{self._folder(n, 'changes')}/_SUCCESS")[1])]

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [self._folder(n, table) for n in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def changes(self) -> DataFrame:
        """All signed rows; ``since`` is the batch that put the row in."""
        return self._read("changes", _CHANGE)

    def current(self, buckets: list[int] | None = None) -> DataFrame:
        """The kept outcome of every page, of some buckets or all."""
        log = self.changes()
        if buckets is not None:
            log = log.filter(F.col("bucket").isin(buckets))
        gone = log.filter("sign = -1").select("page_key", "since")
        return log.filter("sign = 1").join(gone, ["page_key", "since"], "left_anti").select(*_NAMES)

    def totals(self) -> DataFrame:
        """Kept pages and their listings per portal, place and class, as sums of the signed rows."""
        sums = self.changes().groupBy("portal", "location_key", "page_class").agg(
            F.sum("sign").alias("n_pages"), F.sum(F.col("sign") * F.coalesce("n_listings", F.lit(0))).alias("n_listings")
        )
        return sums.filter("n_pages <> 0")

    def rollup(self) -> DataFrame:
        """The newest roll-up row of every portal and place."""
        rows = self._read("rollup", _ROLLUP)
        newest = Window.partitionBy("portal", "location_key").orderBy(F.col("batch").desc())
        return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "batch")

    def apply(self, batch: int, outcomes: DataFrame) -> bool:
        """Commit a batch of ``page_outcomes`` rows with ``fetched_at`` and ``fetch_id``; False when it was committed before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        fresh = latest_pages(outcomes).withColumns({"page_key": _digest(*PAGE), "place_key": _digest(*PAGE[:2])})
        fresh = fresh.withColumns(
            {"bucket": F.pmod(F.xxhash64("place_key"), F.lit(self.buckets)).cast("int"), "since": F.lit(batch).cast("bigint")}
        )
        fields = [part.split() for part in _VERSION.split(", ")]
        fresh = stage(fresh.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields]), "page-batch")
        buckets = [r.bucket for r in fresh.select("bucket").distinct().collect()]
        held = self.current(buckets)
        pairs = fresh.alias("f").join(held.alias("h"), F.col("f.page_key") == F.col("h.page_key"), "left")
        none_held = F.col("h.page_key").isNull()
        # in structs nulls come first, as in latest_pages
        newer = F.struct("f.fetched_at", "f.fetch_id") > F.struct("h.fetched_at", "h.fetch_id")
        row = lambda side, sign: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in _NAMES], F.lit(sign).alias("sign"))
        both = F.when(none_held, F.array(row("f", 1))).otherwise(F.array(row("f", 1), row("h", -1)))
        changes = stage(pairs.filter(none_held | newer).select(F.inline(both)), "page-changes")

        put, taken = changes.filter("sign = 1"), changes.filter("sign = -1").select("page_key")
        places = changes.select("place_key").distinct()
        kept = held.join(places, "place_key", "left_semi").join(taken, "page_key", "left_anti")
        rolled = outcome_rollup(kept.unionByName(put.drop("sign")))
        rolled.write.mode("overwrite").parquet(self._folder(batch, "rollup"))
        changes.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(batch, "changes"))
        return True
