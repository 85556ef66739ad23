"""Token-count rollups kept up to date by signed changes, in idempotent batch commits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roost.llm.packing import encoder

GROUP = ["source", "lang", "tokenizer_version"]
_SUMS = ["n_docs", "n_tokens"]
_DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, versions: list[str], id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens of every whole text, one row per input row and version.

    A version names a byte-level vocabulary of the public tokenizers. Null and empty texts have no token; rows that repeat
    an id, and null ids, count like any other. ``mark``: a boolean of the row that comes along as ``marked`` (null: false), to
    pick the same rows again whatever their ids.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for version in versions:
                encode = encoder(version)
                counts = pa.array([len(encode.encode_to_numpy(t, allowed_special="all")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array([version] * len(texts)), counts, batch.column(4)],
                    names=["doc_id", "source", "lang", "tokenizer_version", "n_tokens", "marked"],
                )

    marked = F.coalesce(mark if mark is not None else F.lit(False), F.lit(False)).alias("marked")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source"), F.col("lang"), F.col(text_col).alias("text"), marked)
    counted = rows.mapInArrow(count, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, marked boolean")
    return counted if mark is not None else counted.drop("marked")


def inserts(counted: DataFrame) -> DataFrame:
    """Changes that add counted documents."""
    return counted.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counted: DataFrame) -> DataFrame:
    """Changes that take counted documents away again."""
    return counted.select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that put new counts of the same documents in place of old ones, also under another group."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals by source, language and tokenizer version in a shared folder.

    A batch is aggregated to one signed row per group and written to a folder of its own; the folder's
    success marker, written last, is the commit. Applying a committed batch again changes nothing, and one
    that failed half-way is overwritten by the retry, so a batch counts exactly once. Totals add up the
    committed batches: nothing is rewritten and no document is read again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _batch(self, batch_id: str) -> str:
        if not batch_id or not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch id {batch_id!r}: letters, digits, - and _ only")
        return f"{self.path}/batch={batch_id}"

    def committed(self, batch_id: str) -> bool:
        fs, marker = self._fs(f"{self._batch(batch_id)}/_SUCCESS")
        return fs.exists(marker)

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit signed changes (group columns, n_docs, n_tokens); False when the batch was committed before.

        Null group values are groups of their own, null amounts count as 0. Partial sums go out per task, so a
        group with a third of all rows shuffles one row per task.
        """
        if self.committed(batch_id):
            return False
        sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in _SUMS]
        delta = changes.groupBy(*GROUP).agg(*sums).filter("n_docs <> 0 or n_tokens <> 0")
        delta.write.mode("overwrite").parquet(self._batch(batch_id))
        return True

    def totals(self) -> DataFrame:
        """Rows: source, lang, tokenizer_version, n_docs, n_tokens, of the groups that are not back at zero."""
        fs, top = self._fs(self.path)
        found = [s.getPath().toString() for s in fs.listStatus(top)] if fs.exists(top) else []
        paths = [p for p in found if fs.exists(self._fs(f"{p}/_SUCCESS")[1])]
        deltas = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        summed = deltas.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in _SUMS])
        return summed.filter("n_docs <> 0 or n_tokens <> 0")
