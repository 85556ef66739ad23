"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents per language that the fit reads at most, on average (a hash of the text picks them).
SAMPLE_PER_LANG = 20_000
#: Characters scored at once; longer texts go on in the next piece.
PIECE = 1 << 20
_MIX = np.uint32(0x9E3779B1)
_LETTER = regex.compile(r"\p{L}")


def ngram_buckets(text: str, order: int) -> np.ndarray:
    """Bucket of every run of ``order`` characters of a lower-cased text."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(codes) < order:
        return np.empty(0, np.uint16)
    mixed = np.full(len(codes) - order + 1, order, np.uint32)
    for k in range(order):
        mixed = (mixed ^ codes[k : len(codes) - order + 1 + k]) * _MIX
        mixed ^= mixed >> np.uint32(15)
    return (mixed & np.uint32(BUCKETS - 1)).astype(np.uint16)


def _pieces(text: str) -> Iterator[str]:
    """A lower-cased, edge-marked text in overlapping pieces that share no n-gram of the highest order."""
    text = f" {text.lower()} "
    for low in range(0, len(text), PIECE):
        yield text[low : low + PIECE]


@dataclass(frozen=True)
class Model:
    """``log_prob``: buckets by languages, float32 (256 KB a language); ``prior``: log shares."""

    langs: list[str]
    log_prob: np.ndarray
    prior: np.ndarray

    def score(self, text: str | None) -> tuple[str, float]:
        """Most probable language and its posterior; ``und`` and 0 for null or letterless text."""
        if not self.langs or text is None or not _LETTER.search(text):
            return "und", 0.0
        total = self.prior.astype(np.float64)
        for piece in _pieces(text):
            for order in ORDERS:
                counts = np.bincount(ngram_buckets(piece, order), minlength=BUCKETS)
                seen = np.flatnonzero(counts)
                total = total + counts[seen] @ self.log_prob[seen]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows with a language and a text; ties of equal probability go to the smaller name.

    Of a language with more than ``sample_per_lang`` rows, a share picked by a hash of the text is read, so the fit costs
    the same at any size. Tasks add up n-gram counts; the counts of a language (65,536 numbers) are summed
    by bucket ranges in Spark and only the finished matrix reaches the driver. No labelled row gives a model
    that answers ``und``.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    shares = {r["lang"]: (r["n"], min(1.0, sample_per_lang / r["n"])) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Model([], np.empty((BUCKETS, 0), np.float32), np.empty(0))
    langs = sorted(shares)
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, shares[lang][1])]), F.col("lang"))
    picked = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in _pieces(text.as_py()):
                    for order in ORDERS:
                        own += np.bincount(ngram_buckets(piece, order), minlength=BUCKETS)
        for lang, own in sums.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(own[seen])], names=["lang", "bucket", "n"]
            )

    # a bounded sample: one partition per few thousand texts keeps the partial counts few
    sample_size = sum(min(n, sample_per_lang) for n, _ in shares.values())
    counted = picked.coalesce(max(8, sample_size // 2000)).mapInArrow(count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    grams = np.zeros((BUCKETS, len(langs)))
    grams[table["bucket"].to_numpy(), table["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy()] = table["n"].to_numpy()
    smooth = grams + 0.5
    prior = np.log(np.array([shares[lang][0] for lang in langs], np.float64) / sum(n for n, _ in shares.values()))
    return Model(langs, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), prior)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its posterior; whole texts, one row per input row.

    ``und`` with score 0 when the text is null or has no letter. The model is broadcast: 256 KB a language.
    The two new columns replace columns of the same name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def label(texts):
        return pd.DataFrame([held.value.score(t) for t in texts], columns=["lang", "score"])

    scored = docs.withColumn("__scored", label(F.col(text_col)))
    return scored.withColumns({lang_col: F.col("__scored.lang"), score_col: F.col("__scored.score")}).drop("__scored")


def is_held_out(id_col: Column) -> Column:
    """Whether crc32 of the id's text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
