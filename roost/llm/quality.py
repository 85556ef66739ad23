"""Quality grades by ordinal (cumulative-link) regression on hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
#: Rated documents that the fit reads at most, on average (a hash of the text picks them).
SAMPLE = 20_000
#: Rows of one part of a gradient.
PART = 2000
SHAPES = ("#repeats", "#shouted", "#distinct", "#length")
_TOKEN = regex.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values of a whole text: hashed words, punctuation runs and word shapes.

    Value: 1 for a token that is there, however long the text, so that one bad word weighs the same in a
    long document; shares for the shapes. A null or empty text has no feature.
    """
    text = text or ""
    seen: set[str] = set()
    last = None
    repeats = shouted = total = 0
    for token in _TOKEN.findall(text):
        total += 1
        low = token.lower()
        repeats += low == last
        shouted += len(token) > 1 and token.isupper()
        last = low
        seen.add(low)
    if not total:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    buckets = np.fromiter((xxhash.xxh32_intdigest(t) for t in seen), np.int64, len(seen)) % BUCKETS
    shape = [repeats / total, shouted / total, len(seen) / total, min(1.0, np.log1p(total) / 12)]
    names = np.array([xxhash.xxh32_intdigest(k) for k in SHAPES], np.int64) % BUCKETS
    return np.concatenate([buckets, names]).astype(np.int32), np.concatenate([np.ones(len(seen)), shape]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(
    row: np.ndarray, column: np.ndarray, value: np.ndarray, above: np.ndarray, n: int, steps: int, l1: float, l2: float
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of largest penalised likelihood, by full-batch Adam with soft thresholding.

    ``row``, ``column``, ``value`` list the features; ``above[i, k]`` says whether row i has a better grade than k.
    """
    thresholds = -np.log(above.mean(axis=0) / (1 - above.mean(axis=0)))
    # gaps between thresholds are exponentials, so they stay in order
    params = np.concatenate([np.zeros(n), thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    k = above.shape[1]
    # features come by row: a part of a few thousand rows at a time bounds the memory
    parts = [slice(*np.searchsorted(row, [low, low + PART])) for low in range(0, len(above), PART)]
    for step in range(1, steps + 1):
        cuts = params[n] + np.concatenate([[0.0], np.cumsum(np.exp(params[n + 1 :]))])
        score = sum(np.bincount(row[p], weights=value[p] * params[column[p]], minlength=len(above)) for p in parts)
        tail = _sigmoid(score[:, None] - cuts)
        bound = np.concatenate([np.ones((len(above), 1)), tail, np.zeros((len(above), 1))], axis=1)
        at = above.sum(axis=1).astype(int)
        upper, lower = bound[np.arange(len(above)), at], bound[np.arange(len(above)), at + 1]
        # log(upper - lower) has slope (1 - upper - lower) in the score
        slope = (1 - upper - lower) / len(above)
        cut_slope = np.zeros(k)
        gap = np.maximum(upper - lower, 1e-12) * len(above)
        for j in range(k):
            inner = tail[:, j] * (1 - tail[:, j]) / gap
            cut_slope[j] = inner[at == j].sum() - inner[at == j + 1].sum()
        back = np.cumsum(cut_slope[::-1])[::-1]
        pull = sum(np.bincount(column[p], weights=slope[row[p]] * value[p], minlength=n) for p in parts)
        gradient = np.concatenate(
            [l2 * params[:n] - pull, -back[:1], -back[1:] * np.exp(params[n + 1 :])]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        params = params - rate * first / (1 - 0.9**step)
        params[:n] = np.sign(params[:n]) * np.maximum(np.abs(params[:n]) - l1 * rate[:n], 0)
    return params[:n], params[n] + np.concatenate([[0.0], np.cumsum(np.exp(params[n + 1 :]))])


@dataclass(frozen=True)
class Model:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]); the thresholds rise, the weights are shared."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """Probability of each grade above the lowest, or of a better one."""
        buckets, values = features(text)
        return _sigmoid(float(self.weights[buckets] @ values) - self.thresholds)


def fit(
    rated: DataFrame,
    sample: int = SAMPLE,
    steps: int = 300,
    l1: float = 0.05,
    least_texts: int = 8,
    text_col: str = "text",
    grade_col: str = "grade",
) -> Model:
    """Fit on rows (text, integer grade); rows with a null grade are left out, null texts count as empty.

    At most about ``sample`` rows are read: with more, a share picked by a hash of text and grade. Executors hash the
    texts, the driver gets feature numbers only (about 1.5 KB a row) and fits twice from a
    fixed start: an L1 penalty (``l1`` over the root of the rows) chooses the features, a second fit without it
    sets their weights; the same rows give the same model. Tokens of fewer than
    ``least_texts`` texts get no weight. One grade only gives a model that always answers it; no row
    at all a model of grade 0.
    """
    rows = rated.select(F.col(text_col).alias("text"), F.col(grade_col).cast("int").alias("grade")).filter("grade is not null")
    total = rows.count()
    share = min(1.0, sample / max(1, total))
    picked = rows.filter(F.pmod(F.xxhash64("text", "grade"), F.lit(1 << 20)) < share * (1 << 20))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([b.tobytes() for b, _ in found]), pa.array([v.tobytes() for _, v in found])],
                names=["grade", "buckets", "values"],
            )

    data = picked.mapInArrow(hashed, "grade int, buckets binary, values binary").toArrow().sort_by(
        [("grade", "ascending"), ("buckets", "ascending"), ("values", "ascending")]
    )
    grade = data.column("grade").to_numpy()
    grades = sorted(set(grade.tolist())) or [0]
    if len(grades) == 1:
        return Model(grades, np.zeros(BUCKETS, np.float32), np.empty(0))
    buckets, values = data.column("buckets"), data.column("values")
    texts = np.zeros(BUCKETS, np.int64)
    for one in buckets:
        texts[np.frombuffer(one.as_py(), np.int32)] += 1
    keep = texts >= least_texts
    keep[np.array([xxhash.xxh32_intdigest(k) for k in SHAPES], np.int64) % BUCKETS] = True
    used = np.flatnonzero(keep & (texts > 0))
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    rows_of: list[tuple[np.ndarray, np.ndarray]] = []
    for one, weight in zip(buckets, values, strict=True):
        column = number[np.frombuffer(one.as_py(), np.int32)]
        rows_of.append((column[column >= 0], np.frombuffer(weight.as_py(), np.float32)[column >= 0]))
    sizes = [len(c) for c, _ in rows_of]
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    column, value = (np.concatenate([r[k] for r in rows_of]) for k in (0, 1))
    del data, buckets, values, rows_of
    above = np.array([grade > g for g in grades[:-1]], np.float64).T
    selected, _ = _descend(row, column, value, above, len(used), steps, l1 / np.sqrt(len(above)), 0.0)
    chosen = np.flatnonzero(selected)
    place = np.full(len(used), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    known = place[column] >= 0
    fitted, thresholds = _descend(row[known], place[column[known]], value[known], above, len(chosen), steps, 0.0, 1e-5)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used[chosen]] = fitted
    return Model(grades, weights, thresholds)


def grade_documents(
    docs: DataFrame, model: Model, least_grade: int, least_tail: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_prob`` = P(grade >= least_grade) and ``keep`` (tail_prob >= least_tail).

    One row per input row, over whole texts; a null or empty text is graded by the thresholds alone. The model is broadcast
    (1 MB of shared weights). The three columns replace columns of the same name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, tail double")
    def grade(texts):
        grades = np.array(held.value.grades, np.float64)
        at = int(np.searchsorted(grades, least_grade))
        out = []
        for text in texts:
            above = np.concatenate([[1.0], held.value.tails(text), [0.0]])
            out.append((float(grades[0] + np.diff(grades) @ above[1:-1]), float(above[at])))
        return pd.DataFrame(out, columns=["expected", "tail"])

    graded = docs.withColumn("__graded", grade(F.col(text_col)))
    return graded.withColumns(
        {
            "expected_grade": F.col("__graded.expected"),
            "tail_prob": F.col("__graded.tail"),
            "keep": F.col("__graded.tail") >= least_tail,
        }
    ).drop("__graded")


def rated_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text``, ``grade`` of labelled documents: one point for quality, one for not being toxic (0, 1 or 2).

    A null label counts as unknown and leaves the row out; several labels of one document: the lowest. Of more than
    ``sample`` labelled documents a share picked by a hash of the id is joined, so the rating side is bounded
    and broadcast, and no text is shuffled.
    """
    grade = (F.col("quality") + 1 - F.col("toxic")).alias("grade")
    rating = labels.select("doc_id", grade).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    share = min(1.0, sample / max(1, rating.count()))
    picked = rating.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "grade")
