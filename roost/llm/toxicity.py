"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the fit reads at most, on average (a hash of the id picks them).
SAMPLE = 12_000
#: Distances between the two words of a pair: neighbours, and skips over one or two words.
GAPS = (1, 2, 3)
#: Characters cut into words at once; a longer text goes on in the next piece.
PIECE = 1 << 20
#: Words whose hashes a task keeps.
KNOWN = 500_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """XXH64 of a word, looked up after its first use."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return found


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters that end where a word ends."""
    low = 0
    while low < len(text):
        high = min(len(text), low + PIECE)
        cut = _WORD.match(text, high) if 0 < high < len(text) and _WORD.match(text[high - 1]) else None
        high = cut.end() if cut else high
        yield text[low:high]
        low = high


def features(text: str | None, known: _Hashes) -> np.ndarray:
    """32-bit hashes of all words and ordered word pairs one, two and three places apart, repeats included.

    Words are runs of letters, digits and underscores of the lower-cased whole text; null and empty texts have none.
    """
    parts = [np.fromiter(map(known.__getitem__, _WORD.findall(piece.lower())), np.uint64) for piece in _pieces(text or "")]
    word = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    found = [word >> np.uint64(32)]
    for gap in GAPS:
        pair = (word[:-gap] * _MIX) ^ (word[gap:] + np.uint64(gap))
        found.append((pair * _MIX) >> np.uint64(32))
    return np.concatenate(found).astype(np.uint32)


@dataclass(frozen=True)
class Model:
    """Rising feature hashes with a weight other than zero, their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, known: _Hashes) -> float:
        """Probability of label 1: every feature of the whole text counts once."""
        total = self.bias
        if len(self.keys):
            found = features(text, known)
            place = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            total += float(self.weights[np.unique(place[self.keys[place] == found])].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def ftrl(
    rows: list[np.ndarray], labels: np.ndarray, n: int, turns: int, alpha: float, beta: float, l1: float, l2: float
) -> tuple[np.ndarray, float]:
    """Weights and bias after ``turns`` passes of FTRL-proximal over rows of present features (numbers below ``n``).

    Each coordinate has its own rate, alpha / (beta + root of its squared gradients), and stays at zero until
    its summed pull exceeds ``l1``. The bias is the last coordinate, without a penalty.
    """
    pull, square = np.zeros(n + 1), np.zeros(n + 1)
    penalty = np.full(n + 1, l1)
    penalty[n] = 0.0

    def weight(at: np.ndarray) -> np.ndarray:
        z, bar = pull[at], penalty[at]
        return np.where(np.abs(z) <= bar, 0.0, -(z - np.sign(z) * bar) / ((beta + np.sqrt(square[at])) / alpha + l2))

    places = [np.append(row, n) for row in rows]
    for _ in range(turns):
        for at, label in zip(places, labels.tolist(), strict=True):
            w = weight(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -40, 40))) - label
            grown = square[at] + gradient * gradient
            pull[at] += gradient - (np.sqrt(grown) - np.sqrt(square[at])) / alpha * w
            square[at] = grown
    every = weight(np.arange(n + 1))
    return every[:n], float(every[n])


def _train(hashed: list[np.ndarray], labels: np.ndarray, least_texts: int, **settings) -> Model:
    """Fit on distinct feature hashes of each text; those of fewer than ``least_texts`` texts are left out."""
    seen = np.zeros(1 << 22, np.int32)
    low = np.uint32(len(seen) - 1)
    for row in hashed:
        np.add.at(seen, row & low, 1)
    hashed = [row[seen[row & low] >= least_texts] for row in hashed]
    keys, count = np.unique(np.concatenate(hashed), return_counts=True) if hashed else (np.empty(0, np.uint32), np.empty(0))
    keys = keys[count >= least_texts]
    rows = []
    for row in hashed:
        place = np.searchsorted(keys, row)
        rows.append(place[keys[np.minimum(place, len(keys) - 1)] == row] if len(keys) else place[:0])
    weights, bias = ftrl(rows, labels, len(keys), **settings)
    used = np.flatnonzero(weights)
    return Model(keys[used], weights[used].astype(np.float32), bias)


def fit(
    labelled: DataFrame,
    turns: int = 8,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 5.0,
    l2: float = 0.0,
    least_texts: int = 5,
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on a bounded table of (text, label 0 or 1), such as ``labelled_documents`` gives; null labels are left out.

    Executors hash the texts; FTRL is sequential, so one task passes over the hashed rows, in the order of their hashes,
    and only the weights that L1 leaves come to the driver. The same rows give the same model, whatever
    their order. Null and empty texts count with the bias alone; no row at all gives score 0.5.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                found = [np.unique(features(t.as_py(), known)).tobytes() for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), part.column(1)], names=["features", "label"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [(row.as_py(), label) for batch in batches for row, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
        texts.sort(key=lambda x: (xxhash.xxh64_intdigest(x[0]), *x))
        labels = np.array([label for _, label in texts], np.float64)
        model = _train(
            [np.frombuffer(row, np.uint32) for row, _ in texts], labels, least_texts, turns=turns, alpha=alpha, beta=beta, l1=l1, l2=l2
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.keys.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["keys", "weights", "bias"]
        )

    hashed = rows.mapInArrow(hash_texts, "features binary, label int")
    fitted = hashed.repartition(1).mapInArrow(train, "keys binary, weights binary, bias double").first()
    if fitted is None:
        return Model(np.empty(0, np.uint32), np.empty(0, np.float32), 0.0)
    return Model(np.frombuffer(bytes(fitted["keys"]), np.uint32), np.frombuffer(bytes(fitted["weights"]), np.float32), fitted["bias"])


def labelled_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text``, ``toxic`` of labelled documents; several labels of one document: the highest; null labels are unknown.

    Of more than ``sample`` labels a share picked by a hash of the id is joined: the label side is bounded and broadcast,
    and no text is shuffled.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the probability of label 1 of every whole text, one row per input row.

    Null and empty texts have the score of the bias. The model is broadcast: 8 bytes for each weight that L1 left, of a
    bounded sample. An empty table gives an empty table; other columns are not carried.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            scores = [held.value.score(t.as_py(), known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double")


def is_held_out(id_col: Column) -> Column:
    """Whether 5 divides the crc32 of the id's text; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
