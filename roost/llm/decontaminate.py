"""Benchmark decontamination: BM25 over test items with block-max pruning, then exact overlap of question and answer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roost.llm.common import stage

BLOCK = 64
#: Item text of one index, on average; more items make more indexes, each held against all passages in turn.
INDEX_BYTES = 8 << 20
#: Upper bounds (term of a passage x block) held at a time.
GROUP_CELLS = 1 << 18
K1, LENGTH_SHARE = 1.2, 0.75
SHINGLE = 5

_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LEAK = (
    "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,first_word:long,last_word:long>>"
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits; characters beyond ASCII count as letters."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that is one text: the last sentence answers, unless it is the only one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (" ".join(parts), "")


def _runs(ids: np.ndarray, size: int) -> np.ndarray:
    """64-bit code of each run of ``size`` ids; a run with an unknown word (-1) has code -1."""
    if len(ids) < size:
        return np.empty(0, np.int64)
    code = np.zeros(len(ids) - size + 1, np.uint64)
    known = np.ones(len(code), bool)
    for k in range(size):
        part = ids[k : len(ids) - size + 1 + k]
        code = (code ^ (part + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        known &= part >= 0
    return np.where(known, (code >> np.uint64(1)).astype(np.int64), -1)


@dataclass
class Index:
    """Impacts of item words, each a share of the item's score against itself, in blocks of 64 items."""

    vocabulary: dict[bytes, int]
    item_ids: list[int]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    top: np.ndarray = field(default_factory=lambda: np.empty(0))
    block_top: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    blocks: list[tuple] = field(default_factory=list)

    @property
    def longest(self) -> int:
        return max((len(q) + len(a) for q, a in zip(self.questions, self.answers, strict=True)), default=0)


def build_index(items: list[tuple[int, list[bytes], list[bytes]]], idf: dict[bytes, float], mean_length: float) -> Index:
    """Index of (id, question words, answer words)."""
    items = sorted(items, key=lambda x: (len(x[1]) + len(x[2]), x[0]))
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, q, a in items for w in q + a}))}
    weight = np.array([idf[w] for w in vocabulary], np.float64)
    index = Index(vocabulary, [i for i, _, _ in items], *([np.array([vocabulary[w] for w in x[k]], np.int64) for x in items] for k in (1, 2)))
    n_blocks = -(-len(items) // BLOCK)
    index.block_top = np.zeros((len(vocabulary), n_blocks))
    for block in range(n_blocks):
        terms, places, impacts = [], [], []
        for place in range(block * BLOCK, min(len(items), (block + 1) * BLOCK)):
            both = np.concatenate([index.questions[place], index.answers[place]])
            term, count = np.unique(both, return_counts=True)
            norm = K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * len(both) / mean_length)
            impact = weight[term] * count * (K1 + 1) / (count + norm)
            impact /= impact.sum() or 1
            terms.append(term)
            places.append(np.full(len(term), place - block * BLOCK))
            impacts.append(impact)
            np.maximum.at(index.block_top[:, block], term, impact)
        term, place, impact = map(np.concatenate, (terms, places, impacts))
        order = np.argsort(term, kind="stable")
        known, start = np.unique(term[order], return_index=True)
        index.blocks.append((known, np.append(start, len(order)), place[order], impact[order]))
    index.top = index.block_top.max(axis=1, initial=0)
    return index


def _block_scores(index: Index, block: int, owner: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    """Exact scores of ``n`` passages (rows) against the items of a block; ``owner`` is the passage of each term."""
    known, start, place, impact = index.blocks[block]
    at = np.searchsorted(known, terms)
    held = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == terms)
    at, owner = at[held], owner[held]
    lengths = start[at + 1] - start[at]
    rows = np.repeat(start[at] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    return np.bincount(np.repeat(owner, lengths) * BLOCK + place[rows], weights=impact[rows], minlength=n * BLOCK).reshape(n, BLOCK)


def _candidates(passage: np.ndarray, terms: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, int, float]]:
    """Passage number, item place and score of all that reach ``threshold``, from the sorted distinct (passage, term) pairs.

    Passages are taken in groups of about ``GROUP_CELLS`` bounds, so memory does not grow with text or index.
    """
    cuts = np.flatnonzero(np.diff(passage, prepend=-1))
    ends = np.append(cuts[1:], len(passage))
    hopeful = np.flatnonzero(np.add.reduceat(index.top[terms], cuts) >= threshold)
    sizes = ends[hopeful] - cuts[hopeful]
    group = np.cumsum(sizes) * index.block_top.shape[1] // GROUP_CELLS
    for own in np.split(hopeful, np.flatnonzero(np.diff(group)) + 1) if len(hopeful) else ():
        n_terms = ends[own] - cuts[own]
        low = np.concatenate(([0], np.cumsum(n_terms)[:-1]))
        here = terms[np.repeat(cuts[own] - low, n_terms) + np.arange(n_terms.sum())]
        bounds = np.add.reduceat(index.block_top[here], low, axis=0) >= threshold
        for block in np.flatnonzero(bounds.any(axis=0)).tolist():
            chosen = np.flatnonzero(bounds[:, block])
            rank = np.full(len(own), -1, np.int64)
            rank[chosen] = np.arange(len(chosen))
            owner = np.repeat(rank, n_terms)
            scores = _block_scores(index, block, owner[owner >= 0], here[owner >= 0], len(chosen))
            for k, place in zip(*np.nonzero(scores >= threshold), strict=True):
                yield int(passage[cuts[own[chosen[k]]]]), block * BLOCK + int(place), float(scores[k, place])


def _share(wanted: np.ndarray, ids: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Distinct shingles of an item part, how many of them the passage has, and where it has them."""
    size = min(SHINGLE, len(wanted))
    if not size:
        return 0, 0, np.empty(0, np.int64)
    shingles, here = np.unique(_runs(wanted, size)), _runs(ids, size)
    return len(shingles), int(np.isin(shingles, here).sum()), np.flatnonzero(np.isin(here, shingles))


def leaks_of(ids: np.ndarray, index: Index, window: int, threshold: float, overlap: float, answer_words: float) -> dict[int, tuple]:
    """Verified items of one document: place in the index -> (score, question and answer overlap, first, last word).

    Passages of ``window`` words start every half window, so every item lies whole inside one. Passages whose words'
    best impacts together miss the threshold are passed over, then blocks whose maxima do; what is left
    is scored exactly.
    """
    found: dict[int, tuple] = {}
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return found
    stride = max(1, window // 2)
    last = max(0, -(-(len(ids) - window) // stride))
    passage = np.concatenate([at // stride, at // stride - 1])
    codes = np.unique((passage * len(index.top) + np.tile(ids[at], 2))[(passage >= 0) & (passage <= last)])
    passage, terms = np.divmod(codes, len(index.top))
    for number, item, score in _candidates(passage, terms, index, threshold):
        low = number * stride
        text = ids[low : low + window]
        question, answer = index.questions[item], index.answers[item]
        n_q, hit_q, at_q = _share(question, text)
        n_a, hit_a, at_a = _share(answer, text)
        n_all, hit_all, at_all = _share(np.concatenate([question, answer]), text)
        near = text[at_all.min() : at_all.max() + SHINGLE] if len(at_all) else text[:0]
        if hit_all < overlap * n_all or len(answer) and np.isin(answer, near).mean() < answer_words:
            continue
        spot = np.concatenate([at_q, at_a, at_all])
        row = (
            score, hit_q / n_q if n_q else 1.0, hit_a / n_a if n_a else 1.0,
            low + int(at_all.min()), low + int(min(at_all.max() + SHINGLE, len(text))) - 1,
        )
        if len(spot) and (item not in found or row[:3] > found[item][:3]):
            found[item] = row
    return found


def with_leaks(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.5,
    overlap: float = 0.8,
    answer_words: float = 0.5,
    text_col: str = "text",
    leaks_col: str = "leaks",
) -> DataFrame:
    """``docs`` with the test items that each row's text holds (an array, empty for a clean row), in place of ``leaks_col``.

    ``items``: item_id, question, answer (may be null). Every passage of every whole text queries the item index;
    items scoring ``threshold`` of their score against themselves are retrieved, all of them, and verified:
    ``overlap`` of the item's five-word runs and ``answer_words`` of the answer's words must stand in the passage.
    Items of fewer than five words are matched as one run; items without a word match nothing. Null or empty
    texts match nothing; repeated rows and null ids are treated like any other. Items are dealt by a hash into indexes of about
    8 MB of text, each broadcast and applied in turn, with document frequencies over all items.
    """
    spark = docs.sparkSession
    tokens = F.udf(lambda t: [w.decode("utf-8") for w in words(t)], "array<string>")
    parts = items.select(F.col("item_id").cast("long").alias("item_id"), tokens("question").alias("q"), tokens("answer").alias("a"))
    # cut into words once: each later pass would start Python workers of its own
    parts = stage(parts, "benchmark-items").filter(F.size("q") + F.size("a") > 0)
    n_items, n_words, n_bytes = parts.agg(
        F.count("*"), F.sum(F.size("q") + F.size("a")), F.sum(F.length(F.array_join("q", " ")) + F.length(F.array_join("a", " ")))
    ).first()
    frequency = parts.select("item_id", F.explode(F.array_union("q", "a")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n_indexes = max(1, -(-(n_bytes or 0) // INDEX_BYTES))
    found = []
    for shard in range(n_indexes if n_items else 0):
        own = parts.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_indexes)) == shard)
        rows = [(r["item_id"], [w.encode() for w in r["q"]], [w.encode() for w in r["a"]]) for r in own.collect()]
        if not rows:
            continue
        own_words = own.select(F.explode(F.array_union("q", "a")).alias("word")).distinct()
        counts = {r["word"].encode(): r["df"] for r in own_words.join(frequency, "word").collect()}
        idf = {w: float(np.log1p((n_items - df + 0.5) / (df + 0.5))) for w, df in counts.items()}
        held = spark.sparkContext.broadcast(build_index(rows, idf, n_words / n_items))
        found.append(_leaks_udf(held, threshold, overlap, answer_words)(F.col(text_col)))
    leaks = F.concat(*found) if found else F.array().cast(_LEAK)
    return docs.withColumn(leaks_col, leaks)


def _leaks_udf(held, threshold: float, overlap: float, answer_words: float):
    @F.pandas_udf(_LEAK)
    def search(texts):
        index = held.value
        window, get, out = 2 * index.longest, index.vocabulary.get, []
        for text in texts:
            ids = np.array([get(w, -1) for w in words(text)], np.int64)
            hits = leaks_of(ids, index, window, threshold, overlap, answer_words)
            names = ("score", "question_overlap", "answer_overlap", "first_word", "last_word")
            out.append([{"item_id": index.item_ids[place]} | dict(zip(names, row, strict=True)) for place, row in hits.items()])
        return pd.Series(out, dtype="object")

    return search


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per (doc_id, item_id) of ``with_leaks``; options are passed on, a null document id stays null."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = with_leaks(rows, items, **options).select("doc_id", F.explode("leaks").alias("leak"))
    return held.select("doc_id", "leak.*")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``question``, ``answer`` of items stored as one text."""
    parts = F.udf(lambda t: dict(zip(("question", "answer"), split_item(t), strict=True)), "question string, answer string")
    return benchmark.select("item_id", parts("text").alias("p")).select("item_id", "p.question", "p.answer")
