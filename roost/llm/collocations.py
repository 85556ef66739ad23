"""Phrase collocations: Rabin-Karp fingerprints of word n-grams, counted level by level and verified against the text."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roost.llm.common import Staged

#: Bits of the filter of frequent fingerprints: 16 MB, whatever the corpus. Crowding costs speed only.
FILTER_BITS = 27
#: Words hashed at once; characters of a text cut into words at once; distinct words that a task keeps.
BLOCK = 1 << 20
PIECE = 1 << 20
KNOWN = 1 << 18
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _SEPARATORS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_SEPARATORS))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Word numbers that stand for no word: an empty string between blanks, and a break between pieces.
_BLANK, _BREAK = 0, 1


class _Words(dict):
    """Numbers of a task's words, with the words and their XXH64."""

    def __init__(self):
        super().__init__({b"": _BLANK, b"\n": _BREAK})
        self.words = [b"", b"\n"]
        self.hashes = array("Q", [0, 0])

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number


class _Block:
    """Consecutive word numbers of a few documents, pieces apart by breaks; n-grams that end before ``fresh`` are another block's."""

    def __init__(self, known: _Words):
        self.known = known
        self.docs: list[tuple[int | None, str]] = []
        self.parts: list[np.ndarray] = []
        self.owners: list[int] = []
        self.places: list[int] = []
        self.fresh = self.size = 0

    def add(self, ids: np.ndarray, owner: int, place: int) -> None:
        self.parts.append(ids)
        self.owners.append(owner)
        self.places.append(place)
        self.size += len(ids)

    def close(self) -> _Block:
        self.ids = np.concatenate(self.parts)
        sizes = [len(p) for p in self.parts]
        self.owner = np.repeat(np.array(self.owners, np.int32), sizes)
        word = self.ids != _BREAK
        self.breaks = np.concatenate([[0], np.cumsum(~word)])
        # number of a word in its document
        before = np.cumsum(word) - word
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.number = before - np.repeat(before[starts], sizes) + np.repeat(np.array(self.places, np.int64), sizes)
        langs = sorted({lang for _, lang in self.docs})
        code = {lang: i for i, lang in enumerate(langs)}
        self.lang = np.array([code[lang] for _, lang in self.docs], np.int32)[self.owner]
        self.seeds = np.array([xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 7) for lang in langs], np.uint64)
        # prefix sums of hash times falling powers of the base; wrapping 64-bit arithmetic
        hashes = np.array(self.known.hashes)[self.ids]
        self.rise, fall = _powers(len(self.ids) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * fall[: len(hashes)], dtype=np.uint64)])
        self.parts = []
        return self

    def starts(self, k: int) -> np.ndarray:
        """Whether a phrase of ``k`` words of this block starts at each position."""
        n = max(0, len(self.ids) - k + 1)
        whole = self.breaks[k : k + n] == self.breaks[:n]
        whole[: max(0, self.fresh - k + 1)] = False
        return whole

    def fingerprints(self, k: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the ``k``-word phrases that start at ``at``: polynomial of the word hashes, salted by lang and length."""
        value = (self.prefix[at + k] - self.prefix[at]) * self.rise[at + k]
        value ^= self.seeds[self.lang[at]] + np.uint64(k)
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return value ^ (value >> np.uint64(32))


#: Word numbers of one document, at most.
_PLACE = 1 << 40
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK)
        _POWERS[:] = [
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)])) for base in (_BASE, _INVERSE)
        ]
    return _POWERS[0], _POWERS[1]


def _chunks(text: bytes) -> Iterator[bytes]:
    """A translated text in chunks of about ``PIECE`` bytes that end at a blank or a break."""
    low = 0
    while len(text) - low > PIECE:
        ends = [x for x in (text.find(c, low + PIECE) for c in (b" ", b"\n")) if x >= 0]
        high = min(ends, default=len(text) - 1) + 1
        yield text[low:high]
        low = high
    yield text[low:]


def _blocks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[_Block]:
    """Blocks of about ``BLOCK`` words of a task's rows (doc_id, lang, text); a text that goes on repeats its last words."""
    known = _Words()
    block = _Block(known)
    for batch in batches:
        for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            owner, place, tail = len(block.docs), 0, np.empty(0, np.int32)
            block.docs.append((doc_id, lang))
            for chunk in _chunks((text.as_py() or b"").translate(_LOWER)):
                if block.size >= BLOCK:
                    yield block.close()
                    known = _Words() if len(known) > KNOWN else known
                    words = block.known.words
                    block, owner = _Block(known), 0
                    block.docs.append((doc_id, lang))
                    if len(tail):
                        tail = np.array([known[words[i]] for i in tail.tolist()], np.int32)
                        block.add(tail, 0, place - int((tail != _BREAK).sum()))
                        block.fresh = len(tail)
                found = chunk.replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                ids = ids[ids != _BLANK]
                block.add(ids, owner, place)
                place += int((ids != _BREAK).sum())
                tail = np.concatenate([tail, ids])[-overlap:] if overlap else tail
            block.add(np.array([_BREAK], np.int32), owner, place)
    if block.docs:
        yield block.close()


def _held(bits: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Whether the filter has each fingerprint; it may also have others."""
    slot = fingerprints & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _open_starts(block: _Block, k: int, part: int, bits: np.ndarray | None) -> np.ndarray:
    """Starts of ``k``-word phrases all of whose parts of ``part`` words may be frequent."""
    at = np.flatnonzero(block.starts(k))
    for low in range(k - part + 1 if part else 0):
        at = at[_held(bits, block.fingerprints(part, at + low))]
    return at


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")
    )


def _frequent(rows: DataFrame, k: int, least: int, bits, max_words: int) -> DataFrame:
    """Fingerprints of ``k``-word phrases that occur ``least`` times; tasks add up blocks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, max_words - 1):
            at = _open_starts(block, k, k - 1, bits.value if bits else None)
            found, n = np.unique(block.fingerprints(k, at), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["fp", "n"])

    counted = rows.mapInArrow(count, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least).select("fp")


def _filter_bits(frequent: DataFrame) -> np.ndarray:
    """The filter of a table of fingerprints: at most 2^21 words of 64 bits reach the driver."""
    slot = F.col("fp").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    word = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = frequent.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(word).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def _groups(block: _Block, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First start and count of every phrase among ``at``: grouped by fingerprint, compared word by word with the group's first."""
    _, first, inverse, counts = np.unique(block.fingerprints(k, at), return_index=True, return_inverse=True, return_counts=True)
    head = at[first][inverse]
    same = block.lang[at] == block.lang[head]
    for j in range(k):
        same &= block.ids[at + j] == block.ids[head + j]
    if same.all():
        return at[first], counts
    # collisions: whatever differs from the first is grouped by its words
    counts = np.bincount(inverse[same], minlength=len(first))
    odd = at[~same]
    words = np.column_stack([block.lang[odd], *[block.ids[odd + j] for j in range(k)]])
    _, again, extra = np.unique(words, axis=0, return_index=True, return_counts=True)
    return np.concatenate([at[first], odd[again]]), np.concatenate([counts, extra])


def _phrases(rows: DataFrame, least: int, bits, max_words: int) -> DataFrame:
    """lang, k, phrase, f, doc_id, word of all phrases that occur ``least`` times; k = 0 holds the words of a lang.

    Only occurrences whose fingerprint is in the filter are written out as text, once per block, with the
    place of their first occurrence; sums by text are exact, whatever the fingerprints did.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, max_words - 1):
            words = block.known.words
            for k in range(max_words + 1):
                if k:
                    at = _open_starts(block, k, k - 1, bits.value)
                    at, n = _groups(block, k, at[_held(bits.value, block.fingerprints(k, at))])
                    parts = [[words[i] for i in block.ids[at + j].tolist()] for j in range(k)]
                    phrases = [b" ".join(p) for p in zip(*parts, strict=True)]
                else:
                    every = np.flatnonzero(block.starts(1))
                    _, first, n = np.unique(block.lang[every], return_index=True, return_counts=True)
                    at = every[first]
                    phrases = [b""] * len(at)
                owner = block.owner[at].tolist()
                tails = [b"\t" + block.docs[o][1].encode() for o in owner]
                columns = [
                    pa.array([p + t for p, t in zip(phrases, tails, strict=True)], pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64)),
                    pa.array([block.docs[o][0] for o in owner], pa.int64()), pa.array(block.number[at]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "f", "doc_id", "word"])

    # one string names phrase and lang: no word holds a tab
    found = rows.mapInArrow(verify, "key string, f long, doc_id long, word long")
    # id and word number in one decimal: a buffer that hash aggregation can keep, where a struct would be sorted
    place = F.expr(f"cast(doc_id as decimal(20,0)) * {_PLACE} + word")
    summed = found.groupBy("key").agg(F.sum("f").alias("f"), F.min(place).alias("place"))
    phrase, lang = F.substring_index("key", "\t", 1), F.expr("substring(key, instr(key, '\\t') + 1)")
    words = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
    summed = summed.select(lang.alias("lang"), words.alias("k"), phrase.alias("phrase"), "f", "place")
    doc_id = F.floor(F.col("place") / _PLACE).cast("long")
    word = (F.col("place") - doc_id.cast("decimal(20,0)") * _PLACE).cast("long")
    return summed.filter((F.col("f") >= least) | (F.col("k") == 0)).select("lang", "k", "phrase", "f", doc_id.alias("doc_id"), word.alias("word"))


def frequent_phrases(
    docs: DataFrame, least: int = 30, max_words: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Staged:
    """Every phrase of 1 to ``max_words`` words that occurs ``least`` times or more in its lang, with its exact count.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and at blanks into words; phrases
    stay inside a piece. A phrase can only be frequent when its parts are, so each length is counted after the one before:
    a shuffle adds up fingerprints, frequent ones go into a filter of fixed size, the next length hashes only
    what the filter lets through. A last scan compares all occurrences with the text they point to. Null langs
    count as ``und``, null and empty texts hold no word, repeated rows count each time.
    """
    rows = _rows(docs, id_col, text_col, lang_col)
    context = docs.sparkSession.sparkContext
    bits, held = np.zeros(1 << (FILTER_BITS - 6), np.uint64), None
    for k in range(1, max_words + 1):
        bits |= _filter_bits(_frequent(rows, k, least, held, max_words))
        if held:
            held.unpersist()
        held = context.broadcast(bits)
    return Staged(_phrases(rows, least, held, max_words), "phrases")


def collocations(
    docs: DataFrame, least: int = 30, max_words: int = 4, cover_percent: int = 80, top: int = 2000,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each lang, by how firmly their parts hold together.

    A cut after the first words gives l and r, the counts of both parts, and floor(2000000 * a / (l + r)); the
    lowest cut counts, ties to the earliest. A phrase inside a longer frequent one with ``cover_percent`` of its
    count is dropped. Ties: higher count, then the phrase in byte order. Arithmetic is decimal, so exact.

    Rows: lang, rank, phrase, a, l, r, n (words of the lang), score, doc_id and word (the phrase's first place by
    id). No frequent phrase, or an empty table: no row. Other columns of ``docs`` are not read.
    """
    found = frequent_phrases(docs, least, max_words, id_col, text_col, lang_col).df
    totals = found.filter("k = 0").select("lang", F.col("f").alias("n"))
    known = found.filter("k > 0")
    many = known.filter("k > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    piece = lambda low, n: F.array_join(F.slice("words", low, n), " ")
    cuts = many.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", piece(F.lit(1), F.col("cut")).alias("first"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score.cast("long"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    longer = many.filter("k > 2").withColumn("n", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("low", F.explode(F.expr("sequence(1, k - n + 1)")))
    cover = longer.groupBy("lang", piece(F.col("low"), F.col("n")).alias("phrase")).agg(F.max("a").alias("longest"))
    covered = F.expr(f"cast(longest as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {cover_percent}")
    kept = many.join(cover, ["lang", "phrase"], "left").filter(F.coalesce(~covered, F.lit(True)))
    rated = kept.select("lang", "phrase", "a", "doc_id", "word").join(weakest, ["lang", "phrase"])
    order = Window.partitionBy("lang").orderBy(F.desc("at.score"), F.desc("a"), "phrase")
    best = rated.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    # one row per lang: small, but as many as the data have
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "at.l", "at.r", "n", "at.score", "doc_id", "word")
