"""Best-fit packing of tokenised documents into fixed-length sequences, by hierarchical residual rounds."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roost.llm.common import stage

SEPARATOR = 0
END_OF_TEXT = {"byte_bpe_50k": {"<|endoftext|>": 50256}}
#: Items of one best-fit run, on average. A group of items is one task's work.
GROUP_ITEMS = 50_000
#: Rounds go on while one saves at least this share of the open bins.
LEAST_GAIN = 0.001

_FIELDS = [
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("offset", pa.int64()),
]
_MEMBER = pa.struct(_FIELDS)
_BINS = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(_MEMBER))])
_BINS_DDL = (
    "sequence_id long, fill int, "
    "members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
)
_LENGTH = 3


@lru_cache(maxsize=2)
def encoder(vocabulary: str = "byte_bpe_50k") -> tiktoken.Encoding:
    """The byte-level BPE of ``vocabulary``, one per Python worker.

    ``byte_bpe_50k.json`` and this rank file hold one vocabulary; the ids are those that
    ``tokenizers`` gives for the JSON file (its added token included), found about five times faster. A test
    compares the two.
    """
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = END_OF_TEXT.get(vocabulary, {})
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, vocabulary: str = "byte_bpe_50k") -> np.ndarray:
    """Unsigned 32-bit ids of a whole text; null counts as empty."""
    return encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all")


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: one, or full ones after a first that takes the remainder."""
    first = n_ids % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n_ids, capacity))]


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item: largest first, each into the fullest open bin that still takes it.

    Open bins are kept by the room they have left, and a bit mask of the rooms in use gives the tightest
    fit, so an item costs the same however many bins are open.
    """
    where = np.empty(len(sizes), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, bins = 0, 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            number = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, number = capacity, bins
            bins += 1
        where[item] = number
        left = room - size
        if left:
            by_room.setdefault(left, []).append(number)
            rooms |= 1 << left
    return where


class _Packer:
    """Best-fit runs of one task; sequence ids name the round, the task and the bin."""

    def __init__(self, capacity: int, level: int):
        self.capacity = capacity
        self.next_id = level << 56 | TaskContext.get().partitionId() << 32
        self.items: list[tuple[int, list]] = []

    def full(self) -> bool:
        return len(self.items) >= 2 * GROUP_ITEMS

    def bins(self) -> Iterator[pa.RecordBatch]:
        """Pack the items held so far and forget them."""
        if not self.items:
            return
        where = best_fit(np.array([size for size, _ in self.items]), self.capacity)
        bins: list[list] = [[] for _ in range(int(where.max()) + 1)]
        fills = [0] * len(bins)
        for number, (_, members) in zip(where.tolist(), self.items, strict=True):
            for member in members:
                bins[number].append((*member[:5], fills[number]))
                fills[number] += member[_LENGTH]
        self.items = []
        for low in range(0, len(bins), 5000):
            part = bins[low : low + 5000]
            ids = range(self.next_id, self.next_id + len(part))
            self.next_id += len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(fills[low : low + 5000], pa.int32()), pa.array(part, _BINS.field(2).type)],
                schema=_BINS,
            )


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    vocabulary: str = "byte_bpe_50k",
    nearly_full: float = 0.995,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences of at most ``capacity`` ids.

    A document is the ids of its whole text and a closing 0, so an empty or null text is the single id 0;
    only longer ones than a sequence are cut. Every partition packs its own pieces best-fit and emits bins
    filled to ``nearly_full``; the others become items of a next round, in groups of about 50,000 dealt by
    a hash, and so on up the tree until one group is left or a round saves under a thousandth of the open
    bins. Each round is a written table. Repeated rows and null ids are packed as they come; an empty table
    gives an empty table. Only id and text are read.

    Rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    enough = int(np.ceil(nearly_full * capacity))

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, 0)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py(), vocabulary), np.uint32(SEPARATOR)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    packer.items.append((length, [(doc_id, piece, start, length, crc)]))
                if packer.full():
                    yield from packer.bins()
        yield from packer.bins()

    def next_round(level: int):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = _Packer(capacity, level)
            for batch in batches:
                for fill, members in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    packer.items.append((fill, [tuple(m.values()) for m in members]))
                    if packer.full():
                        yield from packer.bins()
            yield from packer.bins()

        return merge

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = stage(source.mapInArrow(first_round, _BINS_DDL), "bins")
    finished, level, groups = [], 0, 0
    n_open = packed.filter(F.col("fill") < enough).count()
    while n_open > 1 and groups != 1:
        level, before = level + 1, n_open
        groups = -(-n_open // GROUP_ITEMS)
        finished.append(packed.filter(F.col("fill") >= enough))
        dealt = packed.filter(F.col("fill") < enough).repartition(groups, F.xxhash64("sequence_id"))
        packed = stage(dealt.mapInArrow(next_round(level), _BINS_DDL), "bins")
        n_open, n_bins = packed.agg(F.count_if(F.col("fill") < enough), F.count("*")).first()
        if before - n_bins < LEAST_GAIN * before:
            break
    for done in finished:
        packed = packed.unionByName(done)
    pieces = packed.select("sequence_id", F.explode("members").alias("m"))
    return pieces.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
