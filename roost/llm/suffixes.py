"""Suffix-array dedup: sparse suffix arrays over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roost.llm.common import Staged, lowered_words, stage

#: Words of a key, and keys among which one position is selected: any 16 + 35 - 1 = 50 words in a row hold a selected key.
KEY_WORDS = 16
RIGHT = 64

_NOBODY = np.iinfo(np.int64).max
_MATCH = "doc_id long, start int, other long, windows array<long>"


def word_codes(text: bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in lowered_words(text)], np.uint64)


def _keys(codes: np.ndarray, size: int) -> np.ndarray:
    key = np.zeros((max(0, len(codes) - size + 1), *codes.shape[1:]), np.uint64)
    for k in range(size):
        key = (key ^ codes[k : len(key) + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def minimisers(keys: np.ndarray, window: int) -> np.ndarray:
    """Position of the smallest key of every ``window`` keys in a row; in a run of equal ones only as many as needed."""
    if len(keys) < window:
        return np.empty(0, np.int64)
    smallest = np.lib.stride_tricks.sliding_window_view(keys, window).argmin(axis=1) + np.arange(len(keys) - window + 1)
    spots = np.unique(smallest)
    same = np.concatenate([[False], keys[spots[1:]] == keys[spots[:-1]], [False]])
    if not same.any():
        return spots
    kept, last = [], None
    for i, spot in enumerate(spots.tolist()):
        # a spot between two of its own key may go while the two stay within one window
        if same[i] and same[i + 1] and last is not None and int(spots[i + 1]) - last <= window:
            continue
        kept.append(spot)
        last = spot
    return np.array(kept)


def _common(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(length_a, length_b))


def _grid(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) // 4 for x in column], np.int64)
    flat = b"".join(x.ljust(4 * width, b"\0") for x in column)
    return np.frombuffer(flat, ">u4").reshape(len(column), width), lengths


def _matches(rows: dict[str, list], left_words: int, least: int) -> list[tuple[int, int, int, np.ndarray]]:
    """Matches of each row with the nearest rows of other documents before and after it in suffix order.

    doc_id, first word, the smallest doc_id among row and match, and a digest of every ``least`` words in a row of the match.
    """
    n = len(rows["key"])
    key, doc, pos = (np.array(rows[c], np.int64) for c in ("key", "doc_id", "pos"))
    right, right_n = _grid(rows["right"], RIGHT)
    left, left_n = _grid(rows["left"], left_words)
    change = np.flatnonzero(np.diff(doc) != 0) + 1
    run = np.searchsorted(change, np.arange(n), side="right")
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [n]])
    before = starts[run] - 1
    after = np.where(ends[run] < n, ends[run], -1)
    # column c of these is the window that starts left_words - c words before the key
    columns = np.arange(left_words + RIGHT - least + 1)
    owner = np.full((n, len(columns)), _NOBODY)
    for other in (before, after):
        i = np.flatnonzero(other >= 0)
        i = i[key[i] == key[other[i]]]
        j = other[i]
        ahead = _common(right[i], right[j], right_n[i], right_n[j])
        back = _common(left[i], left[j], left_n[i], left_n[j])
        good = (ahead >= KEY_WORDS) & (ahead + back >= least)
        i, j, ahead, back = i[good], j[good], ahead[good, None], back[good, None]
        inside = (columns >= left_words - back) & (columns + least <= left_words + ahead)
        owner[i] = np.minimum(owner[i], np.where(inside, np.minimum(doc[i], doc[j])[:, None], _NOBODY))
    hit = np.flatnonzero((owner != _NOBODY).any(axis=1))
    words = np.concatenate([left[hit, ::-1], right[hit]], axis=1).astype(np.uint64)
    digests = _keys(words.T, least).T.view(np.int64)
    out = []
    for h, i in enumerate(hit.tolist()):
        cuts = [0, *(np.flatnonzero(np.diff(owner[i])) + 1).tolist(), len(columns)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if owner[i, x] != _NOBODY:
                out.append((int(doc[i]), int(pos[i]) - left_words + x, int(owner[i, x]), digests[h, x:y]))
    return out


def repeated_passages(docs: DataFrame, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of ``least_words`` words or more that stand in an earlier document too (smaller doc_id).

    Words are cut at ASCII white space, ASCII letters lowered. The suffixes kept are those whose first 16 words
    are a minimiser of their surroundings, so equal passages of ``least_words`` words select equal positions.
    Suffixes whose key occurs in one place only are dropped by a count, the others sorted by range
    partitions (ties by document, so a passage that a third of all documents share is cut across tasks) and compared
    with the nearest rows of other documents before and after, across partitions too; matches are extended right and left word by word. The owner
    is taken for every ``least_words`` words in a row of a match: the smallest document that is on either side of a match
    with the same words there. What the document does not own itself is a repeat; repeats that touch are merged.
    Repeats within one document are not reported. Null and short texts have no suffix, null ids no part; rows that repeat an
    id count as one document; an empty table gives an empty table.

    Rows: doc_id, start_word, n_words, first_doc_id.
    """
    if least_words <= KEY_WORDS:
        raise ValueError(f"least_words must exceed {KEY_WORDS}")
    window = least_words - KEY_WORDS + 1
    left_words = window - 1
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spots, keys = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                key = _keys(word_codes(text.as_py() or b""), KEY_WORDS)
                spot = minimisers(key, window)
                ids.append(np.full(len(spot), doc_id, np.int64))
                spots.append(spot)
                keys.append(key[spot] if len(spot) else np.empty(0, np.uint64))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(spots).astype(np.int32))],
                    names=["key", "doc_id", "pos"],
                )

    selected = Staged(source.mapInArrow(select, "key long, doc_id long, pos int"), "suffixes")
    suffixes = selected.df
    shared = suffixes.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc <> last_doc")
    wanted = suffixes.join(shared.select("key"), "key").distinct()
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "pos")).alias("spots"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, spots in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                words = (word_codes(text.as_py() or b"") >> np.uint64(32)).astype(">u4")
                backward = words[::-1]
                inside = [s for s in spots if s["pos"] + KEY_WORDS <= len(words)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["key"] for s in inside], pa.int64()),
                        pa.array([words[s["pos"] : s["pos"] + RIGHT].tobytes() for s in inside], pa.binary()),
                        pa.array([backward[len(words) - s["pos"] :][:left_words].tobytes() for s in inside], pa.binary()),
                        pa.array([doc_id] * len(inside), pa.int64()),
                        pa.array([s["pos"] for s in inside], pa.int32()),
                    ],
                    names=["key", "right", "left", "doc_id", "pos"],
                )

    order = ["key", "right", "doc_id", "pos"]
    rich = Staged(source.join(per_doc, "doc_id").mapInArrow(contexts, "key long, right binary, left binary, doc_id long, pos int"), "suffix-contexts")
    selected.drop()
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    array = rich.df.repartitionByRange(slots, *order).sortWithinPartitions(*order)

    columns = ["key", "right", "left", "doc_id", "pos"]

    def give(matches: list, edges: list[dict]) -> pa.RecordBatch:
        out = [(*m, None, None, None, None) for m in matches] + [(e["doc_id"], None, None, None, *(e[c] for c in ("key", "right", "left", "pos"))) for e in edges]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
        names = ["doc_id", "start", "other", "windows", "key", "right", "left", "pos"]
        given = list(zip(*out, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(given, types, strict=True)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Matches inside a partition, and at both ends of it the rows whose nearest row of another document may lie outside.

        Only rows of one key are compared, so these are the first and last rows that share key and document, and one row more.
        """
        held, lead, leading = None, None, True
        for batch in batches:
            if not len(batch):
                continue
            fresh = pa.Table.from_batches([batch]).select(columns)
            edges = []
            if leading:
                mine = list(zip(fresh["key"].to_pylist(), fresh["doc_id"].to_pylist(), strict=True))
                lead = lead or mine[0]
                n_edge = next((i + 1 for i, m in enumerate(mine) if m != lead), None)
                leading = n_edge is None
                edges = fresh.slice(0, n_edge).to_pylist()
            # what the last batch left open goes on in front
            table = pa.concat_tables([held, fresh]) if held is not None else fresh
            yield give(_matches(table.to_pydict(), left_words, least_words), edges)
            keys, docs_here = table["key"].to_pylist(), table["doc_id"].to_pylist()
            back = len(keys) - 1
            while back > 0 and docs_here[back] == docs_here[-1] and keys[back] == keys[-1]:
                back -= 1
            held = table.slice(back)
        if held is not None:
            yield give([], held.to_pylist())

    match = f"{_MATCH}, key long, right binary, left binary, pos int"
    compared = stage(array.mapInArrow(compare, match), "suffix-matches")
    rich.drop()
    # the open rows of one key side by side: a run of one document may reach over many partitions
    edges = compared.filter("key is not null").select(*columns).distinct().repartition("key").sortWithinPartitions(*order)
    seams = edges.mapInArrow(compare, match)
    matches = compared.unionByName(seams).filter("key is null").select("doc_id", "start", "other", "windows")
    each = matches.select("doc_id", "start", "other", F.posexplode("windows").alias("k", "window"))
    each = each.select("doc_id", (F.col("start") + F.col("k")).alias("start"), "window", "other")
    owners = each.groupBy("window").agg(F.min("other").alias("first_doc"))
    later = each.drop("other").join(owners, "window").filter("first_doc < doc_id")
    spans = later.select("doc_id", "start", (F.col("start") + least_words).alias("end"), "first_doc").distinct()

    so_far = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(F.col("start") <= so_far, 0).otherwise(1))
    number = F.sum("fresh").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    merged = fresh.withColumn("passage", number).groupBy("doc_id", "passage")
    out = merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc").alias("first_doc_id"))
    return out.select("doc_id", F.col("start").alias("start_word"), (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id")
