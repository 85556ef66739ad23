"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost.llm.common import Staged, components, local_roots, lowered_words, shingle_hashes, stage, text_bytes, verified_components

TILE = 4096
STRIP = 256
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is one when it is set in over half of the hashes; no hash gives zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[low : low + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(_POWERS[2 * ones > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """``doc_id``, ``fp`` (64 bits as a signed long), ``fp2`` of every whole text; null text counts as empty.

    ``fp2`` holds 64 more bits from the same shingles, hashed once more, when ``wide``; else it is zero. Wide
    fingerprints count a shingle once, however often it stands in the text; the others count every repeat.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.zeros((len(batch), 2), np.uint64)
            for row, text in enumerate(text_bytes(batch.column(1))):
                hashes = shingle_hashes(lowered_words(text), shingle_words)
                if wide:
                    hashes = np.unique(hashes)
                pairs[row, 0] = fingerprint(hashes)
                if wide:
                    again = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    pairs[row, 1] = fingerprint(again ^ (again >> np.uint64(29)))
            columns = [pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", "fp", "fp2"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, "doc_id long, fp long, fp2 long")


def _segment_counts(fp: Column, segments: int) -> Column:
    """Population counts of the equal segments of a fingerprint, as one number of base 65."""
    width = 64 // segments
    mask = -1 if segments == 1 else (1 << width) - 1
    key = F.lit(0)
    for k in range(segments):
        part = F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit(mask).cast("long"))
        key = key * 65 + F.bit_count(part)
    return key


def _steps(segments: int, radius: int) -> list[int]:
    """Differences between the keys of two tiles that may hold fingerprints within ``radius`` bits.

    A flipped bit moves one segment's count by one, so the counts of two linked fingerprints differ
    by ``radius`` at most in sum. Zero first; of each opposite pair the positive one.
    """
    steps = set()
    for move in product(range(-radius, radius + 1), repeat=segments):
        if sum(map(abs, move)) <= radius:
            steps.add(sum(m * 65 ** (segments - 1 - k) for k, m in enumerate(move)))
    return sorted(s for s in steps if s >= 0)


def close_pairs_as_stars(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of two tiles (of one with itself when ``right`` is None), each row to its component's first row.

    A tile has a row of 64-bit words per fingerprint; rows are numbered through both tiles.
    """
    other = left if right is None else right
    total, shift = (len(left), 0) if right is None else (len(left) + len(right), len(left))
    a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low in range(0, len(left), STRIP):
        apart = sum(np.bitwise_count(left[low : low + STRIP, None, word] ^ other[None, :, word]) for word in range(left.shape[1]))
        a, b = np.nonzero(apart <= radius)
        a, b = a + low, b + shift
        real = a != b
        if real.any():
            roots = local_roots(a[real], b[real], total)
            moved = np.flatnonzero(roots != np.arange(total))
            a_all.append(moved)
            b_all.append(roots[moved])
    roots = local_roots(np.concatenate(a_all), np.concatenate(b_all), total)
    moved = np.flatnonzero(roots != np.arange(total))
    return moved, roots[moved]


def link_fingerprints(distinct: DataFrame, radius: int) -> DataFrame:
    """Links ``a``, ``b`` between the ``node`` of distinct fingerprints (``fp``, ``fp2``) ``radius`` bits apart or less.

    Fingerprints are dealt into tiles of about 4,096 by population count (for a small radius by the
    counts of four 16-bit segments), so a crowded count makes more tiles, not a larger one. Tile pairs
    whose counts differ by more than the radius are never formed; in the others every pair is compared
    by exclusive-or and bit count. Links inside a tile pair come as stars: no pair is lost for
    components, and a dense group of m fingerprints gives m rows for each tile pair it touches.
    """
    segments = 4 if radius <= 3 else 1
    key = _segment_counts(F.col("fp"), segments) + (F.bit_count("fp2") if segments == 1 else 0)
    keyed = distinct.select("node", F.array("fp", "fp2").alias("fps"), key.cast("int").alias("key"))
    crowd = keyed.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n"))
    tiles = stage(
        keyed.join(crowd, "key")
        .groupBy("key", "n", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("tile"))
        .agg(F.collect_list(F.struct("node", "fps")).alias("fps")),
        "tiles",
    )
    steps = F.array(*[F.lit(s) for s in _steps(segments, radius)])
    # keys that exist: at most 129 for one segment, 17 to the 4th power for four
    reach = tiles.select("key", "tile", F.explode(steps).alias("step")).withColumn("other", F.col("key") + F.col("step"))
    near = tiles.select(F.col("key").alias("other"), F.col("tile").alias("other_tile"))
    pairs = reach.join(near, "other").filter("step > 0 or tile <= other_tile").select("key", "tile", "other", "other_tile")
    left = tiles.select("key", "tile", F.col("fps").alias("left"))
    right = tiles.select(F.col("key").alias("other"), F.col("tile").alias("other_tile"), F.col("fps").alias("right"))
    work = pairs.join(left, ["key", "tile"]).join(right, ["other", "other_tile"])
    work = work.select((F.col("key") == F.col("other")).alias("same_key"), "tile", "other_tile", "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [k and s == t for k, s, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            for row, one_tile in enumerate(same):
                sides = [batch.column(c)[row].values for c in ((3,) if one_tile else (3, 4))]
                words = [np.asarray(side.field("fps").flatten(), np.int64).view(np.uint64).reshape(-1, 2) for side in sides]
                used = 2 if any(w[:, 1].any() for w in words) else 1
                u, v = close_pairs_as_stars(words[0][:, :used], None if one_tile else words[1][:, :used], radius)
                if len(u):
                    nodes = np.concatenate([side.field("node").to_numpy() for side in sides])
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["a", "b"])

    slots = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(slots).mapInArrow(compare, "a long, b long")


def simhash_groups(
    docs: DataFrame, radius: int = 2, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``: the smallest id reachable over fingerprints ``radius`` bits apart or less.

    One row per input row. Null and empty texts have fingerprint zero, which links like any other; texts
    with fewer words than a shingle hash as a whole; equal fingerprints are one node, so a group of copies
    costs one comparison; a repeated id keeps all its rows in one group each. A null id stays null and its
    text still links. An empty table gives an empty table; other columns are not read.
    """
    prints = stage(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(link_fingerprints(nodes.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("fp2")), radius))
    reached = nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = reached.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(reached.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicate_documents(
    docs: DataFrame,
    shingle_words: int = 5,
    similarity: float = 0.8,
    radius: int = 28,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``component_id`` of near-duplicate documents: SimHash proposes, exact Jaccard decides.

    Fingerprints of 128 bits over the distinct ``shingle_words``-word shingles propose groups within ``radius`` bits; inside a group two
    documents link when the Jaccard similarity of their shingle sets reaches ``similarity``. At 0.8 the expected
    distance is 19 bits with a standard deviation of 4, so 28 bits find about 49 of 50 pairs at exactly 0.8 and
    nearly all closer ones, while one in ten billion unrelated pairs is proposed: with 64 bits it would be one in
    250,000, and their chains would join everything. Texts without a word form one group. Rows: one per id that
    was proposed (component_id: the smallest id reachable, itself included); ids that are not listed are alone. Null ids take no part; rows
    that repeat an id count as one document.
    """
    docs = docs.filter(F.col(id_col).isNotNull())
    prints = stage(fingerprints(docs, shingle_words, id_col, text_col, wide=True), "fingerprints")
    nodes = stage(prints.groupBy("fp", "fp2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "distinct-fingerprints")
    proposed = components(link_fingerprints(nodes, radius)).withColumnRenamed("component", "cluster")
    clusters = stage(
        nodes.join(proposed, "node", "left").filter("cluster is not null or copies > 1")
        .select("fp", "fp2", F.coalesce("cluster", "node").alias("cluster")),
        "simhash-clusters",
    )
    wanted = prints.join(clusters, ["fp", "fp2"]).select(F.col("doc_id").alias("wanted_id"), "cluster").distinct()
    texts = docs.select(F.col(id_col).alias("wanted_id"), F.col(text_col).alias("text")).join(wanted, "wanted_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(lowered_words(t), shingle_words)) for t in text_bytes(batch.column(1))]
            digest = [int(np.bitwise_xor.reduce(h * np.uint64(0x9E3779B97F4A7C15))) if len(h) else 0 for h in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array([h.tobytes() for h in found])],
                names=["doc_id", "cluster", "set_id", "hashes"],
            )

    held = Staged(
        texts.select("wanted_id", "text", "cluster").mapInArrow(sets, "doc_id long, cluster long, set_id long, hashes binary"), "simhash-sets"
    ).df
    # equal shingle sets are one node: copies never meet pair by pair
    owners = stage(held.groupBy("cluster", "set_id").agg(F.min("doc_id").alias("node")), "simhash-owners")
    members = held.join(owners.withColumnRenamed("node", "doc_id"), ["cluster", "set_id", "doc_id"])
    members = members.groupBy("cluster", F.col("doc_id").alias("node")).agg(F.any_value("hashes").alias("hashes"))
    roots = verified_components(members, similarity)
    labels = owners.join(roots, "node", "left").select("cluster", "set_id", F.coalesce("component", "node").alias("component_id"))
    every = held.select("doc_id", "cluster", "set_id").join(labels, ["cluster", "set_id"]).select("doc_id", "component_id")
    return every.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
