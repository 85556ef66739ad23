"""Staged tables, connected components and the exact comparison of sets that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roost.sources.staging import checkpoint_dir


class Staged:
    """A table written under ``spark.checkpoint.dir``: cuts lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark).rstrip('/')}/roost-llm/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete a table that later steps no longer read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered_words(text: bytes) -> list[bytes]:
    """ASCII letters lowered, cut at ASCII white space (``[\\x20\\x09-\\x0D]+``)."""
    return text.lower().split()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words, space-joined; all words as one run when there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(line[a:b], seed) for a, b in spans], np.uint64)


# -- connected components -----------------------------------------------------------------


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes joined by the links ``a[i]``-``b[i]``."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent is a child."""
    children = edges.groupBy("u").agg(F.count("*").alias("parents"))
    parents = edges.select(F.col("v").alias("u")).distinct()
    bad = children.filter("parents > 1").select("u").unionByName(parents.join(children, "u", "left_semi"))
    return bad.isEmpty()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node``, ``component``: the smallest node reachable, for every node that has a link.

    Alternating large-star and small-star rounds: every node is handed to the smallest node in sight,
    so a hub only takes part as a minimum (partial aggregates) and as a join key that adaptive
    execution may split. Rounds grow with the logarithm of the longest path; each is written to the
    shared folder and the one before it deleted. Nothing is collected. Self links and nulls are
    ignored; an empty table gives an empty table.
    """
    a, b = F.col(left), F.col(right)
    start = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = Staged(start, "links")
    while not _is_stars(edges.df):
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = Staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        edges.drop()
        edges = following
    roots = edges.df.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


# -- exact set similarity inside collision clusters ------------------------------------------

TILE = 128
COLUMNS = 8192


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set, in slices of the vocabulary."""
    vocabulary, ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(vocabulary), COLUMNS):
        here = (ids >= low) & (ids < low + COLUMNS)
        grid = np.zeros((len(left) + len(right), min(COLUMNS, len(vocabulary) - low)), np.float32)
        grid[owner[here], ids[here] - low] = 1
        total += grid[: len(left)] @ grid[len(left) :].T
    return total


def _verified(keys: list[int], tiles: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between members (each to its local smallest) of Jaccard ``threshold`` or more, across the two tiles."""
    first = min(tiles)
    left = [i for i, t in enumerate(tiles) if t == first]
    right = [i for i, t in enumerate(tiles) if t != first] or left
    sizes = np.array([len(x) for x in sets], np.float64)
    shared = _overlaps([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
    whole = sizes[left][:, None] + sizes[right][None, :] - shared
    hit_a, hit_b = np.nonzero(shared >= threshold * whole - 1e-9)
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    roots = local_roots(place[np.array(left)[hit_a]], place[np.array(right)[hit_b]], len(keys))
    return [(keys[order[i]], keys[order[r]]) for i, r in enumerate(roots.tolist()) if i != r]


def verified_components(members: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``component`` of exact links between members of the same cluster.

    ``members``: cluster, node (long, unique), hashes (binary: sorted distinct unsigned 64-bit shingle hashes).
    Two members link when the Jaccard similarity of their sets reaches ``threshold``. A cluster is dealt
    into tiles of about 128 members and tile pairs are compared, each as a task's own small matrix; only
    a link from each member to the smallest of its tile pair's component is emitted, never all pairs.
    """
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n_tiles"))
    tiled = members.join(sizes, "cluster").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles")).cast("int"))
    paired = (
        tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
        .select("cluster", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "hashes")
    )
    parts = paired.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, keys, tiles, sets = None, [], [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1:
                found = _verified(keys, tiles, sets, threshold)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            for cluster, i, j, tile, node, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (cluster, i, j):
                    yield from links()
                    key, keys, tiles, sets = (cluster, i, j), [], [], []
                keys.append(node)
                tiles.append(tile)
                sets.append(np.frombuffer(hashes, np.uint64))
        yield from links()

    return components(parts.mapInArrow(verify, "a long, b long"))
