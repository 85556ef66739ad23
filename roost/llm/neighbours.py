"""Embedding near-duplicates by NN-descent over cells of near copies, with exact double-precision links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roost.llm.common import Staged, components, local_roots, stage

BLOCK = 512
PLANES = 24
#: Cosine within which a vector joins a leader's cell.
CELL = 0.95
NEIGHBOURS = 8
HUB = 64
AUDIT = 256


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, scaled to length one in double precision."""
    values = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return values / np.sqrt((values**2).sum(axis=1, keepdims=True))


def _angle(cosine: np.ndarray | float) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal first ``keys`` columns, of a partition sorted by them."""
    key, parts = None, []
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [len(batch)]]) if len(batch) else np.array([0])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            here = tuple(c[a].item() for c in columns)
            if here != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = here
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _blocks(nodes: DataFrame, turn: int) -> DataFrame:
    """``nodes`` (node, vec, ...) with a ``block`` of about 512 vectors on the same side of random planes.

    The number of planes follows the number of vectors; a side that is still crowded (copies) is dealt by a hash.
    """
    bits = max(0, math.ceil(math.log2(max(1, nodes.count()) / (BLOCK / 2))))
    draws = np.random.default_rng(1000 + turn).normal(size=(bits, 4096))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(len(batch), np.int64)
            lengths = np.diff(np.asarray(batch.column(1).offsets))
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                planes = draws[:, np.arange(dim) % 4096] * (1 + np.arange(dim) // 4096)
                signs = _matrix(batch.column(1).take(pa.array(rows))) @ planes.T > 0
                code[rows] = signs @ (1 << np.arange(bits, dtype=np.int64)) + (dim << 32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code)], names=["node", "side"])

    coded = nodes.select("node", "vec").mapInArrow(sides, "node long, side long")
    placed = nodes.join(coded, "node")
    crowd = coded.groupBy("side").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    return placed.join(crowd, "side").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int"))


def _by_block(blocks: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return blocks.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)


def _cells(nodes: DataFrame, turn: int) -> DataFrame:
    """node, leader: each block's vectors handed to leaders within cosine ``CELL``, smallest node first."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _groups(batches, 2):
            ids = _column(table, "node").to_numpy()
            order = np.argsort(ids)
            unit = _matrix(_column(table, "vec"))[order]
            near = unit @ unit.T >= CELL
            leader = np.full(len(ids), -1)
            for i in range(len(ids)):
                if leader[i] < 0:
                    leader[near[i] & (leader < 0)] = i
                    leader[i] = i
            yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(ids[order][leader])], names=["node", "leader"])

    return _by_block(_blocks(nodes, turn), ["side", "part"], "node", "vec").mapInArrow(lead, "node long, leader long")


def _best(unit: np.ndarray, radius: np.ndarray, bar: np.ndarray, k: int, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours that each row of a small matrix gains: below its bar the ``k`` nearest, and all that a link may join."""
    angle = _angle(unit @ unit.T)
    np.fill_diagonal(angle, np.inf)
    wanted = angle <= theta + radius[:, None] + radius[None, :] + 1e-9
    kth = np.partition(angle, min(k, len(unit)) - 1, axis=1)[:, min(k, len(unit)) - 1] if len(unit) > 1 else np.full(len(unit), np.inf)
    wanted |= (angle <= kth[:, None]) & (angle < bar[:, None]) & np.isfinite(angle)
    a, b = np.nonzero(wanted)
    return a, b, angle[a, b]


def _emit(ids: np.ndarray, a: np.ndarray, b: np.ndarray, angle: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(angle)], names=["u", "v", "angle"])


_EDGES = "u long, v long, angle double"


def _first_graph(leaders: DataFrame, turn: int, theta: float) -> DataFrame:
    """Neighbours inside blocks: the start of the descent."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _groups(batches, 2):
            ids, radius = (_column(table, c).to_numpy() for c in ("node", "radius"))
            yield _emit(ids, *_best(_matrix(_column(table, "vec")), radius, np.full(len(ids), np.inf), NEIGHBOURS, theta))

    return _by_block(_blocks(leaders, turn), ["side", "part"], "node", "vec", "radius").mapInArrow(start, _EDGES)


def _lists(edges: DataFrame, radii: DataFrame, theta: float) -> DataFrame:
    """The ``NEIGHBOURS`` nearest of each node; a list that is still within linking reach is longer, without a cap."""
    ranked = edges.groupBy("u", "v").agg(F.min("angle").alias("angle"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("angle", "v")))
    both = ranked.join(radii.select(F.col("node").alias("u"), F.col("radius").alias("ru")), "u")
    both = both.join(radii.select(F.col("node").alias("v"), F.col("radius").alias("rv")), "v")
    linking = F.col("angle") <= theta + F.col("ru") + F.col("rv") + 1e-9
    return both.withColumn("linking", linking).filter((F.col("rank") <= NEIGHBOURS) | F.col("linking")).select("u", "v", "angle", "linking", "rank")


def _descend(graph: DataFrame, leaders: DataFrame, turn: int, theta: float) -> DataFrame:
    """Neighbours of neighbours: nodes that share a neighbour meet there; hubs are dealt into parts, anew each round."""
    bars = graph.filter(F.col("rank") == NEIGHBOURS).select(F.col("u").alias("node"), F.col("angle").alias("bar"))
    near = graph.select(F.col("u").alias("at"), F.col("v").alias("node"))
    met = near.unionByName(near.select(F.col("node").alias("at"), F.col("at").alias("node"))).distinct()
    crowd = met.groupBy("at").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    dealt = met.join(crowd, "at").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int"))
    full = dealt.join(leaders.select("node", "vec", "radius"), "node").join(bars, "node", "left")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _groups(batches, 2):
            if len(table) > 1:
                lengths = np.diff(np.asarray(_column(table, "vec").offsets))
                if len(set(lengths.tolist())) > 1:
                    continue
                ids, radius = (_column(table, c).to_numpy() for c in ("node", "radius"))
                bar = np.nan_to_num(_column(table, "bar").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
                yield _emit(ids, *_best(_matrix(_column(table, "vec")), radius, bar, NEIGHBOURS, theta))

    return _by_block(full, ["at", "part"], "node", "vec", "radius", "bar").mapInArrow(join, _EDGES)


def _linked(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """node, links (weights of linked others), root: exact cosines of all members of the cell pairs (a <= b).

    A cell's members come in chunks of about 512; a pair of chunks is one small matrix product, and gives
    one row per member that has a link.
    """
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
    crowd = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    chunks = stage(
        members.join(involved, "cell", "left_semi").join(crowd, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
        .agg(F.collect_list(F.struct("node", "weight", "vec")).alias("rows")),
        "chunks",
    )
    left = chunks.select(F.col("cell").alias("a"), F.col("chunk").alias("i"), F.col("rows").alias("left"))
    right = chunks.select(F.col("cell").alias("b"), F.col("chunk").alias("j"), F.col("rows").alias("right"))
    work = pairs.select("a", "b").join(left, "a").join(right, "b").filter("a < b or i <= j")
    work = work.select(((F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))).alias("same"), "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                sides = [batch.column(c)[k].values for c in (1, 2)]
                unit = [_matrix(s.field("vec")) for s in sides]
                ids = [s.field("node").to_numpy() for s in sides]
                weight = [s.field("weight").to_numpy() for s in sides]
                if unit[0].shape[1] != unit[1].shape[1]:
                    continue
                near = unit[0] @ unit[1].T >= threshold
                same = batch.column(0)[k].as_py()
                if same:
                    np.fill_diagonal(near, False)
                    nodes, links = ids[0], near @ weight[1]
                    a, b = np.nonzero(near)
                else:
                    nodes, links = np.concatenate(ids), np.concatenate([near @ weight[1], near.T @ weight[0]])
                    a, b = np.nonzero(near)
                    b = b + len(ids[0])
                roots = nodes[local_roots(a, b, len(nodes))]
                hit = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links[hit]), pa.array(roots[hit])], names=["node", "links", "root"])

    return work.repartition(F.xxhash64("left.node", "right.node")).mapInArrow(compare, "node long, links long, root long")


def _audit(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """Share of the links of ``AUDIT`` vectors (picked by a hash), found against all by brute force, that ``links`` has."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(77))).limit(AUDIT).select("node", "vec").collect()
    if not sample:
        return 1.0
    ids = np.array([r["node"] for r in sample])
    rows = [np.asarray(r["vec"], np.float64) for r in sample]
    held = nodes.sparkSession.sparkContext.broadcast([r / np.sqrt((r**2).sum()) for r in rows])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column(2).offsets))
            node, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == dim)
                mine = [i for i, r in enumerate(held.value) if len(r) == dim]
                if mine:
                    near = np.stack([held.value[i] for i in mine]) @ _matrix(batch.column(2).take(pa.array(here))).T >= threshold
                    near &= ids[mine][:, None] != node[here][None, :]
                    total[mine] += near @ weight[here]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "true_links"])

    truth = nodes.select("node", "weight", "vec").mapInArrow(brute, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("t"))
    found, true = truth.join(links, "node", "left").agg(F.sum(F.least("t", F.coalesce("links", F.lit(0)))), F.sum("t")).first()
    return (found or 0) / true if true else 1.0


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def embedding_near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    least_recall: float = 0.99,
    most_turns: int = 6,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Links of cosine ``threshold`` or more, counted per vector, and their components; one row per input row.

    Equal vectors are one weighted node. Nodes within cosine 0.95 of a leader in their block form cells, twice over, so
    a group of copies of any size shrinks to a few leaders. Leaders start with neighbours from blocks of random planes and
    descend: nodes sharing a neighbour are compared and better neighbours kept; a list whose members are all
    within linking reach (the angle of the threshold and both cells' radii) has no cap. Turns go on until one finds
    no new pair of cells within reach and a brute-force audit of 256 vectors finds ``least_recall`` of
    their links. Then all members of cells within reach are compared exactly.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do vectors of different
    lengths. Repeated ids and null ids are rows like any other (a null id is nobody's component_id unless
    the group has no other). An empty table gives an empty table.

    Rows: vec_id, n_links, component_id, kept.
    """
    theta = float(_angle(threshold))
    vec = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), _usable(vec).alias("ok"))
    # two independent digests name a vector
    digest = [F.xxhash64("vec").alias("node"), F.xxhash64(F.lit(1), "vec").alias("check")]
    keyed = stage(rows.filter("ok").select("vec_id", "vec", *digest), "vectors")
    nodes = stage(
        keyed.groupBy("node", "check").agg(F.count("*").alias("weight"), F.any_value("vec").alias("vec"), F.min("vec_id").alias("first_id")), "nodes"
    )
    first = stage(_cells(nodes, 0), "cells")
    heads = nodes.join(first.select(F.col("leader").alias("node")).distinct(), "node", "left_semi")
    second = _cells(heads, 1).select(F.col("node").alias("leader"), F.col("leader").alias("cell"))
    placed = stage(nodes.join(first.join(second, "leader").select("node", "cell"), "node"), "placed")
    centre = placed.filter("node = cell").select("cell", F.col("vec").alias("centre"))

    dot = F.aggregate(F.zip_with("vec", "centre", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = [F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x)) for c in ("vec", "centre")]
    spread = placed.join(centre, "cell").withColumn("turn", F.acos(F.least(F.lit(1.0), dot / norm[0] / norm[1])))
    size = spread.groupBy("cell").agg(F.max(F.when(F.col("node") != F.col("cell"), F.col("turn") + 1e-7).otherwise(0.0)).alias("radius"), F.count("*").alias("members"))
    leaders = stage(placed.filter("node = cell").select("node", "vec").join(size.withColumnRenamed("cell", "node"), "node"), "leaders")
    radii = leaders.select("node", "radius")
    members = placed.select("cell", "node", "weight", "vec")

    own = leaders.filter("members > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    graph, reach = None, -1
    for turn in range(2, 2 + most_turns):
        fresh = _first_graph(leaders, turn, theta)
        known = fresh if graph is None else fresh.unionByName(graph.df.select("u", "v", "angle"))
        seeded = Staged(_lists(known, radii, theta), "graph")
        descended = _descend(seeded.df, leaders, turn, theta).unionByName(seeded.df.select("u", "v", "angle"))
        following = Staged(_lists(descended, radii, theta), "graph")
        for old in (seeded, graph):
            if old:
                old.drop()
        graph = following
        before, reach = reach, graph.df.filter("linking").count()
        if reach > before and turn < 1 + most_turns:
            continue
        across = graph.df.filter("linking").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        found = stage(_linked(members, across.unionByName(own), threshold), "links")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        if _audit(nodes, links, threshold) >= least_recall:
            break

    roots = components(found.filter("node <> root"), "node", "root")
    labelled = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = labelled.join(smallest, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    good = keyed.select("vec_id", "node").join(answer, "node").select("vec_id", "n_links", "component_id")
    bad = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
