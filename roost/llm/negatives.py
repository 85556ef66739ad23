"""Hard negatives from an STR-packed R-tree: exact integer inner products, best-first search with interval bounds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roost.llm.common import Staged

#: Rows of a tile (a subtree that one task searches), of a leaf, children of a node.
TILE = 2048
LEAF = 64
FAN = 8
#: Queries that one task holds at a time, tiles of one page of the directory.
BLOCK = 2048
PAGE = 512

_TILES = (
    "tile long, lo array<long>, hi array<long>, label_lo long, label_hi long, members array<long>, ids array<long>, "
    "labels array<long>, flat array<long>, node_lo array<long>, node_hi array<long>, node_label_lo array<long>, node_label_hi array<long>"
)
_WINDOWS = "array<struct<wid:int,low:bigint,high:bigint,bar:bigint>>"
_QUERIES = f"array<struct<query:bigint,label:bigint,q:array<bigint>,seed:bigint,windows:{_WINDOWS}>>"
_FOUND = "query long, wid int, score long, member long, vec_id long"


def _size(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices: doubles or 64 bits where they hold them, else Python integers."""
    bound = _size(left) * _size(right) * left.shape[1]
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 61:
        return left @ right.T
    return left.astype(object) @ right.T.astype(object)


def str_order(points: np.ndarray, leaf: int, axes: list[int]) -> np.ndarray:
    """Sort-tile-recursive order: sorted by the first axis and cut into slabs, each packed by the axes that are left."""
    pages = math.ceil(len(points) / leaf)
    if pages <= 1 or not axes:
        return np.arange(len(points))
    order = np.argsort(points[:, axes[0]], kind="stable")
    slab = leaf * math.ceil(pages / math.ceil(pages ** (1 / len(axes))))
    parts = [order[low : low + slab] for low in range(0, len(order), slab)]
    return np.concatenate([part[str_order(points[part], leaf, axes[1:])] for part in parts])


def _boxes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of all nodes, leaves first and the root last, from the rows in their packed order."""
    size, lows, highs = LEAF, [], []
    while True:
        starts = np.arange(0, len(low), size)
        low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        lows.append(low)
        highs.append(high)
        if len(low) == 1:
            return np.concatenate(lows), np.concatenate(highs)
        size = FAN


def _levels(rows: int) -> list[int]:
    """Where each level of a tile's nodes starts, leaves first, and where the last one ends."""
    counts = [math.ceil(rows / LEAF)]
    while counts[-1] > 1:
        counts.append(math.ceil(counts[-1] / FAN))
    return np.concatenate([[0], np.cumsum(counts)]).tolist()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of one partition's rows (row, vec_id, label, q), about ``TILE`` rows each; vectors of one length share a tile."""
    parts = [batch for batch in batches if len(batch)]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    lengths = np.asarray(table.column("q").chunk(0).value_lengths())
    number = TaskContext.get().partitionId() << 24
    for dim in np.unique(lengths).tolist():
        part = table.take(pa.array(np.flatnonzero(lengths == dim))).combine_chunks()
        q = _matrix(part.column("q").chunk(0))
        label = part.column("label").to_numpy()
        # the label is one more coordinate; the widest come first, and a few cuts reach every leaf
        points = np.column_stack([q, label])
        spread = points.astype(np.float64).std(axis=0)
        axes = [dim] if spread[dim] > 0 else []
        axes += [int(a) for a in np.argsort(-spread[:dim], kind="stable")[: max(1, math.ceil(math.log2(len(q) / LEAF + 1) / 2))]]
        order = str_order(points, LEAF, axes)
        for low in range(0, len(order), TILE):
            here = order[low : low + TILE]
            lo, hi = _boxes(points[here], points[here])
            taken = part.take(pa.array(here))
            one = {
                "tile": number, "lo": lo[-1, :dim], "hi": hi[-1, :dim], "label_lo": lo[-1, dim], "label_hi": hi[-1, dim],
                "members": taken.column("row").to_numpy(), "ids": taken.column("vec_id").to_pylist(), "labels": label[here],
                "flat": q[here].ravel(), "node_lo": lo[:, :dim].ravel(), "node_hi": hi[:, :dim].ravel(),
                "node_label_lo": lo[:, dim], "node_label_hi": hi[:, dim],
            }
            number += 1
            kinds = [pa.int64() if k in ("tile", "label_lo", "label_hi") else pa.list_(pa.int64()) for k in one]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one.values(), kinds, strict=True)], names=list(one))


def pack_tree(rows: DataFrame) -> Staged:
    """STR-packed R-tree of (row, vec_id, label, q): a table of tiles, each a subtree with the boxes of its nodes.

    Spark does the first cuts, by label and first coordinate into slabs and by the second coordinate inside; tasks pack on
    by their widest coordinates. ``row`` breaks ties, so equal vectors spread over partitions.
    """
    tiles = max(1, math.ceil(rows.count() / TILE))
    slabs = math.ceil(math.sqrt(tiles))
    slabbed = Staged(rows.repartitionByRange(slabs, "label", F.get("q", F.lit(0)), "row").withColumn("slab", F.spark_partition_id()), "slabs")
    packed = slabbed.df.repartitionByRange(tiles, "slab", F.get("q", F.lit(1)), "row").select("row", "vec_id", "label", "q")
    tree = Staged(packed.mapInArrow(_pack, _TILES), "tiles")
    slabbed.drop()
    return tree


class _Window:
    """The best ``k`` rows with a score from ``low`` to ``high``; ``bar`` is a score that k rows are known to reach."""

    def __init__(self, wid: int, low: int | None, high: int | None, bar: int | None, k: int):
        self.wid, self.low, self.high, self.bar, self.k = wid, low, high, bar, k
        self.rows: list[tuple] = []

    def floor(self) -> int | None:
        limits = [x for x in (self.low, self.bar) if x is not None]
        return max(limits) if limits else None

    def reaches(self, low: int, high: int) -> bool:
        """Whether scores between the bounds may enter: boxes strictly below the k-th are out, ties stay."""
        floor = self.floor()
        top = high if self.high is None else min(high, self.high)
        return top >= low and (floor is None or top >= floor)

    def take(self, scores: np.ndarray, allowed: np.ndarray, ids: list, members: np.ndarray) -> None:
        fits = allowed if self.high is None else allowed & (scores <= self.high)
        floor = self.floor()
        fits = fits if floor is None else fits & (scores >= floor)
        at = np.flatnonzero(fits)
        if not len(at):
            return
        new = [(-int(scores[i]), ids[i] is None, ids[i] or 0, int(members[i]), ids[i]) for i in at.tolist()]
        self.rows = heapq.nsmallest(self.k, self.rows + new, key=lambda r: r[:4])
        if len(self.rows) == self.k:
            self.bar = -self.rows[-1][0] if self.bar is None else max(self.bar, -self.rows[-1][0])


def _intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with any point of each box: coordinate by coordinate."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return products(plus, lo) + products(minus, hi), products(plus, hi) + products(minus, lo)


def _best_first(query: dict, least: list, most: list, tile: dict, same_label: bool, k: int) -> list[_Window]:
    """One query through one tile: the open node of the greatest upper bound next."""
    windows = [_Window(w["wid"], w["low"], w["high"], w["bar"], k) for w in query["windows"]]
    label, levels = query["label"], tile["levels"]

    def opens(node: int) -> bool:
        low, high = tile["label_lo"][node], tile["label_hi"][node]
        if (not low <= label <= high) if same_label else low == high == label:
            return False
        return any(w.reaches(least[node], most[node]) for w in windows)

    root = levels[-1] - 1
    queue = [(-most[root], root, len(levels) - 2)] if opens(root) else []
    while queue:
        _, node, level = heapq.heappop(queue)
        if not opens(node):
            continue
        place = node - levels[level]
        if level:
            first = levels[level - 1] + place * FAN
            for child in range(first, min(first + FAN, levels[level])):
                if opens(child):
                    heapq.heappush(queue, (-most[child], child, level - 1))
            continue
        rows = slice(place * LEAF, (place + 1) * LEAF)
        scores = products(tile["q"][rows], query["q"][None, :])[:, 0]
        allowed = (tile["labels"][rows] == label) == same_label
        allowed &= tile["members"][rows] != query["query"]
        if scores.dtype == object:
            allowed &= np.array([abs(s) < 1 << 63 for s in scores])
        for window in windows:
            window.take(scores, allowed, tile["ids"][rows], tile["members"][rows])
    return windows


def _search_tile(tile: dict, queries: pa.StructArray, same_label: bool, k: int) -> pa.RecordBatch:
    q = _matrix(queries.field("q"))
    least, most = _intervals(q, tile["node_lo"], tile["node_hi"])
    found = []
    rest = [queries.field(name).to_pylist() for name in ("query", "label", "windows")]
    for i, (query, label, windows) in enumerate(zip(*rest, strict=True)):
        one = {"query": query, "label": label, "windows": windows, "q": q[i]}
        for window in _best_first(one, least[i].tolist(), most[i].tolist(), tile, same_label, k):
            found += [(query, window.wid, -r[0], r[3], r[4]) for r in window.rows]
    columns = list(zip(*found, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "wid", "score", "member", "vec_id"])


def _search(work: DataFrame, tiles: DataFrame, same_label: bool, k: int) -> DataFrame:
    """Candidates of every (tile, queries) row: at most ``k`` for each query and window."""
    fields = ["members", "ids", "labels", "flat", "node_lo", "node_hi", "node_label_lo", "node_label_hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                raw = {name: batch.column(name)[i].values for name in fields}
                members = raw["members"].to_numpy()
                shape = (-1, len(raw["flat"]) // len(members))
                tile = {
                    "members": members, "ids": raw["ids"].to_pylist(), "labels": raw["labels"].to_numpy(),
                    "q": raw["flat"].to_numpy().reshape(shape), "node_lo": raw["node_lo"].to_numpy().reshape(shape),
                    "node_hi": raw["node_hi"].to_numpy().reshape(shape), "label_lo": raw["node_label_lo"].to_pylist(),
                    "label_hi": raw["node_label_hi"].to_pylist(), "levels": _levels(len(members)),
                }
                yield _search_tile(tile, batch.column("queries")[i].values, same_label, k)

    return work.join(tiles.select("tile", *fields), "tile").select("queries", *fields).mapInArrow(run, _FOUND)


def _route(queries: DataFrame, tiles: DataFrame, same_label: bool, seeds: bool) -> DataFrame:
    """Which tiles a query must open, by the boxes of their roots.

    Blocks of queries meet pages of the directory. ``seeds``: rows (query, tile, most) with each page's tile of the greatest
    upper bound; else rows (tile, queries) with all queries of a block that the tile may still serve.
    """
    boxes = tiles.select("tile", "lo", "hi", "label_lo", "label_hi")
    n_pages, n_blocks = (max(1, math.ceil(t.count() / n)) for t, n in ((boxes, PAGE), (queries, BLOCK)))
    pages = boxes.groupBy(F.pmod(F.xxhash64("tile"), F.lit(n_pages)).alias("page")).agg(F.collect_list(F.struct(*boxes.columns)).alias("boxes"))
    fields = ["query", "label", "q", "seed", "windows"]
    blocks = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct(*fields)).alias("queries"))
    # both sides are dealt by block and page, so neither a single page nor a single block is a hot key
    left = blocks.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long"))))
    right = pages.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    met = left.join(right, ["block", "page"]).select("queries", "boxes")

    def open_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                mine, box = batch.column(0)[i].values, batch.column(1)[i].values
                lengths, dims = (np.asarray(x.field(n).value_lengths()) for x, n in ((mine, "q"), (box, "lo")))
                for dim in np.intersect1d(lengths, dims).tolist():
                    yield from one_length(mine.take(pa.array(np.flatnonzero(lengths == dim))), box.take(pa.array(np.flatnonzero(dims == dim))))

    def one_length(mine: pa.StructArray, box: pa.StructArray) -> Iterator[pa.RecordBatch]:
        least, most = _intervals(_matrix(mine.field("q")), _matrix(box.field("lo")), _matrix(box.field("hi")))
        label = mine.field("label").to_numpy()[:, None]
        low, high, tile = (box.field(n).to_numpy()[None, :] for n in ("label_lo", "label_hi", "tile"))
        may = (low <= label) & (label <= high) if same_label else (low != label) | (high != label)
        # as doubles: they choose seeds and mark what is open, the tests themselves are exact
        value = np.full(may.shape, -np.inf)
        for i, windows in enumerate(mine.field("windows").to_pylist()):
            for w in windows:
                limits = [x for x in (w["low"], w["bar"]) if x is not None]
                best = most[i] if w["high"] is None else np.minimum(most[i], w["high"])
                fits = (best >= least[i]) & (best >= max(limits)) if limits else best >= least[i]
                value[i] = np.maximum(value[i], np.where(fits.astype(bool) & may[i], best.astype(np.float64), -np.inf))
        if seeds:
            rows = np.flatnonzero((value > -np.inf).any(axis=1))
            best = value[rows].argmax(axis=1)
            ids = mine.field("query").to_numpy()[rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tile[0, best]), pa.array(value[rows, best])], names=["query", "tile", "most"])
            return
        seed = mine.field("seed").fill_null(-1).to_numpy()
        for j in range(len(box)):
            wanted = np.flatnonzero((value[:, j] > -np.inf) & (seed != tile[0, j]))
            if len(wanted):
                part = mine.take(pa.array(wanted))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tile[0, j]]), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["tile", "queries"]
                )

    return met.mapInArrow(open_tiles, "query long, tile long, most double" if seeds else f"tile long, queries {_QUERIES}")



def _nearest(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank`` 1 to ``k`` inside each query's window: higher scores first, then smaller ids."""
    order = Window.partitionBy("query", "wid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "member")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_tree(queries: DataFrame, tree: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The first ``k`` rows of the tree in every window of every query, exactly.

    ``queries``: query (a row number of the tree's table, which is never its own answer), label, q, windows (wid, low, high,
    bar; a null bound is open). ``same_label`` says whether answers have the query's label or another. A first
    round opens the tile with the greatest upper bound of each query; the k-th scores found there close
    most of what the second round would open. Rows: query, wid, score, member, vec_id, rank.
    """
    asked = queries.select("query", "label", "q", F.lit(None).cast("long").alias("seed"), "windows")
    best = Window.partitionBy("query").orderBy(F.desc("most"), "tile")
    seeds = _route(asked, tree, same_label, True).withColumn("n", F.row_number().over(best)).filter("n = 1").select("query", "tile")
    seeds = Staged(seeds, "seeds")
    # a tile that many queries start from is dealt into parts
    crowd = seeds.df.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = seeds.df.join(crowd, "tile").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")))
    fields = F.struct("query", "label", "q", "seed", "windows")
    work = dealt.join(asked, "query").groupBy("tile", "part").agg(F.collect_list(fields).alias("queries"))
    first = Staged(_search(work.select("tile", "queries"), tree, same_label, k), "first")
    kth = first.df.groupBy("query", "wid").agg(F.count("*").alias("n"), F.min("score").alias("bar")).filter(F.col("n") >= k)
    bars = kth.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("wid", "bar"))).alias("bars"))
    known = asked.drop("seed").join(seeds.df.withColumnRenamed("tile", "seed"), "query").join(bars, "query", "left")
    raised = F.transform(
        "windows", lambda w: F.struct(w.wid.alias("wid"), w.low.alias("low"), w.high.alias("high"), F.try_element_at(F.col("bars"), w.wid).alias("bar"))
    )
    known = Staged(known.withColumn("windows", raised).select("query", "label", "q", "seed", "windows"), "raised")
    rest = _search(_route(known.df, tree, same_label, False), tree, same_label, k)
    answer = Staged(_nearest(first.df.unionByName(rest), k), "nearest")
    for old in (seeds, first, known):
        old.drop()
    return answer.df


def integer_rows(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, q: components times ``scale``, floored, of the rows that take part.

    Left out: rows with a null label, a null or empty vector, a null or non-finite component, or one of 2^54 or more.
    """
    x = F.col(vec_col)
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 54)))
    q = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    good = vectors.filter(F.col(label_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(usable, F.lit(False)))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), q.alias("q"))


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100
) -> DataFrame:
    """Hard negatives of every anchor and positive among ``rows`` (vec_id, label, q as ``integer_rows`` gives).

    Anchors are the rows for which the column ``anchors`` holds; a row's score is its inner product with the anchor, higher
    first, ties by smaller vec_id. Positives: the first ``positives`` other rows of the anchor's label. Negatives:
    for each of them the first ``negatives`` rows of another label with a score from ``low_percent`` to ``high_percent``
    of the positive's. Rows of other lengths than the anchor's, and scores that 64 bits cannot hold, are no
    answers. Repeated rows and ids are rows like any other, null ids come last and are no anchors. Of rows
    equal in label and vector only the first few by id can be an answer; the others do not enter the tree. An empty
    table gives an empty table. Rows: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    numbered = Staged(rows.select("vec_id", "label", "q").withColumn("row", F.monotonically_increasing_id()), "integers")
    copies = Window.partitionBy("label", "q").orderBy(F.asc_nulls_last("vec_id"), "row")
    distinct = numbered.df.withColumn("n", F.row_number().over(copies)).filter(F.col("n") <= max(positives, negatives) + 1).drop("n")
    tree = pack_tree(distinct)
    asked = numbered.df.filter(F.coalesce(anchors, F.lit(False))).select(F.col("row").alias("query"), "vec_id", "label", "q")
    open_window = F.array(F.struct(F.lit(1).alias("wid"), *[F.lit(None).cast("long").alias(c) for c in ("low", "high", "bar")]))
    near = search_tree(asked.withColumn("windows", open_window), tree.df, positives, True)
    # exact bound: the smallest integer that is not below the share
    low = F.expr(f"cast(ceil(cast(score as decimal(20,0)) * {low_percent} / 100) as bigint)")
    high = F.expr(f"cast(floor(cast(score as decimal(20,0)) * {high_percent} / 100) as bigint)")
    windows = near.select("query", F.col("rank").alias("wid"), low.alias("low"), high.alias("high"), F.lit(None).cast("long").alias("bar"))
    listed = windows.filter("low <= high").groupBy("query").agg(F.collect_list(F.struct("wid", "low", "high", "bar")).alias("windows"))
    far = search_tree(asked.join(listed, "query"), tree.df, negatives, False)
    positive = near.select("query", F.col("rank").alias("wid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    negative = far.select("query", "wid", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        asked.select("query", F.col("vec_id").alias("anchor_id")).join(positive, "query").join(negative, ["query", "wid"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
