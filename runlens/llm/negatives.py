"""Hard negatives by inner product, found with STR-packed R-trees.

1. Rows become vectors of integers. Sort-tile-recursive packing deals them into tiles: by label first, then by the
   coordinates of largest spread, each level cut at quantiles of a bounded sample. Cuts are (value, id) pairs, so equal
   rows stay together and equal values do not: no vector or label is one tile's.
2. The box of a tile gives an interval for every coordinate of its rows, and so for their inner product with an anchor.
   An anchor goes to the tiles whose interval meets its score window, whose labels can answer, and whose upper end is not
   below the kth score of the sample: sample rows are rows, so that score is a lower bound.
3. Inside a tile, rows are packed the same way into leaves and nodes. A best-first queue takes the node of the highest
   upper end next, drops those outside all score windows, and stops strictly below the kth score, so ties by id stay exact.
4. The best of all tiles are ranked per anchor (positives) and per anchor and positive (negatives).

In many dimensions without structure boxes overlap and little is pruned; then every tile answers every anchor by
products of leaves, in whole numbers. Broadcasts: the cuts and boxes of at most ``MOST_TILES`` tiles, and the sample.

Defined cases: rows whose label, id or vector is null, or whose vector has a null or non-finite component, take no part;
shorter vectors are filled up with zeros; components beyond 2^26 count as that; rows equal in id, label and vector count
once; an id that comes with several vectors is several rows, and as an anchor it is the smallest (label, vector); rows with
the anchor's id are never its positives or negatives; an anchor without positives, or a positive without negatives in
its window, gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.components import written
from runlens.llm.vectors import is_finite, matrix, sample

SCALE = 256
LARGEST = 1 << 26
POSITIVES, NEGATIVES = 5, 10
#: 30 * positive <= 100 * negative <= 90 * positive
LOW_PERCENT, HIGH_PERCENT = 30, 90
SEED = 43
#: A tile has a hundredth of the rows, within these bounds: then rows and copies of anchors cost about the same.
LEAST_ROWS, MOST_NUMBERS, MOST_TILES = 8192, 1 << 24, 4096
LEVELS, LEAF, FANOUT = 3, 64, 16
_SOME = 256

Cuts = tuple[int, list[tuple[float, int]], list]


def _keys(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The coordinates that packing sorts by: the label, then the vector."""
    return np.concatenate([labels[:, None].astype(vectors.dtype), vectors], axis=1)


def _spread(keys: np.ndarray, levels: int) -> list[int]:
    """The label and the coordinates of largest spread."""
    return [0, *(1 + np.argsort(-keys[:, 1:].astype(np.float64).var(axis=0), kind="stable")[: levels - 1]).tolist()] if len(keys) else [0]


def _cut_tree(keys: np.ndarray, ids: np.ndarray, tiles: int, levels: list[int], names: Iterator[int]) -> Cuts | int:
    """Nested cuts of the sample into about ``tiles`` tiles of equal size."""
    if tiles <= 1 or len(ids) < 2:
        return next(names)
    dim, slabs = levels[0], min(len(ids), int(np.ceil(tiles ** (1 / len(levels)) - 1e-9)))
    order = np.lexsort((ids, keys[:, dim]))
    at = [len(order) * s // slabs for s in range(slabs + 1)]
    cuts = [(keys[order[i], dim], int(ids[order[i]])) for i in at[1:-1]]
    below = [_cut_tree(keys[order[i:j]], ids[order[i:j]], -(-tiles // slabs), levels[1:], names) if levels[1:] else next(names) for i, j in zip(at[:-1], at[1:], strict=True)]
    return dim, cuts, below


def _tiles_of(keys: np.ndarray, ids: np.ndarray, tree: Cuts | int) -> np.ndarray:
    """The tile of every row."""
    out = np.zeros(len(ids), np.int32)
    left = [(np.arange(len(ids)), tree)]
    while left:
        rows, node = left.pop()
        if isinstance(node, int):
            out[rows] = node
            continue
        dim, cuts, below = node
        value, slab = keys[rows, dim], np.zeros(len(rows), np.int64)
        for v, i in cuts:
            slab += (value > v) | ((value == v) & (ids[rows] >= i))
        left += [(rows[slab == s], child) for s, child in enumerate(below)]
    return out


def _packed(keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaves: int, levels: list[int]) -> np.ndarray:
    """Rows in STR order: sorted by the first coordinate, cut into slabs, each sorted by the next."""
    order = rows[np.lexsort((ids[rows], keys[rows, levels[0]]))]
    if len(levels) == 1 or leaves <= 1:
        return order
    slabs = int(np.ceil(leaves ** (1 / len(levels)) - 1e-9))
    at = [len(order) * s // slabs for s in range(slabs + 1)]
    return np.concatenate([_packed(keys, ids, order[i:j], -(-leaves // slabs), levels[1:]) for i, j in zip(at[:-1], at[1:], strict=True)])


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper end of the inner product of every anchor with any vector of every box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _kind(largest: float, width: int) -> type:
    """A type in which all sums are exact whole numbers."""
    most = largest * largest * max(1, width)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Tree:
    """A packed R-tree over the rows of a tile: node 0 is the root; leaves hold consecutive rows."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        keys = _keys(vectors, labels)
        order = _packed(keys, ids, np.arange(len(ids)), -(-len(ids) // leaf), _spread(keys, LEVELS))
        self.vectors, self.labels, self.ids = vectors[order], labels[order], ids[order]
        starts = np.arange(0, len(ids), leaf)
        low, high = np.minimum.reduceat(self.vectors, starts), np.maximum.reduceat(self.vectors, starts)
        labels = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        levels = [(low, high, *labels, np.stack([starts, np.minimum(starts + leaf, len(ids))], axis=1))]
        while len(low) > 1:
            starts = np.arange(0, len(low), fanout)
            span = np.stack([starts, np.minimum(starts + fanout, len(low))], axis=1)
            ends = (f.reduceat(x, starts) for f, x in zip((np.minimum, np.maximum) * 2, levels[-1], strict=False))
            levels.append((*ends, span))
            low = levels[-1][0]
        levels.reverse()
        first = np.cumsum([0, *(len(x[0]) for x in levels)])
        self.n_inner = int(first[-2])
        self.low, self.high, self.least_label, self.most_label = (np.concatenate([x[k] for x in levels]) for k in range(4))
        self.span = np.concatenate([x[4] + (first[k + 1] if k + 1 < len(levels) else 0) for k, x in enumerate(levels)])


@dataclass
class Wanted:
    """What an anchor asks for: rows of its label or of others, in score windows, the best ``k`` of each window."""

    same_label: bool
    k: int

    def labels(self, own: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Boxes that can hold rows of the right label."""
        return (low <= own) & (own <= high) if self.same_label else ~((low == own) & (high == own))

    def rows(self, own: int, anchor: int, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return ((labels == own) == self.same_label) & (ids != anchor)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best by (score, smaller id)."""
    return np.lexsort((ids, -scores))[:k]


def search(tree: Tree, wanted: Wanted, anchor: int, own: int, vector: np.ndarray, ends: tuple[np.ndarray, np.ndarray], windows: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the tile's best rows for one anchor, over all its windows.

    ``ends`` are the interval's ends of every node, ``windows`` rows of (lowest, highest) score and ``floors`` the
    score below which a window needs no row.
    """
    lower, upper = ends
    kth = np.maximum(windows[:, 0], floors)
    kept = [(np.empty(0), np.empty(0, np.int64))] * len(windows)
    fits = wanted.labels(own, tree.least_label, tree.most_label)

    def open_(nodes: np.ndarray) -> np.ndarray:
        meets = (upper[nodes, None] >= kth) & (lower[nodes, None] <= windows[:, 1])
        return nodes[fits[nodes] & meets.any(axis=1)]

    queue = [(-upper[node], int(node)) for node in open_(np.array([0]))]
    while queue:
        end, node = heapq.heappop(queue)
        if -end < kth.min():
            break
        first, last = tree.span[node]
        if node < tree.n_inner:
            for child in open_(np.arange(first, last)):
                heapq.heappush(queue, (-upper[child], int(child)))
            continue
        scores = tree.vectors[first:last] @ vector
        some = np.flatnonzero((scores >= kth.min()) & (scores <= windows[:, 1].max()))
        some = some[wanted.rows(own, anchor, tree.labels[first:last][some], tree.ids[first:last][some])]
        if not len(some):
            continue
        scores, ids = scores[some].astype(np.float64), tree.ids[first:last][some]
        for w in range(len(windows)):
            into = (scores >= kth[w]) & (scores <= windows[w, 1])
            if into.any():
                s, i = np.concatenate([kept[w][0], scores[into]]), np.concatenate([kept[w][1], ids[into]])
                top = _best(s, i, wanted.k)
                kept[w] = s[top], i[top]
                if len(top) == wanted.k:
                    kth[w] = max(kth[w], s[top[-1]])
    found = np.unique(np.stack([np.concatenate([i for _, i in kept]), np.concatenate([s for s, _ in kept]).astype(np.int64)]), axis=1)
    return found[0], found[1]


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, components as whole numbers of 1/256."""
    x = F.col("embedding")
    usable = is_finite(x) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()

    def whole(c: Column) -> Column:
        return F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")

    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return embeddings.where(usable).select(vec_id.alias("vec_id"), shifted.alias("label"), F.transform(x, whole).alias("v"))


class Index:
    """All rows in STR tiles in the shared folder, with the tiles' boxes and the sample."""

    def __init__(self, rows: DataFrame, tile_rows: int | None = None):
        spark = rows.sparkSession
        rows = written(spark, rows, "rows")
        size = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
        self.n, width, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), size).first()
        self.width = max(1, width or 0)
        width, self.kind = self.width, _kind(float(largest or 0), self.width)
        some = sample(rows, self.n, width, SEED, "vec_id")
        found = matrix(some["v"], width, self.kind), some["label"].to_numpy(), some["vec_id"].to_numpy()
        self.sample = tuple(x[_once(*found)] for x in found)
        keys = _keys(self.sample[0].astype(np.int64), self.sample[1])
        most = tile_rows or max(LEAST_ROWS, min(self.n // 100, MOST_NUMBERS // width), -(-self.n // MOST_TILES))
        names = iter(range(1 << 30))
        tree = _cut_tree(keys, self.sample[2], -(-self.n // most), _spread(keys, LEVELS), names)
        cuts = spark.sparkContext.broadcast(tree)

        def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _keys(matrix(batch["v"], width, np.int64), batch["label"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(_tiles_of(own, batch["vec_id"].to_numpy(), cuts.value)), *batch.columns], ["tile", *batch.schema.names])

        def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends: dict[int, tuple] = {}
            for batch in batches:
                own, tiles = _keys(matrix(batch["v"], width, np.int64), batch["label"].to_numpy()), batch["tile"].to_numpy()
                for t in np.unique(tiles):
                    low, high = own[tiles == t].min(axis=0), own[tiles == t].max(axis=0)
                    before = ends.get(int(t), (low, high))
                    ends[int(t)] = np.minimum(low, before[0]), np.maximum(high, before[1])
            if ends:
                lists = ([ends[t][e].tolist() for t in ends] for e in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(list(ends), pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["tile", "low", "high"])

        def joined(group: pa.Table) -> pa.Table:
            low, high = matrix(group["low"], width + 1, np.int64).min(axis=0), matrix(group["high"], width + 1, np.int64).max(axis=0)
            return pa.table({"tile": group["tile"].slice(0, 1), "low": pa.array([low.tolist()], pa.list_(pa.int64())), "high": pa.array([high.tolist()], pa.list_(pa.int64()))})

        self.rows = written(spark, rows.mapInArrow(tile, "tile int, vec_id bigint, label bigint, v array<int>"), "tiles")
        kind = "tile int, low array<bigint>, high array<bigint>"
        boxes = self.rows.mapInArrow(box, kind).groupBy("tile").applyInArrow(joined, kind).toArrow().sort_by("tile")
        self.tiles = boxes["tile"].to_numpy()
        self.low, self.high = matrix(boxes["low"], width + 1, np.int64), matrix(boxes["high"], width + 1, np.int64)

    def best(self, anchors: DataFrame, wanted: Wanted, windows_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """(anchor_id, id, score): for each anchor the rows that may be among the best of its windows.

        ``anchors`` has anchor_id, label, v and, where windows depend on them, scores: ``windows_of`` makes rows of
        (lowest, highest) of a list of scores.
        """
        width, kind, shared = self.width, self.kind, self.rows.sparkSession.sparkContext.broadcast((self.tiles, self.low, self.high, self.sample))

        def floors(scores: np.ndarray, fit: np.ndarray, windows: np.ndarray) -> np.ndarray:
            """The kth score of the sample in each window."""
            out = np.full(len(windows), -np.inf)
            for w, (low, high) in enumerate(windows):
                inside = scores[fit & (scores >= low) & (scores <= high)]
                if len(inside) >= wanted.k:
                    out[w] = np.partition(inside, -wanted.k)[-wanted.k]
            return out

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tiles, low, high, (vectors, labels, ids) = shared.value
            for whole in batches:
                for start in range(0, len(whole), _SOME):
                    batch = whole.slice(start, _SOME)
                    own, names = batch["label"].to_numpy(), batch["anchor_id"].to_numpy()
                    v = matrix(batch["v"], width, np.int64)
                    lower, upper = intervals(v, low[:, 1:], high[:, 1:])
                    scores = v.astype(kind) @ vectors.T
                    took, goes, least = [], [], []
                    for i, given in enumerate(batch["scores"].to_pylist()):
                        windows = windows_of(np.array(given, np.float64))
                        floor = floors(scores[i], wanted.rows(own[i], names[i], labels, ids), windows)
                        kth = np.maximum(windows[:, 0], floor)
                        meets = ((upper[i][:, None] >= kth) & (lower[i][:, None] <= windows[:, 1])).any(axis=1)
                        at = np.flatnonzero(meets & wanted.labels(own[i], low[:, 0], high[:, 0]))
                        took.append(np.full(len(at), i))
                        goes.append(tiles[at])
                        least += [floor.tolist()] * len(at)
                    part = batch.take(pa.array(np.concatenate(took)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(goes), pa.int32()), *part.columns, pa.array(least, pa.list_(pa.float64()))], ["tile", *part.schema.names, "floors"])

        def answer(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(rows) or not len(asked):
                return pa.table({n: pa.array([], pa.int64()) for n in ("anchor_id", "id", "score")})
            vectors, labels, ids = matrix(rows["v"], width, kind), rows["label"].to_numpy(), rows["vec_id"].to_numpy()
            once = _once(vectors, labels, ids)
            tree = Tree(vectors[once], labels[once], ids[once])
            out: list[tuple[np.ndarray, ...]] = []
            for start in range(0, len(asked), _SOME):
                part = asked.slice(start, _SOME)
                v = matrix(part["v"], width, kind)
                wide = kind if kind != np.float32 else np.float64
                lower, upper = intervals(v.astype(wide), tree.low.astype(wide), tree.high.astype(wide))
                for i, (anchor, own, given, floor) in enumerate(zip(part["anchor_id"].to_pylist(), part["label"].to_pylist(), part["scores"].to_pylist(), part["floors"].to_pylist(), strict=True)):
                    found, scores = search(tree, wanted, anchor, own, v[i], (lower[i], upper[i]), windows_of(np.array(given, np.float64)), np.array(floor, np.float64))
                    out.append((np.full(len(found), anchor), found, scores))
            a, i, s = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table({"anchor_id": pa.array(a, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

        parts = max(1, -(-anchors.count() * width // MOST_NUMBERS))
        dealt = anchors.mapInArrow(route, f"tile int, {_fields(anchors)}, floors array<double>")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int"))
        rows = self.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return rows.groupBy("tile", "part").cogroup(dealt.groupBy("tile", "part")).applyInArrow(answer, "anchor_id bigint, id bigint, score bigint")


def _fields(frame: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)


def _once(vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The first of all rows equal in id, label and vector. Equal rows are always in one tile."""
    order = np.argsort(ids, kind="stable")
    if len(ids) < 2 or (np.diff(ids[order]) > 0).all():
        return order
    full = np.concatenate([ids[:, None], labels[:, None], vectors.astype(np.int64)], axis=1)
    return np.sort(np.unique(full, axis=0, return_index=True)[1])


def _everything(scores: np.ndarray) -> np.ndarray:
    return np.array([[-np.inf, np.inf]])


def _harder(scores: np.ndarray) -> np.ndarray:
    """For each positive score, the lowest and the highest score of its negatives."""
    s = np.unique(scores[scores >= 0]).astype(np.int64)
    return np.stack([-(-LOW_PERCENT * s // 100), HIGH_PERCENT * s // 100], axis=1).astype(np.float64)


def hard_negatives(embeddings: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label)."""
    index = Index(integer_rows(embeddings), tile_rows)
    spark = embeddings.sparkSession
    first = F.min(F.struct("label", "v")).alias("first")
    anchors = index.rows.where(F.col("vec_id") % 100 == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(first)
    anchors = written(spark, anchors.select("anchor_id", "first.label", "first.v"), "anchors")
    none = F.array().cast("array<bigint>").alias("scores")

    found = index.best(anchors.select("anchor_id", "label", "v", none), Wanted(True, POSITIVES), _everything)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    positives = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= POSITIVES)
    positives = written(spark, positives.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    scores = positives.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))
    found = written(spark, index.best(anchors.join(scores, "anchor_id"), Wanted(False, NEGATIVES), _harder), "negatives")
    low = LOW_PERCENT * F.col("positive_score") <= 100 * F.col("score")
    high = 100 * F.col("score") <= HIGH_PERCENT * F.col("positive_score")
    pairs = positives.join(found, "anchor_id").where(low & high)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
