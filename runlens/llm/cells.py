"""Near copies among embeddings: spherical k-means cells, blocked cosine products, one representative a group.

1. Rows with equal label and vector are one vector with a count, so exact copies cost nothing further.
2. Spherical k-means on a bounded sample gives unit centres. Every vector lives in the cell of its nearest centre and
   visits others: where two vectors of cosine >= t lie in different cells, their chord (at most sqrt(2 - 2t) long)
   crosses the plane between the two centres, so one of them is within half of it of the plane. A vector that is
   within ``margin`` of the plane visits the other cell. With the default margin, half the chord, no link is lost.
3. Per label and cell, blocks of vectors are compared by matrix products in double precision: residents with
   residents and visitors. A pair that meets in both its cells counts in the smaller one. Each block sends counts
   per vector and a spanning forest of its links, never the pairs.
4. Components of the forests name the groups; the smallest id of each is kept.

Fitted on about ``SAMPLE_NUMBERS`` numbers (32,768 vectors of 64 components), chosen by hash; all rows are compared.

Defined cases: rows whose label or id is null, or whose vector is null, empty, zero or holds null or non-finite
components, link with nothing; vectors of different length link with nothing; a row that repeats another links with
it; an id that comes with several vectors is one node that any of them links, with the sum of their links; a null id
has no component and is kept. No rows give no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.blocks import in_blocks
from runlens.llm.components import components, written
from runlens.llm.vectors import SAMPLE_NUMBERS, is_finite, matrix, sample

THRESHOLD = 0.93
#: A cell for so many vectors, as long as the sample has LEAST_SAMPLED for each.
CELL_ROWS, LEAST_SAMPLED = 1024, 8
ROUNDS = 10
SEED = 41
#: A chunk of a block has about so many numbers.
BLOCK_NUMBERS = 1 << 20
_TILE = 256
#: What rounding can add to a margin.
_ROUNDING = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. Rows of zeros stay."""
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    vectors = vectors / np.where(largest > 0, largest, 1)
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(length > 0, length, 1)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` unit centres of unit vectors. A centre that loses its vectors stays where it was."""
    step = max(1, len(vectors) // k)
    centres = vectors[: step * k : step][:k].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(vectors[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(vectors), 4096)])
        order = np.argsort(nearest, kind="stable")
        found, first = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(vectors[order], first, axis=0)
        some = np.abs(sums).max(axis=1) > 1e-12
        moved = centres.copy()
        moved[found[some]] = unit(sums[some])
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def cells_of(vectors: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """How many cells each unit vector is in, and these cells, its own first."""
    near = vectors @ centres.T
    rows = np.arange(len(vectors))
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres[home] @ centres.T)))
    inside = near[rows, home][:, None] - near <= margin * apart + _ROUNDING
    inside[rows, home] = False
    row, cell = np.nonzero(inside)
    row, cell = np.concatenate([rows, row]), np.concatenate([home, cell])
    order = np.argsort(row, kind="stable")
    return np.bincount(row, minlength=len(vectors)), cell[order]


class Forest:
    """Which members of a block are linked, directly or through others."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[np.ndarray] = []

    def link(self, one: int, others: np.ndarray) -> None:
        roots = self.root[others]
        new = np.unique(roots[roots != self.root[one]])
        if not len(new):
            return
        at = np.unique(roots, return_index=True)
        self.edges.append(np.stack([np.full(len(new), one), others[at[1][np.searchsorted(at[0], new)]]]))
        self.root[np.isin(self.root, new)] = self.root[one]


def links_within(
    vectors: np.ndarray, weight: np.ndarray, chunk: np.ndarray, visits: list[np.ndarray], cell: int, threshold: float, across: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each member links with, and a spanning forest of the links, as positions.

    ``visits`` has each member's cells, its own first. A block across two chunks compares members of different ones.
    """
    home = np.array([v[0] for v in visits], np.int64)
    width = int(max(v.max() for v in visits)) + 1
    codes = np.sort(np.concatenate([i * width + v for i, v in enumerate(visits)]))
    own = np.flatnonzero(home == cell)
    counts, forest = np.zeros(len(home), np.int64), Forest(len(home))
    for start in range(0, len(own), _TILE):
        x = own[start : start + _TILE]
        linked = vectors[x] @ vectors.T >= threshold
        resident = home == cell
        linked &= ~resident | (np.arange(len(home)) > x[:, None])
        if across:
            linked &= chunk[x][:, None] != chunk
        i, y = np.nonzero(linked)
        if not len(i):
            continue
        # A visitor and a resident may meet at the visitor's home too: the smaller cell counts.
        code = x[i] * width + home[y]
        there = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
        twice = ~resident[y] & there & (home[y] < cell)
        i, y = i[~twice], y[~twice]
        counts += np.bincount(x[i], weight[y], len(home)).astype(np.int64) + np.bincount(y, weight[x[i]], len(home)).astype(np.int64)
        cuts = np.searchsorted(i, np.arange(len(x) + 1))
        for row in np.unique(i):
            forest.link(x[row], y[cuts[row] : cuts[row + 1]])
    return counts, np.concatenate(forest.edges, axis=1) if forest.edges else np.empty((2, 0), np.int64)


def near_copies(embeddings: DataFrame, threshold: float = THRESHOLD, margin: float | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    ``margin`` is how near a vector must be to the plane between two cells to visit the other one; half the chord of
    the threshold, the default, loses no link. Less margin means fewer visits and may lose links.
    """
    spark = embeddings.sparkSession
    margin = sqrt(2 - 2 * threshold) / 2 if margin is None else margin
    v = F.col("embedding")
    usable = is_finite(v) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = F.when(usable, F.xxhash64("label", "embedding")), F.when(usable, F.xxhash64(F.lit(SEED), "label", "embedding"))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding", key[0].alias("k0"), key[1].alias("k1"))
    single = rows.where("k0 is not null").groupBy("label", "embedding", "k0", "k1").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    single = written(spark, single.withColumn("dim", F.size("embedding")), "vectors")
    total, width = single.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    taken = unit(matrix(sample(single.select("rep", "embedding"), total, width, SEED, "rep")["embedding"], width))
    k = max(1, min(total // cell_rows, len(taken) // LEAST_SAMPLED))
    shared = spark.sparkContext.broadcast(spherical_kmeans(taken, k) if len(taken) else np.zeros((1, width)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        step = max(16, (1 << 20) // len(centres))
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.slice(start, step)
                many, found = cells_of(unit(matrix(batch["embedding"], width)), centres, margin)
                cuts = np.concatenate([[0], np.cumsum(many)])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "cells"])

    columns = single.select("rep", "n", "label", "dim", "embedding")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)
    placed = written(spark, columns.mapInArrow(assign, f"{fields}, cells array<int>"), "cells")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        cell = key[2].as_py()
        rep, n, chunk = (group[c].to_numpy() for c in ("rep", "n", "chunk"))
        lists = group["cells"].combine_chunks()
        cuts = np.asarray(lists.offsets)
        visits = np.split(np.asarray(lists.flatten()).astype(np.int64), cuts[1:-1] - cuts[0])
        across = key[3].as_py() != key[4].as_py()
        counts, (a, b) = links_within(unit(matrix(group["embedding"], width)), n, chunk, visits, cell, threshold, across)
        some = np.flatnonzero(counts)
        return pa.table(
            {
                "a": np.concatenate([rep[some], rep[a]]),
                "b": pa.array(np.concatenate([rep[some], rep[b]]), mask=np.arange(len(some) + len(a)) < len(some)),
                "n": pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)])),
            }
        )

    each = placed.withColumn("cell", F.explode("cells"))
    blocks = in_blocks(each, ["label", "dim", "cell"], "rep", max(1, BLOCK_NUMBERS // width))
    groups = blocks.groupBy("label", "dim", "cell", "first", "second")
    found = written(spark, groups.applyInArrow(compare, "a bigint, b bigint, n bigint"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"))

    single = single.select("rep", "k0", "k1", "n").join(counts, "rep", "left").where("n > 1 or links is not null")
    single = single.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = single.select("k0", "k1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = written(spark, known, "known")
    out = rows.select("vec_id", "k0", "k1").join(known, ["k0", "k1"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
