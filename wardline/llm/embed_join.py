"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and split into blocks of few dimensions. Two of
them link if their cosine is at least ``threshold``, so their squared distance is at most
``budget = 2 - 2 * threshold``; then at least one block has a squared distance of at most its share,
``budget * dimensions of the block / dimensions``. Each block is range-joined under its share: the
first dimensions of the block make a grid of cells at least as wide as the share's radius, a vector
stays in its cell and visits the neighbouring cells that its radius reaches, each pair of cells
meeting once. Candidates are verified on the given vectors in double precision.

How many dimensions the grid has follows from the number of vectors (about ``cell_size`` a cell).
Cells that hold more are dealt over several tasks, pairs of chunks of at most ``cell_size``.

A pair is counted in the first block where it is a candidate, so counts need no list of pairs: a task
gives each of its vectors a number of links and keeps of the links themselves a forest, enough for
components. Equal vectors are one class with a number of members.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing
and are their own component; vectors of different lengths do not link; rows with equal or null ids
are vectors of their own. Cosine is x.y / (|x| |y|) on the vectors as stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, components, numbered, small

SLACK = 1e-6  # for rounding, on the share of a block; the verification has none
ROUNDING = 1e-9  # more than quick distances of unit vectors are off
DEALT = "dim int, block int, cell long, own boolean, class long, vector array<double>"
MET = "src long, dst long, links long"


def rotation(dim: int) -> np.ndarray:
    """The same orthogonal matrix everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, width: int) -> list[tuple[int, int]]:
    number = max(1, dim // width)
    edges = [dim * i // number for i in range(number + 1)]
    return list(zip(edges, edges[1:]))


def shares(dim: int, width: int, threshold: float) -> list[float]:
    """The squared distance up to which two vectors are candidates of a block, the one bound for all steps."""
    budget = 2 - 2 * threshold
    return [budget * (b - a) / dim * (1 + SLACK) + SLACK for a, b in block_edges(dim, width)]


def within(share: float, quick: np.ndarray, units: np.ndarray, p: np.ndarray, q: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Whether rows ``p`` and ``q`` of ``units`` are within ``share`` on the rotated ``axes``, by their own numbers only.

    Products of matrices round by the rows beside a row. Where ``quick`` is too close to tell, the
    distance is summed exactly, so that every task decides alike.
    """
    inside = quick <= share
    for i in np.flatnonzero(np.abs(quick - share) <= ROUNDING):
        gap = units[p[i]] - units[q[i]]
        inside[i] = math.fsum(math.fsum(gap * axis) ** 2 for axis in axes) <= share
    return inside


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither large nor small components overflow.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _dealer(threshold: float, width: int, grid: int):
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby(batch["vector"].map(len)):
                vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
                turned = unit_rows(vectors) @ rotation(dim).T
                names, out, share = rows["class"].to_numpy(), [], shares(dim, width, threshold)
                for block, (a, b) in enumerate(block_edges(dim, width)):
                    radius = np.sqrt(share[block]) + ROUNDING
                    side = max(radius, 1.5 / np.sqrt(dim))
                    axes = min(grid, b - a, 8)
                    scaled = turned[:, a : a + axes] / side
                    home = np.floor(scaled).astype(np.int64)
                    reach = radius / side
                    for step in product((-1, 0, 1), repeat=axes):
                        if step < (0,) * axes:
                            continue
                        move = np.array(step, dtype=np.int64)
                        inside = scaled - home
                        gap = np.where(move < 0, inside, np.where(move > 0, 1 - inside, 0))
                        near = (gap**2).sum(axis=1) <= reach**2 + SLACK
                        if not near.any():
                            continue
                        cells = (home[near] + move + 64) @ (128 ** np.arange(axes, dtype=np.int64))
                        out.append((block, cells, not any(step), near))
                for block, cells, own, near in out:
                    yield pd.DataFrame({
                        "dim": np.int32(dim), "block": np.int32(block), "cell": cells, "own": own,
                        "class": names[near], "vector": list(vectors[near]),
                    })

    return deal


def _joiner(threshold: float, width: int):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of one cell, or of two chunks of a large one: ``src, dst, links``.

        A row with ``dst`` is a link of the forest, one without gives ``src`` a number of links.
        """
        vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        # By powers of two, which rounds nothing and keeps squares in range.
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
        names, many = rows["class"].to_numpy(), rows["many"].to_numpy()
        left_side, right_side = rows["left"].to_numpy(), rows["right"].to_numpy()
        block = int(rows["block"].iloc[0])
        scaled = unit_rows(vectors)
        dim = vectors.shape[1]
        axes = rotation(dim)
        turned = scaled @ axes.T
        edges, share = block_edges(dim, width), shares(dim, width, threshold)
        a, b = edges[block]
        mine = turned[:, a:b]
        half = (mine**2).sum(axis=1)
        right = np.flatnonzero(right_side)
        degree = np.zeros(len(rows), np.int64)
        parent = np.arange(len(rows))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        lefts, forest = np.flatnonzero(left_side), []
        for start in range(0, len(lefts), 256):
            left = lefts[start : start + 256]
            far = half[left][:, None] + half[right][None, :] - 2 * (mine[left] @ mine[right].T)
            i, j = np.nonzero(far <= share[block] + ROUNDING)
            i, j = left[i], right[j]
            # Where both rows stand on both sides, a pair shows twice.
            once = (names[i] != names[j]) & ~(left_side[j] & right_side[i] & (names[i] > names[j]))
            i, j = i[once], j[once]
            for at in range(0, len(i), 65536):
                p, q = i[at : at + 65536], j[at : at + 65536]
                for at_block, (c, d) in enumerate(edges[: block + 1]):
                    quick = ((turned[p, c:d] - turned[q, c:d]) ** 2).sum(axis=1)
                    counts = within(share[at_block], quick, scaled, p, q, axes[c:d]) == (at_block == block)
                    p, q = p[counts], q[counts]
                near = (scaled[p] * scaled[q]).sum(axis=1) > threshold - 1e-6
                p, q = p[near], q[near]
                x, y = vectors[p], vectors[q]
                cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                linked = cosine >= threshold
                p, q = p[linked], q[linked]
                np.add.at(degree, p, many[q])
                np.add.at(degree, q, many[p])
                for u, v in zip(p.tolist(), q.tolist()):
                    s, t = root(u), root(v)
                    if s != t:
                        parent[s] = t
                        forest.append((names[u], names[v]))
        has = np.flatnonzero(degree)
        src = [*names[has].tolist(), *[int(u) for u, _ in forest]]
        dst = [None] * len(has) + [int(v) for _, v in forest]
        links = [*degree[has].tolist()] + [0] * len(forest)
        return pd.DataFrame({"src": src, "dst": pd.array(dst, dtype="Int64"), "links": links})

    return join


def link_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, width: int = 16,
    cell_size: int = 4096,
) -> DataFrame:
    """``_rid, _row, links, component`` for every row of ``table``."""
    scratch = Scratch(table.sparkSession, "embeddings")
    rows = numbered(table, key, scratch)
    v = F.col("_row").getField(vector)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    doubles = F.when(good & F.exists(v, lambda x: x != 0), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)))
    sound = rows.select("_rid", doubles.alias("vector")).where(F.col("vector").isNotNull())
    classes = sound.groupBy("vector").agg(F.min("_rid").alias("class"), F.count("*").alias("many"))
    classes = scratch.save(classes, "classes")
    number = classes.count()
    grid = max(1, int(np.ceil(np.log(max(1, number / cell_size)) / np.log(3))))
    dealt = classes.select("class", "vector").mapInPandas(_dealer(threshold, width, grid), DEALT)
    dealt = scratch.save(dealt.join(classes.select("class", "many"), "class"), "dealt")
    place = ["dim", "block", "cell"]
    filled = dealt.groupBy(*place).agg(F.count(F.when(F.col("own"), 1)).alias("owners"), F.count("*").alias("all"))
    filled = filled.where("owners > 0 and all > 1").select(
        *place,
        F.ceil(F.col("owners") / cell_size).cast("int").alias("own_chunks"),
        F.ceil((F.col("all") - F.col("owners") + 1) / cell_size).cast("int").alias("guest_chunks"),
    )
    filled = scratch.save(filled, "filled")
    chunk = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    seated = dealt.join(small(filled, 40), place)
    seated = seated.withColumn("chunk", F.when(F.col("own"), chunk(F.col("own_chunks"))).otherwise(chunk(F.col("guest_chunks"))))
    # Tables: (i, j) with i <= j for two chunks of owners, (-1 - g, j) for guests and owners.
    last, c = F.col("own_chunks") - 1, F.col("chunk")
    owner = F.concat(
        F.transform(F.sequence(F.lit(0), c), lambda i: F.struct(i.alias("i"), c.alias("j"))),
        F.filter(F.transform(F.sequence(c, last), lambda j: F.struct(c.alias("i"), j.alias("j"))), lambda s: s["j"] != c),
        F.transform(F.sequence(F.lit(0), F.col("guest_chunks") - 1), lambda g: F.struct((-1 - g).alias("i"), c.alias("j"))),
    )
    guest = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct((-1 - c).alias("i"), j.alias("j")))
    seats = seated.withColumn("seat", F.explode(F.when(F.col("own"), owner).otherwise(guest)))
    left = F.when(F.col("seat.i") >= 0, F.col("chunk") == F.col("seat.i")).otherwise(~F.col("own"))
    right = F.when(F.col("seat.i") >= 0, F.col("chunk") == F.col("seat.j")).otherwise(F.col("own"))
    seats = seats.select(*place, F.col("seat.i").alias("i"), F.col("seat.j").alias("j"), "class", "many", "vector", left.alias("left"), right.alias("right"))
    met = scratch.save(seats.groupBy(*place, "i", "j").applyInPandas(_joiner(threshold, width), MET), "met")
    found = met.where("dst is null").groupBy(F.col("src").alias("class")).agg(F.sum("links").alias("found"))
    whole = components(met.where("dst is not null").select("src", "dst"), scratch).withColumnRenamed("node", "class")
    named = classes.join(found, "class", "left").join(whole, "class", "left").select(
        "vector",
        (F.coalesce("found", F.lit(0)) + F.col("many") - 1).alias("links"),
        F.coalesce("component", "class").alias("component"),
    )
    result = sound.join(named, "vector").select("_rid", "links", "component")
    result = scratch.save(result, "result")
    return rows.join(result, "_rid", "left").select(
        "_row", "_rid", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("component", "_rid").alias("component")
    )
