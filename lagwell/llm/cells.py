"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Equal vectors are one point with a weight. Unit centres are fitted on at most `SAMPLE` points (picked by hash); every point
has a home, the cell of the nearest centre, and visits each cell of a lower number whose bisecting plane with the home
is nearer than `MARGIN`. A pair is compared once, in the lower of its two homes, so counts add up. Two vectors of
cosine 0.95 are 0.316 apart; MARGIN = 0.316 would find all pairs, 0.12 is three standard deviations of
that distance along one of 64 directions (tests measure the recall against all pairs). Cells of more than `BLOCK` points are
cut into blocks and each pair of blocks is its own group, so a hot cell is many tasks.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null vec_id, link with
nothing and keep their rows; vectors of different lengths never link; repeated rows count as vectors of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.llm.stage import components, staged

COSINE, MARGIN, SAMPLE, BLOCK, PER_CELL, MOST_CELLS = 0.95, 0.12, 20_000, 1024, 400, 4096


def centres(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means; empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    c = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        home = np.argmax(points @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, points)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision of a list column whose lists are equally long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge vectors in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(c: np.ndarray, margin: float):
    gap = np.linalg.norm(c[:, None, :] - c[None], axis=2) if len(c) <= 512 else np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
    np.fill_diagonal(gap, 1)

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 2000):
                b = batch.slice(i, 2000)
                if not len(b):
                    continue
                lengths = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                ids, cells, homes = [], [], []
                for n in np.unique(lengths):
                    at = np.flatnonzero(lengths == n)
                    if n != c.shape[1]:
                        where, cell, home = at, np.full(len(at), -int(n)), np.ones(len(at), bool)
                    else:
                        near = _matrix(b.column(1).take(pa.array(at))) @ c.T
                        own = np.argmax(near, axis=1)
                        off = (near[np.arange(len(at)), own][:, None] - near) / gap[own]
                        off[np.arange(len(at)), own] = 0
                        row, cell = np.nonzero((off <= margin) & (np.arange(len(c)) <= own[:, None]))
                        where, home = at[row], cell == own[row]
                    ids.append(where), cells.append(cell), homes.append(home)
                where = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(where), b.column(1).take(where), b.column(2).take(where), pa.array(np.concatenate(cells), pa.int64()), pa.array(np.concatenate(homes))],
                    ["vid", "embedding", "w", "cell", "home"])

    return run


def _labels(m: np.ndarray) -> np.ndarray:
    """Component of each vertex of a boolean symmetric matrix with a true diagonal: its smallest member."""
    label = np.arange(len(m))
    while True:
        new = np.where(m, label, len(m)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(cosine: float):
    def run(key, table):
        ids, w = table.column("vid").to_numpy(), table.column("w").to_numpy()
        home, block = table.column("home").to_numpy(), table.column("block").to_numpy()
        one, two = key[1].as_py(), key[2].as_py()
        x = _matrix(table.column("embedding"))
        m = x @ x.T >= cosine
        # home x home of the two blocks, home x visitor where the home block is the first
        left, right = home & (block == one), block == two
        pick = left[:, None] & right[None]
        if one != two:
            pick |= (home & (block == two))[:, None] & (~home & (block == one))[None]
        m &= pick | pick.T
        np.fill_diagonal(m, False)
        links = m @ w
        np.fill_diagonal(m, True)
        root = _labels(m)
        keep = (links > 0) | (root != np.arange(len(root)))
        return pa.table({"vid": ids[keep], "links": pa.array(links[keep].astype(np.int64)), "root": ids[root[keep]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, margin: float = MARGIN) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    import pyarrow.compute  # noqa: F401  used in the tasks

    fine = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    rows = vectors.select("vec_id", "embedding")
    points = staged(rows.filter(fine).groupBy("embedding").agg(F.min("vec_id").alias("vid"), F.count("*").alias("w")))
    n, dim = points.count(), points.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    k = max(1, min(MOST_CELLS, n // PER_CELL))
    if dim is None:
        c = np.zeros((1, 1))
    else:
        part = min(1.0, SAMPLE / n)
        sample = points.filter((F.size("embedding") == dim.d) & (F.pmod(F.xxhash64("vid"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)).select("embedding").toArrow()
        c = centres(_matrix(sample.column(0)), k)
    placed = staged(points.select("vid", "embedding", "w").mapInArrow(_assign(c, margin), f"vid bigint, embedding {points.schema['embedding'].dataType.simpleString()}, w bigint, cell bigint, home boolean"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocked = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")))
    pairs = F.expr("transform(sequence(0L, blocks - 1), j -> named_struct('one', least(block, j), 'two', greatest(block, j)))")
    dealt = blocked.withColumn("p", F.explode(pairs)).select("cell", "p.one", "p.two", "vid", "embedding", "w", "home", "block")
    found = staged(dealt.groupBy("cell", "one", "two").applyInArrow(_compare(cosine), "vid bigint, links bigint, root bigint"))
    label = components(found.select(F.col("vid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vid").agg(F.sum("links").alias("links"))
    out = points.select("embedding", "vid", "w").join(links, "vid", "left").join(label.withColumnRenamed("v", "vid"), "vid", "left")
    out = out.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("c", "vid").alias("component_id"))
    good = rows.filter(fine).join(out, "embedding")
    lone = rows.filter(f"NOT coalesce({fine}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.select("vec_id", "n_links", "component_id").unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
