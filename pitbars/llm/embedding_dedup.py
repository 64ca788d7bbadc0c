"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors, cosine >= c means a squared distance of at most 2 - 2c. After a rotation (the principal axes of all rows)
the coordinates are dealt into blocks, and the squared-distance budget is split over the blocks in proportion to their
variance: a pair within the whole budget is within the budget of at least one block. So each block is joined by
range on its own, which is cheap in few dimensions: cells of a grid over its first axes, as wide as the radius, meet
themselves and half of their neighbours. Every pair inside a block's budget is a candidate and is checked on the
whole vectors in double precision, in the same task; a pair that several blocks find counts only in the block
where it is closest for its budget. Tasks return sums of links and stars of components, never pairs.

A cell with many rows is cut into tiles and every two tiles meet in a task of their own. Equal vectors are one class with a
multiplicity before any join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.llm.common import Workspace, components, over_batches

#: Rows of a cell that one task takes against as many others.
TILE = 8192
BLOCKS, GRID = 8, 2
_SLACK = 1e-9


def merge_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after nodes x[i] and y[i] are joined: the smallest label of each group."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def read_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, dim, key, vec): vec holds the values as little-endian doubles or floats (as the column has them); key is a
    digest of them, null where the vector can't link."""
    width = 4 if dict(vectors.dtypes)[vec_col] == "array<float>" else 8

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        out: dict[str, object] = {"row": batch.column(0), "id": batch.column(1), "dim": [], "key": [], "vec": []}
        for v in batch.column(2).to_pylist():
            data = None
            if v is not None and all(x is not None for x in v):
                x = np.array(v, f"<f{width}") + 0.0  # -0.0 becomes 0.0
                if len(x) and np.isfinite(x).all() and x.any():
                    data = x.tobytes()
            out["dim"].append(len(data) // width if data else None)
            out["key"].append(hashlib.md5(data).digest() if data else None)
            out["vec"].append(data)
        yield out

    slim = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.col(vec_col).cast("array<float>" if width == 4 else "array<double>").alias("vec"),
    )
    return over_batches(slim, run, "row long, id long, dim int, key binary, vec binary")


def unit_rows(data: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that no square overflows."""
    flat = b"".join(data)
    x = np.frombuffer(flat, f"<f{len(flat) // (dim * len(data))}").reshape(len(data), dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(classes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns) and variances, largest first, over all rows: the sums are added up by Spark, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = unit_rows(batch.column(0).slice(at, 4096).to_pylist(), dim)
                x = np.column_stack([x, np.ones(len(x))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    sums = classes.select("vec").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dim + 1) ** 2)
    for r in sums:  # (dim + 1)^2 numbers
        total[r["k"]] = r["v"]
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    values, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, ::-1], np.maximum(values[::-1], 0)


def deal_blocks(variance: np.ndarray, blocks: int) -> list[list[int]]:
    """Axes to blocks there and back again, so that blocks get alike variances; blocks without variance are left out."""
    out: list[list[int]] = [[] for _ in range(blocks)]
    for k in range(len(variance)):
        turn, at = divmod(k, blocks)
        out[blocks - 1 - at if turn % 2 else at].append(k)
    return [b for b in out if b and variance[b].sum() > 1e-12 * max(variance.sum(), 1e-300)]


def join_blocks(ws: Workspace, classes: DataFrame, dim: int, least: float, blocks: int, grid: int, tile: int) -> DataFrame:
    """(id, links, root) from every task: links weighted by multiplicity, root the smallest id joined to in the task."""
    axes, variance = principal_axes(classes, dim)
    dealt = deal_blocks(variance, min(blocks, max(1, dim // 2)))
    if not dealt:  # no two vectors of this length differ
        return classes.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root")).limit(0)
    share = np.array([variance[b].sum() for b in dealt])
    budget = (2 - 2 * least) * share / share.sum()
    radius = np.sqrt(budget) * (1 + 1e-6) + 1e-9
    near = [(0, 1), (1, -1), (1, 0), (1, 1)]

    def place(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        """The cell of each row in every block, as the cell's own and as a neighbour of four others."""
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            ids, n = np.array(part.column(0).to_pylist(), np.int64), part.num_rows
            x = unit_rows(part.column(1).to_pylist(), dim) @ axes
            out: dict[str, list] = {c: [] for c in ("id", "block", "cx", "cy", "home")}
            for b, own in enumerate(dealt):
                cell = np.zeros((n, 2), np.int64)
                g = min(grid, len(own))
                cell[:, :g] = np.floor(x[:, own[:g]] / radius[b])
                for home, (dx, dy) in ((1, (0, 0)), *((0, o) for o in near)):
                    if home or g == 2 or (dx, dy) == (1, 0):
                        out["id"].append(ids)
                        out["block"].append(np.full(n, b))
                        out["cx"].append(cell[:, 0] - dx)
                        out["cy"].append(cell[:, 1] - dy)
                        out["home"].append(np.full(n, home))
            yield {k: np.concatenate(v) for k, v in out.items()}

    placed = ws.table(over_batches(classes.select("id", "vec"), place, "id long, block int, cx int, cy int, home int"), "placed")
    cell = ["block", "cx", "cy"]
    tiles = placed.groupBy(*cell).agg(
        F.ceil(F.sum("home") / F.lit(tile)).cast("int").alias("own"),
        F.ceil(F.sum(1 - F.col("home")) / F.lit(tile)).cast("int").alias("others"),
    ).where("own > 0")
    numbered = placed.join(tiles, cell).withColumn("h", F.xxhash64("id", F.lit(17)))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own, others = F.col("own"), F.col("others")
    home_tile, other_tile = (F.pmod("h", F.greatest(c, F.lit(1)).cast("long")).cast("int") for c in (own, others))
    home = numbered.where("home = 1").withColumn("t", home_tile)
    task = lambda df, kind, i, j: df.select("id", *cell, F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), "home", "t")
    t, k = F.col("t"), F.col("k")
    inside = task(home.withColumn("k", F.explode(upto(own))), 0, F.least(t, k), F.greatest(t, k))
    left = task(home.withColumn("k", F.explode(upto(others))), 1, t, k)
    right = task(numbered.where("home = 0").withColumn("t", other_tile).withColumn("k", F.explode(upto(own))), 1, k, t)
    rows = inside.union(left).union(right).join(classes.select("id", "vec", "m"), "id")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, b = int(pdf["kind"].iat[0]), int(pdf["block"].iat[0])
        side = pdf["t"] == pdf["i"] if kind == 0 else pdf["home"] == 1
        other = pdf["t"] == pdf["j"] if kind == 0 else pdf["home"] == 0
        lefts, rights = pdf[side], pdf[other]
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "links", "root")})
        if not len(lefts) or not len(rights):
            return empty
        own_pairs = kind == 0 and pdf["i"].iat[0] == pdf["j"].iat[0]
        u, v = unit_rows(list(lefts["vec"]), dim), unit_rows(list(rights["vec"]), dim)
        ru, rv = u @ axes, v @ axes
        li, ri = lefts["id"].to_numpy(), rights["id"].to_numpy()
        lm, rm = lefts["m"].to_numpy(), rights["m"].to_numpy()
        lc, rc = np.zeros(len(li), np.int64), np.zeros(len(ri), np.int64)
        ids, at = np.unique(np.concatenate([li, ri]), return_inverse=True)
        label, la, ra = np.arange(len(ids)), at[: len(li)], at[len(li) :]
        ub, vb = ru[:, dealt[b]], rv[:, dealt[b]]
        vv = np.einsum("ij,ij->i", vb, vb)
        for k in range(0, len(u), 256):
            a = ub[k : k + 256]
            # squared distance within the block up to rounding, by one product; the exact check follows
            loose = a @ (-2 * vb.T)
            loose += vv
            x, y = np.nonzero(loose <= (budget[b] + _SLACK) - np.einsum("ij,ij->i", a, a)[:, None])
            x += k
            if own_pairs:
                x, y = x[li[x] < ri[y]], y[li[x] < ri[y]]
            for s in range(0, len(x), 65536):
                p, q = x[s : s + 65536], y[s : s + 65536]
                linked = np.einsum("ij,ij->i", u[p], v[q]) >= least
                p, q = p[linked], q[linked]
                if len(p):
                    gap = (ru[p] - rv[q]) ** 2
                    by_block = np.stack([gap[:, o].sum(axis=1) / t for o, t in zip(dealt, budget, strict=True)])
                    here = by_block.argmin(axis=0) == b
                    p, q = p[here], q[here]
                    lc += np.bincount(p, rm[q], len(li)).astype(np.int64)
                    rc += np.bincount(q, lm[p], len(ri)).astype(np.int64)
                    label = merge_labels(label, la[p], ra[q])
        links = np.bincount(la, lc, len(ids)).astype(np.int64) + np.bincount(ra, rc, len(ids)).astype(np.int64)
        got = links > 0
        return pd.DataFrame({"id": ids[got], "links": links[got], "root": ids[label][got]})

    # a named count: the few bytes hold much work, which Spark would fold into one task
    tasks = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt_out = rows.repartition(tasks, *cell, "kind", "i", "j")
    return dealt_out.groupBy(*cell, "kind", "i", "j").applyInPandas(meet, "id long, links long, root long")


def near_vectors(
    vectors: DataFrame,
    least: float = 0.9,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    blocks: int = BLOCKS,
    grid: int = GRID,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Rows link when their cosine is at least ``least``, in double precision. A vector that is null, empty, zero, or holds a
    null or non-finite component links with nothing. Vectors of different lengths never link; each length is joined by
    itself (a table has few). n_links counts other rows, so equal vectors count each other; kept says that the row has the
    smallest id reachable. Rows that share an id are rows of their own, and one class in what they reach. A row with a null
    id has a null component unless an equal vector has an id. An empty table gives no rows. Only the two named
    columns are read.
    """
    ws = Workspace(vectors.sparkSession, "vectors")
    rows = ws.table(read_vectors(vectors, id_col, vec_col), "rows")
    classes = ws.table(
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.min("id").alias("id"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count("*").alias("m"))
        .where("id is not null")
        # a class has a number of its own (fixed by the table written): an id may stand for two different vectors
        .select("key", "dim", "vec", "m", F.col("id").alias("least_id"), F.monotonically_increasing_id().alias("id")),
        "classes",
    )
    found = None
    for r in classes.select("dim").distinct().collect():
        one = join_blocks(ws, classes.where(F.col("dim") == r["dim"]), r["dim"], least, blocks, grid, tile)
        found = one if found is None else found.union(one)
    if found is None:
        found = rows.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root")).limit(0)
    found = ws.table(found, "found")
    joined = components(ws, found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.select("key", "id", "m", "least_id")
        .join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        .join(joined, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    of_class = ws.table(of_class, "of_class")
    smallest = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_key = of_class.join(smallest, "component").select(
        "key", (F.coalesce("links", F.lit(0).cast("long")) + F.col("m") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("id", "key").join(by_key, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
