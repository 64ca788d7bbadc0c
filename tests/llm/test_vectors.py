import random

import numpy as np
import pytest

from pitbars.llm import embedding_dedup as ed


def plain(rows, least=0.9):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in rows]
    near = [
        [j for j in range(len(rows)) if i != j and a is not None and units[j] is not None and len(a) == len(units[j]) and a @ units[j] >= least]
        for i, a in enumerate(units)
    ]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(len(rows))]
    smallest = {}
    for i, c in enumerate(comp):
        smallest[c] = min(smallest.get(c, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(near[i]), smallest[comp[i]], smallest[comp[i]] == rows[i][0]) for i in range(len(rows)))


def corpus(dim=12, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dim))
    rows = [c + rng.normal(size=dim) * s for c in centre for s in (0, 0.05, 0.1, 0.15, 0.2, 0.3) for _ in range(6)]
    rows += [rng.normal(size=dim) for _ in range(60)]
    rows += [rows[0]] * 3 + [rows[7] * 2]
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    return [(k, rows[i].astype(np.float32).tolist()) for k, i in enumerate(order)]


@pytest.mark.parametrize("tile,blocks,grid", [(8192, 4, 2), (7, 3, 1), (20, 6, 2)])
def test_links_are_those_of_all_pairs(spark, tile, blocks, grid):
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ed.near_vectors(df, tile=tile, blocks=blocks, grid=grid).collect())) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
        (8, [1.0, -0.0]), (9, [1e30, 1e-30]), (10, [1.0, 0.0, 0.0]), (11, [3.0]), (12, [4.0]), (13, [-4.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, key string, id int")
    assert sorted(map(tuple, ed.near_vectors(df).collect())) == plain(rows)
    doubles = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ed.near_vectors(doubles).collect())) == plain(rows)
    assert ed.near_vectors(df.limit(0)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(r["n_links"] for r in ed.near_vectors(same).collect()) == [2, 2, 2]


def test_labels_merge():
    label = ed.merge_labels(np.arange(6), np.array([5, 4, 1]), np.array([4, 2, 0]))
    assert label.tolist() == [0, 0, 2, 3, 2, 2]
