import random

from pitbars.llm.common import Workspace, components


def plain(edges):
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_components_of_paths_stars_and_random_edges(spark):
    rng = random.Random(6)
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(500, k) for k in range(501, 520)] + [(7, 7), (9, 8), (8, 9), (9, 8)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in components(Workspace(spark, "test"), df).collect()}
    want = plain([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(Workspace(spark, "test"), df.limit(0)).collect() == []
