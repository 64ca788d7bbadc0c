import random
from collections import Counter

from pyspark.sql import functions as F

from pitbars.llm import sharding
from pitbars.llm.common import Workspace


def corpus(n=997, seed=1):
    rng = random.Random(seed)
    return [(k, f"t{k}", None, rng.choice(["a", "a", "a", "b", "c", None])) for k in range(n)]


def test_shards_match_the_mixture(docs):
    got = sharding.assign(docs(corpus()), n_shards=8, rows_per_cell=50).collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    total = Counter(r["stratum"] for r in got)
    for s in sizes:
        own = Counter(r["stratum"] for r in got if r["shard"] == s)
        assert all(abs(own[k] - total[k] / 8) <= 2 for k in total)


def test_cells_do_not_change_the_result(docs):
    rows = docs(corpus(300))
    assert sorted(sharding.assign(rows, 7, rows_per_cell=11).collect()) == sorted(sharding.assign(rows, 7).collect())


def test_no_python_in_the_plan(docs):
    plan = sharding.assign(docs(corpus(20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(docs, odd):
    got = sharding.assign(docs(odd), n_shards=40).collect()
    assert sorted(r["size"] for r in got) == sorted(16 + len((t or "").encode()) for _, t in odd)
    assert all(r["slot"] == 0 for r in got) and len({r["shard"] for r in got}) == len(odd)
    assert sharding.assign(docs([])).collect() == []


def test_written_shards(spark, docs, odd):
    path = Workspace(spark, "test").path("shards")
    rows = docs(odd + corpus(60))
    shards = sharding.assign(rows, n_shards=4)
    sharding.write_shards(rows, shards, path, files=6)
    back = spark.read.parquet(path)
    assert Counter(back.select("doc_id", "text", "row").collect()) == Counter(rows.select("doc_id", "text", "row").collect())
    slots = back.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in slots)
