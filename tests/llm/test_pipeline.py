import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pitbars.llm import langid, packing
from pitbars.llm.common import Workspace
from tests.llm.test_minhash import plain as components
from tests.llm.test_pii import plain as spans
from tests.llm.test_quality import plain as judged

KINDS = ("EMAIL", "IP", "CARD", "PHONE")


def corpus():
    rng = random.Random(8)
    words = {"en": ["the", "and", "with", "shall"], "fr": ["le", "étoile", "où", "chaque"]}
    rows = []
    for k in range(80):
        lang = rng.choice(sorted(words))
        w = [rng.choice(words[lang]) + rng.choice(["", f"q{rng.randrange(99)}"]) for _ in range(60)]
        rows.append((k, " ".join(w[:40]) + "\nCommon line of the source\n" + " ".join(w[40:]), lang, "s"))
    near = rows[0][1].replace("Common", "common") + " tail"
    return rows + [(90, near, "en", "s"), (91, rows[1][1], "fr", "s"), (92, "12345 678", None, "s"), (93, "", None, "s"),
                   (94, "few words", "en", "s"), (95, rows[2][1] + " mail a.b@c.example now", "en", "s"), (96, None, "en", "s")]


def test_stages_against_brute_force(spark, docs, tmp_path):
    rows = corpus()
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    start = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ws, out = Workspace(spark, "test"), [start]
    for name, stage in corpus_pipeline.STAGES:
        out.append(ws.table(stage(spark, out[-1], str(tmp_path)), name))
    text = [{r["doc_id"]: r["text"] for r in t.collect()} for t in out[:-1]]
    assert all(t.columns == start.columns for t in out[:-1])
    net = langid.fit(start.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    known = {r["doc_id"] for r in langid.predict(start, net).collect() if r["lang_pred"] != "und" and r["score"] >= 0.4}
    assert set(text[1]) == known and not known & {92, 93, 96} and known >= set(range(80))
    want = judged([(i, t, None, "s") for i, t in text[1].items()])
    assert text[2] == {i: w[4] for i, w in want.items() if w[3]} and "Common" not in text[2][5]
    assert set(text[3]) == {c for _, _, c in components(list(text[2].items()), size=5)} and not {90, 91} & set(text[3])
    for i, t in text[3].items():
        for s, k, e in reversed(spans(t)):
            t = t[:s] + f"<{KINDS[k]}>" + t[e:]
        assert text[4][i] == t
    cut = packing.cut(out[-2]).select("doc_id" if False else "id", "start", "length", "ids_crc32", "doc_tokens").collect()
    got = out[-1].collect()
    assert sorted(map(tuple, cut)) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, got))


def test_queries_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_warc", "op4_minhash", "op6_vectors", "op9_interleaving", "op10_quality"])
def test_query_matches_sql(spark, name):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables absent")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    mine = entry.queries()[name](spark, sf).toPandas().astype(object)
    sql = con.execute(entry.oracle_sql()[name]).df().astype(object)
    assert set(mine) == set(sql)
    rows = lambda df: sorted(map(repr, df[sorted(df)].where(df.notna(), None).astype(str).values.tolist()))
    assert rows(mine) == rows(sql)


def test_crc_of_ids_is_of_little_endian_words():
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0")
