import random

import numpy as np

from pitbars.llm import langid

WORDS = {"aa": ["the", "and", "shall", "with", "wholly"], "bb": ["le", "des", "étoile", "où", "chaque"], "cc": ["und", "nicht", "zwölf", "auf"]}


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 120))), lang))
    return rows


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], 5, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, live = langid.padded([b"hello wor", b"abc", b"xyzzy qq"], 9)
    y = np.array([0, 2, 1])
    _, grads = net.gradients(data, live, y)
    for k in net.w:
        at = tuple(int(rng.integers(s)) for s in net.w[k].shape)
        at = (int(data[1, 0]), at[1]) if k[0] == "x" else at
        old, e = net.w[k][at], 1e-5
        net.w[k][at] = old + e
        up = net.gradients(data, live, y)[0]
        net.w[k][at] = old - e
        down = net.gradients(data, live, y)[0]
        net.w[k][at] = old
        assert abs((up - down) / (2 * e) - grads[k][at]) < 1e-6


def test_padding_and_batches_do_not_matter():
    net = langid.Network.fresh(["a", "b"], 6, 2)
    texts = [b"short", b"x" * 700, "längerer Text ".encode() * 40, b"q"]
    together = langid.document_probabilities(net, texts, batch=3)
    alone = np.concatenate([langid.document_probabilities(net, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and np.allclose(together.sum(axis=1), 1, atol=1e-5)


def test_held_out_accuracy(docs):
    net = langid.fit(docs(corpus(300, 1)), steps=150)
    fresh = corpus(200, 2)
    got = {r["doc_id"]: r for r in langid.predict(docs(fresh), net).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in fresh]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_rows(docs, odd):
    net = langid.fit(docs(corpus(60, 3)), steps=20)
    rows = odd + [(99, "12 34 !!")]
    got = langid.predict(docs(rows), net).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {0, 1, 2, 3, 99, None}
    kept = langid.keep_known(docs(rows), net, least_score=0.0)
    assert kept.columns == docs([]).columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(
        r["doc_id"] or -1 for r in got if r["lang_pred"] != "und"
    )
    assert langid.fit(docs([])) is None and langid.predict(docs([]), net).collect() == []
    assert {r["lang_pred"] for r in langid.predict(docs(odd), None).collect()} == {"und"}


def test_sample_is_bounded_by_rows(docs):
    one_id = [(7, f"text number {k}", "aa") for k in range(5000)]
    few = [(k, f"other text {k}", "bb") for k in range(30)]
    copies = [(9, "one text", "cc")] * 2000 + [(9, f"rare text {k}", "cc") for k in range(20)]
    rows = docs(one_id + few + copies + [(None, "no id", "dd"), (1, None, "dd"), (2, "no label", None)])
    got = langid.sampled_rows(rows, "lang", "doc_id", "text", 400).collect()
    n = {x: [r["text"] for r in got if r["label"] == x] for x in ("aa", "bb", "cc", "dd")}
    assert len(got) == sum(map(len, n.values())) and {k: len(v) for k, v in n.items()} == {"aa": 400, "bb": 30, "cc": 21, "dd": 1}
    again = langid.sampled_rows(rows.repartition(7), "lang", "doc_id", "text", 400).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
