import random
from collections import Counter

import numpy as np

from pitbars.llm import minhash


def plain_set(text, size):
    words = (text or "").encode().lower().split()
    k = min(size, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def plain(rows, size=2, percent=80):
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                if rows[a][0] < rows[b][0]:
                    a, b = b, a
                root[a] = b
    return {(r[0], len(s), rows[find(k)][0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    """Copies, chains, stars whose members are too far apart from each other, and pairs on both sides of the threshold."""
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(100)]
        texts += [" ".join(base)] * (g % 3)
        texts += [edited(base, n, rng) for n in (0, 3, 4, 5, 6, 7, 8, 9) for _ in range(3)]
        chain = list(base)
        for k in range(6):
            chain[10 * k] = f"c{g}-{k}"
            texts.append(" ".join(chain))
    texts += ["one", "One", "one two", "a b", "b a", "x  y\tz", "X y\nz"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_are_those_of_all_pairs(docs):
    rows = corpus()
    got = minhash.near_duplicates(docs(rows), shingle_size=2).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == plain(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_tiles_and_partners_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "PARTNERS", 3)
    rows = corpus()[:150]
    for slots in (minhash.SLOTS, 7):
        monkeypatch.setattr(minhash, "SLOTS", slots)
        got = minhash.near_duplicates(docs(rows), shingle_size=2).collect()
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == plain(rows)


def template(n):
    """Documents of one template and words of their own: similarity 0.6, in large buckets together."""
    common = " ".join(f"t{k}" for k in range(121))
    return [(i, common + " " + " ".join(f"own{i}-{k}" for k in range(38))) for i in range(n)]


def test_a_template_raises_pairs_in_proportion_to_its_documents(docs, monkeypatch):
    sent = []
    confirm = minhash.Finder.confirm

    def counted(self, pairs, sets):
        sent[-1] += pairs.count()
        return confirm(self, pairs, sets)

    monkeypatch.setattr(minhash.Finder, "confirm", counted)
    for n in (250, 500, 1000):
        sent.append(0)
        got = minhash.near_duplicates(docs(template(n)), shingle_size=2).collect()
        assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)
    assert sent[2] < 20 * 1000 and sent[2] < 2.5 * sent[1] < 6.5 * sent[0]


def near_copies(n):
    """Documents of one text with 6 of 30 spots changed in a known way, 4 of them never alike in two: similarity up to 0.784."""
    rng = random.Random(8)
    spots = []
    while len(spots) < n:
        new = frozenset(rng.sample(range(30), 6))
        if all(len(new & x) < 4 for x in spots):
            spots.append(new)
    return [(i, " ".join(f"alt{k}" if k % 3 == 1 and k // 3 in x else f"w{k}" for k in range(100))) for i, x in enumerate(spots)]


def test_near_copies_below_the_threshold_raise_rows_in_proportion(docs, monkeypatch):
    sent, links = [], []
    confirm, large = minhash.Finder.confirm, minhash.Finder.large

    def counted(self, pairs, sets):
        sent[-1] += pairs.count()
        return confirm(self, pairs, sets)

    def told(self, *a):
        out = large(self, *a)
        links[-1] += out.count()
        return out

    monkeypatch.setattr(minhash.Finder, "confirm", counted)
    monkeypatch.setattr(minhash.Finder, "large", told)
    monkeypatch.setattr(minhash, "SMALL", 4)
    for n in (100, 200, 400):
        sent.append(0)
        links.append(0)
        got = minhash.near_duplicates(docs(near_copies(n)), shingle_size=2).collect()
        assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)
    assert sent[2] < 50 * 400 and sent[2] < 2.5 * sent[1] < 6.5 * sent[0]
    assert links == [0, 0, 0]


def test_links_among_near_copies_are_found_in_tiles(docs, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "TILE", 32)
    monkeypatch.setattr(minhash, "HELD", 2000)
    rows, rng = near_copies(150), random.Random(9)
    rows += [(1000 + i, edited(t.split(), rng.randrange(3, 9), rng)) for i, t in rows[::5]]
    got = minhash.near_duplicates(docs(rows), shingle_size=2).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == plain(rows)


def test_rows_of_hashes():
    held = minhash.Postings([np.array(x, np.int64) for x in ([1, 5, 9], [], [5], [-7, 9])])
    assert held.shared(np.array([5, 9, 10])).tolist() == [2, 0, 1, 1]
    assert held.shared(np.array([2, 99])).tolist() == [0, 0, 0, 0]
    assert minhash.Postings([np.zeros(0, np.int64)]).shared(np.array([1])).tolist() == [0]


def test_sets_at_the_threshold_share_a_shingle_of_their_prefixes():
    rng = np.random.default_rng(3)
    counts = rng.integers(2, 50, 1 << 10).astype(np.uint32)
    for n in (1, 2, 5, 37, 200, 1000):
        for _ in range(20):
            keys = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            gone = n // 9  # n - gone of n + gone shingles are shared: at least 0.8
            a, b = (minhash.prefix(x, counts, 80) for x in (keys[:n], keys[gone : n + gone]))
            assert np.intersect1d(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")).size
            hits = minhash.Shared([a, b""], [b"", b, a])(range(2))
            assert hits.tolist() == [[False, True, True], [False] * 3]


def test_kept_rows(docs):
    rows = corpus()[:120]
    kept = minhash.keep_one(docs(rows + rows[:5]), shingle_size=2)
    assert kept.columns == docs([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in plain(rows)})


def test_estimate_follows_similarity():
    rng = np.random.default_rng(0)
    for s in (0.2, 0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, int(4000 * s)).astype(np.uint64)
        rest = rng.integers(0, 2**63, 2 * (4000 - len(both))).astype(np.uint64)
        a, b = (np.concatenate([both, x]) for x in np.split(rest, 2))
        true = len(both) / len(np.union1d(a, b))
        sig = [np.frombuffer(minhash.pack_bits(minhash.minima(x, 2000), 2), np.uint64)[None] for x in (a, b)]
        assert abs(minhash.estimate(*sig, 2000, 2)[0] - true) < 0.06


def test_odd_rows(docs, odd):
    got = minhash.near_duplicates(docs(odd), shingle_size=2).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by_id[k]["n_shingles"] for k in range(5)] == [0, 0, 0, 0, 1]
    assert by_id[0]["component_id"] == 0 and by_id[11]["component_id"] == 10 and not by_id[11]["kept"]
    assert minhash.near_duplicates(docs([])).collect() == []


def test_null_ids_and_ids_of_two_texts_lose_nothing(docs):
    words = lambda p, n=40: " ".join(f"{p}{k}" for k in range(n))
    a, b, c, d, e = map(words, "abcde")
    rows = [(None, a), (None, b), (None, b + " tail"), (1, c), (1, d), (2, d + " tail"), (None, c + " tail"), (3, e), (3, e)]
    kept = [(r["doc_id"], r["text"]) for r in minhash.keep_one(docs(rows), shingle_size=2).collect()]
    assert len(kept) == 5 and {(None, a), (1, c), (1, d), (3, e)} < set(kept)
    assert len({(None, b), (None, b + " tail")} & set(kept)) == 1
    got = [tuple(r) for r in minhash.near_duplicates(docs(rows), shingle_size=2).collect()]
    assert (2, 40, 1, False) in got and (None, 40, 1, False) in got and (None, 39, None, True) in got
    assert sum(r[0] is None and r[3] for r in got) == 2
