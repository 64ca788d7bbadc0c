import hashlib
import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pitbars.llm import runs


def plain_runs(w, least=12):
    """All maximal stretches of every period, without those that a shorter period explains."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = p
        while i < len(w):
            s = i - p
            while i < len(w) and w[i] == w[i - p]:
                i += 1
            n = i - s
            if n >= max(least, 2 * p) and not any(w[s + q : s + n] == w[s : s + n - q] for q in range(1, p)):
                out.append((s, n, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretched(rng, n, letters):
    w = [str(rng.randrange(letters)) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 4:
            s, p = rng.randrange(n), rng.randrange(1, 25)
            for i in range(s + p, min(n, s + p + rng.randrange(90))):
                w[i] = w[i - p]
    return w


def test_against_all_periods():
    rng = random.Random(1)
    for _ in range(1500):
        w = stretched(rng, rng.randrange(160), rng.choice([1, 2, 2, 3, 4, 10]))
        assert runs.find_runs(w) == plain_runs(w), w


@given(st.lists(st.sampled_from("ab"), max_size=80), st.integers(12, 30))
def test_two_words(w, least):
    assert runs.find_runs(w, least) == plain_runs(w, least)


def test_words_may_come_in_parts():
    rng = random.Random(2)
    for _ in range(100):
        w = stretched(rng, 200, 3)
        catcher = runs.SquareCatcher()
        at = 0
        while at < len(w):
            step = rng.randrange(1, 9)
            catcher.extend(w[at : at + step])
            at += step
        assert catcher.finish() == plain_runs(w)


def test_fibonacci_and_constant_words():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    assert runs.find_runs(list(b)) == plain_runs(list(b))
    assert runs.find_runs(["x"] * 30000) == [(0, 30000, 1)]
    half = ["a", "b"] * 500
    assert runs.find_runs(half + ["x"] + half) == plain_runs(half + ["x"] + half)


def test_shorter_runs_are_refused():
    with pytest.raises(ValueError):
        runs.SquareCatcher(11)


def changed(doc_id, text):
    w = runs.WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def test_rows_against_plain_version(docs, odd):
    rng = random.Random(4)
    rows = [*odd, *((k, " ".join(stretched(rng, rng.randrange(120), 3))) for k in range(20, 150))]
    rows = [r for r in rows if len(r[1] or "") < 60000]
    got = runs.text_runs(docs(rows), plant=True, with_text=True)
    want = []
    for doc_id, text in rows:
        w = changed(doc_id, text)
        all_runs = plain_runs(w)
        best = min(all_runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, n, p in all_runs for i in range(s + p, s + n)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(all_runs), *four, sha("".join(f"{s},{n},{p}\n" for s, n, p in all_runs)), sha(left), left))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(w[1] for w in want) > 60 and any(x % 10 == 0 for x in (zlib.crc32(str(k).encode()) for k in range(20, 150)))


def test_long_texts_and_no_rows(docs, odd):
    long = [r for r in odd if len(r[1] or "") >= 60000]
    assert len(runs.text_runs(docs(long)).collect()) == len(long) > 0
    assert runs.text_runs(docs([])).collect() == []
