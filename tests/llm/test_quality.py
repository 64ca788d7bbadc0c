import random
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from pitbars.llm import quality


def plain_repeats(words, size=8):
    seen = Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    return len({k + j for k in range(len(words) - size + 1) if seen[tuple(words[k : k + size])] > 1 for j in range(size)})


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert quality.repeated_words(words) == plain_repeats(words)


def corpus():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(120):
        lines = [" ".join(rng.sample(words, 30)) for _ in range(2)]
        if k < 60:
            lines.insert(1, "Subscribe   to OUR letter now")
        rows.append((k, "\n".join(lines), None, "a" if k % 2 else "b"))
    rows += [(200 + k, f"only {k} " + "\n".join(["shared text " * 12] * 1), None, "a") for k in range(3)]
    rows += [(300 + k, "subscribe to our letter now\n" * 6 + " ".join(rng.sample(words, 25)), None, "a") for k in range(2)]
    copied = " ".join(rng.sample(words, 40))
    return rows + [(400 + k, copied, None, "b") for k in range(50)]


def plain(rows, limit=10):
    norm = lambda x: " ".join(x.encode().lower().decode().split(" "))
    norm = lambda x: " ".join(x.lower().split())
    by_line = {}
    for _, t, _, h in rows:
        for x in set(map(norm, t.split("\n"))) - {""}:
            by_line.setdefault((h, x), set()).add(t)
    out = {}
    for i, t, _, h in rows:
        keep = [x for x in t.split("\n") if not norm(x) or len(by_line[h, norm(x)]) <= limit]
        words, left = t.split(), sum(len(x.split()) for x in keep)
        failed = len(words) < 20 or 100 * plain_repeats(words) > 30 * len(words)
        out[i] = (len(words), len(words) - left, failed, not failed and 2 * left >= len(words), "\n".join(keep))
    return out


def test_against_plain_count(docs):
    rows = corpus()
    want = plain(rows)
    got = quality.judge(docs(rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed_words"], r["base_failed"], r["kept"]) for r in got} == {
        i: w[:4] for i, w in want.items()
    }
    assert not want[300][3] and want[400][3] and want[0][1] == 5
    clean = quality.clean(docs(rows))
    assert clean.columns == docs([]).columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()} == {
        i: (w[4], len(w[4])) for i, w in want.items() if w[3]
    }


def test_odd_rows(docs, odd):
    got = quality.judge(docs(odd)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd)
    assert {r["doc_id"] for r in got if r["n_words"] == 0} >= {0, 1, 2, 3}
    assert quality.judge(docs([])).collect() == [] and quality.clean(docs([])).collect() == []


def test_limit_does_not_grow_with_the_host(docs):
    own = lambda k: " ".join(f"d{k}w{j}" for j in range(25))
    rows = [(k, own(k) + ("\nAll rights reserved by us" if k < 11 else "\nSeen ten times" if k < 21 else ""), None, "a") for k in range(1300)]
    got = {r["doc_id"]: r["n_removed_words"] for r in quality.judge(docs(rows)).collect()}
    assert got == {k: 5 if k < 11 else 0 for k in range(1300)}
