import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

from pitbars.llm import alignment

BITS = ["a", "b", "the", "The", " ", " ", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "語", "ﬁ", "'s", ".", ",", "!!", "12", "<s>",
        "</s>", "<|endoftext|>", "\r\n", "\x1c", "　", "ü", "🙂", "\x00", "İ", "don't", "x.", " "]


@pytest.fixture(scope="module")
def know():
    return alignment.Aligner()


def plain(know, text):
    """Tokens, groups and links of one text, by the libraries on the whole text; None where it has none."""
    spaced = " " + (text or "")
    a, b = know.a.encode(spaced, add_special_tokens=False).ids, know.b.encode(text or "")
    in_a, in_b = [know.bytes_a[i] for i in a], [know.bytes_b[i] for i in b]
    if not text or b"".join(in_a) != spaced.encode() or b"".join(in_b) != spaced.encode():
        return None
    end_a, end_b = list(accumulate(map(len, in_a))), list(accumulate(map(len, in_b)))
    both = sorted(set(end_a) & set(end_b))
    groups = [([], []) for _ in both]
    for side, (ids, ends) in enumerate(((a, end_a), (b, end_b))):
        for i, e in zip(ids, ends, strict=True):
            groups[bisect_left(both, e)][side].append(i)
    told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return len(a), len(b), len(groups), told, Counter((x, y) for xs, ys in groups for x in xs for y in ys)


def plain_rows(know, rows):
    each = [plain(know, t) for _, t in rows]
    held = Counter(p for e in each if e for p in e[4])
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), e in zip(rows, each, strict=True):
        if e is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, told, links = e
        n_best = sum(n for p, n in links.items() if held[p] == best[p[0]])
        total = sum(n * held[p] for p, n in links.items())
        out.append((i, n_a, n_b, n_groups, sum(links.values()), n_best, total, hashlib.sha256(told.encode()).hexdigest()))
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_segments_are_aligned_like_whole_texts(know):
    small = alignment.Aligner(limit=50)
    rng = random.Random(7)
    plainer = [" ".join(rng.choice(["word", "Wörter,", "it's", "2024", "日本語", "\nline", " gap", "x"]) for _ in range(9)) for _ in range(800)]
    texts = random_texts(1200, 1) + plainer
    assert sum(small.segments(t)[1] for t in texts) < 0.5 * len(texts)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        small.room()
        found = small.numbers(part)
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        own, pair, n = small.links(np.array([x for f in found for x in f], np.int64), owner)
        for k, (text, numbers) in enumerate(zip(part, found, strict=True)):
            want = plain(know, text)
            if want is None:
                assert numbers == []
                continue
            sums = [int(sum(c.values[x] for x in numbers)) for c in small.figures]
            assert sums == [*want[:3], sum(want[4].values())], repr(text)
            assert ";".join(small.strings[x] for x in numbers) == want[3]
            got = {(p >> 24, p & 0xFFFFFF): c for p, c in zip(pair[own == k].tolist(), n[own == k].tolist(), strict=True)}
            assert got == dict(want[4])


def test_links_are_expanded_in_bounded_parts(know, monkeypatch):
    texts = random_texts(60, 3)
    want = [plain(know, t) for t in texts]
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 3)
    fresh = alignment.Aligner()
    found = fresh.numbers(texts)
    own, pair, n = fresh.links(
        np.array([x for f in found for x in f], np.int64), np.repeat(np.arange(len(found)), [len(f) for f in found])
    )
    for k, e in enumerate(want):
        got = {(p >> 24, p & 0xFFFFFF): c for p, c in zip(pair[own == k].tolist(), n[own == k].tolist(), strict=True)}
        assert got == (dict(e[4]) if e else {})


@pytest.mark.parametrize("frequent", [1, 40, 200000])
def test_rows_against_plain_version(docs, odd, know, frequent):
    texts = random_texts(60, 5)
    rows = [*odd, *enumerate(texts, 100), *((300 + k, texts[0]) for k in range(40)), (500, "a▁b"), (501, "plain words here")]
    got = alignment.align(docs(rows), frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_rows(know, rows))


def test_groups_as_text_and_no_rows(docs, know):
    from pyspark.sql import functions as F

    texts = docs([(1, "Some words")]).select(F.lit(b"d").alias("digest"), "text", F.lit(1).cast("long").alias("copies"))
    assert alignment.align_distinct(texts, with_groups=True).collect()[0]["groups"] == plain(know, "Some words")[3]
    assert alignment.align(docs([])).collect() == []
