import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitbars.llm import bpe, packing, token_store, tokens
from pitbars.llm.common import Workspace

LETTERS = "ab é1'.,  \n\n\t  !s日x\x1c "


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def by_ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(16))) for _ in range(n)]


def test_pieces_join_and_encode_like_the_library(library):
    encoder = tokens.text_encoder()
    for text in random_texts(4000, 1):
        assert "".join(tokens.pieces(text)) == text
        assert encoder([text])[0].tolist() == library(text), repr(text)


def test_memory_that_overflows_changes_nothing(library):
    encoder = tokens.text_encoder(special=False)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    library = lambda text: t.encode(text, add_special_tokens=False).ids
    small = tokens.Remembered(encoder.encode, encoder.dtype, limit=5)
    texts = random_texts(300, 2)
    assert [x.tolist() for x in small(texts)] == [library(t) for t in texts]


def test_added_tokens_are_the_library_default(library):
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a<|endoftext|", " <|endoftext|> "):
        assert tokens.text_encoder()([text])[0].tolist() == library(text), text
    assert library("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert 50256 not in tokens.text_encoder(special=False)(["a <|endoftext|> b"])[0]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert tokens.text_encoder(path)(["Some words, two  blanks"])[0].tolist() == t.encode(
        "Some words, two  blanks", add_special_tokens=False
    ).ids


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=6))
def test_values_round_trip(lists):
    values, counts = np.array(sum(lists, []), np.uint32), np.array([len(x) for x in lists], np.int64)
    control, data, control_ends, data_ends = token_store.encode_values(values, counts)
    assert len(control) == sum(-(-len(x) // 4) for x in lists)
    assert len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
    assert token_store.decode_values(control, data, counts).tolist() == values.tolist()
    for k, x in enumerate(lists):
        lo = (control_ends[k - 1], data_ends[k - 1]) if k else (0, 0)
        one = control[lo[0] : control_ends[k]], data[lo[1] : data_ends[k]]
        assert token_store.decode_values(*one, [len(x)]).tolist() == x


def test_store_returns_every_id_in_order(spark, docs, odd, library):
    path = Workspace(spark, "test").path("store")
    rows = [r for r in odd]
    token_store.write_tokens(docs(rows), path, block_tokens=50)
    got = token_store.read_tokens(spark, path, with_ids=True).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, (*library(t), 0)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r["n"] for r in ranks] == sorted((r["n"] for r in ranks), reverse=True)


def test_store_of_nothing(spark, docs):
    path = Workspace(spark, "test").path("store")
    token_store.write_tokens(docs([]), path)
    assert token_store.read_tokens(spark, path).collect() == []


def plain_best_fit(lengths, size):
    rooms, out = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        out.append(min(fits) if fits else size)
        if fits:
            rooms.remove(min(fits))
        rooms.append(out[-1] - n)
    return out, sum(r > 0 or True for r in rooms)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    for size in (7, 64, 100):
        lengths = sorted((rng.randrange(1, size + 1) for _ in range(200)), reverse=True)
        window, offset = packing.best_fit(np.array(lengths), size)
        rooms, n = plain_best_fit(lengths, size)
        assert (size - offset).tolist() == rooms
        assert window.max() + 1 == n


@pytest.mark.parametrize("group_rows", [4, 10000])
def test_packing_holds_each_id_once(docs, odd, library, group_rows):
    got = packing.pack(docs(odd), size=16, group_rows=group_rows, with_ids=True).collect()
    by_sequence = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 16
    whole = Counter()
    for i, t in odd:
        whole.update((i, k, x) for k, x in enumerate([*library(t), 0]))
    assert Counter((r["doc_id"], r["start"] + k, x) for r in got for k, x in enumerate(r["ids"])) == whole
    assert all(r["doc_tokens"] >= r["start"] + r["length"] for r in got)
    assert packing.pack(docs([])).collect() == []


def test_repeated_rows_spread_over_groups(docs, library):
    rows = [(5, "always the same words", None, "a")] * 3000 + [(k, f"text {k}", None, "a") for k in range(100, 400)]
    got = packing.pack(docs(rows), size=64, group_rows=100, with_ids=False).collect()
    assert Counter(r["doc_id"] for r in got)[5] == 3000
    # a window of 64 holds as many of the copies as fit, in every group; one hot group alone would fill as well but in one task
    sizes = Counter()
    for r in got:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 64 and sorted(sizes) == list(range(len(sizes)))
    many = packing.dealt(docs(rows), 60).groupBy("group").count().collect()
    assert max(r["count"] for r in many) < 3 * len(rows) / 60


def test_perfect_hash_finds_keys_and_nothing_else():
    keys = [str(k).encode() for k in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(5000)) and [h.find(k) for k in keys] == list(range(5000))
    assert all(h.find(str(k).encode()) == -1 for k in range(5000, 9000)) and bpe.PerfectHash([]).find(b"a") == -1


def test_merges_like_the_library(by_ranks):
    pairs = bpe.load()
    for text in [*random_texts(3000, 4), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 40, "internationalization " * 9]:
        assert pairs.encode(text) == by_ranks.encode_ordinary(text), repr(text)
        assert pairs.decode(pairs.encode(text)) == text.encode()


@pytest.mark.parametrize("pattern", [r"\S+\s*", r"[\s\S]{1,3}"])
def test_other_patterns_encode_whole_texts(pattern):
    pairs, encoder = bpe.coder(None, pattern)
    texts = ["some words, two  blanks\nand a line", "don't 12 é"]
    assert [x.tolist() for x in encoder(texts)] == [pairs.encode(t) for t in texts]


def test_encoded_texts(docs, odd, by_ranks):
    got = bpe.encode_texts(docs(odd)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in odd:
        ids = by_ranks.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.encode_texts(docs([])).collect() == []
