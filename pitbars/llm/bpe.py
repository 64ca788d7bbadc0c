"""Byte-level BPE from a file of ranks, without a tokenizer library: two-tier lookup.

First tier: a minimal perfect hash over the vocabulary tells in one probe whether a whole pre-token is a token. Second
tier: what misses is merged from its bytes, kept as a linked list, with a heap of neighbouring pairs by rank (equal
ranks: leftmost first). Decoding joins the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.llm.common import over_batches
from pitbars.llm.tokens import Remembered, vocabulary_file


class PerfectHash:
    """Minimal perfect hash by displacement: a key's bucket names the seed that sends it to a slot of its own.

    ``find`` needs one lookup of the seed and one comparison with the key kept in the slot.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = max(1, len(keys))
        self.n_buckets = max(1, -(-len(keys) // per_bucket))
        first = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        buckets: dict[int, list[int]] = {}
        for k, b in enumerate((first % np.uint64(self.n_buckets)).tolist()):
            buckets.setdefault(b, []).append(k)
        self.seeds = [0] * self.n_buckets
        self.slots: list[int] = [-1] * self.n
        hashes, taken = first.tolist(), self.slots
        free: int = 0
        for b in sorted(buckets, key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) == 1:  # the rest go to free slots, named outright by a negative seed
                while taken[free] >= 0:
                    free += 1
                taken[free], self.seeds[b] = own[0], -free - 1
                continue
            seed = 1
            while True:
                got = [self.place(hashes[k], seed) for k in own]
                if len(set(got)) == len(got) and all(taken[x] < 0 for x in got):
                    break
                seed += 1
            for k, x in zip(own, got, strict=True):
                taken[x] = k
            self.seeds[b] = seed
        self.keys = [keys[k] if k >= 0 else None for k in self.slots]

    def place(self, h: int, seed: int) -> int:
        h = (h ^ seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (h ^ h >> 29) % self.n

    def find(self, key: bytes) -> int:
        """Position of ``key`` in the list given, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.n_buckets]
        at = -seed - 1 if seed < 0 else self.place(h, seed) if seed else 0
        return self.slots[at] if self.keys[at] == key else -1


class BytePairs:
    """A vocabulary of ranks (token bytes to id) with the pattern that splits text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        tokens = list(ranks)
        self.whole = PerfectHash(tokens)
        self.ids = [ranks[t] for t in tokens]
        self.bytes_of = {i: t for t, i in ranks.items()}

    def encode_token(self, token: bytes) -> list[int]:
        """Ids of one pre-token."""
        at = self.whole.find(token)
        return [self.ids[at]] if at >= 0 else self.merge(token)

    def merge(self, token: bytes) -> list[int]:
        """Merge linked bytes, always the pair of least rank, the leftmost of equals."""
        ranks, n = self.ranks, len(token)
        end = list(range(1, n + 1))  # a part starts at k and ends at end[k]; 0 where a part was swallowed
        back = list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            r = ranks.get(token[k : k + 2])
            if r is not None:
                heap.append((r, k, k + 2))
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            mid = end[k]
            if not mid or mid >= n or end[mid] != stop:  # one of the two has changed
                continue
            end[k], end[mid] = stop, 0
            if stop < n:
                back[stop] = k
                r = ranks.get(token[k : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, k, end[stop]))
            left = back[k]
            if left >= 0:
                r = ranks.get(token[left:stop])
                if r is not None:
                    heapq.heappush(heap, (r, left, stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[token[k : end[k]]])
            k = end[k]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for t in self.split.findall(text) for i in self.encode_token(t.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load(file: str | None = None, pattern: str | None = None) -> BytePairs:
    """Read a file of ranks: a line holds a token in base64 and its rank."""
    import public_tokenizers

    with open(file or vocabulary_file("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return BytePairs(ranks, pattern or public_tokenizers.PATTERN)


Encoder = Callable[[list[str]], list[np.ndarray]]
_READY: dict[tuple, tuple[BytePairs, Encoder]] = {}


def coder(file: str | None = None, pattern: str | None = None) -> tuple[BytePairs, Encoder]:
    """The vocabulary of a worker process, and its encoder of texts, which remembers a bounded number of pieces.

    Texts are only cut into pieces where the library's pattern cuts; with another pattern each text is encoded whole.
    """
    if (file, pattern) not in _READY:
        pairs = load(file, pattern)
        each = lambda new: [pairs.encode(p) for p in new]
        whole = lambda texts: [np.array(ids, "<u4") for ids in each(texts)]
        _READY[file, pattern] = pairs, whole if pattern else Remembered(each, "<u4")
    return _READY[file, pattern]


def encode_texts(
    docs: DataFrame,
    file: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode and decode whole texts: id, n_tokens, ids_sha256, decoded_sha256 (and the ids and decoded text).

    A null text counts as empty: no ids, the digests of nothing. Any text is taken whole; rows that share an id give a row
    each, a null id stays null, an empty table gives no rows. Only the two named columns are read.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        pairs, encoder = coder(file)
        size = max(pairs.bytes_of, default=-1) + 1
        decimal = [str(i) for i in range(size)]
        tokens = [pairs.bytes_of.get(i, b"") for i in range(size)]
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            out: dict[str, list] = {"id": part.column(0), "n": [], "sha": [], "back": [], "ids": [], "text": []}
            for ids in encoder([x or "" for x in part.column(1).to_pylist()]):
                ids = ids.tolist()
                decoded = b"".join([tokens[i] for i in ids])
                out["n"].append(len(ids))
                out["sha"].append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                out["back"].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
                    out["text"].append(decoded.decode(errors="replace"))
            if not with_ids:
                del out["ids"], out["text"]
            yield out

    schema = "id long, n long, sha string, back string" + ", ids array<long>, decoded string" * with_ids
    rows = over_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        F.col("sha").alias("ids_sha256"),
        F.col("back").alias("decoded_sha256"),
        *(["ids", "decoded"] if with_ids else []),
    )
