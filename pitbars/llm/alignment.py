"""Alignment of two tokenizers over a corpus: which tokens of one cover the bytes of which tokens of the other.

Texts are shuffled by their full text and each distinct text is tokenized and aligned once; its pair counts are weighted by
how many rows hold it, and the measures go back to the ids by a digest of the text. Byte offsets where tokens of both
tokenizers end cut a text into groups; every token of A is linked to every token of B in its group.

Neither tokenizer merges over the start of white space behind another character, and such a place is an end of tokens for
both. So a text falls into segments that are aligned by themselves, and a worker keeps a bounded memory of segments.

The count of a pair is the number of rows that hold it. Pairs are counted per batch of texts before the shuffle. To bring
the counts back to the texts, the most frequent pairs, a bounded number, are looked up in tasks; all others are joined by
shuffles, exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.llm.common import Workspace, over_batches
from pitbars.llm.tokens import Remembered, _byte_letters, text_encoder, vocabulary_file

#: Segments a worker remembers before it starts anew.
MEMORY = 250_000
#: Pairs that tasks look up; the others are joined.
FREQUENT = 200_000
#: Links a worker expands at once.
LINKS_AT_ONCE = 500_000
#: Bits of an id in a pair: A's id above B's.
_BITS = 24

_SEGMENT = re.compile(r"\s*\S+|\s+")
#: White space other than blank, tab and line feed behind a character: such texts are taken as one segment.
_UNUSUAL = re.compile(r"\S[^\S \n\t]")


class _Column:
    """A growing array of integers."""

    def __init__(self) -> None:
        self.held, self.n = np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(len(self.held), need - len(self.held)), np.int64)])
        self.held[self.n : need] = values
        self.n = need

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of ``n``."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _bounded(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose counts sum to ``most`` at most, or of a single item."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto
        at = upto


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Aligner:
    """Both vocabularies, and the segments seen so far with their alignments."""

    def __init__(self, file_a: str | None = None, file_b: str | None = None, limit: int = MEMORY):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.file_a = file_a or vocabulary_file("byte_bpe_50k.json")
        self.encoder = text_encoder(self.file_a, special=False)
        tokenizer = self._tokenizer()
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b or vocabulary_file("piece_bpe_32k.model"))
        letters = {c: k for k, c in _byte_letters().items()}
        self.bytes_a = [b""] * tokenizer.get_vocab_size()
        for t, i in tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)
        ]
        if max(len(self.bytes_a), len(pieces)) > 1 << _BITS:
            raise ValueError("a vocabulary has too many ids")
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.decimal = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]
        self.lead = [self.b.piece_to_id("\u2581"), self.b.piece_to_id("<0x0A>")]
        mixed = [p for p in pieces if "\n" in p or "\t" in p or "\u2581" in p.lstrip("\u2581")]
        self.cuts = not mixed and self.b.is_byte(self.lead[1]) and isinstance(self.encoder, Remembered)
        self.limit = limit
        self.marks: dict[str, list[int]] = {}
        self._forget()

    def _tokenizer(self):  # noqa: ANN202
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.file_a)
        tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        return tokenizer

    @cached_property
    def a(self):  # noqa: ANN201
        """A's tokenizer, for texts that can't be cut; most workers need none."""
        return self._tokenizer()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.strings: list[str] = []
        self.broken: set[int] = set()
        self.figures = [_Column() for _ in range(4)]  # tokens of A and B, groups, links
        self.pair, self.times, self.start, self.count = (_Column() for _ in range(4))

    def room(self) -> None:
        """Forget all segments if there are too many; numbers given before are void then."""
        if len(self.strings) > self.limit:
            self._forget()

    def _encode_a(self, segments: list[str]) -> list[list[int]]:
        """A word with one mark behind it has the ids of the word and the mark's."""
        cut = [len(s) > 2 and s[-1] in ".,;:!?" and s[-2].isalpha() for s in segments]
        ids = self.encoder.encode([s[:-1] if c else s for s, c in zip(segments, cut, strict=True)])
        for k, c in enumerate(cut):
            if c:
                mark = segments[k][-1]
                if mark not in self.marks:
                    self.marks[mark] = self.encoder.encode([mark])[0]
                ids[k] = ids[k] + self.marks[mark]
        return ids

    def _encode_b(self, segments: list[str]) -> list[list[int]]:
        """Behind a line feed a segment stands as inside a text; the blank and the feed in front are cut off again."""
        found = self.b.encode(["\n" + s for s in segments], num_threads=1)
        if any(f[:2] != self.lead for f in found):
            raise ValueError("the piece model merges over a line feed")
        return [f[2:] for f in found]

    def learn(self, segments: list[str], whole: bool = False) -> None:
        """Align segments that aren't known; a ``whole`` text starts with its blank and is no segment of another."""
        for at in range(0, len(segments), 16384):
            part = segments[at : at + 16384]
            if whole:
                ids_a = [self.a.encode(s, add_special_tokens=False).ids for s in part]
                ids_b = [self.b.encode(s[1:], num_threads=1) for s in part]
            else:
                ids_a, ids_b = self._encode_a(part), self._encode_b(part)
            self._align(part, ids_a, ids_b, whole)

    def _align(self, segments: list[str], ids_a: list[list[int]], ids_b: list[list[int]], whole: bool) -> None:
        base = len(self.strings)
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        for k, s in enumerate(segments):
            self.index["\n" + s if whole else s] = base + k  # a whole text's key is none that a cut text asks for
            data = s.encode()
            if b"".join([bytes_a[i] for i in ids_a[k]]) != data or b"".join([bytes_b[i] for i in ids_b[k]]) != data:
                self.broken.add(base + k)
                ids_a[k], ids_b[k] = [], []
        n = len(segments)
        a, b = (np.array([i for ids in x for i in ids], np.int64) for x in (ids_a, ids_b))
        seg_a, seg_b = (np.repeat(np.arange(n), [len(ids) for ids in x]) for x in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, bool)
        ends[end_a] = True
        both = end_b[ends[end_b]]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        per_a, per_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        seg = seg_a[first_a]
        groups = np.bincount(seg, minlength=n)
        decimal, told, i, k = self.decimal, [], 0, 0
        text_a, text_b = [decimal[x] for x in a.tolist()], [decimal[x] for x in b.tolist()]
        for p, q in zip(per_a.tolist(), per_b.tolist(), strict=True):
            told.append(",".join(text_a[i : i + p]) + "|" + ",".join(text_b[k : k + q]))
            i, k = i + p, k + q
        at = 0
        for g in groups.tolist():
            self.strings.append(";".join(told[at : at + g]))
            at += g
        links = np.zeros(n, np.int64)
        np.add.at(links, seg, per_a * per_b)
        for column, x in zip(
            self.figures, (np.bincount(seg_a, minlength=n), np.bincount(seg_b, minlength=n), groups, links), strict=True
        ):
            column.add(x)
        keys, times = [], []
        for lo, hi in _bounded(per_b[group_a], LINKS_AT_ONCE):
            g = group_a[lo:hi]
            c = per_b[g]
            pair = np.repeat(a[lo:hi], c) << _BITS | b[np.repeat(first_b[g], c) + _within(c)]
            key, t = _summed(np.repeat(seg_a[lo:hi], c) << 2 * _BITS | pair, np.ones(len(pair), np.int64))
            keys.append(key)
            times.append(t)
        key, t = _summed(np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64),) * 2
        count = np.bincount(key >> 2 * _BITS, minlength=n)
        self.start.add(self.pair.n + np.cumsum(count) - count)
        self.count.add(count)
        self.pair.add(key & (1 << 2 * _BITS) - 1)
        self.times.add(t)

    def segments(self, text: str) -> tuple[list[str], bool]:
        """The segments of a text with its blank in front, or the text itself, where it can't be cut."""
        text = " " + text
        if not self.cuts or "\u2581" in text or _UNUSUAL.search(text):
            return [text], True
        return _SEGMENT.findall(text), False

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The known numbers of the texts' segments; none for a text a tokenizer doesn't give back."""
        cut = [self.segments(t) for t in texts]
        for whole in (False, True):
            new = {s for parts, w in cut if w == whole for s in parts if ("\n" + s if whole else s) not in self.index}
            self.learn(sorted(new), whole)
        index = self.index
        out = [[index["\n" + p[0]]] if w else [index[s] for s in p] for p, w in cut]
        return [[] if self.broken and not self.broken.isdisjoint(f) else f for f in out]

    def links(self, number: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, pair, occurrences) of segments with their owners, by owner and pair; at most 32,768 owners."""
        key, n = _summed(owner << 32 | number, np.ones(len(number), np.int64))
        number, owner = key & 0xFFFFFFFF, key >> 32
        start, count = self.start.values[number], self.count.values[number]
        keys, times = [], []
        for lo, hi in _bounded(count, LINKS_AT_ONCE):
            c = count[lo:hi]
            at = np.repeat(start[lo:hi], c) + _within(c)
            key, t = _summed(
                np.repeat(owner[lo:hi], c) << 2 * _BITS | self.pair.values[at], np.repeat(n[lo:hi], c) * self.times.values[at]
            )
            keys.append(key)
            times.append(t)
        key, t = _summed(np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64),) * 2
        return key >> 2 * _BITS, key & (1 << 2 * _BITS) - 1, t


_READY: dict[tuple, Aligner] = {}


def aligner(file_a: str | None, file_b: str | None) -> Aligner:
    """The aligner of a worker process; kept between tasks."""
    if (file_a, file_b) not in _READY:
        _READY[file_a, file_b] = Aligner(file_a, file_b)
    return _READY[file_a, file_b]


def align_distinct(texts: DataFrame, file_a: str | None = None, file_b: str | None = None, with_groups: bool = False) -> DataFrame:
    """Align (text, copies): digest, copies, n_a, n_b, n_groups, n_links, groups_sha256, and the text's distinct pairs with
    their occurrences as arrays (``with_groups``: also the groups as text)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        know = aligner(file_a, file_b)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            know.room()
            found = know.numbers(part.column(1).to_pylist())
            numbers = np.array([x for f in found for x in f], np.int64)
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            sums = [
                np.bincount(owner, weights=c.values[numbers], minlength=len(found)).astype(np.int64) for c in know.figures
            ]
            own, pair, n = know.links(numbers, owner)
            ends = np.searchsorted(own, np.arange(len(found) + 1))
            strings = [";".join([know.strings[k] for k in f]) for f in found]
            yield {
                "digest": part.column(0),
                "copies": part.column(2),
                **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True)),
                "sha": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings],
                "pairs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pair, pa.int64())),
                "times": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(n, pa.int64())),
                **({"groups": strings} if with_groups else {}),
            }

    schema = (
        "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<long>" + ", groups string" * with_groups
    )
    return over_batches(texts.select("digest", "text", "copies"), run, schema)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n): rows of the corpus that hold a pair; texts are summed by batch before the shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        lists = batch.column(0)
        lengths = np.diff(lists.offsets.to_numpy())
        weight = np.repeat(batch.column(1).to_numpy(), lengths)
        pair, where = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, where, weight)
        yield {"pair": pair, "n": n}

    told = over_batches(aligned.select("pairs", "copies"), run, "pair long, n long")
    return told.groupBy("pair").agg(F.sum("n").alias("n"))


def align(
    docs: DataFrame,
    file_a: str | None = None,
    file_b: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one that a tokenizer doesn't give back byte by byte (with the blank in front), has no tokens:
    zeros and an empty string. Rows that share an id or a text give a row each, a null id stays null, an empty table gives
    no rows. Texts are taken whole. Only the two named columns are read. ``frequent`` is the number of pairs tasks look up;
    it changes the work, not the result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "align")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    named = distinct.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")
    aligned = ws.table(align_distinct(named, file_a, file_b), "aligned")
    counts = ws.table(count_pairs(aligned), "counts")
    # one row per id of A, so the size of its vocabulary bounds it
    best = counts.groupBy(F.shiftright("pair", _BITS).alias("a")).agg(F.max("n").alias("top"))
    judged = counts.join(best, F.shiftright("pair", _BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    judged = ws.table(judged, "judged")
    known = judged.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")  # at most ``frequent`` rows
    pair, n, top = known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)
    shared = spark.sparkContext.broadcast((pair, n, top))

    def look_up(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        pair, n, top = shared.value
        lists = batch.column(1)
        ends = lists.offsets.to_numpy()
        ask = lists.flatten().to_numpy(zero_copy_only=False)
        times = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        ends = ends - ends[0]
        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        at = np.minimum(np.searchsorted(pair, ask), max(len(pair) - 1, 0))
        there = pair[at] == ask if len(pair) else np.zeros(len(ask), bool)
        sums = np.zeros((batch.num_rows, 2), np.int64)
        if len(pair):
            np.add.at(sums, owner[there], np.stack([times * top[at], times * n[at]], 1)[there])
        rest = np.searchsorted(owner[~there], np.arange(batch.num_rows + 1))
        yield {
            "digest": batch.column(0),
            "n_best": sums[:, 0],
            "count_sum": sums[:, 1],
            "pairs": pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(ask[~there], pa.int64())),
            "times": pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(times[~there], pa.int64())),
        }

    looked = ws.table(
        over_batches(
            aligned.select("digest", "pairs", "times"),
            look_up,
            "digest binary, n_best long, count_sum long, pairs array<long>, times array<long>",
        ),
        "looked",
    )
    shared.unpersist()
    rare = looked.where(F.size("pairs") > 0).select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rare = rare.select("digest", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    joined = rare.join(judged, "pair").select(
        "digest", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    measured = (
        looked.select("digest", "n_best", "count_sum")
        .unionByName(joined)
        .groupBy("digest")
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    per_text = aligned.drop("pairs", "times", "copies").join(measured, "digest")
    keyed = rows.select("id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("digest"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return keyed.join(per_text, "digest", "left").select(
        F.col("id").alias(id_col),
        *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
