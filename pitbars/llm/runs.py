"""Runs (maximal stretches with a period) of the words of a text, by online dyadic square catching.

Words are appended one by one. Whenever a block of 2^k words that starts at a multiple of 2^k is complete, it becomes a
catcher: it watches for its own words to come again at a distance of 2 * 2^k - 1 to 4 * 2^k - 2 (block length 2 serves
all distances below 7). The first half of a square of such a period holds a whole block of that length, so no square
escapes. The comparison of suffixes advances with each word: the words that end at the new one are named by the halves'
names, and only lengths whose last half is a known block are looked at, so most words are compared once. A caught
distance is extended to the left, then followed word by word until it breaks; it counts as a run from the moment its
square is complete. Blocks inside one run catch the same distance, which is followed once. Distances that are multiples of
a period already followed over the block can't be smallest periods and are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.llm.common import over_batches

#: The characters that are no white space, as the words' pattern lists them.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class SquareCatcher:
    """Takes words one by one; ``finish`` gives all runs (start, length, period) of at least ``least`` words.

    ``least`` must be 12 or more: with shorter runs the blocks of two words don't serve the distances below 7.
    """

    def __init__(self, least: int = 12):
        if least < 12:
            raise ValueError("runs of fewer than 12 words need other block lengths")
        self.least = least
        self.words: list[int] = []
        self.known: dict[str, int] = {}
        self.names: list[dict[tuple[int, int], int]] = []  # by level: halves to name
        self.blocks: list[list[int]] = []  # by level: names of the complete blocks
        self.last: list[dict[int, int]] = []  # by level: start of the last complete block of a name
        self.ending: list[dict[int, int]] = []  # by level: name of the known words that end here
        self.followed: dict[int, int] = {}  # period to start
        self.found: list[tuple[int, int, int]] = []

    def extend(self, words: list[str]) -> None:
        known, own, followed = self.known, self.words, self.followed
        pairs = self.names[0] if self.names else self._level()
        ending, last = self.ending[0], self.last[0]
        before = own[-1] if own else -1
        for word in words:
            w = known.setdefault(word, len(known))
            j = len(own)
            own.append(w)
            if followed:
                self._advance(j, w)
            name = pairs.get((before, w))
            if name is not None:
                ending[j] = name
                if j - 1 - last[name] < 7:
                    self._catch(0, j, name)
                if j - 2 in ending:
                    self._longer(j)
            if j & 1:
                self._complete(j, before, w)
            before = w

    def _level(self) -> dict[tuple[int, int], int]:
        self.names.append({})
        self.blocks.append([])
        self.last.append({})
        self.ending.append({})
        return self.names[-1]

    def _complete(self, j: int, left: int, right: int) -> None:
        """The blocks that end at ``j`` become catchers, from the shortest up."""
        k, size = 0, 2
        while True:
            if k == len(self.names):
                self._level()
            name = self.names[k].setdefault((left, right), len(self.names[k]))
            self.last[k][name] = j + 1 - size
            own = self.blocks[k]
            own.append(name)
            size *= 2
            if (j + 1) % size:
                return
            left, right, k = own[-2], own[-1], k + 1

    def _longer(self, j: int) -> None:
        """Names of the longer suffixes, as far as both halves are known, and their catches."""
        k, half = 1, 2
        while k < len(self.names):
            left = self.ending[k - 1].pop(j - half, None)  # nothing else asks for it
            if left is None:
                return
            name = self.names[k].get((left, self.ending[k - 1][j]))
            if name is None:
                return
            self.ending[k][j] = name
            size = 2 * half
            if j + 1 - size - self.last[k][name] < 4 * size - 1:
                self._catch(k, j, name)
            k, half = k + 1, size

    def _catch(self, k: int, j: int, name: int) -> None:
        """Blocks of level ``k`` equal to the suffix at ``j``, at the distances the level serves, nearest first."""
        size, blocks, words, followed = 2 << k, self.blocks[k], self.words, self.followed
        here = j + 1 - size
        nearest, farthest = (1 if k == 0 else 2 * size - 1), 4 * size - 2
        # inside a run with a period of half a block at most, all distances to blocks of the run are its multiples
        if k and any(2 * p <= size and start <= here - farthest for p, start in followed.items()):
            return
        for b in range((here - nearest) // size, max(-1, (here - farthest - 1) // size), -1):
            if b < len(blocks) and blocks[b] == name:
                at = b * size
                p = here - at
                if p in followed or any(p % q == 0 and start <= at for q, start in followed.items()):
                    continue
                i = at - 1
                while i >= 0 and words[i] == words[i + p]:
                    i -= 1
                followed[p] = i + 1

    def _advance(self, j: int, w: int) -> None:
        words, broken = self.words, []
        for p in self.followed:
            if words[j - p] != w:
                broken.append(p)
        for p in broken:
            self._report(p, self.followed.pop(p), j)

    def _report(self, p: int, start: int, end: int) -> None:
        if end - start >= max(self.least, 2 * p):
            self.found.append((start, end - start, p))

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs by start, then period. No word can be appended afterwards."""
        for p, start in self.followed.items():
            self._report(p, start, len(self.words))
        self.followed = {}
        return sorted(self.found, key=lambda r: (r[0], r[2]))


def find_runs(words: list[str], least: int = 12) -> list[tuple[int, int, int]]:
    catcher = SquareCatcher(least)
    catcher.extend(words)
    return catcher.finish()


def keep_once(n: int, runs: list[tuple[int, int, int]]) -> list[bool]:
    """Which of ``n`` words stay when every run keeps its first period only."""
    keep = [True] * n
    reach = 0
    for start, length, period in sorted((s + p, length - p, p) for s, length, p in runs):
        a, b = max(start, reach), start + length
        if b > a:
            keep[a:b] = [False] * (b - a)
            reach = b
    return keep


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """Every tenth document by checksum repeats a stretch of its words up to its end; the others stay as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def text_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, plant: bool = False, with_text: bool = False
) -> DataFrame:
    """Per row: the id, n_runs, the longest run (start, length, period, exponent_milli), digests of all runs and of the text
    without repeated periods (``with_text``: that text too). ``plant`` repeats words of some documents first (``planted``).

    Among runs of one length the first counts, then the shortest period; without runs these four are null. A null text has no
    words: no runs, digests of the empty string. Texts are taken whole, one at a time in memory; rows that share an id
    give a row each, a null id stays null, an empty table gives no rows. Only the two named columns are read.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            out: dict[str, list] = {k: [] for k in ("n", "start", "length", "period", "milli", "runs", "text_sha", "text")}
            ids = part.column(0).to_pylist()
            for doc_id, text in zip(ids, part.column(1).to_pylist(), strict=True):
                words = WORD.findall(text or "")
                if plant:
                    words = planted(words, doc_id)
                runs = find_runs(words, least)
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
                for name, value in zip(("start", "length", "period"), best, strict=True):
                    out[name].append(value)
                out["milli"].append(1000 * best[1] // best[2] if runs else None)
                out["n"].append(len(runs))
                told = "".join([f"{s},{length},{p}\n" for s, length, p in runs])
                out["runs"].append(hashlib.sha256(told.encode()).hexdigest())
                if runs:
                    words = [w for w, stays in zip(words, keep_once(len(words), runs), strict=True) if stays]
                left = " ".join(words)
                out["text_sha"].append(hashlib.sha256(left.encode()).hexdigest())
                out["text"].append(left if with_text else None)
            yield {"id": ids} | out

    schema = "id long, n long, start long, length long, period long, milli long, runs string, text_sha string, collapsed string"
    rows = over_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema)
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_runs"),
        "start",
        "length",
        "period",
        F.col("milli").alias("exponent_milli"),
        F.col("runs").alias("runs_sha256"),
        F.col("text_sha").alias("collapsed_sha256"),
        *(["collapsed"] if with_text else []),
    )
