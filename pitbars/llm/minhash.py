"""Near-duplicate documents by b-bit MinHash, links confirmed on whole shingle sets.

Documents with the same shingle set are one class from the start. Each class has ``bands * rows`` minima; a band of
minima is a bucket key, and the low bits of all minima, packed, are the signature by which a pair's similarity is
estimated from the count of equal positions, corrected for positions that agree by chance.

A large bucket never becomes all its pairs. First every member meets one hub, so the rows are as many as the members; the
hub of a large bucket is its most central member, the one that meets most others over all its buckets. Pairs whose
estimate lies five standard deviations below the threshold are left out, and the rest are confirmed. What
these links don't join is then compared across components only. Buckets of a few members join by key. Members of larger
ones are gathered by hub, so that a class has one seat a hub and not one a band: the classes outside the hub's component
are compared with all of its seats in tiles. A tile holds the whole sets of its seats and confirms there, so that pairs
below the threshold, of which a large group may have very many, never become rows: each class that asks gets its most
similar linked class of another component or none. The links join components, and the classes that got one ask again
until none gets any; a class without a link to another component never gets one later, as components only grow. So links
within one component are not all found (they change nothing), while none between two is lost except by the bands: at the
threshold 0.8 a pair shares no band with probability (1 - 0.8^5)^40 = 1e-7.

In tiles a pair is confirmed only after bit counts and an exact prefix filter: two sets at the threshold share one of their rarest
n - ceil(0.8 n) + 1 shingles, whatever order says which are rare, as long as all sets use the same one. Rare is what a table of
``SLOTS`` hashed counts says; shingles that meet in a slot make the filter weaker, never wrong. A class that shares no shingle
of its prefix takes no seat, so documents that have a common template and words of their own raise no pairs.

Confirmation is on whole sets of 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.llm.common import Workspace, components, over_batches

BANDS, ROWS, BITS = 40, 5, 2
#: Up to so many members, a bucket's pairs of two components are made by a join; beyond, they are compared in tiles.
SMALL = 32
#: Seats of a hub that one task compares with so many others, and about how many shingles either side holds together.
TILE, HELD = 1024, 1 << 20
#: Hashed counts of shingles that order the prefixes: 4 bytes each, sent to the tasks; any number gives the same links.
SLOTS = 1 << 20
#: A hub with more partners than this is read by several tasks.
PARTNERS = 2048

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _K2
    x = (x ^ x >> np.uint64(27)) * _K3
    return x ^ x >> np.uint64(31)


class Words:
    """64-bit hashes of words; a worker remembers a bounded number."""

    def __init__(self, limit: int = 500_000):
        self.seen, self.limit = {}, limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        try:
            got = [seen[w] for w in words]
        except KeyError:
            for w in set(words).difference(seen):
                seen[w] = xxhash.xxh3_64_intdigest(w)
            got = [seen[w] for w in words]
            if len(seen) > self.limit:
                seen.clear()
        return np.array(got, np.uint64)


_WORDS = Words()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; see ``near_duplicates``."""
    words = _WORDS(text.encode().lower().split())
    size_here = min(size, len(words))
    if not size_here:
        return np.zeros(0, np.uint64)
    n = len(words) - size_here + 1
    key = np.full(n, size_here, np.uint64)
    for k in range(size_here):
        key = _mix(key * _K1 + words[k : k + n])
    return np.unique(key)


def minima(keys: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values (32 bits) of a set."""
    seeds = _mix(np.arange(1, n + 1, dtype=np.uint64) * _K1)
    out = np.empty(n, np.uint32)
    step = max(1, 65536 // len(keys))
    high = keys >> np.uint64(32)
    for at in range(0, n, step):
        s = seeds[at : at + step, None]
        out[at : at + step] = (((keys ^ high) * (s | np.uint64(1)) + (s >> np.uint64(7))) >> np.uint64(32)).min(axis=1)
    return out


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of each value, one plane of packed bits after the other, each padded to 8 bytes."""
    planes = [np.packbits((values >> np.uint32(k) & 1).astype(np.uint8)) for k in range(bits)]
    return b"".join(p.tobytes().ljust(-(-len(p) // 8) * 8, b"\0") for p in planes)


def estimate(a: np.ndarray, b: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Similarity of packed signatures (rows of 64-bit words): bit counts of positions that agree, chance removed."""
    planes = (a ^ b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], bits, -1)
    differ = np.bitwise_count(np.bitwise_or.reduce(planes, axis=-2)).sum(axis=-1, dtype=np.int32)
    chance = 2.0**-bits
    return (1 - differ / n - chance) / (1 - chance)


def _least_estimate(threshold: float, n: int, bits: int) -> float:
    """Five standard deviations of the estimate below the threshold."""
    chance = 2.0**-bits
    agree = threshold + (1 - threshold) * chance
    return threshold - 5 * (agree * (1 - agree) / n) ** 0.5 / (1 - chance)


def prefix(keys: np.ndarray, counts: np.ndarray, percent: int) -> bytes:
    """The rarest shingles of a set that a set at the threshold can't all miss, as sorted 32-bit hashes; those counted once go."""
    slots = (keys % np.uint64(len(counts))).astype(np.int64)
    rare = np.lexsort((keys, counts[slots]))[: len(keys) - -(-percent * len(keys) // 100) + 1]
    return np.unique((keys[rare[counts[slots[rare]] > 1]] >> np.uint64(32)).astype("<u4")).tobytes()


class Postings:
    """The rows that hold each hash."""

    def __init__(self, rows: list[np.ndarray]):
        tokens = np.concatenate(rows)
        order = np.argsort(tokens, kind="stable")
        self.rows = np.repeat(np.arange(len(rows)), [len(x) for x in rows])[order]
        self.tokens, starts = np.unique(tokens[order], return_index=True)
        self.ends = np.append(starts, len(tokens))
        self.width = len(rows)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The rows that hold one of the distinct ``keys``, each as often as it holds one."""
        place = np.searchsorted(self.tokens, keys)
        here = place < len(self.tokens)
        place = place[here][self.tokens[place[here]] == keys[here]]
        return np.concatenate([self.rows[:0], *(self.rows[self.ends[p] : self.ends[p + 1]] for p in place)])

    def shared(self, keys: np.ndarray) -> np.ndarray:
        """How many of the distinct ``keys`` each row holds."""
        return np.bincount(self(keys), minlength=self.width)


class Shared:
    """Which rows on the right share a 32-bit hash with a row on the left."""

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.left, rows = ([np.frombuffer(x, "<u4") for x in side] for side in (left, right))
        self.right = Postings(rows)

    def __call__(self, at: range) -> np.ndarray:
        out = np.zeros((len(at), self.right.width), bool)
        for k, i in enumerate(at):
            out[k, self.right(self.left[i])] = True
        return out


class Finder:
    """One run over one table; see ``near_duplicates``."""

    def __init__(self, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, bands: int, rows: int, bits: int):
        self.ws = Workspace(docs.sparkSession, "minhash")
        self.size, self.percent, self.bands, self.rows, self.bits = size, percent, bands, rows, bits
        self.n = bands * rows
        self.least = _least_estimate(percent / 100, self.n, bits)
        # rows are told apart by id and text: ids may be null, or stand for several texts
        self.docs = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"), row_ref(id_col, text_col).alias("ref"))

    def signed(self) -> DataFrame:
        """(own id, ref, n, key, keys of bands, signature) of every row; key is null for an empty set."""
        size, n, bands, rows, bits = self.size, self.n, self.bands, self.rows, self.bits

        def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            weights = _mix(np.arange(7, 7 + rows, dtype=np.uint64) * _K1) | np.uint64(1)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: dict[str, object] = {"own": part.column(0), "ref": part.column(2)} | {c: [] for c in ("n", "key", "keys", "signature")}
                for text in part.column(1).to_pylist():
                    own = shingles(text or "", size)
                    out["n"].append(len(own))
                    if not len(own):
                        for c in ("key", "keys", "signature"):
                            out[c].append(None)
                        continue
                    low = minima(own, n)
                    mixed = _mix((low.reshape(bands, rows).astype(np.uint64) * weights).sum(axis=1))
                    out["key"].append(hashlib.md5(own.tobytes()).digest())
                    out["keys"].append(mixed.view(np.int64).tolist())
                    out["signature"].append(pack_bits(low, bits))
                yield out

        return over_batches(self.docs, run, "own long, ref long, n long, key binary, keys array<long>, signature binary")

    def sets(self, classes: DataFrame) -> DataFrame:
        """(id, crowded, shingles) of the named classes, from their texts. Both sides grow with the corpus, so they are merged."""
        size = self.size

        def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t or "", size) for t in part.column(1).to_pylist()]
                # texts of one ref are told apart by the key of their class
                mine = [hashlib.md5(x.tobytes()).digest() == k for x, k in zip(sets, part.column(2).to_pylist(), strict=True)]
                ids, crowded = ([v for v, m in zip(part.column(c).to_pylist(), mine, strict=True) if m] for c in (0, 3))
                yield {"id": ids, "crowded": crowded, "shingles": [x.view(np.int64).tolist() for x, m in zip(sets, mine, strict=True) if m]}

        texts = self.docs.join(classes.select("id", "key", "ref", "crowded").hint("merge"), "ref")
        texts = texts.withColumn("check", F.xxhash64(F.lit(1), "text")).dropDuplicates(["ref", "id", "check"])
        return over_batches(texts.select("id", "text", "key", "crowded"), run, "id long, crowded boolean, shingles array<long>")

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets pass the threshold. b is the side that may be one hub for very many."""
        crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("parts"))
        dealt = pairs.join(crowd, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts").cast("long")).cast("int"))
        hubs = crowd.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("b", "part")
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).join(hubs, "b")
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        both = dealt.select("a", "b", "part").join(left, "a").join(right, ["b", "part"])
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * shared >= self.percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

    def near(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs whose sizes and estimate allow the threshold."""
        n, bits, least, percent = self.n, self.bits, self.least, self.percent

        @F.pandas_udf("boolean")
        def close(a: pd.Series, b: pd.Series) -> pd.Series:
            words = [np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1) for x in (a, b)]
            return pd.Series(estimate(*words, n, bits) >= least if len(a) else np.zeros(0, bool))

        sides = [classes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("signature").alias(f"s{s}")) for s in "ab"]
        full = pairs.join(sides[0], "a").join(sides[1], "b")
        ratio = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        return full.where(ratio).where(close("sa", "sb")).select("a", "b")

    def small(self, buckets: DataFrame) -> DataFrame:
        """Pairs inside buckets of at most SMALL members: at most SMALL / 2 a member."""
        own = buckets.where(F.col("m") <= SMALL)
        sides = [own.select("bucket", F.col("id").alias(s)) for s in "ab"]
        return sides[0].join(sides[1], "bucket").where("a > b").select("a", "b").distinct()

    def apart(self, pairs: DataFrame, joined: DataFrame) -> DataFrame:
        """The pairs whose classes are not in one component yet."""
        sides = [joined.select(F.col("id").alias(s), F.col("component").alias(f"c{s}")) for s in "ab"]
        full = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left")
        return full.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def counts(self, sets: DataFrame) -> np.ndarray:
        """How many crowded classes hold a shingle of each slot: bounded by ``SLOTS`` on the driver and in tasks."""
        n = SLOTS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n, np.int64)
            for batch in batches:
                keys = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                total += np.bincount((keys % np.uint64(n)).astype(np.int64), minlength=n)
            slots = np.flatnonzero(total)
            for at in range(0, len(slots), 65536):
                part = slots[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "count"])

        told = sets.where("crowded").select("shingles").mapInArrow(run, "slot long, count long")
        got = told.groupBy("slot").agg(F.sum("count").alias("count")).toPandas()
        out = np.zeros(n, np.uint32)
        out[got["slot"].to_numpy(np.int64)] = np.minimum(got["count"].to_numpy(np.int64), 2**32 - 1)
        return out

    def prefixes(self, sets: DataFrame, counts: np.ndarray) -> DataFrame:
        """(id, prefix, shingles) of the crowded classes that may share a shingle of their prefix with another."""
        percent = self.percent

        def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            got = [prefix(np.array(x, np.int64).view(np.uint64), counts, percent) for x in batch.column(1).to_pylist()]
            yield {"id": batch.column(0), "prefix": got, "shingles": batch.column(1)}

        schema = "id long, prefix binary, shingles array<long>"
        found = over_batches(sets.where("crowded").select("id", "shingles"), run, schema)
        return found.where(F.length("prefix") > 0)

    def large(self, own: DataFrame, members: DataFrame) -> DataFrame:
        """Links (asks, other) of two components among the seats of a hub, confirmed in tiles.

        Every such link has a class outside its hub's component; those classes (minor = 1) ask, and each gets its most
        similar one, whatever number it has.
        """
        tiles = lambda n, held: F.ceil(F.greatest(F.col(n) / F.lit(TILE), F.col(held) / F.lit(HELD))).cast("int")
        sizes = own.groupBy("hub").agg(
            F.count("*").alias("m"), F.sum("n").alias("held"), F.sum("minor").alias("minors"), F.sum(F.col("n") * F.col("minor")).alias("asked")
        )
        sizes = sizes.select("hub", tiles("minors", "asked").alias("lefts"), tiles("m", "held").alias("rights"))
        tile = lambda n: F.pmod(F.xxhash64("id", "hub"), F.col(n).cast("long")).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        member = own.join(sizes, "hub")
        cols = ["hub", "i", "j", "side", "id", "component"]
        left = member.where("minor = 1").withColumn("i", tile("lefts")).withColumn("j", upto("rights")).withColumn("side", F.lit(0))
        right = member.withColumn("j", tile("rights")).withColumn("i", upto("lefts")).withColumn("side", F.lit(1))
        tasks = int(self.ws.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = left.select(*cols).union(right.select(*cols)).join(members, "id")
        spread = spread.repartition(tasks, "hub", "i", "j")  # a named count: few bytes, much work
        n, bits, least, percent = self.n, self.bits, self.least, self.percent

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
            out = []
            if len(left) and len(right):
                sig = lambda x: np.frombuffer(b"".join(x["signature"]), np.uint64).reshape(len(x), -1)
                ls, rs = sig(left), sig(right)
                li, lc, ln = (left[c].to_numpy() for c in ("id", "component", "n"))
                ri, rc, rn = (right[c].to_numpy() for c in ("id", "component", "n"))
                shared = Shared(list(left["prefix"]), list(right["prefix"]))
                asking, sets = list(left["shingles"]), None
                for k in range(0, len(left), 64):
                    s = slice(k, k + 64)
                    small, large = np.minimum(ln[s, None], rn), np.maximum(ln[s, None], rn)
                    ok = (lc[s, None] != rc) & (100 * small >= percent * large) & shared(range(k, min(k + 64, len(left))))
                    if ok.any():
                        ok &= estimate(ls[s, None], rs[None], n, bits) >= least
                    for x in np.flatnonzero(ok.any(axis=1)):
                        sets = sets or Postings(list(right["shingles"]))
                        both = sets.shared(asking[k + x])
                        union = ln[k + x] + rn - both
                        alike = np.where(ok[x] & (100 * both >= percent * union), both / union, -1.0)
                        y = alike.argmax()
                        if alike[y] >= 0:
                            out.append((li[k + x], ri[y], alike[y]))
            return pd.DataFrame(out, columns=["asks", "other", "alike"]).astype({"asks": "int64", "other": "int64", "alike": "float64"})

        found = spread.groupBy("hub", "i", "j").applyInPandas(run, "asks long, other long, alike double")
        return found.groupBy("asks").agg(F.max_by("other", F.struct("alike", "other")).alias("other"))

    @staticmethod
    def apart_of_hub(seats: DataFrame, asks: DataFrame, joined: DataFrame) -> DataFrame:
        """Seats (id, hub, n) of the hubs with an asking class outside their component; the class's component, and minor = 1 for those."""
        at = joined.select(F.col("id").alias("hub"), F.col("component").alias("of_hub"))
        full = seats.join(joined, "id", "left").join(at, "hub", "left").join(asks.select("id", F.lit(True).alias("asks")), "id", "left")
        outside = F.coalesce("component", "id") != F.coalesce("of_hub", "hub")
        placed = full.select(
            "id", "hub", "n", F.coalesce("component", "id").alias("component"), (F.col("asks").isNotNull() & outside).cast("int").alias("minor")
        )
        mixed = placed.where("minor = 1").select("hub").distinct()
        return placed.join(mixed, "hub", "left_semi")

    def grown(self, joined: DataFrame, links: DataFrame) -> DataFrame:
        """Components with more links (a, b). What is joined already goes on as one edge a class, not with all its links."""
        stars = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
        out = self.ws.table(components(self.ws, stars.union(links)), "joined")
        self.ws.drop(joined)
        return out

    def run(self) -> DataFrame:
        """(own id, ref, n, root) of every row: root is the first row (none: its id is null, own, ref) of the component."""
        ws = self.ws
        signed = ws.table(self.signed(), "signed")
        classes = ws.table(
            signed.where("key is not null")
            .groupBy("key")
            .agg(
                F.min(F.struct(F.col("own").isNull().alias("none"), "own", "ref")).alias("first"), F.first("n").alias("n"),
                F.first("signature").alias("signature"), F.first("keys").alias("keys"),
            )
            .withColumn("ref", F.col("first.ref"))
            .withColumn("id", F.monotonically_increasing_id()),  # the class's number, fixed by this table
            "classes",
        )
        rows = ws.table(signed.select("own", "ref", "n", "key"), "rows")
        ws.drop(signed)
        banded = classes.select("id", F.posexplode("keys").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("bucket"))
        hubs = banded.groupBy("bucket").agg(
            F.min(F.struct(F.xxhash64("id", "bucket"), "id")).alias("hub"), F.count("*").alias("m")
        )
        buckets = ws.table(
            banded.join(hubs.where("m > 1").select("bucket", "m", F.col("hub.id").alias("hub")), "bucket"), "buckets"
        )
        # in a large bucket the hub is the member that meets most others over all its large buckets: the centre of its copies
        crowd = buckets.where(F.col("m") > SMALL).select("id", "bucket", "m")
        met = crowd.groupBy("id").agg(F.sum("m").alias("met"))
        central = crowd.join(met, "id").groupBy("bucket").agg(F.max(F.struct("met", F.xxhash64("id"), "id")).alias("hub"))
        seats = crowd.join(central.select("bucket", F.col("hub.id").alias("hub")), "bucket").select("id", "hub")
        seats = ws.table(seats.where("id <> hub").distinct(), "seats")
        few = buckets.where((F.col("m") <= SMALL) & (F.col("id") != F.col("hub"))).select("id", "hub")
        stars = few.union(seats).select(F.col("id").alias("a"), F.col("hub").alias("b"))
        tried = ws.table(self.near(stars.distinct(), classes), "stars")
        pairs = ws.table(self.near(self.small(buckets), classes), "pairs")
        ws.drop(buckets)
        ids = [df.select(F.col(c).alias("id"), F.lit(False).alias("crowded")) for df in (tried, pairs) for c in "ab"]
        needed = reduce(DataFrame.union, [*ids, seats.select("id", F.lit(True))]).groupBy("id").agg(F.max("crowded").alias("crowded"))
        sets = ws.table(self.sets(classes.select("id", "key", "ref").join(needed, "id")), "sets")
        links = ws.table(self.confirm(tried, sets), "links")
        joined = ws.table(components(ws, links), "joined")
        fresh = ws.table(self.apart(pairs, joined), "fresh")
        ws.drop(pairs)
        if not fresh.isEmpty():
            joined = self.grown(joined, ws.table(self.confirm(fresh, sets), "links"))
        if not seats.isEmpty():
            members = self.prefixes(sets, self.counts(sets)).join(classes.select("id", "n", "signature"), "id")
            members = ws.table(members, "members")
            asks, seated = members.select("id"), seats.join(members.select("id", "n"), "id")
            while True:
                # components only grow: a hub that has no part in this round, or a class that gets no link, has none in a later one
                own = ws.table(self.apart_of_hub(seated.select("id", "hub", "n"), asks, joined), "seats")
                ws.drop(seats)
                seats = seated = own
                links = ws.table(self.large(seats, members), "links")
                if links.isEmpty():
                    break
                joined = self.grown(joined, links.select(F.col("asks").alias("a"), F.col("other").alias("b")))
                asks = links.select(F.col("asks").alias("id"))
            ws.drop(members)
        ws.drop(sets, seats)
        by_class = classes.select("key", "id", "first").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # written, so that a large component is an uneven join of two tables, which is dealt anew
        by_class = ws.table(by_class, "named")
        roots = ws.table(by_class.groupBy("component").agg(F.min("first").alias("root")), "roots")
        return rows.join(
            by_class.join(roots, "component").select("key", "root"), "key", "left"
        ).drop("key")


def row_ref(id_col: str, text_col: str) -> Column:
    """A 64-bit name of a row's id and text, the same in every plan."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def near_duplicates(
    docs: DataFrame,
    shingle_size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    bits: int = BITS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of ``shingle_size`` words (runs of anything but ASCII white space, A-Z
    lower-cased); a text with fewer words is one shingle; a null or empty text has the empty set and links with nothing.
    Two documents link when 100 * intersection >= ``percent`` * union. The component is the smallest id reachable; kept says
    that it is the row's own id, so rows repeated under one id are kept or dropped together. Rows are told apart by id and
    text, so texts under one id link each for itself. A null id gets the component of what it links with, null where nothing in
    it has an id; then its first text is kept. An empty table gives no rows. Only the two named columns are read.
    """
    found = Finder(docs, shingle_size, percent, id_col, text_col, bands, rows, bits).run()
    component = F.coalesce("root.own", "own")
    first = F.coalesce(F.col("root.none") & (F.col("root.ref") == F.col("ref")), F.col("root").isNull())
    kept = F.when(F.col("own").isNotNull(), F.col("own") == component).otherwise(first)
    return found.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def keep_one(
    docs: DataFrame, shingle_size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    bands: int = BANDS, rows: int = ROWS, bits: int = BITS,
) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they were: one row of each group, the one with the smallest id (null last).

    Rows without words are no group: each stays. Rows that repeat both id and text (null ids too) stay once; a null id, or an
    id another text has as well, loses no row.
    """
    found = Finder(docs, shingle_size, percent, id_col, text_col, bands, rows, bits).run()
    stay = found.select(F.coalesce("root.ref", "ref").alias("_ref")).distinct()
    named = docs.withColumn("_ref", row_ref(id_col, text_col)).withColumn("_check", F.xxhash64(F.lit(1), id_col, text_col))
    return named.join(stay, "_ref", "left_semi").dropDuplicates(["_ref", "_check"]).select(docs.columns)
