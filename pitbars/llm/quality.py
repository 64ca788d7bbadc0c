"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, runs of ASCII white space as one blank) and hashed. A line is boilerplate of its host
when it stands in more distinct documents of the host than the limit; those lines are removed, and a document that loses
too much is rejected. Copies of one text count once, so a much copied text doesn't turn its own lines into boilerplate.
Counting is a grouped count with partial sums before the shuffle: a line or host that holds a third of all rows is one
row per task by then. What is kept of a document for counting is its distinct line hashes, never its text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitbars.llm.common import Workspace, over_batches, sized

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A line is boilerplate above this many distinct documents of its host, however many the host has.
LIMIT_DOCS = 10
#: Base rules: fewest words; largest share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A document is depleted when more than this percentage of its words went with boilerplate lines.
MOST_REMOVED = 50


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur at least twice, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # equal hashes are only candidates: the windows themselves decide
    at = np.flatnonzero(twice)
    windows = [tuple(ids[k : k + size].tolist()) for k in at.tolist()]
    count = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for k, w in zip(at.tolist(), windows, strict=True):
        if count[w] > 1:
            edge[k] += 1
            edge[k + size] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str) -> tuple[dict[str, int], dict[int, int]]:
    """Base figures of a text, and the words by hash of each of its normalised lines that has a word."""
    data = text.encode()
    words = data.split()
    raw_lines = Counter(line for line in data.split(b"\n") if line.strip())
    lines: dict[int, int] = {}
    for line, times in raw_lines.items():
        own = line.lower().split()
        key = xxhash.xxh3_64_intdigest(b" ".join(own)) - (1 << 63)
        lines[key] = lines.get(key, 0) + len(own) * times
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    figures = {
        "n_words": len(words),
        "word_chars": len(text) - blanks,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": sum(raw_lines.values()) - len(raw_lines),
        "n_repeat_words": repeated_words(words),
    }
    return figures, lines


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(
    docs: DataFrame,
    host_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit_docs: int = LIMIT_DOCS,
    keep_rows: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, figures, n_removed_words, base_failed, kept; with ``keep_rows`` also the row
    as a struct ``doc`` and the hashes of its boilerplate lines.

    A null or empty text has no words and fails the base rules; a null host is a host of its own; rows that share an id
    are judged one by one; an empty table gives no rows. Columns other than the three named pass inside ``doc`` only, so
    their names can't clash.
    """
    ws = Workspace(docs.sparkSession, "quality")
    base = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),  # fixed by the table written below
        F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("-")).alias("host"),
        F.col(text_col).alias("text"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if keep_rows else []),
    )
    carried = [f for f in base.schema.fields if f.name != "text"]
    schema = StructType.fromDDL(
        ", ".join(f"{f} long" for f in FIGURES) + ", content binary, lines array<long>, line_words array<long>"
    )

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            out: dict[str, object] = {f.name: part.column(f.name) for f in carried}
            texts = [x or "" for x in part.column("text").to_pylist()]
            found = [measure(t) for t in texts]
            out |= {f: [x[f] for x, _ in found] for f in FIGURES}
            out["content"] = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
            out["lines"] = [list(x) for _, x in found]
            out["line_words"] = [list(x.values()) for _, x in found]
            yield out

    rows = ws.table(over_batches(base, run, StructType(carried + schema.fields)), "rows")
    lines = rows.select("row", "host", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(
        "row", "host", "content", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words")
    )
    often = (
        lines.groupBy("host", "line")
        .agg(F.countDistinct("content").alias("n"))
        .where(F.col("n") > limit_docs)
        .select("host", "line")
    )
    removed = (
        lines.join(often, ["host", "line"])
        .groupBy("row")
        .agg(F.sum("words").alias("n_removed_words"), *([F.collect_list("line").alias("drop")] if keep_rows else []))
    )
    out = rows.drop("lines", "line_words", "content").join(removed, "row", "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = 100 * F.col("n_removed_words") > MOST_REMOVED * F.col("n_words")
    return out.select(
        F.col("id").alias(id_col),
        *FIGURES,
        "n_removed_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        *(["doc", "drop"] if keep_rows else []),
    )


def clean(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their text without boilerplate lines, the columns as they were.

    Lines keep their order and own spelling; ``n_chars`` is set anew where the table has it.
    """
    judged = judge(docs, host_col, id_col, text_col, keep_rows=True, **limits).where("kept")

    @F.pandas_udf("string")
    def strip(text, drop):  # noqa: ANN001, ANN202
        out = []
        for t, d in zip(text, drop, strict=True):
            if d is not None and len(d):
                gone = set(d)
                key = lambda s: xxhash.xxh3_64_intdigest(b" ".join(s.encode().lower().split())) - (1 << 63)
                t = "\n".join(x for x in t.split("\n") if key(x) not in gone)
            out.append(t)
        import pandas as pd

        return pd.Series(out, dtype=object)

    kept = judged.select("doc", F.when(F.col("drop").isNull(), F.col(f"doc.{text_col}")).otherwise(
        strip(F.col(f"doc.{text_col}"), F.col("drop"))).alias("clean"))
    return sized(
        kept.select(*[(F.col("clean") if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns]), text_col
    )
