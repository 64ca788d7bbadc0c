"""Packing of token sequences by best-fit decreasing.

A document is cut into full windows first, which fill a sequence each; its rest is packed. Pieces are dealt by hash into
groups of bounded size, so groups pack independently and in parallel: within a group they go in order of falling
length, each into the open window with the least room that still holds it, found by a segment tree indexed by
remaining room. With thousands of rests in a group the padding is about as small as for one group over everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitbars.llm.common import Workspace, over_batches
from pitbars.llm.tokens import text_encoder

#: Expected pieces in a group that packs on its own.
GROUP_ROWS = 16384


class RoomTree:
    """Counts of open windows by remaining room, in a segment tree: the least room of at least r in log time."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.tree = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, room: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the tightest open window with at least ``room``."""
        node, tree = self.base + room, self.tree
        while not tree[node]:
            while node & 1:  # a right child: nothing to its right below this parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.base:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        found = node - self.base
        self._add(found, -1)
        return found, self.open[found].pop()


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1 to ``size``), given in falling order."""
    tree, n = RoomTree(size), 0
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, length in enumerate(lengths.tolist()):
        found = tree.take(length)
        if found is None:
            room, w, n = size, n, n + 1
        else:
            room, w = found
        window[k], offset[k] = w, size - room
        if room > length:
            tree.put(room - length, w)
    return window, offset


def cut(
    docs: DataFrame,
    size: int = 1024,
    tokenizer_file: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``size`` tokens: id, start, length, ids_crc32, doc_tokens (and the ids)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        encoder = text_encoder(tokenizer_file)
        ends = np.array([end_id], "<u4")
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows: list[tuple] = []
            for doc, ids in zip(
                part.column(0).to_pylist(), encoder([x or "" for x in part.column(1).to_pylist()]), strict=True
            ):
                ids = np.concatenate([ids.astype("<u4"), ends])
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece))
            cols = list(zip(*rows, strict=True))
            names = ("id", "start", "length", "ids_crc32", "doc_tokens")
            yield dict(zip(names, map(list, cols), strict=False)) | ({"ids": [x.tolist() for x in cols[5]]} if with_ids else {})

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return over_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def dealt(rows: DataFrame, groups: int) -> DataFrame:
    """A group for each row by its place in the table, so that repeated rows spread over all groups."""
    return rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))


def pack(
    docs: DataFrame,
    size: int = 1024,
    tokenizer_file: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_rows: int = GROUP_ROWS,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all texts: one row per piece with sequence_id and offset; windows are padded to ``size`` by the reader.

    A null or empty text is the end id alone. Rows that share an id are packed one by one; a null id stays null. An empty
    table gives no rows. Only the two named columns are read. Sequences are numbered without gaps by a running sum over
    the groups' counts (one small row a group).
    """
    ws = Workspace(docs.sparkSession, "pack")
    pieces = ws.table(cut(docs, size, tokenizer_file, end_id, id_col, text_col, with_ids), "pieces")
    rows = dealt(pieces, -(-pieces.count() // group_rows) or 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "id", "start", "ids_crc32"]
        pdf = pdf.sort_values(order, ascending=[False, True, True, True], ignore_index=True)
        window, offset = best_fit(pdf["length"].to_numpy(), size)
        return pdf.assign(window=window, offset=offset)

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", window long, offset long"
    packed = ws.table(rows.groupBy("group").applyInPandas(run, schema), "packed")
    ws.drop(pieces)
    counts = packed.groupBy("group").agg((F.max("window") + 1).alias("n"))
    starts = counts.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("first"))
    return packed.join(starts, "group").select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.col("window")).alias("sequence_id"),
        "offset",
        *(["ids"] if with_ids else []),
    )
