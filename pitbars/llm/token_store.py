"""Token ids on disk: ids by falling frequency, in byte-aligned variable-length coding with separate control bytes.

Three passes: tokenize and keep each document's ids; count ids over the whole corpus and rank them; code the ranks. A rank
below 2^8, 2^16, 2^24 or 2^32 takes 1 to 4 bytes; two bits a value in the control bytes, four values to a byte, say how
many. Frequent ids get small ranks and so take one byte. Decoding looks control bytes up in a table of lengths and
gathers all values of a block at once in numpy.

The files are a table of blocks: each row holds consecutive documents (ascending ids), their token counts, the control
bytes, the data bytes and the place of the block's first token. The ranks lie beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitbars.llm.common import Workspace, over_batches
from pitbars.llm.tokens import text_encoder

#: A block closes when it holds so many tokens; a longer document is a block by itself.
BLOCK_TOKENS = 65536

_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values, and where each list ends in both.

    ``counts`` gives the lengths of the lists that ``values`` joins; each list starts with a new control byte.
    """
    values = np.ascontiguousarray(values, "<u4")
    counts = np.array([len(values)]) if counts is None else counts
    size = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    control_ends, ends = np.cumsum(-(-counts // 4)), np.cumsum(counts)
    shift = 4 * (control_ends - -(-counts // 4)) - (ends - counts)
    codes = np.zeros(4 * (control_ends[-1] if len(counts) else 0), np.uint8)
    codes[np.arange(len(values)) + np.repeat(shift, counts)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) < size[:, None]
    data = values.view(np.uint8).reshape(-1, 4)[keep].tobytes()
    data_ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[ends]
    return control.astype(np.uint8).tobytes(), data, control_ends, data_ends


def decode_values(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The values of lists of the given lengths: sizes by table lookup, then one gather per byte position."""
    counts = np.asarray(counts, np.int64)
    per_list = -(-counts // 4)
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1).astype(np.int64)
    shift = 4 * (np.cumsum(per_list) - per_list) - (np.cumsum(counts) - counts)
    size = size[np.arange(counts.sum()) + np.repeat(shift, counts)]
    start = np.cumsum(size) - size
    at = np.frombuffer(data, np.uint8)
    out = at[start].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= at[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenize(docs: DataFrame, tokenizer_file: str | None, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, ids, width, counts): little-endian ids of ``width`` bytes, end id included.

    The last row of a task has no ids but ``counts``, how often it met each id, so that counting needs no second pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_file)
        code = np.dtype(encoder.dtype)
        ends = np.array([end_id], code).tobytes()
        names, total = ["id", "n", "ids", "width", "counts"], np.zeros(end_id + 1, np.int64)
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

        def rows(*cols: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [x.tobytes() + ends for x in encoder([x or "" for x in part.column(1).to_pylist()])]
                seen = np.bincount(np.frombuffer(b"".join(ids), code), minlength=len(total))
                seen[: len(total)] += total
                total = seen
                n = [len(x) // code.itemsize for x in ids]
                yield rows(part.column(0).to_pylist(), n, ids, [code.itemsize] * len(n), [None] * len(n))
        if total.any():
            yield rows([None], [None], [None], [None], [total.astype("<i8").tobytes()])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n long, ids binary, width int, counts binary"
    )


def rank_ids(tokens: DataFrame) -> DataFrame:
    """(token, n, rank): ids of the corpus by falling count, then by id; as many rows as the vocabulary has ids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                n = np.frombuffer(counts, "<i8")
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["token", "n"])

    told = tokens.where("counts is not null").select("counts").mapInArrow(run, "token long, n long")
    counts = told.groupBy("token").agg(F.sum("n").alias("n"))
    return counts.select("token", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1).alias("rank"))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_file: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Encode all texts and write ``path``/ranks and ``path``/blocks.

    Every document ends with ``end_id``; a null or empty text is that id alone. Blocks ascend by id; rows that share an
    id all stay, next to each other in no fixed order unless their ids differ; a null id comes first. An empty table gives
    no blocks. Only the two named columns are read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    tokens = ws.table(tokenize(docs, tokenizer_file, end_id, id_col, text_col), "ids")
    rank_ids(tokens).coalesce(1).write.parquet(f"{path}/ranks")
    ranks = np.zeros(1, np.uint32)
    known = spark.read.parquet(f"{path}/ranks").toPandas()  # bounded by the vocabulary
    if len(known):
        ranks = np.zeros(int(known["token"].max()) + 1, np.uint32)
        ranks[known["token"].to_numpy()] = known["rank"].to_numpy()
    shared = spark.sparkContext.broadcast(ranks)

    def code(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        by = shared.value
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, width = part.column(2).to_pylist(), part.column(3)[0].as_py()
            n = np.array(part.column(1).to_pylist(), np.int64)
            control, data, c_ends, d_ends = encode_values(by[np.frombuffer(b"".join(ids), f"<u{width}")], n)
            cut = lambda x, ends: [x[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield {"id": part.column(0), "n": part.column(1), "control": cut(control, c_ends), "data": cut(data, d_ends)}

    documents = tokens.where("counts is null").drop("counts")
    coded = over_batches(documents, code, "id long, n long, control binary, data binary")
    ordered = coded.repartitionByRange("id").sortWithinPartitions("id", "n", "control", "data")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal held, size, number
            row = [
                [part],
                [number],
                [[h[0] for h in held]],
                [[h[1] for h in held]],
                [b"".join(h[2] for h in held)],
                [b"".join(h[3] for h in held)],
                [size],
            ]
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)],
                ["part", "block", "ids", "counts", "control", "data", "n_tokens"],
            )

        types = [
            pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(),
            pa.int64(),
        ]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += row[1]
                if size >= block_tokens:
                    yield closed()
        if held:
            yield closed()

    ordered.mapInArrow(
        block,
        "part int, block long, ids array<long>, counts array<long>, control binary, data binary, "
        "n_tokens long",
    ).write.option("compression", "none").parquet(f"{path}/blocks")
    shared.unpersist()
    ws.close()


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Decode the files of ``write_tokens``: id, start (tokens of all documents before), n_tokens, ids_crc32, and the ids.

    The start of a block comes from the token counts of the blocks before it, one small row a block.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = blocks.select(
        "part",
        "block",
        (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("block_start"),
    )
    starts = inside.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("start"))
    known = spark.read.parquet(f"{path}/ranks").toPandas()
    back = np.zeros(len(known) or 1, np.uint32)
    back[known["rank"].to_numpy()] = known["token"].to_numpy()
    shared = spark.sparkContext.broadcast(back)

    def decode(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        for row in range(batch.num_rows):
            one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
            n = np.array(one["counts"], np.int64)
            ends = np.cumsum(n)
            tokens = shared.value[decode_values(one["control"], one["data"], n)].astype("<u4", copy=False)
            data, bounds = memoryview(tokens).cast("B"), [0, *ends.tolist()]
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            ids = [tokens[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] if with_ids else None
            out = {"part": [one["part"]] * len(n), "block": [one["block"]] * len(n), "id": one["ids"],
                   "at": (ends - n).tolist(), "n_tokens": one["counts"], "ids_crc32": sums}
            yield out | ({"ids": ids} if with_ids else {})

    schema = "part int, block long, id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = over_batches(blocks.drop("n_tokens"), decode, schema)
    return rows.join(starts, ["part", "block"]).select(
        F.col("id").alias(id_col), (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []),
    )
