"""Proportional stratified interleaving of rows into shards, by DataFrame operations only.

Rows get a seeded shuffled rank within their stratum; the rank divided by the size of the stratum (shifted by a
seeded offset per stratum, so that many small strata spread out too) is their place on the unit interval. Sorted by
place, every stretch of rows mixes the strata in proportion, and the cut into equal numbers of rows gives every shard
the mixture. No window ever holds a whole stratum: rows are ranked in cells of the hash or of the unit interval,
and a running sum over the counts of cells carries the rank on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitbars.llm.common import Workspace, hex_order

ROWS_PER_CELL = 16384
_TWO32 = 4294967296.0


def _unit(hexed: Column) -> Column:
    """The first 32 bits of a hex digest as a number from 0 up to 1."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") / F.lit(_TWO32)


def assign(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes plus 16), text_crc32, stratum, shard and slot.

    Shards differ by at most one row; slots count from 0 without gaps in the order of interleaving. A null text has
    16 bytes and the checksum of the empty text; a null stratum is a stratum of its own; null ids are ranked as the
    empty string. Rows with the same id are told apart by checksum and size; rows equal in these too may swap places,
    which changes no result. An empty table gives no rows; with fewer rows than shards some shards are empty. Only the
    named columns are read, so others may have any name.
    """
    ws = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = ws.table(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("-")).alias("stratum"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
        ).withColumn("h", hex_order(F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")))),
        "slim",
    )
    n = slim.count()
    cells = -(-n // rows_per_cell) or 1
    order = ["h", "id", "crc", "size"]

    by_hash = slim.withColumn("cell", F.floor(_unit(F.col("h")) * cells))
    counts = by_hash.groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    running = Window.partitionBy("stratum").orderBy("cell")
    before = counts.select(
        "stratum",
        "cell",
        (F.sum("n").over(running) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("n_stratum"),
    )
    ranked = by_hash.withColumn(
        "k", F.row_number().over(Window.partitionBy("stratum", "cell").orderBy(*order))
    ).join(before, ["stratum", "cell"])
    shift = _unit(hex_order(F.lit(str(seed)), F.lit("stratum"), F.col("stratum")))
    placed = ws.table(
        ranked.withColumn(
            "place", ((F.col("k") + F.col("before")).cast("double") - 1 + shift) / F.col("n_stratum").cast("double")
        ).select(*order, "stratum", "place"),
        "placed",
    )
    by_place = placed.withColumn("cell", F.least(F.floor(F.col("place") * cells), F.lit(cells - 1)))
    # one row per cell of rows_per_cell rows: the one window without a partition is over these counts
    starts = by_place.groupBy("cell").agg(F.count("*").alias("n")).select(
        "cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("before")
    )
    at = by_place.withColumn(
        "k", F.row_number().over(Window.partitionBy("cell").orderBy("place", "stratum", *order))
    ).join(starts, "cell").withColumn("at", (F.col("k") + F.col("before") - 1).cast("long"))
    cut = at.withColumn("shard", F.expr(f"at * {n_shards} div {max(n, 1)}").cast("int"))
    first = F.expr(f"(shard * cast({n} as long) + {n_shards - 1}) div {n_shards}")
    return cut.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "stratum",
        "shard",
        (F.col("at") - first).cast("long").alias("slot"),
    )


def write_shards(
    docs: DataFrame, shards: DataFrame, path: str, files: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the rows of ``docs`` with shard and slot, a folder per shard, rows in slot order within each file.

    ``files`` range partitions are dealt over (shard, slot), so a shard is not bound to one task. ``docs`` and ``shards``
    meet by id, checksum and size; repeated rows are numbered on both sides.
    """
    keys = [id_col, "text_crc32", "size"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("text_crc32", F.crc32(text.cast("binary"))).withColumn(
        "size", (F.octet_length(text) + 16).cast("long")
    )
    number = lambda df, *o: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*o)))
    left = number(keyed, F.xxhash64(*docs.columns))
    right = number(shards.select(*keys, "shard", "slot"), "shard", "slot")
    on = [left[k].eqNullSafe(right[k]) for k in (*keys, "_n")]
    (
        left.join(right, on).select(*[left[c] for c in docs.columns], right["shard"], right["slot"])
        .repartitionByRange(files, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
