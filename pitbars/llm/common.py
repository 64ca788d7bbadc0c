"""Helpers the operators share: tables in the shared folder, Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder on a local master (tests); on a cluster that is an error,
    as executors could not read what another machine wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Workspace:
    """Intermediate tables of one operator call, in a folder of their own below the shared one.

    Writing cuts the lineage: a lost executor costs a re-read. ``drop`` removes a table nothing reads any more;
    tables the returned DataFrame still reads stay until the caller removes ``folder`` with ``close``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._kept: list[DataFrame] = []

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._kept.append(out)
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self._paths.pop(id(t), None):
                self._delete(path)

    def close(self) -> None:
        self._delete(self.folder)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def over_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, object]]], schema: str | StructType
) -> DataFrame:
    """``fn`` maps a batch to dicts of columns (lists or Arrow arrays) in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(typed, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                        for c, f in zip(cols.values(), arrow, strict=True)
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long). Returns (id, component): every node with its smallest id.

    Alternates two star contractions, each a grouped minimum and a join, until the edges are stars around the smallest
    ids. Loops and repeated edges are allowed.
    """
    cur = ws.table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "edges",
    )
    while True:
        # done when every node that points somewhere points to one node, which points nowhere (edges point to smaller ids)
        ends = cur.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
            cur.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into"))
        )
        degrees = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if degrees.where("out + into > 1 and out > 0").isEmpty():
            break
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        nxt = ws.table(small, "edges")
        ws.drop(cur)
        cur = nxt
    roots = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return roots.union(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def sized(df: DataFrame, text: str = "text", count: str = "n_chars") -> DataFrame:
    """Set the character count of ``documents`` anew after its text changed, where the column exists."""
    return df.withColumn(count, F.length(text).cast(dict(df.dtypes)[count])) if count in df.columns else df


def hex_order(*cols: Column | str) -> Column:
    """A seeded order both Spark and SQL can state: MD5 of the joined values, in lower-case hex."""
    return F.md5(F.concat_ws(":", *cols))
