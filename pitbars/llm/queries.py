"""The numbered queries over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.llm import (
    alignment,
    bpe,
    chat,
    embedding_dedup,
    langid,
    minhash,
    oracle,
    packing,
    pii,
    quality,
    runs,
    sharding,
    token_store,
    warc,
)
from pitbars.llm.common import Workspace, read


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "op1").path("tokens")
    token_store.write_tokens(read(spark, sf_dir, "documents"), path)
    return token_store.read_tokens(spark, path)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), size=1024)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(read(spark, sf_dir, "pages")))
    return records.drop("block").withColumnRenamed("source_key", "page_id")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_size=2)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~held_out))
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(read(spark, sf_dir, "documents")))


def op8_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read(spark, sf_dir, "documents"))


def op9_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign(read(spark, sf_dir, "documents"), n_shards=40)
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        "select -1L conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_chats(turns))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.text_runs(read(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_packing,
        op3_warc,
        op4_minhash,
        op5_language,
        op6_vectors,
        op7_personal_data,
        op8_byte_pairs,
        op9_interleaving,
        op10_quality,
        op11_chat,
        op12_alignment,
        op13_runs,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": oracle.warc_derivatives(),
    "op4_minhash": oracle.near_duplicates(),
    "op6_vectors": oracle.vectors(),
    "op9_interleaving": oracle.interleaving(),
    "op10_quality": oracle.quality(),
    "op11_chat": oracle.chats(),
}
