"""Corpus cleaning in stages; each is written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe_chunks, decontaminate, exact_dedup, near_dedup, toxicity
from cohortlens.llm.queries import ID_DIGESTS, id_digests, new_name
from cohortlens.session import durable


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the other columns in one: none of them can clash with a new one."""
    row = F.struct(*[c for c in docs.columns if c != "text"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from packed ones."""
    return df.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the columns, nulls being equal."""
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[name])
    return found


#: Shingle similarity, in percent, from which on documents are near duplicates here. With 25
#: bands a pair at this limit shares none with probability (1 - 0.8**4)**25, less than 2e-6.
NEAR_PERCENT, NEAR_BANDS = 80, 25


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below 0.5.

    Null and empty texts are scored as empty ones, and stay unless labels say that those are toxic;
    equal rows are all kept or all dropped; an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(packed(docs), labels, ["row", "text"])
    return unpacked(scored.where("score < 0.5"), docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id; of rows that share it, any one."""
    rows = durable(exact_dedup.DigestIndex(spark, new_name("digests")).absorb(docs, "pipeline"))
    out = packed(docs).withColumn("digest", exact_dedup.digest())
    dropped = rows.where(~F.col("kept")).select("doc_id", "digest").distinct()
    out = out.join(dropped, same(out, dropped, "doc_id", "digest"), "left_anti")
    repeated = rows.where(F.col("kept") & (F.col("n_kept") > 1)).select("doc_id", "digest").distinct()
    if repeated.isEmpty():
        return unpacked(out, docs)
    single = out.join(repeated, same(out, repeated, "doc_id", "digest"), "left_anti")
    several = out.join(repeated, same(out, repeated, "doc_id", "digest"), "left_semi")
    several = several.groupBy("digest").agg(F.first("row").alias("row"), F.first("text").alias("text"))
    return unpacked(single, docs).union(unpacked(several, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of a similarity of 0.8: the one with the smallest doc_id.

    A doc_id names a document: rows that share one stay together if any of them is kept.
    Of a component of rows without doc_id, all stay.
    """
    rows = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS)
    dropped = rows.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    return unpacked(packed(docs).join(durable(dropped), "doc_id", "left_anti"), docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts have no passage and stay; equal rows are all kept or all dropped; without
    items everything stays; an empty table gives an empty one.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scanned = decontaminate.scan(packed(docs), items, ["row", "text"])
    return unpacked(scanned.where(F.size("hits") == 0), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and digest of the text decoded from them.

    A null text is an empty one, without ids; each row gives one row, also a repeated one or one
    without doc_id; an empty table gives an empty one.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_chunks.encode(docs, path, ["doc_id"], finish=id_digests, fields=ID_DIGESTS)


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", contaminated),
    ("bpe", encoded),
]

#: No SQL states the toxicity, the sketches or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
