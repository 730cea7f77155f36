"""Exact duplicates against a persistent index of digests, in DataFrame operations only.

The index is a table bucketed and sorted by digest. A batch is reduced to its distinct
digests, those the index lacks are found by a sort-merge anti-join, and appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import durable

SCHEMA = "digest binary, keep_id long, n_rows long, n_kept long, batch string"


def digest(text: str = "text") -> Column:
    """SHA-256 of the text's UTF-8 bytes; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class DigestIndex:
    """A table of digests, each with the row that stays.

    ``buckets`` is fixed when the table is made; by default it is the session's number of
    shuffle partitions.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if spark.catalog.tableExists(table):
            facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
            self.buckets = int(facts["Num Buckets"])
        else:
            self._append(spark.createDataFrame([], SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        # the partitioning of the buckets: one file each
        (rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def absorb(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """Add the texts of ``docs`` and return ``doc_id, digest, keep_id, group_size, kept, n_kept``
        of every row.

        Of equal texts in a batch the one with the largest id stays; a text that an earlier
        batch brought is never kept again. ``group_size`` counts the rows of the batch that
        brought the text and of this one. A null id is smaller than any other, a null text
        is empty; equal ids with equal texts are all marked as kept, and ``n_kept`` tells how
        many they are. An empty table adds nothing. Other columns are ignored. A batch
        absorbed twice under one name changes nothing and returns the same.
        """
        ids = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest")))
        # partial sums before the shuffle: a text that fills a third of the rows is one row per task
        found = ids.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
        found = found.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"),
            F.sum("n").alias("n_rows"),
            F.max_by("n", F.coalesce("doc_id", F.lit(-(2**63)))).alias("n_kept"),
        )
        found = durable(found)
        new = found.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._append(new.withColumn("batch", F.lit(batch)))
        known = self.rows().join(found.select("digest", F.col("n_rows").alias("now")), "digest")
        mine = F.col("batch") == batch
        known = known.select(
            "digest", "keep_id", "n_kept", mine.alias("mine"),
            F.when(mine, F.col("n_rows")).otherwise(F.col("n_rows") + F.col("now")).alias("group_size"),
        )
        # both sides of the last join are dealt out anew, so that a digest with very many rows is
        # split among tasks and its one index row copied to them
        return ids.join(durable(known).hint("merge"), "digest").select(
            "doc_id", "digest", "keep_id", "group_size",
            (F.col("mine") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "n_kept",
        )
