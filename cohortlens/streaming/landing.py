"""Result documents as they land: an append-only log and its current view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cohortlens.operators.frames import last_by
from cohortlens.session import durable
from cohortlens.sources.documents import RESULT_SCHEMA, document_records

KEYS = ["entity", "grp", "unit", "step"]
#: Which record of a key is the latest.
ORDER = ["landed", "batch", "path", "result_pos", "member_pos"]
MANIFEST = "unit string, step string, gen long, batch long"


def document_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = (
        spark.readStream.schema(RESULT_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    meta = F.col("_metadata")
    return reader.json(path).select(
        "results", meta["file_path"].alias("path"), meta["file_modification_time"].alias("landed")
    )


def land(stream: DataFrame, log: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each micro-batch to its own ``batch`` partition of the log.

    A batch that runs again after a failure overwrites its own partition, so every
    document counts once. Nothing written earlier is read or rewritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        document_records(batch, keep=["landed"]).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, log: str) -> DataFrame:
    """Long rows of the latest record of each student, site and project in the log."""
    return last_by(spark.read.parquet(log), KEYS, ORDER).select(*KEYS, F.inline("cells"))


def compact(spark: SparkSession, log: str, target: str) -> list[tuple]:
    """Merge the batches of the log that are new into the table at ``target``, and trim the log.

    Only partitions (unit, step) with new records are written, each into a folder of a new
    generation; a manifest, written last, says which generation of a partition counts. A
    merge that breaks off leaves the former manifest in force and is made again as a whole.
    Returns the partitions written.

    A batch without its success mark is still being written and left for the next time. What a
    manifest no longer names is deleted one merge later, so that readers can end.
    """
    fs, path_of = _files(spark, log)
    complete = [b for b in _numbers(fs, path_of, log, "batch=") if fs.exists(path_of(f"{log}/batch={b}/_SUCCESS"))]
    generation, merged, parts = _manifest(spark, target)
    fresh = [b for b in complete if b > merged]
    written: list[tuple] = []
    if fresh:
        new = spark.read.option("basePath", log).parquet(*[f"{log}/batch={b}" for b in fresh])
        new = durable(last_by(new, KEYS, ORDER).select(*KEYS, *ORDER, "cells"))
        # as many as there are projects with news, which the step list bounds
        touched = [(r.unit, r.step) for r in new.select("unit", "step").distinct().collect()]
        former = {p: g for p, g in parts.items() if p in set(touched)}
        every = new.unionByName(_records(spark, target, former, new.schema)) if former else new
        newest = last_by(every, KEYS, ORDER).withColumn("gen", F.lit(generation + 1))
        shape = newest.hint("rebalance", "unit", "step")  # few files, and a large project in several tasks
        shape.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gen", "unit", "step").parquet(
            f"{target}/records"
        )
        now = parts | dict.fromkeys(touched, generation + 1)
        rows = [(u, s, g, max(fresh)) for (u, s), g in now.items()]
        listed = spark.createDataFrame(rows or [(None, None, None, max(fresh))], MANIFEST)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/{generation + 1}")
        _sweep(spark, target, parts, now, generation + 1)
        written, merged = sorted(touched, key=str), max(fresh)
    for batch in complete:
        if batch <= merged:
            fs.delete(path_of(f"{log}/batch={batch}"), True)
    return written


def merged(spark: SparkSession, target: str, units: list[str] | None = None) -> DataFrame:
    """Long rows of a table that ``compact`` keeps; of some units only their folders are read."""
    _, last, parts = _manifest(spark, target)
    if last < 0:
        raise FileNotFoundError(f"nothing merged at {target}")
    wanted = {p: g for p, g in parts.items() if units is None or p[0] in units}
    return _records(spark, target, wanted, None).select(*KEYS, F.inline("cells"))


def _records(spark: SparkSession, target: str, parts: dict[tuple, int], schema) -> DataFrame:
    """Records of the partitions, each of its generation. The choice is made by partition
    columns, so no other folder is read."""
    kinds = schema or spark.read.parquet(f"{target}/records").schema
    fields = [f for f in kinds.fields if f.name not in ("gen", "unit", "step")]
    table = StructType([*fields, StructField("gen", LongType()), StructField("unit", StringType()), StructField("step", StringType())])
    rows = spark.read.schema(table).parquet(f"{target}/records")
    hit = F.lit(False)
    for gen in sorted(set(parts.values())):
        mine = [F.col("unit").eqNullSafe(F.lit(u)) & F.col("step").eqNullSafe(F.lit(s)) for (u, s), g in parts.items() if g == gen]
        hit = hit | ((F.col("gen") == gen) & reduce(lambda a, b: a | b, mine))
    return rows.where(hit).select(*[f.name for f in kinds.fields if f.name != "gen"])


def _manifest(spark: SparkSession, target: str) -> tuple[int, int, dict[tuple, int]]:
    """Generation, last batch merged and the generation of each partition, of the newest
    manifest that is complete; (0, -1, nothing) without one."""
    fs, path_of = _files(spark, target)
    known = [g for g in _numbers(fs, path_of, f"{target}/manifest", "") if fs.exists(path_of(f"{target}/manifest/{g}/_SUCCESS"))]
    if not known:
        return 0, -1, {}
    rows = spark.read.schema(MANIFEST).parquet(f"{target}/manifest/{max(known)}").collect()
    return max(known), rows[0].batch, {(r.unit, r.step): r.gen for r in rows if r.gen is not None}


def _sweep(spark: SparkSession, target: str, before: dict, now: dict, generation: int) -> None:
    """Delete folders that neither this manifest nor the one before it names."""
    fs, path_of = _files(spark, target)
    named = set(before.values()) | set(now.values())
    for gen in _numbers(fs, path_of, f"{target}/records", "gen="):
        if gen not in named:
            fs.delete(path_of(f"{target}/records/gen={gen}"), True)
    for gen in _numbers(fs, path_of, f"{target}/manifest", ""):
        if gen < generation - 1:
            fs.delete(path_of(f"{target}/manifest/{gen}"), True)


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and how it names a path."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(folder).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _numbers(fs, path_of, folder: str, prefix: str) -> list[int]:
    """Sorted numbers of the folders ``<prefix><number>`` in a folder."""
    if not fs.exists(path_of(folder)):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path_of(folder)) if s.isDirectory()]
    return sorted(int(n[len(prefix):]) for n in found if n.startswith(prefix) and n[len(prefix):].isdigit())
