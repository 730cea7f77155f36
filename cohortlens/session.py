"""Session helpers: building a session, cutting lineage, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have to be sent to every executor.
BROADCAST_ROWS = 20_000


def local_session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the session names in
    ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder: on a cluster that would not
    survive the loss of an executor, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/cohortlens-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back from there.

    What follows starts from the table: nothing before it is computed again, also not
    after a lost executor, its columns are pruned and its size is known to the planner.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` computed once and marked for broadcast if it has at most ``max_rows`` rows.

    At most ``max_rows + 1`` rows are fetched to find out. A larger table comes back as
    it was, so that the join it takes part in is an ordinary shuffle join.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema))


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table as constants; no join."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one row expected, not {len(rows) or 'none'}")
    kinds = {f.name: f.dataType for f in one_row.schema.fields}
    return df.withColumns({c: F.lit(rows[0][c]).cast(k) for c, k in kinds.items()})


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where the keys agree; NULL keys agree too."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
    out = left.join(named, on, how)
    return out if how == "left_semi" else out.drop(*[f"_r_{k}" for k in keys])


def in_parallel(spark: SparkSession, fn: Callable, items: list, threads: int | None = None) -> dict:
    """``fn`` of each item, several jobs at a time, as a dict by item.

    For independent fits: the threads keep the cluster busy between the short stages of
    a single one. By default as many run as there are cores, four at least.
    """
    threads = threads or max(4, spark.sparkContext.defaultParallelism)
    with ThreadPoolExecutor(max(1, min(threads, len(items)))) as pool:
        return dict(zip(items, pool.map(inheritable_thread_target(spark)(fn), items)))
