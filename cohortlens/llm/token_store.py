"""Token ids in shard files: one concatenated id array and Elias-Fano document boundaries.

A shard is two files in a shared folder. ``ids`` is the array itself, unsigned 16-bit where
the vocabulary allows it, else 32-bit, little-endian. ``index`` holds two Elias-Fano
sequences, the boundaries of its documents in that array and their doc_ids, each with
select. The manifest, one row per shard, lists the files that count: those of an attempt
that was lost are not in it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import elias_fano
from cohortlens.llm.arrow import mapped, new_file, read_bytes, ship, slices
from cohortlens.llm.units import UnitEncoder

MANIFEST = "shard int, ids string, index string, width int, n_docs long, n_ids long"
_INDEX = "<qQQQ"  # base of the doc_ids, rows without one, bytes of each sequence


def write(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0,
    id_col: str = "doc_id", text: str = "text", shards: int | None = None,
) -> DataFrame:
    """Encode every text and write shards in ascending order of ``id_col``; the manifest.

    Documents are range-partitioned by id, so shard k holds smaller ids than shard k+1.
    Rows without an id come first; rows of equal id are in order of text. A null text is
    empty; ``end_id`` is appended to each document unless None. An empty table gives empty
    shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id or 0) <= 1 << 16 else 4
        out, ids_path = new_file(folder, "ids")
        lens, keys, nulls = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, starts = encoder.ids(pc.fill_null(part.column("text"), ""))
                if end_id is not None:
                    ids = np.insert(ids, starts[1:], end_id)
                    starts = starts + np.arange(len(starts))
                out.write(ids.astype(f"<u{width}").tobytes())
                lens.append(np.diff(starts))
                key = part.column("id")
                nulls += key.null_count
                keys.append(key.drop_null().to_numpy(zero_copy_only=False))
        out.close()
        ends = np.cumsum(np.concatenate([[0], *lens]).astype(np.int64))
        keys = np.concatenate([np.zeros(0, np.int64), *keys])
        base = int(keys[0]) if len(keys) else 0
        bounds = elias_fano.encode(ends)
        coded = elias_fano.encode((keys - base).astype(np.uint64))
        out, index_path = new_file(folder, "index")
        out.write(struct.pack(_INDEX, base, nulls, len(bounds), len(coded)) + bounds + coded)
        out.close()
        row = [TaskContext.get().partitionId(), ids_path, index_path, width, len(ends) - 1, int(ends[-1])]
        names = ["shard", "ids", "index", "width", "n_docs", "n_ids"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    rows.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``, the number of ids in all shards before."""
    rows = sorted(manifest.collect(), key=lambda r: r.shard)  # one row per shard
    first = np.concatenate([[0], np.cumsum([r.n_ids for r in rows])]).tolist()
    data = [(*r, at) for r, at in zip(rows, first, strict=False) if r.n_docs]
    out = manifest.sparkSession.createDataFrame(data, MANIFEST + ", first long")
    return out.repartition(max(1, len(data)), "shard")


class Shard:
    """One shard, its documents by position."""

    def __init__(self, ids: str, index: str, width: int):
        data = read_bytes(index)
        self.base, self.nulls, n_bounds, _ = struct.unpack_from(_INDEX, data)
        head = struct.calcsize(_INDEX)
        self.bounds = elias_fano.EliasFano(data[head : head + n_bounds])
        self.keys = elias_fano.EliasFano(data[head + n_bounds :])
        self.file, self.width = mapped(ids), width

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def blocks(self, block_docs: int = 4096) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
        """Boundaries, doc_ids and ids of runs of documents."""
        for start in range(0, len(self), block_docs):
            end = min(start + block_docs, len(self))
            bounds = self.bounds.select(start, end + 1)
            known = self.keys.select(max(0, start - self.nulls), max(0, end - self.nulls)) + self.base
            keys = [None] * max(0, min(end, self.nulls) - start) + known.tolist()
            self.file.seek(int(bounds[0]) * self.width)
            size = int(bounds[-1] - bounds[0]) * self.width
            yield bounds, keys, np.frombuffer(self.file.read(size), f"<u{self.width}")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: ``doc_id, start, n_tokens, ids_crc32``, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            for bounds, keys, ids in Shard(row["ids"], row["index"], row["width"]).blocks():
                wide = memoryview(ids.astype("<u4")).cast("B")
                cuts = ((bounds - bounds[0]) * 4).tolist()
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(bounds[:-1] + row["first"], pa.int64()),
                     pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def open_store(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a store written before."""
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
