"""Arrow helpers: appending columns in tasks, slices of bounded bytes, words, shared files."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a task works on at once, and of rows that a task is sent at once.
SLICE_BYTES, BATCH_BYTES = 2 << 20, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application.

    Rows go to the tasks in batches of bounded bytes: by number alone, some thousand very long
    texts would stand in memory at once, on both sides.
    """
    _bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_cohortlens_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="cohortlens-")) / "cohortlens_modules.zip"
    with zipfile.ZipFile(file, "w") as z:
        for path in root.rglob("*.py"):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(file))
    context._cohortlens_shipped = True


def _bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = (spark.conf.get(key, None) or "-1").removesuffix("b")
    if given.lstrip("-").isdigit() and not 0 < int(given) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows with about ``max_bytes`` of text, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, end - start)


def hand_back() -> None:
    """Give memory that is no longer used back to the system. Workers live on between tasks, and
    what they keep adds up over the stages of a job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its memory


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a task that hands its memory back at its end."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        hand_back()

    return task


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: list[StructField],
    keep: list[str],
    text: str = "text",
    max_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The columns ``keep`` of ``df`` and the ones that a function of the text gives.

    ``make`` builds the function in the task; it gets a slice of the text column without
    nulls (a null is an empty text). A kept column with the name of a new one gives way.
    Rows stay where they are.
    """
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    schema = StructType([df.schema[c] for c in keep] + fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, text, max_bytes):
                kept = [part.column(c) for c in keep]
                texts = pc.fill_null(part.column(text), "")
                yield pa.RecordBatch.from_arrays(kept + fn(texts), names=names)

    ship(df.sparkSession)
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(released(run), schema)


class Words(NamedTuple):
    """Words of several texts: ``codes`` into ``words``; text i has codes[starts[i]:starts[i+1]]."""

    codes: np.ndarray
    starts: np.ndarray
    words: pa.Array


def coded(lists: pa.Array) -> Words:
    """A list column of strings without its empty strings, each distinct string once."""
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, starts = flat.filter(pa.array(full)), before[starts]
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(codes, starts, encoded.dictionary)


def space_words(texts: pa.Array) -> Words:
    """Words between ASCII white space, A-Z in lower case."""
    return coded(pc.ascii_split_whitespace(pc.ascii_lower(texts)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes."""
    if len(strings) == 0:
        return np.zeros(0, np.uint64)
    strings = pa.concat_arrays([strings])
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    offsets = offsets.astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if size == 0:
        return mixed(np.zeros(len(strings), np.uint64))
    data = np.frombuffer(strings.buffers()[2], np.uint8, size, int(offsets[0]))
    offsets = offsets - offsets[0]
    lens = np.diff(offsets)
    at = np.arange(size) - np.repeat(offsets[:-1], lens)
    terms = np.concatenate([_BYTE[data] * powers(_STEP, int(lens.max()))[at], np.zeros(1, np.uint64)])
    sums = np.where(lens > 0, np.add.reduceat(terms, offsets[:-1]), np.uint64(0))
    return mixed(sums + lens.astype(np.uint64))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as ranges of hashes."""
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def list_array(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


# Files in the shared folder ---------------------------------------------------------------


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def new_file(folder: str, name: str):
    """An output stream under a name no other attempt has, and its path."""
    system, root = _located(folder)
    system.create_dir(root, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    return system.open_output_stream(f"{root}/{file}"), f"{folder.rstrip('/')}/{file}"


def read_bytes(path: str) -> bytes:
    system, at = _located(path)
    with system.open_input_stream(at) as f:
        return f.read()


def mapped(path: str) -> pa.NativeFile:
    """A file for random access; memory-mapped where the folder is mounted."""
    system, at = _located(path)
    return pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at)


def list_files(folder: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files below ``folder``, in order of name."""
    system, root = _located(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    head = folder.rstrip("/")
    return sorted(
        (head + x.path[len(root.rstrip("/")) :], x.size) for x in found if x.type == fs.FileType.File
    )
