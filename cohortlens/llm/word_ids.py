"""Numbers for the words of each language, from sorted arrays in the shared folder.

Words are dealt out by ranges of their hashes to files of a bounded size. A file is an Arrow
table sorted by hash, which tasks map into memory: a word is found by a binary search and
compared letter by letter, so hashes that clash do no harm; a number leads back to its word.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrow import bucket_of, mapped, mixed, new_file, read_bytes, ship, string_hashes
from cohortlens.session import durable, shared_folder

#: Words of one file.
FILE_WORDS = 1 << 19
_LANG = np.uint64(0x9FB21C651E98DF25)


def word_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """A hash of each word and its language."""
    return mixed(string_hashes(langs) * _LANG + string_hashes(words))


class WordIds(NamedTuple):
    """Where the files are and the first number of each; a row per file."""

    paths: list[str]
    firsts: list[int]


def _write(folder: str):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        table = table.combine_chunks()
        hashes = word_hashes(table.column("lang").combine_chunks(), table.column("word").combine_chunks())
        order = pa.array(np.lexsort([hashes]))
        out = pa.table({"hash": hashes}).append_column("lang", table.column("lang")).append_column("word", table.column("word"))
        out = out.append_column("n", table.column("n")).take(order).combine_chunks()
        file, path = new_file(folder, f"words-{bucket}")
        with pa.ipc.new_file(file, out.schema) as writer:
            writer.write_table(out)
        file.close()
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "path": [path], "size": pa.array([out.num_rows], pa.int64())})

    return run


def write(words: DataFrame, folder: str | None = None, file_words: int = FILE_WORDS) -> WordIds:
    """Number the rows of ``(lang, word, n)``, which has each once and no nulls."""
    spark = words.sparkSession
    ship(spark)
    folder = folder or f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    buckets = max(1, -(-words.count() // file_words))

    def place(batches):
        for b in batches:
            hashes = word_hashes(b.column("lang"), b.column("word"))
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(hashes, buckets)), *b.columns], ["bucket", "lang", "word", "n"])

    placed = words.select("lang", "word", "n").mapInArrow(place, "bucket long, lang string, word string, n long")
    files = placed.groupBy("bucket").applyInArrow(_write(folder), "bucket long, path string, size long")
    rows = durable(files).orderBy("bucket").collect()  # a row per file
    paths, firsts, at = [""] * buckets, [0] * buckets, 1
    sizes = {r.bucket: (r.path, r["size"]) for r in rows}
    for b in range(buckets):
        firsts[b] = at
        paths[b], size = sizes.get(b, ("", 0))
        at += size
    return WordIds(paths, firsts)


class Lookup:
    """Numbers of words and words of numbers, by the mapped files."""

    def __init__(self, ids: WordIds):
        self.ids = ids
        self.open: dict[int, tuple] = {}
        self.firsts = np.array(ids.firsts, np.int64)

    def _file(self, bucket: int):
        if bucket not in self.open:
            source = mapped(self.ids.paths[bucket])
            if not isinstance(source, pa.MemoryMappedFile):
                source = pa.BufferReader(read_bytes(self.ids.paths[bucket]))
                self.open.clear()  # not mapped: one file in memory at a time
            table = pa.ipc.open_file(source).read_all().combine_chunks()
            columns = [table.column(c).chunk(0) for c in ("hash", "lang", "word", "n")]
            self.open[bucket] = (columns[0].to_numpy(), *columns[1:])
        return self.open[bucket]

    def find(self, langs: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, 0 if it has none, and its count."""
        hashes = word_hashes(langs, words)
        out, counts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        bucket = bucket_of(hashes, len(self.ids.paths))
        for b in np.unique(bucket).tolist():
            if not self.ids.paths[b]:
                continue
            keys, key_langs, key_words, n = self._file(b)
            open_ = np.flatnonzero(bucket == b)
            at = np.searchsorted(keys, hashes[open_])
            while len(open_):
                there = at < len(keys)
                there[there] = keys[at[there]] == hashes[open_[there]]
                open_, at = open_[there], at[there]
                take, where = pa.array(at), pa.array(open_)
                same = pc.and_(pc.equal(key_words.take(take), words.take(where)), pc.equal(key_langs.take(take), langs.take(where)))
                same = same.to_numpy(zero_copy_only=False)
                out[open_[same]] = self.ids.firsts[b] + at[same]
                counts[open_[same]] = n.take(take).to_numpy()[same]
                open_, at = open_[~same], at[~same] + 1  # another word of the same hash
        return out, counts

    def rows(self, ids: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, word and count of each number, which has one."""
        distinct, back = np.unique(ids, return_inverse=True)
        bucket = np.searchsorted(self.firsts, distinct, "right") - 1
        parts = []
        for b in np.unique(bucket).tolist():
            at = pa.array(distinct[bucket == b] - self.ids.firsts[b])
            parts.append([c.take(at) for c in self._file(b)[1:]])
        if not parts:
            return pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0, np.int64)
        langs, words, n = (pa.concat_arrays(c) for c in zip(*parts, strict=True))
        back = pa.array(back)
        return langs.take(back), words.take(back), n.take(back).to_numpy()
