"""Token counts of whole texts without keeping the ids."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from cohortlens.llm.arrow import append_columns
from cohortlens.llm.units import UnitEncoder


def count_tokens(
    docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text", batch_bytes: int = 8 << 20
) -> DataFrame:
    """``keep`` of each row, ``n_bytes`` (UTF-8) and ``n_tokens`` of its text.

    Each Arrow batch is cut into runs of rows with ``batch_bytes`` of text, whatever the
    number of rows; texts are split where the tokenizer starts anew, and what recurs is
    encoded once per worker and remembered as a length. A null text is empty and has no
    tokens; an empty table gives an empty one; repeated rows and ties stay as they are; input
    columns named ``n_bytes`` or ``n_tokens`` are replaced.
    """

    def make():
        encoder = UnitEncoder(tokenizer, lengths_only=True)

        def count(texts: pa.Array) -> list[pa.Array]:
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            return [sizes, pa.array(encoder.lengths(texts), pa.int64())]

        return count

    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    return append_columns(docs, make, fields, keep, text, batch_bytes)
