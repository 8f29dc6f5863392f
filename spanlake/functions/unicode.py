"""Unicode normal forms of a text column, batch by batch."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def normalised(df: DataFrame, column: str, form: str = "NFKC") -> DataFrame:
    """``df`` with ``column`` in a normal form (NFKC: full-width letters, ligatures and the like as plain ones); null stays null.

    Arrow's own kernel leaves composed forms decomposed, so the standard library's tables serve.
    """
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
