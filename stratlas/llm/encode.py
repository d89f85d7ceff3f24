"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratlas.llm.bpe import MatrixBpe, vocabulary_path


@lru_cache(maxsize=2)
def encoder(path: str) -> MatrixBpe:
    """One encoder per Python worker and vocabulary."""
    return MatrixBpe(path)


def encode_ids(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    out_col: str = "ids",
) -> DataFrame:
    """``(id, ids)`` of every row of ``docs``: the vocabulary's ids of the whole text, without special tokens.

    A map over the scan: no shuffle, and only the two columns are read. Null and empty texts get an empty
    list; repeated rows come out as often as they went in; a null id stays null; other columns, whatever
    their names, are ignored; an empty table gives an empty table. Strings of special tokens in a text are
    ordinary text.
    """
    narrow = docs.select(docs[id_col], docs[text_col].cast("string"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(out_col, T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary or vocabulary_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                flat, ends = bpe.encode(part.column(1).to_pylist())
                field = pa.field("element", pa.int32(), False)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), type=pa.list_(field))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, out_col])

    return narrow.mapInArrow(run, schema)
