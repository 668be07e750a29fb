"""Operator 7, byte-level BPE encoding and decoding of whole texts.

`encode` adds the ids of a text as little-endian unsigned 32-bit integers,
`decode` turns such ids back into bytes; both run batch by batch in Arrow,
without a shuffle.  See `bpe` for the matrices.

Defined cases: null and empty texts have no ids; the order of rows and
repeated rows do not matter; other columns pass through unless named as the
output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewell.llm import bpe
from tracewell.llm.common import slices

BATCH_BYTES = 4 << 20


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array of slices of data's bytes; ends in items of data."""
    offsets = np.append(0, ends).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _adds(docs: DataFrame, source: str, out: str, fn) -> DataFrame:
    rest = [c for c in docs.columns if c.lower() != out.lower()]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(out, T.BinaryType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, source, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), fn(b)], [*rest, out])

    return docs.mapInArrow(batches, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    def fn(b: pa.RecordBatch) -> pa.Array:
        ids, ends = bpe.byte_level_coder(path, pattern).batch(b.column(text))
        return _binary(ids.astype("<u4"), ends)

    return _adds(docs, text, out, fn)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    def fn(b: pa.RecordBatch) -> pa.Array:
        get = bpe.token_bytes(path).__getitem__
        return pa.array([b"".join(map(get, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in b.column(ids).to_pylist()], pa.binary())

    return _adds(coded, ids, out, fn)
