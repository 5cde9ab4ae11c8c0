"""Token counts: batch encoding in Arrow functions that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crewmetrics.llm.tokens import ENCODED_BYTES, Encoder
from crewmetrics.llm.words import buffers, slices, text_column


def token_counts(docs: DataFrame, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for each row, repeated rows and null keys included.

    ``tokenizer`` is the file of a byte-level BPE that executors can open.  Each task takes its rows in
    slices of about equal bytes, cuts long texts at safe spaces and encodes each distinct piece once;
    only numbers leave the task.  A null text is empty and has 0 tokens.  Other columns are not read.
    """
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, text, ENCODED_BYTES):
                n_tokens = encoder.lengths(part.column(text))
                n_bytes = np.diff(buffers(text_column(part.column(text)))[1])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], schema.names)

    return docs.select(key, text).mapInArrow(count, schema)
