"""Encoding of a whole corpus with a public vocabulary (see ``bpe``).

Defined results: empty and NULL texts have an empty list of ids; every row of the table comes out, repeated ones too; a
lone surrogate counts as ``?``; columns other than the two named are not read. No shuffle, no limit on a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.llm.bpe import Encoder, read_ranks
from lodeflow.operators.batches import spread, text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ENCODERS: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if (key := hash(data)) not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(data))
    return _ENCODERS[key]


def encode_corpus(table: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``id_col``, ``ids`` ARRAY<INT>) of every row. The vocabulary file is read by the driver and sent to the workers."""
    with open(vocabulary, "rb") as f:
        sent = table.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = [encoder.encode(t) for t in part.column("text").to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])

    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(encode, "id BIGINT, ids ARRAY<INT>").withColumnRenamed("id", id_col)
