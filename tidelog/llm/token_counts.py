"""Token counts of whole texts under a byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.bpe import byte_bpe
from tidelog.llm.vec import pieces


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes, n_tokens.

    `vocabulary` is the path of a tokenizers file, present on every executor. Pre-tokens of a batch of texts lie in ragged
    arrays; distinct ones are merged rank by rank together, the surviving symbols counted and remembered for later batches.
    A special string inside a text counts one. A null text is empty and has no tokens. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(bpe.counts(data, offsets))], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return found.withColumnRenamed("id", id_col)
