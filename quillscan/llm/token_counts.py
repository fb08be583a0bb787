"""Token counts by the whole-token shortcut.

The vocabulary is examined offline (when a worker loads it): every string whose
boundary-marked form is one piece *and* which the library encodes as that piece
alone enters the whole-token table.  A text's pre-tokens that are in the table
count one each; only the others are merged by the library, each distinct one once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column, filled, slices
from .tokenizing import TOKEN_SLICE, encoder

CONTEXT = 4096


def token_counts(docs: DataFrame, tokenizer: str, context: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    One scan, no shuffle; memory per worker is one slice of text plus a bounded
    memo.  Null and empty texts have no bytes and no tokens.  Repeated rows each
    give a row, a null id stays null, other columns of ``docs`` are never read, and
    an empty table gives an empty result.  A very long text is counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer, "counts").count
        for part in slices(batches, "text", TOKEN_SLICE, "tokens"):
            text = filled(column(part, "text"))
            n = count(text)
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n, pa.int64()), pa.array(np.asarray(n) > context)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
