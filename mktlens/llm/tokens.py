"""Token counts: batch encoding in Arrow functions that return lengths only."""
from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktlens.llm._arrow import slices
from mktlens.llm._pieces import PieceTable, words

#: Pieces up to this many bytes are kept in the worker's table and encoded
#: together; longer ones are encoded one by one and not kept.
SHORT = 256
#: Bytes of new pieces that one call of the tokenizer gets at most.
CALL_BYTES = 1 << 16


@lru_cache(maxsize=4)
def _table(path: str) -> PieceTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    def encode(pieces: list[bytes]) -> list[int]:
        out: list[int] = []
        call: list[str] = []
        size = 0
        for p in pieces:
            call.append(p.decode("utf-8", "replace"))
            size += len(p)
            if size >= CALL_BYTES:
                out += lengths(call)
                call, size = [], 0
        return out + lengths(call) if call else out

    def lengths(call: list[str]) -> list[int]:
        return [len(e) for e in tok.encode_batch_fast(call, add_special_tokens=False)]

    return PieceTable(encode, lengths_only=True)


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text, as the ``tokenizers`` file at path
    ``tokenizer`` gives them (no added special tokens, no truncation; special
    strings inside a text count as that library's default).

    For a tokenizer that drops white space and never merges across it, such as
    ``word_bpe_49k.json``: every run of space, tab and line breaks is then a safe
    boundary, long texts included.  Arrow slices are balanced by bytes.  No
    shuffle: one pass over the rows, whatever one source or text weighs.

    Null and empty texts: 0 bytes, 0 tokens.  Repeated rows each give a row.
    Other columns are ignored, whatever their names; an empty table gives an
    empty result.  Columns: the id, n_bytes, n_tokens, over_limit.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer)
        for rows, raw, off in slices(batches, "text"):
            start, end = words(raw, off)
            n = np.zeros(len(start), np.int64)
            long = end - start > SHORT
            if len(start):
                short = ~long
                if short.any():
                    rows_of = table.rows(raw, start[short], end[short])
                    n[short] = table.count[rows_of]
                for i in np.flatnonzero(long).tolist():
                    n[i] = table.encode([raw[start[i] : end[i]].tobytes()])[0]
            sums = np.concatenate([[0], np.cumsum(n)])
            first = np.searchsorted(start, off)
            total = sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(off)), pa.array(total), pa.array(total > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    )
    return out.withColumnRenamed("id", id_col)
