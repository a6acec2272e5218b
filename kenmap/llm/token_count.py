"""Token counts by the whole-token shortcut.

Before any text is read, the merge procedure is run once over each string of the vocabulary, which
proves the set of strings that encode alone as one token.  A pre-token of a text that is in that set
counts one; only the rest is merged (through the exact encoder of ``bpe``), and its count is remembered
for the pre-tokens that come back.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count as the
library counts them by default (one token each); repeated rows give repeated results; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.bpe import BpeCodec, Memo, codec


class TokenCounter:
    def __init__(self, own: BpeCodec) -> None:
        self.own = own
        self.whole = own.tables.whole
        self.pieces = Memo(self._count_piece)
        self.chunks = Memo(self._count_chunk)

    def _count_piece(self, piece: str) -> int:
        form = self.own._mapped(piece)
        return 1 if form in self.whole else len(self.own.tables.encode_form(form))

    def _count_chunk(self, chunk: str) -> int:
        own = self.own
        if own.lowers or (own.special_split is not None and "<|" in chunk) or not chunk.isascii():
            return len(own._encode_chunk(chunk))
        return sum(map(self.pieces.__getitem__, own.pieces_of(chunk)))

    def count(self, text: str | None) -> int:
        return sum(map(self.chunks.__getitem__, self.own.chunks(text))) if text else 0


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(codec(path))


def token_counts(df: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``), one row for each row of ``df``, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            n = [own.count(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
