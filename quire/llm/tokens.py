"""Token counts under a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from quire.session import shipped

VOCABULARY = os.environ.get("QUIRE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published split pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    """Encoding of a vocabulary file's bytes (a line each: base64 token, rank)."""
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def with_token_counts(rows: DataFrame, text: str, vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``rows`` with the whole text's token count instead of ``text``; null texts have 0 tokens.

    The vocabulary file (under a megabyte) is read once by the driver and broadcast.
    """
    held = rows.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kept = [f for f in rows.schema.fields if f.name != text]
    columns = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{name}` long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(held.value).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], sizes], [*[f.name for f in kept], name])

    return shipped(rows.select(*[f.name for f in kept], text)).mapInArrow(count, columns)
