"""Byte-level BPE: texts to token ids and back to bytes, by a local rank file.

The tiktoken library encodes each text; ranks and pre-splitting pattern are
parameters. A long text is first cut where the pattern always ends a match: before
a single blank between two characters that are not white space. Pieces then have
the same ids as the whole text. Where no such place exists the piece stays whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from marketlake.llm import words

#: Characters of a piece of a long text, or a little more.
PIECE = 1 << 16
#: Ids that are decoded between two results.
IDS = 1 << 18
# Python counts every blank of the pattern's engine as white space, and more.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder per worker process."""
    ranks = {}
    with open(ranks_path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(
        "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """The text in pieces of ``limit`` characters or more, cut at safe places only."""
    at = 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode_text(encoder: tiktoken.Encoding, text: str, limit: int = PIECE) -> np.ndarray:
    if len(text) <= limit:
        return np.asarray(encoder.encode_ordinary(text), np.int32)
    return np.concatenate(
        [np.asarray(encoder.encode_ordinary(x), np.int32) for x in pieces(text, limit)]
    )


def _encode(column: str, path: str, pattern: str, batches: Iterator[pa.RecordBatch]):
    encoder = encoding(path, pattern)
    for batch in batches:
        for part in words.slices(batch, column, words.BATCH // 8):
            texts = pc.fill_null(part[column], "").to_pylist()
            ids = [encode_text(encoder, text) for text in texts]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "ids"])


def _decode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]):
    encoder = encoding(path, pattern)
    for whole in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(whole["ids"]), 0)).to_numpy()
        at = 0
        while at < len(ends):
            start = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, start + IDS, "right")))
            batch = whole.slice(at, stop - at)
            # One list of Python numbers at a time.
            decoded = [
                encoder.decode_bytes(ids.values.to_pylist()) if ids.is_valid else None
                for ids in batch["ids"]
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"]
            )
            at = stop


def encode(
    df: DataFrame,
    column: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``df`` with ``ids array<int>``, the tokens of ``column`` without special tokens.

    NULL and empty texts have no ids. An existing column ``ids`` is replaced. Every
    row gives one row; repeated rows and other columns are kept as they are.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = [c for c in df.columns if c != "ids"]
    df = df.select(*[f"`{c}`" for c in kept])
    schema = StructType([*df.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    return df.mapInArrow(partial(_encode, column, path, pattern), schema)


def decode(
    df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``df`` with ``decoded binary``, the raw bytes of ``ids``; NULL for NULL."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = [c for c in df.columns if c != "decoded"]
    df = df.select(*[f"`{c}`" for c in kept])
    schema = StructType([*df.schema.fields, StructField("decoded", BinaryType())])
    return df.mapInArrow(partial(_decode, path, pattern), schema)


def _round_trip(path: str, pattern: str, batches: Iterator[pa.RecordBatch]):
    for batch in _decode(path, pattern, _encode("text", path, pattern, batches)):
        yield batch.drop_columns(["text"])


def round_trip(
    docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """The columns of ``docs`` but text, with n_tokens, ids, and digests of the ids, as
    decimals joined by one blank, and of the bytes that they decode to.

    ``encode`` and then ``decode``, in one pass of one worker. The texts may have any other
    columns but ids and decoded.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = StructType(
        [
            *docs.drop("text").schema.fields,
            StructField("ids", ArrayType(IntegerType())),
            StructField("decoded", BinaryType()),
        ]
    )
    return (
        docs.mapInArrow(partial(_round_trip, path, pattern), schema)
        .withColumns(
            {
                "n_tokens": F.size("ids").cast("long"),
                "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
                "decoded_sha256": F.sha2("decoded", 256),
            }
        )
        .drop("decoded")
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of a round trip of every text."""
    return round_trip(docs.select("doc_id", "text")).drop("ids")
