"""Token ids in binary files of independent zstandard frames.

A file holds documents in ascending order, one zstandard frame each, then a
skippable frame with the seek table. Any zstandard reader can decompress the
file; with the table, a reader fetches and decompresses only the documents it wants.

The seek table has an entry per frame: doc_id (8 bytes, the least value for
NULL), place of the frame (8), its compressed size (4), number of ids (4), and a
CRC-32 of the decompressed bytes (4). A footer follows: number of frames (8),
bytes per id (1), mark (4) and a line feed, which Spark's text writer adds. All
numbers are little-endian.

Spark's writer makes the files, one row each, so they go to any store that Spark
reaches, and a task that is run again leaves no half-written file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlake.llm import words
from marketlake.llm.common import work_path

#: Uncompressed bytes of ids after which a file ends.
FILE = 8 << 20
#: Words whose ids a worker remembers.
REMEMBERED = 500_000
MARK = 0x314B5453
SKIPPABLE = 0x184D2A5E
ENTRY = np.dtype(
    [("doc_id", "<i8"), ("at", "<u8"), ("size", "<u4"), ("n", "<u4"), ("crc", "<u4")]
)
NULL_ID = -(1 << 63)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_characters()
# Fixed value: how the vocabulary's file splits lower-case text.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Letters that normalisation leaves as they are, with one lower-case form each.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u017f]+")
# White space of Python's split beside the six characters of _GAP.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_GAP = re.compile("[\x20\x09-\x0d]+")


class WordCoder(dict):
    """Ids of words as bytes, remembered up to a bound.

    White space ends every token of this vocabulary, so a word has the same ids
    wherever it stands. A plain word's parts go straight to the library's merges;
    any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, width: int = 2, remembered: int = REMEMBERED):
        super().__init__()
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.kind = f"<u{width}"
        self.remembered = remembered
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join([self._part(x) for x in _PARTS.findall(word.lower())])
        else:
            ids = self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) < self.remembered:
            self[word] = ids
        return ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            mapped = part if part.isascii() else "".join([_BYTES[b] for b in part.encode()])
            ids = self._bytes([token.id for token in self.model.tokenize(mapped)])
            if len(self.parts) < self.remembered:
                self.parts[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        found = text.split() if not _OTHER_SPACE.search(text) else filter(None, _GAP.split(text))
        return b"".join(map(self.__getitem__, found))


def pack(rows: Iterator[tuple[int | None, bytes]], width: int, limit: int) -> Iterator[bytes]:
    """Files, without their last line feed, for documents in order."""
    writer = zstandard.ZstdCompressor(level=1)
    frames, table, size, raw = [], [], 0, 0

    def done() -> bytes:
        body = np.array(table, ENTRY).tobytes()
        body += struct.pack("<QBI", len(table), width, MARK)
        head = struct.pack("<II", SKIPPABLE, len(body) + 1)
        return b"".join([*frames, head, body])

    for doc_id, plain in rows:
        frame = writer.compress(plain)
        doc_id = NULL_ID if doc_id is None else doc_id
        entry = (doc_id, size, len(frame), len(plain) // width, zlib.crc32(plain))
        frames.append(frame)
        table.append(entry)
        size += len(frame)
        raw += len(plain) + ENTRY.itemsize
        if raw >= limit:
            yield done()
            frames, table, size, raw = [], [], 0, 0
    if table:
        yield done()


def seek_table(data: bytes) -> tuple[np.ndarray, int]:
    """The table of a file's bytes and the bytes per id."""
    n, width, mark = struct.unpack("<QBI", data[-14:-1])
    if mark != MARK or data[-1:] != b"\n":
        raise ValueError("not a token file")
    end = len(data) - 14
    return np.frombuffer(data[end - n * ENTRY.itemsize : end], ENTRY), width


def fetch(data: bytes, entry, width: int) -> np.ndarray:
    """The ids of one document; no other frame is decompressed."""
    at = int(entry["at"])
    plain = zstandard.ZstdDecompressor().decompress(
        data[at : at + int(entry["size"])], max_output_size=int(entry["n"]) * width
    )
    if zlib.crc32(plain) != entry["crc"]:
        raise ValueError(f"checksum of document {entry['doc_id']} is wrong")
    return np.frombuffer(plain, f"<u{width}")


@lru_cache(maxsize=2)
def _coder(path: str, width: int) -> WordCoder:
    """One per worker process, kept from task to task."""
    return WordCoder(path, width)


def _files(path: str, end: int, width: int, limit: int, batches: Iterator[pa.RecordBatch]):
    coder = _coder(path, width)
    last = end.to_bytes(width, "little")

    def rows():
        for batch in batches:
            for part in words.slices(batch, "text", words.BATCH // 8):
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    yield doc_id, coder.encode(text) + last

    for data in pack(rows(), width, limit):
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])


def write(
    docs: DataFrame, folder: str, path: str | None = None, end: int = 2, width: int = 2,
    limit: int = FILE,
) -> None:
    """Encode every whole text with the tokenizer of ``path``, append ``end``, and write
    the files in ascending doc_id order: ids of ``width`` bytes.

    NULL and empty texts have the end id only. NULL doc_ids come first; rows of one
    doc_id come in the order of their texts. An empty table writes no document.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    if tokenizer(path).get_vocab_size() > 1 << 8 * width:
        raise ValueError("ids need more bytes")
    files = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(partial(_files, path, end, width, limit), "file binary")
    )
    (
        files.select(F.col("file").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("maxRecordsPerFile", 1)
        .text(folder)
    )


_ROWS = "path string, doc_id long, before long, n long, ids binary"


def _documents(doc_ids: list[int] | None, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for file, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            table, width = seek_table(data)
            before = np.concatenate(([0], np.cumsum(table["n"].astype(np.int64))))[:-1]
            if doc_ids is not None:
                rows = np.isin(table["doc_id"], doc_ids)
                table, before = table[rows], before[rows]
            ids = [fetch(data, entry, width).astype("<u4").tobytes() for entry in table]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * len(table), pa.string()),
                    pa.array(table["doc_id"], mask=table["doc_id"] == NULL_ID),
                    pa.array(before),
                    pa.array(table["n"].astype(np.int64)),
                    pa.array(ids, pa.binary()),
                ],
                names=["path", "doc_id", "before", "n", "ids"],
            )


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [seek_table(data)[0] for data in batch["content"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["path"], pa.array([int(t["n"].sum()) for t in tables], pa.int64())],
            names=["path", "total"],
        )


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n, ids): ids as little-endian 4-byte numbers, ``start`` the
    number of ids before the document in all files.

    With ``doc_ids`` only those documents are decompressed, and ``start`` is left
    out. A frame whose checksum is wrong raises an error.
    """
    files = (
        spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    )
    if doc_ids is not None:
        return files.mapInArrow(partial(_documents, sorted(doc_ids)), _ROWS).select("doc_id", "n", "ids")
    number = r"part-(\d+).*-c(\d+)"
    order = [F.regexp_extract("path", number, i).cast("long") for i in (1, 2)]
    totals = files.mapInArrow(_totals, "path string, total long").withColumn(
        "file_start",
        F.sum("total").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)),
    )
    return (
        files.mapInArrow(partial(_documents, None), _ROWS)
        .join(totals, "path")
        .select(
            "doc_id",
            (F.coalesce("file_start", F.lit(0)) + F.col("before")).alias("start"),
            "n",
            "ids",
        )
    )


def digests(docs: DataFrame, path: str | None = None, end: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files written for it."""
    folder = work_path(docs.sparkSession, "tokens")
    write(docs, folder, path, end)
    return read(docs.sparkSession, folder).select(
        "doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
