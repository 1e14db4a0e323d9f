"""Passages that repeat across documents, found by difference-cover anchors.

A window is ``WINDOW`` consecutive words. Words at places whose number modulo
``PERIOD`` is in the difference cover begin anchors of ``WINDOW - PERIOD + 1`` words.
For any two places there is a shift below ``PERIOD`` that brings both into the cover,
so two equal windows share an aligned anchor wherever they stand. Only windows
that hold a shared anchor are extended to their full length and compared.

Documents are dealt into slices of bounded size by a hash of identifier and text.
A slice asks for its anchors, each once, then for the windows around shared ones,
with the smallest document that has them, and learns which also begin in a smaller
document elsewhere. Questions and answers travel as packed arrays, by bucket of the
hash. So a passage that a third of all documents share costs one entry per slice, and
copies of one text are dealt over all slices. Texts are shuffled once, and all three
steps read that exchange. Window hashes have 64 bits; anchors are told apart by fewer,
since a false one only costs a comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import words

WINDOW = 13
PERIOD = 7
#: Every remainder modulo 7 is a difference of two of these.
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text in a slice, about.
SLICE = 2 << 20
#: Bytes of text whose anchors and windows fall into one bucket, about.
BUCKET = 8 << 20

_QUESTION = "bucket int, slice long, hashes binary, docs binary"
_ANSWER = "slice long, bucket int, hashes binary"


class _Words:
    """The words of a slice, by document in ascending order."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        column = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        self.data, bounds = words.text_bytes(column)
        self.starts, self.ends, self.hashes, first = words.split(self.data, bounds, lower=False)
        self.first = first
        n = np.diff(first)
        # Values and NULLs apart: together they would become floats, which are not exact.
        known = pc.is_valid(table["doc_id"]).to_numpy().astype(bool)
        doc = pc.fill_null(table["doc_id"], 0).to_numpy()
        self.row = np.repeat(np.arange(len(n)), n)
        self.doc = doc.astype(np.int64)[self.row]
        self.place = np.arange(len(self.hashes)) - first[self.row]
        left = first[1:][self.row] - np.arange(len(self.hashes))
        total = n[self.row]
        self.known = known[self.row]
        self.anchors = np.flatnonzero(
            self.known & (left >= ANCHOR) & (total >= WINDOW) & np.isin(self.place % PERIOD, COVER)
        )
        self.windows = np.flatnonzero(self.known & (left >= WINDOW))

    def anchor_codes(self, buckets: int) -> np.ndarray:
        """Bucket and 32 further bits of each anchor's hash, in one number."""
        hashes = words.runs(self.hashes, ANCHOR)[self.anchors]
        return _bucket(hashes, buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)

    def near(self, anchors: np.ndarray) -> np.ndarray:
        """The windows that hold one of ``anchors`` (word numbers)."""
        change = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(change, np.maximum(anchors - (WINDOW - ANCHOR), self.first[self.row[anchors]]), 1)
        np.add.at(change, anchors + 1, -1)
        return self.windows[np.cumsum(change)[self.windows] > 0]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(40)) % np.uint64(buckets)


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)


def _least(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, the smallest document of each, and the largest."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    first = np.flatnonzero(_first_of_runs(hashes))
    last = np.append(first[1:], len(hashes)) - 1 if len(first) else first
    return hashes[first], docs[first], docs[last]


def _packed(slice_id: int, bucket: np.ndarray, hashes: np.ndarray, docs: np.ndarray | None) -> pa.Table:
    """A row for each bucket; ``bucket`` need not be sorted."""
    order = np.argsort(bucket, kind="stable")
    bucket, hashes = bucket[order], hashes[order]
    docs = docs[order] if docs is not None else None
    edges = np.flatnonzero(_first_of_runs(bucket))
    stops = np.append(edges[1:], len(bucket))
    pairs = list(zip(edges.tolist(), stops.tolist()))
    return pa.table(
        [
            pa.array(bucket[edges].astype(np.int32)),
            pa.array(np.full(len(edges), slice_id, np.int64)),
            pa.array([hashes[a:b].tobytes() for a, b in pairs], pa.binary()),
            pa.array([docs[a:b].tobytes() if docs is not None else None for a, b in pairs], pa.binary()),
        ],
        names=["bucket", "slice", "hashes", "docs"],
    )


def _ask_anchors(buckets: int, table: pa.Table) -> pa.Table:
    codes = np.unique(_Words(table).anchor_codes(buckets))
    return _packed(
        table["slice"][0].as_py(), codes >> np.uint64(32), codes.astype(np.uint32), None
    )


def _entries(table: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All packed values of a bucket's questions and the row of each."""
    values = [np.frombuffer(x.as_py(), kind) for x in table[column]]
    return np.concatenate(values), np.repeat(np.arange(len(values)), [len(x) for x in values])


def _answers(table: pa.Table, rows: np.ndarray, hashes: np.ndarray) -> pa.Table:
    order = np.argsort(rows, kind="stable")
    rows, hashes = rows[order], hashes[order]
    edges = np.flatnonzero(_first_of_runs(rows))
    stops = np.append(edges[1:], len(rows))
    slices = table["slice"].to_numpy()
    return pa.table(
        [
            pa.array(slices[rows[edges]]),
            pa.array(np.full(len(edges), table["bucket"][0].as_py(), np.int32)),
            pa.array([hashes[a:b].tobytes() for a, b in zip(edges, stops)], pa.binary()),
        ],
        names=["slice", "bucket", "hashes"],
    )


def _shared_anchors(table: pa.Table) -> pa.Table:
    """To each slice those of its anchors that another slice asks for."""
    hashes, rows = _entries(table, "hashes", np.uint32)
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    first = _first_of_runs(hashes)
    alone = first & np.append(first[1:], True)
    return _answers(table, rows[~alone], hashes[~alone])


def _ask_windows(buckets: int, table: pa.Table, answers: pa.Table) -> pa.Table:
    if not table.num_rows:
        return _packed(0, *[np.zeros(0, np.uint64)] * 3)
    found = _Words(table)
    codes = found.anchor_codes(buckets)
    here, least, most = _least(codes, found.doc[found.anchors])
    elsewhere = [
        np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) | np.uint64(bucket.as_py() << 32)
        for bucket, x in zip(answers["bucket"], answers["hashes"])
    ]
    shared = np.concatenate([here[least < most], *elsewhere])
    near = found.near(found.anchors[np.isin(codes, shared)])
    hashes, docs, _ = _least(words.runs(found.hashes, WINDOW)[near], found.doc[near])
    return _packed(table["slice"][0].as_py(), _bucket(hashes, buckets), hashes, docs)


def _earlier_windows(table: pa.Table) -> pa.Table:
    """To each slice those of its windows that begin in a smaller document elsewhere."""
    hashes, rows = _entries(table, "hashes", np.uint64)
    docs, _ = _entries(table, "docs", np.int64)
    order = np.lexsort((docs, hashes))
    hashes, rows, docs = hashes[order], rows[order], docs[order]
    first = _first_of_runs(hashes)
    least = docs[np.flatnonzero(first)][np.cumsum(first) - 1]
    later = docs > least
    return _answers(table, rows[later], hashes[later])


def _remove(table: pa.Table, answers: pa.Table) -> pa.Table:
    names = ["doc_id", "n_words", "n_removed", "kept"]
    if not table.num_rows:
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.string()
        return pa.table([pa.array([], kind) for kind in kinds], names=names)
    found = _Words(table)
    hashes = words.runs(found.hashes, WINDOW)[found.windows]
    docs = found.doc[found.windows]
    distinct, least, _ = _least(hashes, docs)
    earlier = docs > least[np.searchsorted(distinct, hashes)] if len(hashes) else np.zeros(0, bool)
    if answers.num_rows:
        earlier |= np.isin(hashes, _entries(answers, "hashes", np.uint64)[0])
    change = np.zeros(len(found.hashes) + 1, np.int64)
    change[found.windows[earlier]] += 1
    np.add.at(change, found.windows[earlier] + WINDOW, -1)
    gone = np.cumsum(change)[:-1] > 0
    n = len(found.first) - 1
    kept = np.flatnonzero(~gone)
    row = found.row[kept]
    last = np.append(row[1:] != row[:-1], True)[: len(kept)]
    # Each kept word, and one blank after it unless it is its text's last.
    data = found.data.copy()
    ends = found.ends[kept] + ~last
    data[found.ends[kept][~last]] = 0x20
    edge = np.zeros(len(data) + 2, np.int32)
    edge[found.starts[kept]] += 1
    np.add.at(edge, ends, -1)
    data = data[np.cumsum(edge)[: len(data)] > 0]
    sizes = np.bincount(row, weights=ends - found.starts[kept], minlength=n).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(data))
    counts = [np.diff(found.first), np.bincount(found.row[gone], minlength=n)]
    return pa.table(
        [table["doc_id"].combine_chunks(), *[pa.array(x.astype(np.int64)) for x in counts], text.cast(pa.string())],
        names=names,
    )


def kept_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``.

    Removed are the words of each window that also begins in a document of a smaller
    doc_id; all windows are judged on the input. ``kept`` joins the other words by one
    blank. NULL and empty texts have no words. Rows of one doc_id are one document and
    remove nothing from each other; a row without doc_id loses nothing and removes
    nothing. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(-(-size // SLICE), 1)
    buckets = max(2 * partitions, -(-size // BUCKET))
    # The row's number deals repeated rows over all slices.
    key = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    dealt = texts.withColumn("slice", F.pmod(key, F.lit(slices).cast("long"))).repartition(partitions, "slice")
    by_slice = dealt.groupBy("slice")
    anchors = (
        by_slice.applyInArrow(lambda table: _ask_anchors(buckets, table), _QUESTION)
        .groupBy("bucket")
        .applyInArrow(_shared_anchors, _ANSWER)
    )
    windows = (
        by_slice.cogroup(anchors.groupBy("slice"))
        .applyInArrow(lambda table, found: _ask_windows(buckets, table, found), _QUESTION)
        .groupBy("bucket")
        .applyInArrow(_earlier_windows, _ANSWER)
    )
    return by_slice.cogroup(windows.groupBy("slice")).applyInArrow(
        _remove, "doc_id long, n_words long, n_removed long, kept string"
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return kept_words(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
