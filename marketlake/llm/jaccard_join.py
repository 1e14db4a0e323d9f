"""Near duplicates by a size-aware heavy-light join on word shingles.

Two sets link when ``100 * |A and B| >= percent * |A or B|``. All sets follow one
global order of shingles: rare ones first, frequent ones last. Linked sets share
``o = ceil(percent * n / 100)`` shingles at least, so the first ``n - o + c`` of
each hold ``c`` common ones.

* Light sets (fewer than ``boundary`` shingles) enumerate the two-element subsets
  of that prefix. A subset of two is rarely shared by chance, so lists stay short.
* Heavy sets, for which subsets would be too many, list the single shingles of
  their prefix. Light sets that may link with a heavy one list singles as well.
* The boundary is the size with the least cost: subsets written for light sets
  against list entries written and met for heavy ones, both counted from the data.

Sets that share a list meet in the cell of the list's smallest set. A cell first sees
sketches: bit maps of the parity of shingles per bit, half a bit a shingle. Two sets differ
in at least as many shingles as their bit maps do in bits, so sets that no partner in the
cell can link with leave it. For those that remain the inverted lists of the full sets
are scanned for exact overlaps, as products of membership matrices. A cell of many sets
is dealt in blocks: each task gets two blocks, and gives back at most one link per set,
enough for the components.

The order only decides cost, never the result. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm import common, words

#: Frequent shingles that the order knows; a longer list only lowers cost.
FREQUENT = 1 << 17
#: Frequent shingles reported by one batch of documents.
REPORTED = 4096
#: Sizes for which light and heavy cost are compared.
LARGEST_LIGHT = 256
#: Sets in a block of a cell, and shingles of them, on average.
BLOCK = 400
BLOCK_SHINGLES = 400_000

_PAIR = np.uint64(0xD6E8FEB86659FD93)
_COLUMNS = 2048


def overlap(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with a set it links with."""
    return -(-percent * n // 100)


def can_link(n: int, percent: int) -> bool:
    """Whether a set of ``n`` links with any other set."""
    return 100 * n >= percent * (n + 1)


def _profile(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent shingles of each batch; by set size the sets and the list entries they meet."""
    for part in (part for batch in batches for part in words.slices(batch, "text", words.BATCH // 2)):
        sets = list(words.shingle_sets(part["text"], k))
        if not sets:
            continue
        sizes = np.array([len(s) for s in sets])
        everything, place, counts = np.unique(
            np.concatenate(sets), return_inverse=True, return_counts=True
        )
        often = np.flatnonzero(counts >= 3)
        often = often[np.argsort(-counts[often], kind="stable")][:REPORTED]
        met = np.concatenate(([0], np.cumsum(counts[place] - 1)))
        ends = np.cumsum(sizes)
        met = met[ends] - met[ends - sizes]
        small = sizes < LARGEST_LIGHT
        n_sets = np.bincount(sizes[small], minlength=LARGEST_LIGHT)
        n_met = np.bincount(sizes[small], weights=met[small], minlength=LARGEST_LIGHT)
        used = np.flatnonzero(n_sets)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.ones(len(often), bool), np.zeros(len(used), bool)])),
                pa.array(np.concatenate([everything[often].view(np.int64), used])),
                pa.array(np.concatenate([counts[often], n_sets[used]]).astype(np.int64)),
                pa.array(np.concatenate([np.zeros(len(often)), n_met[used]]).astype(np.int64)),
            ],
            names=["shingle", "key", "n", "met"],
        )


def boundary(sizes: dict[int, tuple[int, int]], percent: int) -> int:
    """Smallest size of a heavy set, by cost. ``sizes``: sets and entries met, by size."""

    def light(n: int) -> int:
        prefix = min(n, n - overlap(n, percent) + 2)
        return sizes[n][0] * (prefix * (prefix - 1) // 2)

    def heavy(n: int) -> float:
        prefix = n - overlap(n, percent) + 1
        return sizes[n][0] * prefix + sizes[n][1] * prefix / n

    sized = [n for n in sizes if n and can_link(n, percent)]
    return min(
        range(2, LARGEST_LIGHT + 1),
        key=lambda x: sum(light(n) for n in sized if n < x)
        + sum(heavy(n) for n in sized if 100 * n >= percent * x),
    )


def _keys(
    sorted_set: np.ndarray, percent: int, limit: int, frequent: np.ndarray, rank: np.ndarray
) -> np.ndarray:
    n = len(sorted_set)
    if not n or not can_link(n, percent):
        return sorted_set[:0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sorted_set), len(frequent) - 1)
        order = np.where(frequent[at] == sorted_set, rank[at], -1)
        sorted_set = sorted_set[np.argsort(order, kind="stable")]
    least = overlap(n, percent)
    found = []
    if n < limit:
        prefix = sorted_set[: n - least + 2]
        i, j = np.triu_indices(len(prefix), 1)
        found.append(words.mix(prefix[i] * _PAIR + words.mix(prefix[j])))
    if 100 * n >= percent * limit:
        found.append(sorted_set[: n - least + 1])
    return np.concatenate(found)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the hashes on each of at least half as many bits, a power of two from 64."""
    bits = 64
    while 2 * bits < len(hashes):
        bits *= 2
    place = (hashes >> np.uint64(17)) & np.uint64(bits - 1)
    parity = np.bincount(place.astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(parity).tobytes()


def _folded(parity: np.ndarray, bits: int) -> np.ndarray:
    while len(parity) > bits:
        half = len(parity) // 2
        parity = parity[:half] ^ parity[half:]
    return parity


def may_link(
    left: list[bytes], right: list[bytes], n_left: np.ndarray, n_right: np.ndarray, percent: int
) -> np.ndarray:
    """Which sets of either side may link, by size and sketch. No pair that links is left out."""
    small, large = np.minimum.outer(n_left, n_right), np.maximum.outer(n_left, n_right)
    possible = 100 * small >= percent * large
    sides = [[np.unpackbits(np.frombuffer(x, np.uint8)) for x in side] for side in (left, right)]
    sizes = [np.array([len(x) for x in side]) for side in sides]
    for bits in np.unique(np.concatenate(sizes)):
        rows, columns = (np.flatnonzero(size >= bits) for size in sizes)
        if not len(rows) or not len(columns):
            continue
        signs = [
            np.array([_folded(side[i], bits) for i in chosen]).astype(np.float32) * 2 - 1
            for side, chosen in zip(sides, (rows, columns))
        ]
        differ = (bits - signs[0] @ signs[1].T) / 2
        both = n_left[rows][:, None] + n_right[columns][None, :]
        possible[np.ix_(rows, columns)] &= differ * (100 + percent) <= both * (100 - percent)
    return possible


def _listed(
    k: int, percent: int, limit: int, shared, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Per document its set size, the set's digest and the keys it is listed under."""
    frequent, rank = shared.value
    for batch in batches:
        for part in words.slices(batch, "text", words.BATCH // 8):
            sizes, ids, keys, sketches = [], [], [], []
            for s in words.shingle_sets(part["text"], k):
                sizes.append(len(s))
                ids.append(set_number(s) if len(s) else None)
                keys.append(_keys(s, percent, limit, frequent, rank))
                sketches.append(sketch(s) if len(keys[-1]) else None)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    part["code"],
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["doc_id", "code", "n", "set_id", "sketch", "keys"],
            )


def set_number(hashes: np.ndarray) -> int:
    """A digest of a set, the same for equal sets."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _full_sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text beside the number that it was fetched for: rows of one doc_id may
    have different texts."""
    for batch in batches:
        for part in words.slices(batch, "text", words.BATCH // 8):
            sets = list(words.shingle_sets(part["text"], k))
            yield pa.RecordBatch.from_arrays(
                [
                    part["set_id"],
                    pa.array([set_number(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["wanted", "set_id", "elements"],
            )


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``left`` and ``right`` link: exact overlaps from their inverted lists."""
    one, two = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(np.unique(one), np.unique(two), assume_unique=True)
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    owners = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes)]
    common_size = np.zeros((len(left), len(right)), np.float32)
    places = []
    for flat, owner in ((one, owners[0]), (two, owners[1])):
        at = np.searchsorted(shared, flat)
        inside = at < len(shared)
        inside[inside] = shared[at[inside]] == flat[inside]
        order = np.argsort(at[inside], kind="stable")
        places.append((at[inside][order], owner[inside][order]))
    for start in range(0, len(shared), _COLUMNS):
        sides = []
        for (at, owner), side in zip(places, (left, right)):
            a, b = np.searchsorted(at, [start, start + _COLUMNS])
            matrix = np.zeros((len(side), min(_COLUMNS, len(shared) - start)), np.float32)
            matrix[owner[a:b], at[a:b] - start] = 1
            sides.append(matrix)
        common_size += sides[0] @ sides[1].T
    inter = common_size.astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - inter
    return 100 * inter >= percent * union


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """One link to the smallest member for every other member of a component."""
    root = ids.copy()
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        if (least == root).all():
            return [(int(a), int(b)) for a, b in zip(ids, root) if a != b]
        root = least


def _cells(columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The cells of a partition, whose rows come one after the other: its key, and for either
    block a list of the values of ``columns`` by row."""
    cell, sides = None, ([], [])
    for batch in batches:
        values = [batch[x].to_pylist() for x in ("leader", "i", "j", "block", *columns)]
        for leader, i, j, block, *row in zip(*values):
            if (leader, i, j) != cell:
                if cell:
                    yield cell, sides
                cell, sides = (leader, i, j), ([], [])
            sides[block != i].append(row)
    if cell:
        yield cell, sides


def _alone(cell: tuple, sides: tuple[list, list]) -> bool:
    """Whether the cell has no pair: one block with one set, or two of which one is empty."""
    return len(sides[0]) < 2 if cell[1] == cell[2] else not (sides[0] and sides[1])


def _remaining(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of each cell that may link with another of it."""
    names = ["leader", "i", "j", "block", "set_id"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for cell, sides in _cells(["set_id", "n", "sketch"], batches):
        if _alone(cell, sides):
            continue
        same = cell[1] == cell[2]
        left, right = sides[0], sides[0] if same else sides[1]
        sizes = [np.array([n for _, n, _ in side]) for side in (left, right)]
        possible = may_link(*[[x for _, _, x in side] for side in (left, right)], *sizes, percent)
        if same:
            np.fill_diagonal(possible, False)
        rows += [(*cell, cell[1], left[k][0]) for k in np.flatnonzero(possible.any(axis=1))]
        if not same:
            rows += [(*cell, cell[2], right[k][0]) for k in np.flatnonzero(possible.any(axis=0))]
        if len(rows) > 10_000:
            yield made()
    if rows:
        yield made()


def _links(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the cells of a partition, one at most for each set of a cell."""
    found: list[tuple[int, int]] = []

    def made() -> pa.RecordBatch:
        columns = [pa.array(x, pa.int64()) for x in zip(*found)]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    for cell, sides in _cells(["set_id", "elements"], batches):
        if _alone(cell, sides):
            continue
        ids = [[x for x, _ in side] for side in sides]
        sets = [[np.frombuffer(x, np.uint64) for _, x in side] for side in sides]
        if cell[1] == cell[2]:
            i, j = np.nonzero(np.triu(linked(sets[0], sets[0], percent), 1))
        else:
            i, j = np.nonzero(linked(*sets, percent))
            j = j + len(ids[0])
        found += _forest(np.array(ids[0] + ids[1]), i, j)
        if len(found) > 10_000:
            yield made()
    if found:
        yield made()


def _code() -> Column:
    """With doc_id, what tells the rows of ``docs`` apart."""
    return F.xxhash64("text")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): per row of ``docs`` its set size and the
    smallest doc_id that it reaches by links, its own included.

    NULL or empty texts and texts of separators have an empty set and link with
    nothing. Texts with fewer than ``k`` words have one shingle, the whole
    sequence. Equal sets link. Rows without doc_id are returned with their size and a
    NULL component, and link with nothing. Repeated rows each give a row; rows of one
    doc_id with different texts are different sets. Other columns of ``docs``, whatever
    their names, are not read. An empty table gives an empty result.
    """
    return _labelled(docs, k, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the
    document with the smallest doc_id, and all rows without doc_id."""
    doc, code = common.free_name(docs, "_doc"), common.free_name(docs, "_code")
    gone = (
        _labelled(docs, k, percent)
        .where("component < doc_id")
        .select(F.col("doc_id").alias(doc), F.col("code").alias(code))
    )
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (_code() == F.col(code))
    return docs.join(gone, same, "left_anti")


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, code, n, component) of every row."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _code().alias("code"), "text"
    )
    context = docs.sparkSession.sparkContext
    profile = common.materialize(
        texts.select("text")
        .mapInArrow(partial(_profile, k), "shingle boolean, key long, n long, met long")
        .groupBy("shingle", "key")
        .agg(F.sum("n").alias("n"), F.sum("met").alias("met")),
        "shingle-profile",
    )
    top = profile.where("shingle").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toPandas()
    top = top.sort_values("key", kind="stable") if len(top) else top
    frequent = np.sort(top["key"].to_numpy(np.int64).view(np.uint64))
    by_key = np.argsort(top["key"].to_numpy(np.int64).view(np.uint64), kind="stable")
    rank = top["n"].to_numpy(np.int64)[by_key]
    sizes = {r["key"]: (r["n"], r["met"]) for r in profile.where("NOT shingle").collect()}
    limit = boundary(sizes, percent)
    shared = context.broadcast((frequent, rank))

    listed = common.materialize(
        texts.mapInArrow(
            partial(_listed, k, percent, limit, shared),
            "doc_id long, code long, n long, set_id long, sketch binary, keys array<long>",
        ),
        "shingle-lists",
    )
    rows = listed.select("doc_id", "code", "n", "set_id")
    classes = common.materialize(
        rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least_doc")),
        "set-classes",
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_class = listed.where(F.size("keys") > 0).join(
        classes.select("set_id", F.col("least_doc").alias("doc_id")), ["set_id", "doc_id"], "left_semi"
    )
    # Dealt by key once, for the leaders of the lists and for their entries.
    entries = of_class.select("set_id", "n", F.explode("keys").alias("key")).repartition(partitions, "key")
    leaders = (
        entries.groupBy("key")
        .agg(F.min("set_id").alias("leader"), F.max("set_id").alias("last"))
        .where("leader < last")
        .select("key", "leader")
    )
    met = common.materialize(
        entries.join(leaders, "key").select("leader", "set_id", "n").distinct(), "shingle-cells"
    )
    blocks = met.groupBy("leader").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    dealt = (
        met.join(blocks, "leader")
        .withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "leader", "set_id", "block",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )

    def by_cell(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions, "leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    sketches = of_class.select("set_id", "n", "sketch").dropDuplicates(["set_id"])
    remaining = common.materialize(
        by_cell(dealt.join(sketches, "set_id")).mapInArrow(
            partial(_remaining, percent), "leader long, i int, j int, block int, set_id long"
        ),
        "shingle-cells-left",
    )
    wanted = remaining.select("set_id").distinct().join(classes, "set_id")
    sets = (
        texts.join(wanted, F.col("doc_id") == F.col("least_doc"))
        .select("set_id", "text")
        .mapInArrow(partial(_full_sets, k), "wanted long, set_id long, elements binary")
        .where("wanted = set_id")
        .select("set_id", "elements")
        .dropDuplicates(["set_id"])
    )
    edges = common.materialize(
        by_cell(remaining.join(sets, "set_id"))
        .mapInArrow(partial(_links, percent), "a long, b long")
        .distinct(),
        "shingle-links",
    )
    roots = common.components(edges)
    labels = classes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", F.coalesce("root", "set_id").alias("root"), "least_doc"
    )
    named = labels.groupBy("root").agg(F.min("least_doc").alias("component"))
    labels = common.materialize(
        labels.join(named, "root").select("set_id", "component"), "shingle-components"
    )
    return rows.join(labels, "set_id", "left").select(
        "doc_id", "code", "n",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"),
    )
