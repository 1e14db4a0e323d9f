"""Benchmark passages in documents, found by spaced seeds.

A mask looks at some of consecutive words and ignores the others, so that a hash of
what it sees survives substituted words at the ignored places. Seeds of benchmark items
and of documents are joined by hash. Around each hit the words of document and item are
compared place by place: a passage of ``PASSAGE`` words, of which ``SIMILAR`` percent are
the same, shows contamination. Of an item with fewer words all of them are the passage.

Masks are chosen so that none is missed: wherever the allowed substitutions of a passage
fall, some mask of its length sees none of them.

Everything is expressed with DataFrame functions. A document is cut into words once,
seeds are made and looked up as they are generated, and hits are verified before any
shuffle. A seed carries the few words around it, never a text. Seeds of the items are
broadcast if they take at most ``BROADCAST`` bytes; beyond that, seeds of both sides are
shuffled by hash.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import located, located_freely, lower_ascii, materialize

#: Words of a passage and the percentage of them that must agree.
PASSAGE = 13
SIMILAR = 80
#: Places of a mask that count, from 0, for passages of ``PASSAGE`` words. Of the words of a passage
#: any two may differ: the masks, moved along it, leave none of the 78 pairs out.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: The words that may stand before a hit in its passage, and all those compared around it.
REACH = PASSAGE - 8
AROUND = REACH + PASSAGE
#: Bytes of seeds of items that are broadcast, and those of a seed in memory.
BROADCAST = 64 << 20
SEED = 64 + 8 * AROUND

_BLANKS = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, A-Z in lower case; NULL has none."""
    trimmed = F.btrim(F.coalesce(lower_ascii(text), F.lit("")), F.lit(_BLANKS))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(words, lambda w: F.xxhash64(w))
    )


def substitutions(size: int) -> int:
    """Words of a passage that may differ."""
    return size * (100 - SIMILAR) // 100


def masks(size: int) -> tuple[tuple[int, ...], ...]:
    """Masks for items of ``size`` words; those of items shorter than a passage start at its
    first word.

    The places of a short item are dealt to parts, more than words may differ, and there is a
    mask for every choice of parts left out: one leaves out all parts with a substitution.
    """
    if size >= PASSAGE:
        return MASKS
    differ = substitutions(size)
    parts = min(differ + 2, size) if differ else 1
    return tuple(
        tuple(place for place in range(size) if place % parts not in out)
        for out in combinations(range(parts), differ)
    )


def _seeds(words: str, at: Column, size: int) -> list[Column]:
    """The seed of every mask for items of a size at a place, told apart by size and mask.
    Places outside the text have no word."""
    return [
        F.xxhash64(F.lit(size), F.lit(n), *[F.get(F.col(words), at + place) for place in mask])
        for n, mask in enumerate(masks(size))
    ]


def _seeded_items(items: DataFrame) -> DataFrame:
    """(seed, item_id, item_near, item_before, size): the words around a seed, how many of them
    stand before it, and the words of the passage."""
    size = F.size("words")
    shorter = F.lit(None).cast("array<bigint>")
    for n in range(1, PASSAGE):
        shorter = F.when(size == n, F.array(*_seeds("words", F.lit(0), n))).otherwise(shorter)
    short = items.where((size > 0) & (size < PASSAGE)).select(
        "item_id", "words", F.lit(0).alias("at"), F.explode(shorter).alias("seed")
    )
    long = (
        items.where(size >= PASSAGE)
        .withColumn("at", F.explode(F.sequence(F.lit(0), size - PASSAGE + REACH)))
        .select("item_id", "words", "at", F.explode(F.array(*_seeds("words", F.col("at"), PASSAGE))).alias("seed"))
    )
    return short.union(long).select("seed", "item_id", *_around("item_"), F.least(size, F.lit(PASSAGE)).alias("size"))


def _seeded_docs(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(_file, _row, seed, near, before) for each place and each mask of items of ``sizes``.

    The first words of a short item may be the substituted ones, and so stand before the text.
    """
    places = F.sequence(F.lit(-max(map(substitutions, sizes))), F.size("words") - 1)
    seeds = [seed for size in sizes for seed in _seeds("words", F.col("at"), size)]
    return (
        docs.select("_file", "_row", "words", F.explode(F.when(F.size("words") > 0, places)).alias("at"))
        .withColumn("seed", F.explode(F.array(*seeds)))
        .select("_file", "_row", "seed", *_around())
    )


def _around(prefix: str = "") -> list[Column]:
    """The words around ``at``, and the place of ``at`` among them."""
    first = F.greatest(F.col("at") - REACH, F.lit(0))
    return [
        F.slice("words", first + 1, F.lit(AROUND)).alias(f"{prefix}near"),
        (F.col("at") - first).alias(f"{prefix}before"),
    ]


def _compared(found: DataFrame) -> DataFrame:
    """``agreeing``, the most places that agree in a passage that holds the hit, and ``size``,
    the words of the passage."""
    ahead = F.col("item_before") - F.col("before")  # words of the item before those of the document

    def aligned(words: str, skipped: Column) -> Column:
        return F.slice(words, F.greatest(skipped, F.lit(0)) + 1, F.lit(AROUND))

    same = F.zip_with(
        aligned("near", -ahead), aligned("item_near", ahead), lambda a, b: F.when(a == b, 1).otherwise(0)
    )
    found = found.select("_file", "_row", "item_id", "size", same.alias("same"))

    def agreeing(start: Column) -> Column:
        part = F.slice("same", start, F.lit(PASSAGE))
        return F.aggregate(part, F.lit(0), lambda total, x: total + x)

    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("same") - PASSAGE + 1))
    return found.select(
        "_file", "_row", "item_id", "size", F.array_max(F.transform(starts, agreeing)).alias("agreeing")
    )


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_file, _row, item_id, agreeing) of verified passages: for each row and item the most
    words that agree. ``docs`` has a place and ``words``."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("words")
    )
    seeds = materialize(_seeded_items(items), "benchmark-seeds")
    known = seeds.groupBy("size").count().collect()  # a row a length, PASSAGE at most
    if SEED * sum(row["count"] for row in known) <= BROADCAST:
        seeds = F.broadcast(seeds)
    sizes = sorted(row["size"] for row in known) or [PASSAGE]
    return (
        _compared(_seeded_docs(docs, sizes).join(seeds, "seed"))
        .groupBy("_file", "_row", "item_id")
        .agg(F.max("agreeing").alias("agreeing"), F.max("size").alias("size"))
        .where(F.col("agreeing") * 100 >= F.col("size") * SIMILAR)
        .drop("size")
    )


def _found(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_file, _row, item_ids, agreeing) of the contaminated rows."""
    worded = rows.select("_file", "_row", word_hashes(F.col("text")).alias("words"))
    return materialize(
        hits(worded, benchmark)
        .groupBy("_file", "_row")
        .agg(
            F.sort_array(F.collect_set("item_id")).alias("item_ids"),
            F.max("agreeing").cast("long").alias("agreeing"),
        ),
        "contaminated",
    )


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, agreeing) for every row of ``docs``: the items of which
    it holds a passage, in order, and the most words that agree in one.

    NULL and empty texts, on either side, hold and give no passage; of an item shorter than a
    passage all words form one, so an item of a word is in every text with that word. A word
    missing at the end of a text counts as a substituted one. Items without item_id
    make a document contaminated but are not listed. Repeated rows each give a row. Other
    columns are not read. An empty benchmark leaves all documents clean.
    """
    rows = located(docs.select("doc_id", "text"))
    found = _found(rows, benchmark)
    return rows.join(found, ["_file", "_row"], "left").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("agreeing").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("agreeing", F.lit(0).cast("long")).alias("agreeing"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``, with all their columns."""
    rows, file, row = located_freely(docs)
    found = _found(rows.select("text", F.col(file).alias("_file"), F.col(row).alias("_row")), benchmark)
    gone = found.select(F.col("_file").alias(file), F.col("_row").alias(row))
    return rows.join(gone, [file, row], "left_anti").select(*[f"`{c}`" for c in docs.columns])
