"""Document fingerprints by Order MinHash, sensitive to the order of words and so to edits.

A text is cut into tokens, runs of up to eight characters other than white space, and into
k-mers of consecutive tokens. Equal k-mers of a text are told apart by their occurrence
number. The hashes of the numbered k-mers fall into ``SKETCHES`` times ``TUPLE`` ranges; the
least of each range is selected, and an empty range takes the selection of the next one
that is not. The selected k-mers of ``TUPLE`` ranges, in the order of the text, are hashed to
one value of the fingerprint. The likeness of two texts is the share of equal values:
k-mers that moved past each other give other tuples.

Everything is expressed with DataFrame functions on arrays of 64-bit integers, one text at a
time and without a shuffle. Places of k-mers are kept in the lowest bits of their hashes, as
many as the text needs, so that one sort of integers brings equal k-mers together in order
of the text, and another the least of each range to its front.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import located, materialize, numbered

TOKEN = r"[^\x20\x09-\x0D]{1,8}"
#: Tokens of a k-mer.
K = 2
#: k-mers of a tuple, and tuples of a fingerprint.
TUPLE = 2
SKETCHES = 64


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x))


def kmers(tokens: Column, k: int = K) -> Column:
    """Hashes of the k-mers of a text in order; of fewer tokens, the whole sequence is one."""
    found = tokens
    for i in range(1, k):
        shifted = F.slice(tokens, i + 1, F.greatest(F.size(tokens) - i, F.lit(0)))
        found = F.zip_with(found, shifted, lambda a, b: F.xxhash64(a, b))
    return F.slice(found, 1, F.greatest(F.size(tokens) - (k - 1), F.least(F.size(tokens), F.lit(1))))


def fingerprints(
    texts: DataFrame, column: str = "text", name: str = "values", k: int = K, size: int = TUPLE, sketches: int = SKETCHES
) -> DataFrame:
    """``texts`` with the fingerprint of the text in ``column`` as ``name``, an array of integers.

    NULL counts as an empty text; texts without tokens are alike. ``size`` times ``sketches`` must be
    a power of 2. Names that begin with ``name`` and a dot must be free.
    """
    parts = size * sketches
    if parts & parts - 1:
        raise ValueError("size times sketches must be a power of 2")
    at = {
        step: f"{name}.{step}"
        for step in ("tokens", "kmers", "low", "sorted", "first", "later", "starts", "hashed", "least", "filled")
    }
    cut, kmer, low, ordered, first, later, starts, hashed, least, filled = [F.col(f"`{x}`") for x in at.values()]

    def place(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def upper(x: Column) -> Column:
        return x.bitwiseAND(-low - 1)

    def number(x: Column, occurrence: Column) -> Column:
        """The hash of a k-mer and its occurrence number, packed with the place."""
        return upper(F.xxhash64(F.get(kmer, place(x)), occurrence)).bitwiseOR(x.bitwiseAND(low))

    def range_of(x: Column) -> Column:
        """The range of a hash; ranges ascend with the hashes."""
        return F.shiftright(x, 65 - parts.bit_length())

    # The k-mers that occur again stand in runs; the i-th of a run, from 0, has the number i + 2.
    length = lambda s, i: F.coalesce(F.get(starts, i + 1), F.size(later)) - s
    again = F.flatten(
        F.transform(
            starts,
            lambda s, i: F.transform(
                F.slice(later, s + 1, length(s, i)), lambda x, j: number(F.coalesce(x, F.lit(0).cast("long")), j + 2)
            ),
        )
    )
    picked = F.filter(hashed, lambda x, i: ~range_of(x).eqNullSafe(range_of(F.get(hashed, i - 1))))
    # What an empty range takes: the selection of the next, after the last that of the first.
    ends = F.transform(
        least, lambda x, i: F.array_repeat(x, x["range"] - F.coalesce(F.get(least, i - 1)["range"], F.lit(-1)))
    )
    last = F.coalesce(F.get(least, F.size(least) - 1)["range"], F.lit(-1))
    values = F.transform(
        F.sequence(F.lit(0), (F.size(filled) / size).cast("int") - 1),
        lambda i: F.hash(F.transform(F.sort_array(F.slice(filled, i * size + 1, size)), lambda x: x["kmer"])),
    )
    # A step that a lambda or several places of the next one read is a column of its own.
    digits = F.length(F.bin(F.size(kmer)))
    return (
        texts.withColumn(at["tokens"], tokens(F.coalesce(column, F.lit(""))))
        .withColumn(at["kmers"], kmers(cut, k))
        .drop(at["tokens"])
        .withColumn(at["low"], F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), digits) - 1, F.lit(0)))
        .withColumn(at["sorted"], F.sort_array(F.transform(kmer, lambda x, i: upper(x).bitwiseOR(i.cast("long")))))
        .withColumn(at["first"], F.filter(ordered, lambda x, i: ~upper(x).eqNullSafe(upper(F.get(ordered, i - 1)))))
        .withColumn(at["later"], F.array_except(ordered, first))
        .withColumn(
            at["starts"],
            F.filter(
                F.sequence(F.lit(0), F.size(later)),
                lambda i: (i < F.size(later)) & ~upper(F.get(later, i)).eqNullSafe(upper(F.get(later, i - 1))),
            ),
        )
        .withColumn(at["hashed"], F.sort_array(F.concat(F.transform(first, lambda x: number(x, F.lit(1))), again)))
        .withColumn(
            at["least"],
            F.transform(
                picked,
                lambda x: F.struct(
                    place(x).alias("at"),
                    F.get(kmer, place(x)).alias("kmer"),
                    (range_of(x) + parts // 2).cast("int").alias("range"),
                ),
            ),
        )
        .withColumn(
            at["filled"],
            F.concat(F.flatten(ends), F.array_repeat(F.get(least, F.lit(0)), F.lit(parts - 1) - last)),
        )
        .withColumn(name, values)
        .drop(*at.values())
    )


def likeness(one: Column, two: Column) -> Column:
    """Share of equal values of two fingerprints."""
    equal = F.zip_with(one, two, lambda a, b: (a == b).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda total, x: total + x) / F.size(one)


def shown(values: Column) -> Column:
    """A fingerprint as hexadecimal digits, eight per value."""
    digits = F.transform(values, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.array_join(digits, "")


def _placed(docs: DataFrame) -> DataFrame:
    """(file, row, doc_id, text) of every row, NULL as an empty text; ``file`` is a hash of the path
    under the first seed by which no two files of the table have the same."""
    rows = located(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")),
        "path", "row",
    )
    paths = rows.select("path").distinct()
    n = paths.count()
    for seed in count():
        file = F.xxhash64("path", F.lit(seed))
        if paths.select(file).distinct().count() == n:
            return rows.select(file.alias("file"), "row", "doc_id", "text")


def _followers(rows: DataFrame) -> DataFrame:
    """(file, row, p_file, p_row, p_doc_id, p_cut): the place of each document, that of the one it
    follows in the order of doc_id, and how many characters that one takes from it."""
    light = rows.select(
        "doc_id", "file", "row", F.xxhash64("text").alias("same"), F.floor(F.length("text") / 4).alias("cut")
    )
    ranked = materialize(
        numbered(light, F.asc_nulls_last("doc_id"), "same", "file", "row"), "fingerprint-order"
    )
    n = F.lit(max(ranked.count(), 1))
    before = ranked.select(
        ((F.col("rank") + 1) % n).alias("rank"),
        *[F.col(c).alias(f"p_{c}") for c in ("file", "row", "doc_id", "cut")],
    )
    return materialize(
        ranked.select("rank", "file", "row").join(before, "rank").drop("rank"), "fingerprint-pairs"
    )


def edited(rows: DataFrame, followers: DataFrame) -> DataFrame:
    """(file, row, text, edited): every text, and the text with its last quarter replaced by as
    many characters of the next document, or all it has."""
    # Both joins take the same columns by the same key, so the texts are shuffled once.
    texts = rows.select("file", "row", "text")
    heads = texts.join(followers.select("file", "row", "p_file", "p_row", "p_cut"), ["file", "row"]).select(
        F.col("p_file").alias("file"), F.col("p_row").alias("row"),
        F.substring("text", F.lit(1), F.col("p_cut").cast("int")).alias("head"),
    )
    n = F.length("text")
    kept = F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int"))
    return texts.join(heads, ["file", "row"]).select("file", "row", "text", F.concat(kept, "head").alias("edited"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    every row of ``docs`` (doc_id, text).

    The next document is that of the next row by doc_id, NULL ones last, repeated ones by text;
    the first follows the last, and a lone document follows itself. NULL and empty
    texts are empty, and alike. An empty table gives an empty result. Other columns,
    whatever their names, are not read.
    """
    rows = _placed(docs)
    followers = _followers(rows)
    pairs = edited(rows, followers)
    found = fingerprints(fingerprints(pairs, "text", "mine"), "edited", "changed")
    found = materialize(
        found.select(
            "file", "row", "mine", "changed", F.length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
        ),
        "fingerprints",
    )
    following = followers.join(found.select("file", "row", F.col("mine").alias("next")), ["file", "row"])
    following = following.select(
        F.col("p_file").alias("file"), F.col("p_row").alias("row"), F.col("p_doc_id").alias("doc_id"), "next"
    )
    return found.join(following, ["file", "row"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("mine")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("changed")).alias("near_edited"),
        likeness(F.col("mine"), F.col("next")).alias("near_next"),
    )
