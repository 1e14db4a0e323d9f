"""Importance resampling: draw the documents whose words look most like a target corpus.

Words fall into buckets. The gain of a bucket is the log ratio of its smoothed shares in the
target and in the documents; the gains are one array, against which every document's
buckets are scored. Gumbel noise from a hash of the identifier turns the weights into a draw
without replacement: the documents with the highest scores.

The lowest drawn score is found by bisection: exact counts over the written scores, several
thresholds a job, until one score is left, then in the same way over the doc_ids tied on it.
Only the drawn rows are sorted, by ranges.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import lower_ascii, materialize, numbered

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Features fall into this many buckets; the gains are collected, so it bounds the driver's part.
BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 1
SEED = 2024
#: Documents with fewer words are not drawn.
LEAST = 20
PERCENT = 10
#: Thresholds that one job counts: four halvings.
THRESHOLDS = 15


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), GAP), "")


def buckets(words: Column, run: int = RUN, n: int = BUCKETS) -> Column:
    """The bucket of every run of up to ``run`` words, repeats included."""
    found, runs = [], words
    for k in range(1, run + 1):
        if k > 1:
            # Each run with the word after it. Shifted arrays, since a lambda would split the text again.
            more = F.greatest(F.size(words) - (k - 1), F.lit(0))
            last = F.slice(words, F.lit(k), more)
            runs = F.zip_with(F.slice(runs, F.lit(1), more), last, lambda a, b: F.concat(a, F.lit(" "), b))
        found.append(F.transform(runs, lambda x: (F.crc32(x.cast("binary")) % n).cast("int")))
    return F.concat(*found)


def _counts(rows: DataFrame, n: int) -> np.ndarray:
    """How many features each bucket holds: at most ``n`` rows reach the driver."""
    found = rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    counts = np.zeros(n)
    for b, count in found.collect():
        counts[b] = count
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares, a bucket each."""
    n = len(source)
    all_source, all_target = source.sum() + n, target.sum() + n
    return np.array(
        [math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target)))
         for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) for a Gumbel value g from the hash of seed and identifier."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(
    docs: DataFrame, target: DataFrame, run: int = RUN, n: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, row) of every document, written; ``row`` tells
    repeated rows apart."""
    found = words(F.col("text"))
    featured = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("words")).select(
            "doc_id", F.size("words").cast("long").alias("n_words"), buckets(F.col("words"), run, n).alias("buckets")
        ),
        "resample-features",
    )
    wanted = target.select(found.alias("words")).select(buckets(F.col("words"), run, n).alias("buckets"))
    gain = F.lit(gains(_counts(featured, n), _counts(wanted, n)))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get(gain, b))
    return materialize(
        featured.select(
            "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)),
        "resample-scores",
    )


def bisect(rows: DataFrame, key: Column, k: int) -> tuple[int, int, int]:
    """The k-th smallest value of an integer ``key``, counted from 1, the rows below it and the
    rows that have it. Every step is one job of exact counts and returns one row."""
    rows = rows.select(key.alias("key"))
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    below = 0
    while low < high:
        cuts = sorted({low + (high - low) * i // (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)})
        counts = rows.where(F.col("key").between(low, high)).agg(
            *[F.count(F.when(F.col("key") <= cut, 1)) for cut in cuts]
        ).first()
        found = next((i for i, count in enumerate(counts) if below + count >= k), len(cuts))
        if found < len(cuts):
            high = cuts[found]
        if found:
            low, below = cuts[found - 1] + 1, below + counts[found - 1]
    return low, below, rows.where(F.col("key") == low).count()


def cutoff(rows: DataFrame, keys: list[Column], k: int) -> Column:
    """Condition that holds for the first ``k`` of ``rows`` in the order of integer ``keys``."""
    if k <= 0:
        return F.lit(False)
    values: list[int] = []
    for key in keys:
        value, below, having = bisect(rows, key, k)
        values.append(value)
        k -= below
        if k == having:
            break
        rows = rows.where(key == value)
    taken = F.lit(True)
    for key, value in zip(reversed(keys[: len(values)]), reversed(values)):
        taken = (key < value) | ((key == value) & taken)
    return taken


def resample(
    docs: DataFrame,
    target: DataFrame,
    run: int = RUN,
    n: int = BUCKETS,
    seed: int = SEED,
    least: int = LEAST,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text).

    Of the N documents with at least ``least`` words the floor(percent N / 100) highest scores are
    drawn and ranked from 1; ``rank`` is NULL for the others. Ties go to the smaller
    doc_id, a NULL one last and hashed as empty; of repeated rows any may be drawn. NULL,
    empty and wordless texts have no features and weight 0. Without a target text all
    gains follow from the smoothing. Empty ``docs`` give an empty result. Other columns,
    whatever their names, are not read.
    """
    scored = scores(docs, target, run, n, seed)
    fit = scored.where(F.col("n_words") >= least)
    keys = [
        -F.col("score"),
        F.col("doc_id").isNull().cast("long"),
        F.coalesce("doc_id", F.lit(0)),
        F.col("row"),
    ]
    drawn = (F.col("n_words") >= least) & cutoff(fit, keys, percent * fit.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(
        scored.where(drawn).select(*columns, "row"), F.desc("score"), F.asc_nulls_last("doc_id"), "row"
    )
    return ranked.select(*columns, (F.col("rank") + 1).alias("rank")).unionByName(
        scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    )
