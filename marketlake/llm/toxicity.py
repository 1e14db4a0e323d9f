"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel of two words counts common subsequences of three characters, each weighted by
``DECAY`` to the power of its length including gaps, up to ``REACH``. So an insult with
inserted or changed characters, or with an ending, still has most of its subsequences.
Landmarks drawn from the training words give Nyström features; a linear machine with
squared hinge loss is trained on them. As the kernel is a product of explicit features, the
machine folds into one weight per subsequence, with which a word is scored directly.

Training reads labelled sentences: words of at most ``DOCS`` documents of either label, the
bound of the sample. Words are labelled by the fragments that occur in toxic documents
far more often than chance allows. A document's score is a logistic function of its
strongest word, fitted on the same documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import combinations, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm import words
from marketlake.llm.common import materialize

#: Labelled documents of either label that training reads at most.
DOCS = 3000
#: Words of either label that the machine is trained on at most, and landmarks.
WORDS, LANDMARKS = 3000, 600
#: Least hashes by which near copies in the sample are told.
SKETCH = 3
#: Rounds of training that add words mistaken for positive.
HARD = 3
DECAY, REACH = 0.7, 6
#: Words whose features, a number for each of 32,768 subsequences, are in memory at once while the machine is
#: trained; only those of the landmarks are all there.
ROWS = 128
#: Characters of a word that are compared at once; longer words are scored in parts.
PART = 24
#: Predicted toxic from this score on.
THRESHOLD = 0.7
#: Decision values are cut off here before the logistic function.
LARGEST = 3.0
#: Words whose scores a worker remembers.
REMEMBERED = 100_000

_SYMBOLS = 32
# Signs often put for letters.
_SIGNS = str.maketrans("013457@$", "oieastas")
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_SPELLED = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w){2,}(?!\w)")


def _symbols() -> np.ndarray:
    """A number for each character: letters 1 to 26, other letters by their code, the rest 0."""
    table = np.zeros(0x250, np.int64)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    others = np.arange(0xC0, 0x250)
    table[others] = 27 + others % (_SYMBOLS - 27)
    return table


_TABLE = _symbols()


def normal(word: str) -> str:
    """Lower case, without marks at the ends, signs put back to letters; numbers give nothing."""
    word = _EDGE.sub("", word)
    return word.lower().translate(_SIGNS) if any(c.isalpha() for c in word) else ""


def tokens(text: str) -> list[str]:
    """Words of a text, and what a run of single letters spells."""
    found = text.split()
    spelled = [re.sub(r"[\W_]", "", x) for x in _SPELLED.findall(text)]
    return found + spelled


@lru_cache(maxsize=None)
def _shapes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all three-character subsequences of ``n`` characters, and their weights."""
    found = [
        (i, j, k)
        for i in range(n - 2)
        for j, k in combinations(range(i + 1, min(n, i + REACH)), 2)
    ]
    places = np.array(found, np.int64).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] - 1)


def _parts(word: str) -> list[str]:
    if len(word) <= PART:
        return [word]
    step = PART // 2
    return [word[i : i + PART] for i in range(0, len(word) - step, step)]


def features(parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: numbers of the parts, their subsequences, and weights that give each part
    a kernel of one with itself."""
    sizes = np.array([len(p) for p in parts])
    for n in np.unique(sizes):
        if n < 3:
            continue
        places, weights = _shapes(int(n))
        for rows in np.array_split(np.flatnonzero(sizes == n), -(-int((sizes == n).sum()) // 500)):
            symbols = np.array([[ord(c) for c in parts[r]] for r in rows])
            symbols = np.where(symbols < len(_TABLE), _TABLE[np.minimum(symbols, len(_TABLE) - 1)], 0)
            a, b, c = (symbols[:, places[:, i]] for i in range(3))
            codes = (a * _SYMBOLS + b) * _SYMBOLS + c
            yield rows, codes, weights / _norms(codes, weights)[:, None]


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Length of each row's features: equal subsequences add up before they are squared."""
    order = np.argsort(codes, axis=1)
    ordered = np.take_along_axis(codes, order, 1)
    first = np.ones(codes.shape, bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    run = np.cumsum(first.ravel()) - 1
    sums = np.bincount(run, weights=weights[order].ravel())
    row = np.repeat(np.arange(len(codes)), codes.shape[1])[first.ravel()]
    return np.sqrt(np.bincount(row, weights=sums**2, minlength=len(codes)))


def dense(parts: list[str]) -> np.ndarray:
    """Explicit kernel features, a row for each part."""
    matrix = np.zeros((len(parts), _SYMBOLS**3), np.float32)
    for rows, codes, weights in features(parts):
        for column in range(codes.shape[1]):  # a row has each place once
            matrix[rows, codes[:, column]] += weights[:, column]
    return matrix


def score_words(found: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of each word: that of its strongest part; of short words the bias."""
    parts, owner = [], []
    for i, word in enumerate(found):
        plain = normal(word)
        bare = "".join(c for c in plain if c.isalnum())
        for part in _parts(plain) + (_parts(bare) if bare != plain else []):
            parts.append(part)
            owner.append(i)
    values = np.full(len(parts), bias)
    for rows, codes, weights in features(parts):
        values[rows] += (weight[codes] * weights).sum(axis=1)
    out = np.full(len(found), -np.inf)
    np.maximum.at(out, owner, values)
    return out


@dataclass
class Model:
    """Weights of subsequences, the bias of words, and the logistic fit of documents."""

    weight: np.ndarray
    bias: float
    fit: tuple[float, float]

    def probability(self, best: np.ndarray) -> np.ndarray:
        x = self.fit[0] * np.clip(best, -LARGEST, LARGEST) + self.fit[1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last column is the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    before = None
    for _ in range(50):
        active = y * (x @ w) < 1
        if before is not None and (active == before).all():
            break
        before = active
        square, along = np.diag(penalty), np.zeros(x.shape[1])
        for at in range(0, len(x), ROWS):
            some = slice(at, at + ROWS)
            xa, ca = x[some][active[some]], cost[some][active[some]]
            square += xa.T @ (ca[:, None] * xa)
            along += xa.T @ (ca * y[some][active[some]])
        w = np.linalg.solve(square, along)
    return w


def fragments(word: str) -> set[str]:
    return {word[i : i + n] for n in (4, 5, 6) for i in range(len(word) - n + 1)} | {word}


def label_words(
    counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int
) -> tuple[list[str], list[str]]:
    """Words of toxic documents with a fragment far too frequent in these, and other words.

    ``counts``: documents of either label by word. A fragment counts if its documents are
    toxic too often for chance, given as many fragments as there are.
    """
    toxic: dict[str, int] = {}
    for word, (t, _) in counts.items():
        if t:
            for x in fragments(word):
                toxic[x] = toxic.get(x, 0) + t
    limit = np.log(max(len(toxic), 1)) + 2
    toxic = {x: t for x, t in toxic.items() if t >= 3}
    clean = dict.fromkeys(toxic, 0)
    for word, (_, c) in counts.items():
        if c:
            for x in fragments(word):
                if x in clean:
                    clean[x] += c
    rate = (n_toxic + 1) / (n_toxic + n_clean + 2)

    def surprise(x: str) -> float:
        t, c = toxic[x], clean[x]
        share = t / (t + c)
        if share < max(rate, 0.95):
            return 0.0
        return t * np.log(share / rate) + (c * np.log((1 - share) / (1 - rate)) if c else 0.0)

    found = {x: surprise(x) for x in toxic}
    telling = {x: value for x, value in found.items() if value > limit}
    groups: dict[str, list[str]] = {}
    negative = []
    for word, (t, c) in sorted(counts.items(), key=lambda x: (-x[1][0], x[0])):
        if t > 9 * c and (found := [x for x in fragments(word) if x in telling]):
            groups.setdefault(max(found, key=lambda x: (telling[x], x)), []).append(word)
        elif c:
            negative.append(word)
    # Each telling fragment gives words in turn, so that none has all places.
    turns = [word for turn in zip_longest(*groups.values()) for word in turn if word]
    return turns[:WORDS], sorted(negative, key=lambda w: (-counts[w][1], w))


def _machine(positive: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
    found = [*positive, *negative]
    parts = [max(_parts(w), key=len) for w in found]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.where(y > 0, len(negative) / len(positive), 1.0)
    first = np.arange(min(LANDMARKS // 2, len(positive)))
    others = np.linspace(len(positive), len(found) - 1, min(LANDMARKS // 2, len(negative)))
    marks = np.concatenate([first, np.unique(others.astype(int))])
    marked = [parts[i] for i in marks]
    landmark = dense(marked)
    values, vectors = np.linalg.eigh((landmark @ landmark.T).astype(float))
    keep = values > 1e-4 * values.max()
    half_inverse = vectors[:, keep] / np.sqrt(values[keep])
    x = np.ones((len(parts), keep.sum() + 1))
    for at in range(0, len(parts), ROWS):
        x[at : at + ROWS, :-1] = dense(parts[at : at + ROWS]) @ landmark.T @ half_inverse
    # Made again after the training, as it is the largest of all.
    del landmark
    w = _svm(x, y, cost)
    del x
    share = half_inverse @ w[:-1]
    weight = np.zeros(_SYMBOLS**3)
    for at in range(0, len(marked), ROWS):
        weight += dense(marked[at : at + ROWS]).T @ share[at : at + ROWS]
    return weight, float(w[-1])


def train_words(positive: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
    """The machine on Nyström features of the words, folded into weights of subsequences.

    ``negative``: frequent words first. The machine begins with the most frequent and learns
    twice more with those other words that it took for positive.
    """
    if not positive or not negative:
        return np.zeros(_SYMBOLS**3), -1.0
    used = negative[:WORDS]
    for _ in range(HARD):
        weight, bias = _machine(positive, used)
        rest = sorted(set(negative).difference(used))
        values = score_words(rest, weight, bias)
        hard = np.argsort(-values, kind="stable")[: WORDS // HARD]
        used = used + [rest[i] for i in hard if values[i] > -0.9]
    return _machine(positive, used)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "text", words.BATCH // 8):
            texts = pc.fill_null(part["text"], "").to_pylist()
            found = [sorted({normal(w) for w in tokens(t)} - {""}) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part["row"], part["toxic"], pa.array(found, pa.list_(pa.string()))],
                names=["row", "toxic", "words"],
            )


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hashes of each text's shingles, in a few orders."""
    seeds = words.mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    for batch in batches:
        for part in words.slices(batch, "text", words.BATCH // 8):
            sketches = [
                [int(words.mix(s ^ seed).min().view(np.int64)) if len(s) else 0 for seed in seeds]
                for s in words.shingle_sets(part["text"], 4)
            ]
            yield pa.RecordBatch.from_arrays(
                [part["row"], pa.array(sketches, pa.list_(pa.int64()))], names=["row", "sketch"]
            )


def _unlike(texts: DataFrame) -> list[int]:
    """Rows of the sample without copies and near copies of earlier ones, which would count
    one document's words many times: rows that share no least hash with an earlier row."""
    seen: set[tuple[int, int]] = set()
    rows = []
    found = texts.select("row", "text").mapInArrow(_sketches, "row long, sketch array<long>")
    for row, sketch in sorted(found.toPandas().itertuples(index=False), key=lambda x: x[0]):
        marks = set(enumerate(sketch))
        if not marks & seen:
            rows.append(row)
        seen |= marks
    return rows


class Scorer(dict):
    """Decision values of words, remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def best(self, texts: list[str]) -> np.ndarray:
        """The decision value of the strongest word of each text."""
        found = [set(tokens(t)) for t in texts]
        new = sorted(set().union(*found).difference(self)) if found else []
        values = {}
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            values.update(zip(some, score_words(some, self.model.weight, self.model.bias).tolist()))
        top = np.array(
            [max((self[w] if w in self else values[w] for w in text), default=-LARGEST) for text in found]
        )
        room = REMEMBERED - len(self)
        self.update(list(values.items())[: max(room, 0)])
        return np.maximum(top, -LARGEST)


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(shared.value)
    for batch in batches:
        for part in words.slices(batch, "text", words.BATCH // 8):
            best = scorer.best(pc.fill_null(part["text"], "").to_pylist())
            kept = [name for name in part.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[part[name] for name in kept], pa.array(shared.value.probability(best)), pa.array(best)],
                names=[*kept, "score", "best"],
            )


def _learned(n_toxic: int, n_clean: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine trained on the words of the sample, one task's, as the driver has little memory;
    no row without words of both kinds."""
    counts = {}
    for batch in batches:
        word, t, c = (batch[x].to_pylist() for x in ("word", "t", "c"))
        counts.update(zip(word, zip(t, c)))
    positive, negative = label_words(counts, n_toxic, n_clean)
    del counts
    if positive and negative:
        weight, bias = train_words(positive, negative)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weight.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])],
            names=["weight", "bias"],
        )


def held_out(doc_id="doc_id"):
    """Documents whose labels training never reads."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents that are not held out, at most ``DOCS`` of either label,
    the first in the order of a hash. Without labels of both kinds all scores are low."""
    spark = docs.sparkSession
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    sample = materialize(
        usable.where("toxic = 1").orderBy(order).limit(DOCS)
        .union(usable.where("toxic = 0").orderBy(order).limit(DOCS)),
        "toxic-sample",
    )
    # At most 2 * DOCS rows of two numbers.
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(sample), "doc_id")
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "toxic", "text")
    )
    found = materialize(found, "toxic-found")
    numbers = found.select("row", "doc_id", F.xxhash64("text").alias("h")).toPandas()
    numbers = numbers.sort_values(["doc_id", "h", "row"], kind="stable")["row"].tolist()
    order = spark.createDataFrame(list(enumerate(numbers)), "n long, row long")
    texts = found.join(F.broadcast(order), "row").select(F.col("n").alias("row"), "toxic", "text")
    kept = spark.createDataFrame([(row,) for row in _unlike(texts)], "row long")
    texts = materialize(texts.join(F.broadcast(kept), "row"), "toxic-texts")
    sizes = dict(texts.groupBy("toxic").count().collect())
    learned = (
        texts.mapInArrow(_distinct, "row long, toxic int, words array<string>")
        .select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(
            F.sum("toxic").cast("int").alias("t"),
            F.sum(1 - F.col("toxic")).cast("int").alias("c"),
        )
        .repartition(1)
        .mapInArrow(partial(_learned, sizes.get(1, 0), sizes.get(0, 0)), "weight binary, bias double")
        .first()
    )
    # Without labels of both kinds no word tells anything.
    weight, bias = np.zeros(_SYMBOLS**3, np.float32), -1.0
    if learned:
        weight, bias = np.frombuffer(learned["weight"], np.float32), learned["bias"]
    model = Model(weight, bias, (0.0, -3.0))
    if learned:
        shared = spark.sparkContext.broadcast(model)
        fitted = texts.mapInArrow(
            partial(_score, shared), "row long, toxic int, score double, best double"
        ).toPandas()
        x = np.column_stack([fitted["best"].clip(-LARGEST, LARGEST), np.ones(len(fitted))])
        slope, start = _logistic(x, fitted["toxic"].to_numpy(float))
        if slope > 0:  # a stronger word never lowers a score
            model.fit = (float(slope), float(start))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, with ``score`` and ``best``, the decision value of the strongest
    word. NULL and empty texts, and texts without words, get the least score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "best", "text")]
    rows = docs.select(*[f"`{c}`" for c in kept], "text")
    schema = docs.select(*[f"`{c}`" for c in kept]).schema
    for name in ("score", "best"):
        schema = schema.add(name, "double")
    return rows.mapInArrow(partial(_score, shared), schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``. Rows without doc_id
    are scored, and not held out; repeated rows each give a row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, train(docs, labels)).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    columns = docs.columns
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_keep, shared), docs.schema).select(*[f"`{c}`" for c in columns])


def _keep(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(shared.value)
    for batch in batches:
        for part in words.slices(batch, "text", words.BATCH // 8):
            scores = shared.value.probability(scorer.best(pc.fill_null(part["text"], "").to_pylist()))
            yield part.filter(pa.array(scores < THRESHOLD))
