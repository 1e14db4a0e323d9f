"""Secrets in texts: fixed patterns, and two character models compared by likelihood.

Base spans follow three patterns. The models add tokens whose characters look random:
one first-order Markov model of characters is trained on labelled random strings over the
alphabets that keys are written in, one on labelled ordinary identifiers (words and numbers
of a bounded sample of the texts). Half of either sample is held out; it sets the threshold.
A token whose log-likelihood ratio per character reaches it becomes a span of kind
``model``, unless it overlaps a base span.

Everything is expressed with DataFrame functions. Places are counted in code points,
ends exclusive. The models are one table of 67 x 67 character pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.llm.common import materialize

# The base patterns, and the least length of an assigned value.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "model")

#: Tokens that the models judge: a value without its key, and the padding of base64.
TOKEN = "[A-Za-z0-9+/_-]{12,}={0,2}"
_ALONE = "(?<![A-Za-z0-9+/_=-])(?:%s)(?![A-Za-z0-9+/_=-])"
#: Ordinary identifiers and numbers for training, as whole tokens: parts that are written as words,
#: so that a random string in the texts is hardly ever taken for one.
IDENTIFIER = _ALONE % "(?:[A-Z]{2,5}+|[A-Z]?[a-z]{2,}+)(?:[-_/]?[A-Z]?[a-z]{2,}+)*+[0-9]{0,4}|[0-9]+(?:[-/_][0-9]+)*+"
#: Documents whose words train the model of identifiers, about.
SAMPLE = 2000
#: Labelled random strings, as many of each alphabet.
RANDOM = 4000
#: Least ratio per character, in natural logarithms, whatever the held-out samples say.
RATIO = 1.0
#: Share of held-out random strings that may be missed, and of held-out identifiers that may pass.
MISSED, PASSED = 0.02, 0.001

# The alphabets of base62, base64, base64url, base36 and base32.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (
    _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "-_",
    _LOWER + _DIGITS,
    _UPPER + "234567",
)
_SYMBOLS = _UPPER + _LOWER + _DIGITS + "+/_-="
#: Weight of the frequency of a character where the one before it was seen rarely.
_PRIOR = 20


def _matches(kind: int, pattern: str, group: int = 0) -> Column:
    """The matches of a pattern, in order: gap before, length, and value of each."""
    text = F.col("text")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.transform(
        F.arrays_zip(
            F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"),
            whole.alias("whole"),
            value.alias("value"),
        ),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["whole"]).alias("size"),
            x["value"].alias("value"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, first, last, value): all matches of the patterns and all tokens;
    a row without any has one entry of NULLs."""
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "row",
        "doc_id",
        F.concat(
            _matches(0, ASSIGN, 2), _matches(1, ACCESS), _matches(2, HEX), _matches(3, TOKEN)
        ).alias("found"),
    )
    found = materialize(found, "secret-matches")
    before = Window.partitionBy("row", "found.kind").orderBy("at")
    return (
        found.select("row", "doc_id", F.posexplode_outer("found").alias("at", "found"))
        .withColumn("last", F.sum(F.col("found.gap") + F.col("found.size")).over(before))
        .select(
            "row", "doc_id", "found.kind",
            (F.col("last") - F.col("found.size")).cast("int").alias("first"),
            F.col("last").cast("int").alias("last"),
            "found.value",
        )
        .where("kind IS NULL OR kind <> 0 OR length(value) >= %d" % ASSIGN_VALUE)
    )


def _pairs(values: DataFrame, *kept: str) -> DataFrame:
    """Every two characters that follow each other in ``value``."""
    return values.where("length(value) > 1").select(
        *kept, "value", F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("at")
    ).select(*kept, "value", F.substring("value", F.col("at"), F.lit(2)).alias("pair"))


def random_strings(spark: SparkSession) -> DataFrame:
    """(value): ``RANDOM`` strings of 12 to 64 characters for each alphabet, drawn by hashing."""
    alphabets = F.array(*[F.lit(x) for x in ALPHABETS])
    row = spark.range(RANDOM * len(ALPHABETS)).withColumn(
        "alphabet", F.element_at(alphabets, (F.col("id") % len(ALPHABETS) + 1).cast("int"))
    )
    size = (F.pmod(F.xxhash64("id", F.lit("size")), F.lit(53)) + 12).cast("int")

    def drawn(at: Column) -> Column:
        place = F.pmod(F.xxhash64("id", at), F.length("alphabet")) + 1
        return F.substring("alphabet", place.cast("int"), F.lit(1))

    return row.select(F.array_join(F.transform(F.sequence(F.lit(1), size), drawn), "").alias("value"))


def train(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(pair, ratio): for two characters the log ratio of the likelihoods, that the second
    follows the first in a random string and that it does in an ordinary identifier.

    Both samples are tables of ``value``. Every pair of known characters has a row. The
    likelihood of b after a is ``(count(ab) + PRIOR * share(b)) / (count(a) + PRIOR)``, so that a
    character that a sample hardly has is unlikely after any other; shares are by add-one
    smoothing over the characters.
    """
    symbols = F.array(*[F.lit(x) for x in _SYMBOLS])
    grid = (
        random.sparkSession.range(1)
        .select(F.explode(symbols).alias("first"))
        .select("first", F.explode(symbols).alias("second"))
        .withColumn("pair", F.concat("first", "second"))
    )
    every = Window.partitionBy()  # at most 67 * 67 rows

    def likelihood(values: DataFrame, name: str) -> DataFrame:
        counts = _pairs(values).groupBy("pair").agg(F.count("*").alias("n"))
        n = F.col("n")
        share = (F.sum("n").over(Window.partitionBy("second")) + 1) / (F.sum("n").over(every) + len(_SYMBOLS))
        after = F.sum("n").over(Window.partitionBy("first"))
        return (
            grid.join(counts, "pair", "left")
            .na.fill(0, ["n"])
            .select("pair", F.log((n + _PRIOR * share) / (after + _PRIOR)).alias(name))
        )

    return likelihood(random, "r").join(likelihood(ordinary, "o"), "pair").select(
        "pair", (F.col("r") - F.col("o")).alias("ratio")
    )


def score(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """(value, ratio): the log-likelihood ratio per pair of each distinct ``value``; pairs
    that no sample has count 0."""
    pairs = _pairs(tokens.select("value").distinct())
    small = F.broadcast(model)  # at most 67 * 67 rows
    return (
        pairs.join(small, "pair", "left")
        .groupBy("value")
        .agg((F.sum(F.coalesce("ratio", F.lit(0.0))) / F.count("*")).alias("ratio"))
    )


def ordinary_identifiers(docs: DataFrame) -> DataFrame:
    """(value): the identifiers and numbers in a sample of about ``SAMPLE`` documents, chosen by
    doc_id and text; once as they are written and once in capitals, as in headings."""
    every = F.greatest(F.lit(1), F.ceil(F.lit(docs.count()) / F.lit(SAMPLE)))
    chosen = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    words = F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))
    sample = docs.where(F.pmod(chosen, every) == 0).select(F.explode(words).alias("value"))
    return sample.select(F.explode(F.array("value", F.upper("value"))).alias("value"))


def fit(random: DataFrame, ordinary: DataFrame) -> tuple[DataFrame, float]:
    """The table of pairs, and the least ratio of a span. Half of either sample, by hash of the value,
    trains; the other half sets the threshold. Of identifiers only those as long as tokens count there."""
    held = F.pmod(F.xxhash64("value"), F.lit(2)) == 1
    model = materialize(train(random.where(~held), ordinary.where(~held)), "secret-model")

    def quantile(values: DataFrame, at: float) -> float:
        found = score(values.where(held), model).agg(F.percentile("ratio", F.lit(at))).first()[0]
        return RATIO if found is None else found

    long = ordinary.where("length(value) >= 12")
    return model, max(RATIO, quantile(random, MISSED), quantile(long, 1 - PASSED))


def spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, spans): per row of ``docs`` its spans as an array of (first, kind, last,
    value), by start and then kind. ``kind`` is a place in ``KINDS``.

    NULL and empty texts have no spans. Repeated rows and NULL doc_ids are rows like any
    other. Columns other than doc_id and text are not read.
    """
    found = materialize(matches(docs), "secret-spans")
    model, least = fit(random_strings(docs.sparkSession), ordinary_identifiers(docs))
    tokens = found.where("kind = 3").select("value")
    likely = score(tokens, model).where(F.col("ratio") >= least).select("value", F.lit(True).alias("likely"))
    span = F.struct("first", "kind", "last", "value")
    # Only tokens join by value: rows without any span would all have the same, no value.
    judged = (
        found.where("kind = 3").join(likely, "value", "left")
        .select(*found.columns, "likely")
        .union(found.where("kind IS NULL OR kind < 3").withColumn("likely", F.lit(None).cast("boolean")))
    )
    gathered = (
        judged.groupBy("row", "doc_id")
        .agg(F.array_sort(F.collect_list(F.when(F.expr("kind < 3 OR likely"), span))).alias("all"))
    )
    base = F.filter("all", lambda x: x["kind"] < 3)
    added = F.filter(
        "all",
        lambda x: (x["kind"] == 3)
        & ~F.exists("base", lambda b: (b["first"] < x["last"]) & (x["first"] < b["last"])),
    )
    return gathered.withColumn("base", base).select(
        "row", "doc_id", F.array_sort(F.concat("base", added)).alias("spans")
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(
                ":", F.get(names, x["kind"]), x["first"].cast("string"), x["last"].cast("string")
            ),
        ),
        ",",
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    found = F.col("spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")

    return spans(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter(found, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _joined(found).alias("spans"),
    )
