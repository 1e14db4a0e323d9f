"""Importance resampling, conversation repair and fingerprints against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from marketlake.llm import common, conversation_repair, fingerprints, resampling

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.importable(spark)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Importance resampling


def resampled(docs, target, run=1, least=20, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        runs = [" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(x.encode()) % 10000 for x in runs]

    source, wanted = [0] * 10000, [0] * 10000
    for counts, texts in ((source, [t for _, t in docs]), (wanted, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    S, T = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (S + 10000) / ((s + 1) * (T + 10000)))) for s, t in zip(source, wanted)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, n, len(found), weight, score))
    order = sorted((i for i, r in enumerate(rows) if r[1] >= least),
                   key=lambda i: (-rows[i][4], rows[i][0] is None, rows[i][0] or 0))
    rank = {i: k + 1 for k, i in enumerate(order[: percent * len(order) // 100])}
    return sorted([(d, n, w, s, rank.get(i)) for i, (d, _, n, w, s) in enumerate(rows)], key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("run,percent", [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_resampling(spark, run, percent):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["Apple", "bär", "c3", "delta", "e", "MIXED"]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(None, None), (None, LONG), (7, LONG), (7, LONG), (8, ""), (9, " \t"), (10, "A" * 100_000)]
    target = ["apple bär apple", None, "Delta"]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, `_metadata` string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(frame.repartition(5), wanted, run=run, percent=percent)
    assert got(found) == resampled(docs, target, run=run, percent=percent)


def test_resampling_ties(spark):
    """One score for all rows: identifiers decide, then repeated rows, NULL ones last."""
    rows = spark.createDataFrame([(5, i if i % 7 else None) for i in range(300)] + [(5, 3)] * 20, "score long, doc_id long")
    rows = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "ties")
    keys = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("row")]
    order = sorted((r.doc_id is None, r.doc_id or 0, r.row) for r in rows.collect())
    for k in (0, 1, 2, 10, 150, 290, 319, 320):
        found = rows.where(resampling.cutoff(rows, keys, k)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.row) for r in found) == order[:k]


def test_resampling_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert resampling.resample(docs, some).count() == 0
    assert [r.rank for r in resampling.resample(some, docs, percent=100).collect()] == [1]


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    found = common.numbered(rows, F.desc("x")).collect()
    assert sorted((r["rank"], r.x) for r in found) == [(i, 999 - i) for i in range(1000)]


# Conversation repair


def repaired(rows):
    """By exhaustive dynamic programming over (state, cost, audit), apart from the operator's search."""
    groups = {}
    for conv_id, turn, role, text in rows:
        mine = groups.setdefault(conv_id, [])
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        mine += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv_id, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        faults, seen = [], set()
        for _, role, text in mine:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            counts[fault] += 1
        letters = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

        def put(state, letter):  # state of (s?(ua)+)?
            return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))

        def inserted(ways):
            for _ in range(4):
                for state, (cost, audit, lines) in list(ways.items()):
                    for letter, role in (("u", "user"), ("a", "assistant")):
                        after = put(state, letter)
                        way = cost + 2, audit + "I", [*lines, f"{role}:"]
                        if after is not None and (after not in ways or way < ways[after]):
                            ways[after] = way
            return ways

        ways = inserted({"": (0, "", [])})
        for (_, role, text), fault in zip(mine, faults):
            new = {}
            for state, (cost, audit, lines) in ways.items():
                choices = [(state, (cost + 3, audit + "D", lines))]
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    choices.append((put(state, role[:1]), (cost + extra, audit + "K", [*lines, f"{role}:{text}"])))
                    for r in ("user", "assistant"):
                        choices.append((put(state, r[0]), (cost + 2 + extra, audit + "R", [*lines, f"{r}:{text}"])))
                for after, way in choices:
                    if after is not None and (after not in new or way < new[after]):
                        new[after] = way
            ways = inserted(new)
        cost, audit, lines = min(ways[s] for s in ("", "a") if s in ways)
        out.append((conv_id, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(11)
    rows = []
    for conv_id in [*range(60), None]:
        for turn in range(rng.randint(0, 12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Hello.", "no end", "Wait!  ", "", " \t", None, "a.b", "Und ä? ", "."])
            rows.append((conv_id, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(100, i, "user" if i % 2 else "assistant", f"text {i}" + "." * (i % 3)) for i in range(2500)]
    rows += [(101, 1, "user", "the same row.")] * 1500 + [(101, 2, "assistant", LONG)]
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("short,piece", [(1000, 1024), (3, 5), (0, 64)])
def test_conversation_repair(spark, monkeypatch, short, piece):
    """Whole conversations, and the same cut into pieces."""
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, code string")
    damaged = conversation_repair.damage(frame.repartition(4))
    found = conversation_repair.report(damaged, short)
    assert sorted([tuple(r) for r in found.select(*COLUMNS).collect()], key=repr) == repaired(rows)


def test_repaired_turns(spark):
    rows = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    damaged = common.materialize(conversation_repair.damage(rows), "damaged")
    turns = conversation_repair.repair(damaged).collect()
    assert sorted(map(repr, turns)) == sorted(map(repr, conversation_repair.repair(damaged, 2).collect()))
    lines = {}
    for r in sorted(turns, key=lambda r: r.position):
        lines.setdefault(r.conv_id, []).append(r)
    for r in conversation_repair.report(damaged).collect():
        mine = lines.get(r.conv_id, [])
        text = "\n".join(f"{x.role}:{x.text}" for x in mine)
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in mine))
        assert [x.edit for x in mine] == [x for x in r.audit if x != "D"]


def test_search_is_exhaustive():
    def brute(codes):
        best = None
        stack = [("", "", 0, 0, 0)]
        while stack:
            out, audit, cost, at, added = stack.pop()
            if at == len(codes) and re.fullmatch("(s?(ua)+)?", out):
                best = min(best or (cost, audit), (cost, audit))
            if added < 3:
                stack += [(out + r, audit + "I", cost + 2, at, added + 1) for r in "ua"]
            if at < len(codes):
                code = codes[at]
                stack.append((out, audit + "D", cost + 3, at + 1, added))
                if code not in "xy":
                    stack.append((out + code.lower(), audit + "K", cost + code.isupper(), at + 1, added))
                    stack += [(out + r, audit + "R", cost + 2 + code.isupper(), at + 1, added) for r in "ua"]
        return best

    rng = random.Random(2)
    for _ in range(60):
        codes = "".join(rng.choice("xsuaoSUA") for _ in range(rng.randint(0, 4)))
        assert conversation_repair.search(codes) == brute(codes)


def test_conversation_repair_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.digests(none).count() == 0
    assert conversation_repair.repair(conversation_repair.undamaged(none)).count() == 0


# Fingerprints


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(*values, seed=42):
    for x in values:
        data = x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def selected(text, k=2, size=2, sketches=64):
    """The tuples of k-mer hashes, in the order of the text."""
    tokens = [chained(x) for x in re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")]
    grams = [chained(*tokens[i : i + k]) for i in range(max(len(tokens) - k + 1, min(1, len(tokens))))]
    seen, least = {}, {}
    for at, gram in enumerate(grams):
        seen[gram] = seen.get(gram, 0) + 1
        value = signed(xxhash.xxh64_intdigest(seen[gram].to_bytes(4, "little"), chained(gram) & ((1 << 64) - 1)))
        r = (value + (1 << 63)) * size * sketches >> 64
        least[r] = min(least.get(r, (value, at)), (value, at))
    out = []
    for i in range(sketches):
        picked = []
        for r in range(i * size, i * size + size):
            near = next((x for x in sorted(least) if x >= r), min(least, default=None))
            picked.append((least[near][1], grams[least[near][1]]) if near is not None else (0, None))
        out.append(tuple(x for _, x in sorted(picked)))
    return out


def test_fingerprints(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"wörd{rng.randint(0, 50)}" for _ in range(rng.randint(0, 300)))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, " \n "), (53, "one"), (54, LONG), (55, LONG), (None, "no id"), (55, "again a b"), (56, "x" * 70_000)]
    frame = spark.createDataFrame([(*d, "f", 1) for d in docs], "doc_id long, text string, file string, `row` int")
    found = fingerprints.digests(frame.repartition(6)).collect()
    # Repeated identifiers stand in the order of a hash, so their order is taken from the result.
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, chained(d[1] or "")))
    assert len(found) == len(docs)
    by_text = {}
    for r in found:
        by_text.setdefault((r.doc_id, r.n_chars), []).append(r)
    prints = {}
    for n, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        cut = len(text) // 4
        changed = text[: len(text) - cut] + following[:cut]
        r = next(x for x in by_text[doc_id, len(text)] if x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest())
        mine, other, after = selected(text), selected(changed), selected(following)
        near = lambda a, b: sum(x == y for x, y in zip(a, b)) / 64
        assert (r.near_edited, r.near_next) == (near(mine, other), near(mine, after))
        assert prints.setdefault(r.fingerprint, mine) == mine and len(r.fingerprint) == 512
        assert prints.setdefault(r.edited_fingerprint, other) == other
    assert len({tuple(x) for x in prints.values()}) == len(prints)


def test_fingerprints_see_order(spark):
    """The same words in another order: the sets of k-mers nearly agree, the fingerprints do not."""
    rng = random.Random(9)
    lines = [f"line{i} {' '.join(str(rng.random()) for _ in range(12))}" for i in range(60)]
    texts = spark.createDataFrame([(0, " ".join(lines)), (1, " ".join(lines[::-1])), (2, " ".join(lines[:57]))], "id int, text string")
    values = {r.id: r["values"] for r in fingerprints.fingerprints(texts).collect()}
    near = lambda a, b: sum(x == y for x, y in zip(values[a], values[b])) / 64
    assert near(0, 1) < 0.65 and near(0, 2) > 0.75


def test_fingerprints_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.digests(none).count() == 0
    one = spark.createDataFrame([(1, "alone and by itself")], "doc_id long, text string")
    assert fingerprints.digests(one).first().near_next == 1.0
