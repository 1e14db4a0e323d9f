import random

from marketlake.operators import latest as module
from marketlake.operators.latest import key_bits, latest, merge_latest

SCHEMA = "k string, t bigint, v string"
ROWS = [("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 5, "x"), ("b", 5, "y"), ("c", None, "z")]


def collect(df):
    return sorted(tuple(r) for r in df.collect())


def test_newest_wins_in_any_order(spark):
    expected = [("a", 3, "new"), ("b", 5, "y"), ("c", None, "z")]
    for seed in range(3):
        rows = random.Random(seed).sample(ROWS, len(ROWS))
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert collect(latest(df, ["k"], ["t"])) == expected


def test_idempotent(spark):
    once = latest(spark.createDataFrame(ROWS, SCHEMA), ["k"], ["t"])
    assert collect(latest(once, ["k"], ["t"])) == collect(once)


def test_merge_equals_latest_of_all(spark):
    rng = random.Random(7)
    rows = [(f"k{rng.randrange(40)}", rng.randrange(9), f"v{i}") for i in range(300)]
    base = latest(spark.createDataFrame(rows[:200], SCHEMA), ["k"], ["t"])
    fresh = spark.createDataFrame(rows[200:], SCHEMA)
    expected = collect(latest(spark.createDataFrame(rows, SCHEMA), ["k"], ["t"]))
    for small in (True, False):
        assert collect(merge_latest(base, fresh, ["k"], ["t"], small)) == expected


def test_one_version_per_key_leaves_each_task(spark):
    plan = latest(spark.createDataFrame(ROWS, SCHEMA), ["k"], ["t"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    shuffle = text.index("Exchange hashpartitioning")
    assert "Partial" in text[shuffle:]


def test_bitmap_of_keys_spares_the_base_a_shuffle(spark, monkeypatch):
    """Equal to the latest of all, with keys of two columns, NULLs and a bitmap of more than one bucket."""
    rng = random.Random(11)
    key = lambda i: (None if i % 50 == 0 else f"k{i}", i % 7)
    schema = "k string, w int, t bigint, v string"
    rows = [(*key(rng.randrange(3000)), rng.choice([None, *range(9)]), f"v{i}") for i in range(4000)]
    keys = ["k", "w"]
    base = latest(spark.createDataFrame(rows[:3000], schema), keys, ["t"])
    fresh = spark.createDataFrame(rows[3000:], schema)
    expected = latest(spark.createDataFrame(rows, schema), keys, ["t"]).collect()
    for n in (1000, 9000):
        merged = merge_latest(base, fresh, keys, ["t"], False, fresh_rows=n)
        assert sorted(merged.collect(), key=str) == sorted(expected, key=str)
        marked = module._marked(base, fresh, keys, key_bits(n))
        hits = {tuple(r) for r in marked.where("_hit = 1").select(*keys).collect()}
        true = {tuple(r)[:2] for r in base.collect()} & {r[:2] for r in rows[3000:]}
        assert hits >= true and len(hits) < marked.count() * 0.7 and marked.count() == base.count()
    # too many keys for a bitmap: all rows are compared
    monkeypatch.setattr(module, "MOST_KEY_BITS", 1000)
    merged = merge_latest(base, fresh, keys, ["t"], False, fresh_rows=1000)
    assert "bitmap" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(merged.collect(), key=str) == sorted(expected, key=str)


def test_bits_grow_with_the_keys():
    assert [key_bits(n) for n in (0, 1, 4096, 4097, 2**26, 2**40)] == [2**15, 2**15, 2**15, 2**16, 2**29, 2**29]
