import datetime
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake.operators import usage
from marketlake.schemas import REQUEST_LOG
from marketlake.streaming.requests import BUCKETS, PARTITIONS, Requests, read_request_figures, start_request_figures
from marketlake.streaming.usage import fold_rollup, read_rollup, start_rollup

T0 = datetime.datetime(2024, 1, 1, 23, 58)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


# ts, request, iteration, in, out, tool, duration, method, route, status
ROWS = [
    (at(0), "a", 1, 100, 10, "search", None, "POST", "/chat", None),
    (at(10), "a", 2, 150, 15, None, None, None, None, None),
    (at(40), "a", None, 50, 5, None, 40_000.0, "POST", "/chat", 200),
    (at(70), "b", 1, 60, 6, "search", None, "POST", "/chat", None),
    (at(80), "b", 4, 60, 6, "prices", None, None, None, None),
    (at(125), "c", 1, 30, 3, None, None, "GET", "/prices", None),
    # b fails: rounds, but no duration. It is logged after c.
    (at(119), "b", None, 0, 0, None, None, "POST", "/chat", 500),
    (at(30), None, 9, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, REQUEST_LOG)


def test_totals(log):
    (r,) = usage.usage_totals(log).collect()
    assert (r["input_tokens"], r["output_tokens"]) == (450, 45)
    assert r["cost_usd"] == pytest.approx((450 + 45 * 5) / 1e6)


def test_tools(log):
    assert {r["tool_name"]: r["calls"] for r in usage.usage_tools(log).collect()} == {"search": 2, "prices": 1}
    assert usage.usage_tool_calls(log).first()["calls"] == 3


def test_rates(log):
    rows = usage.usage_rates(log).orderBy("window_start").collect()
    assert [r["input_per_second"] for r in rows] == [5.0, 2.0, 0.5]
    assert rows[0]["cost_per_minute"] == pytest.approx((300 + 30 * 5) / 1e6)


def test_requests(log):
    rows = {r["request_id"]: tuple(r)[1:] for r in usage.requests(log).collect()}
    assert rows == {
        "a": (at(0), at(40), 2, 40_000.0, "POST", "/chat"),
        "b": (at(70), at(119), 4, None, "POST", "/chat"),
        "c": (at(125), None, 1, None, "GET", "/prices"),
    }


def test_means(log):
    rows = usage.usage_means(log).orderBy("window_start").collect()
    assert [(r["mean_duration_ms"], r["mean_iterations"]) for r in rows] == [(40_000.0, 2.0), (None, 4.0)]


def test_routes(log):
    rows = usage.usage_routes(log).collect()
    assert [(r["method"], r["route"], r["requests_per_second"]) for r in rows] == [("POST", "/chat", 1 / 60)] * 2


def test_active(log):
    rows = usage.usage_active(log).orderBy("window_start").collect()
    assert [(r["window_start"].minute, r["active"]) for r in rows] == [(58, 0), (59, 0), (0, 1)]
    for second, chat, prices in [(20, 1, 0), (75, 1, 0), (130, 0, 1), (10**5, 0, 1)]:
        got = {r["route"]: r["active"] for r in usage.active_at(log, F.lit(at(second))).collect()}
        assert got == {"/chat": chat, "/prices": prices}


@pytest.mark.parametrize("rollup", [usage.rates(), usage.routes()])
def test_stream_equals_batch(spark, log, tmp_path, rollup):
    """One row a batch, an hour-late and a day-late one among them, with folds between."""
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    late = [(at(-3600), "l", 1, 7, 1, None, None, "GET", "/late", 200), (at(-86400), "m", 1, 9, 1, None, 5.0, "GET", "/late", 200)]
    rows = [*ROWS, *late, ROWS[3]]

    def figures(df):
        return sorted(map(str, df.collect()))

    listed = []
    for i, row in enumerate(rows):
        spark.createDataFrame([row], REQUEST_LOG).coalesce(1).write.mode("append").parquet(source)
        if i % 3 == 2 or i == len(rows) - 1:
            stream = spark.readStream.schema(REQUEST_LOG).option("maxFilesPerTrigger", 1).parquet(source)
            start_rollup(stream, rollup, out, str(tmp_path / "c"), interval=None).awaitTermination()
            expected = figures(rollup(spark.createDataFrame(rows[: i + 1], REQUEST_LOG)))
            assert figures(read_rollup(spark, out, rollup)) == expected
            assert fold_rollup(spark, out, rollup) == i == fold_rollup(spark, out, rollup)
            assert figures(read_rollup(spark, out, rollup)) == expected
            listed.append(sum(1 for p in (tmp_path / "out").rglob("*") if p.is_dir()))
    assert max(listed) <= 16


def _figures(spark, path):
    return {
        name: {r["window_start"]: tuple(r)[1:] for r in read_request_figures(spark, str(path), name).collect()}
        for name in ("means", "active", "expired")
    }


def _run(spark, tmp_path, keep, **options):
    log = spark.readStream.schema(REQUEST_LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start_request_figures(
        log, f"{tmp_path}/out", f"{tmp_path}/checkpoint", interval=None, keep=keep
    ).awaitTermination()


@pytest.mark.parametrize("order", [([0, 4, 7], [2, 6], [5, 1], [3]), ([6, 2], [3, 0], [5], [1, 4, 7])])
def test_request_stream_in_any_order(spark, tmp_path, order):
    """Four batches, the closing rows before or after the others, and a restart in between."""
    for start in (0, 2):
        for batch in order[start : start + 2]:
            rows = spark.createDataFrame([ROWS[i] for i in batch], REQUEST_LOG).coalesce(1)
            rows.write.mode("append").parquet(f"{tmp_path}/in")
        _run(spark, tmp_path, 10**9)
    log = spark.createDataFrame(ROWS, REQUEST_LOG)
    found = _figures(spark, f"{tmp_path}/out")
    assert found["means"] == {r["window_start"]: tuple(r)[1:] for r in usage.usage_means(log).collect()}
    assert found["active"] == {r["window_start"]: tuple(r)[1:] for r in usage.usage_active(log).collect()}
    assert found["expired"] == {}


def test_request_stream_expires(spark, tmp_path):
    """c never closes: its timer ends it at its last row, and it is counted."""
    spark.createDataFrame(ROWS, REQUEST_LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    _run(spark, tmp_path, 1)
    time.sleep(0.5)
    spark.createDataFrame([(at(500), "d", 1, 1, 1, None, None, None, None, None)], REQUEST_LOG).coalesce(1).write.mode(
        "append"
    ).parquet(f"{tmp_path}/in")
    _run(spark, tmp_path, 1)
    found = _figures(spark, f"{tmp_path}/out")
    minute = at(120)
    assert found["expired"] == {minute: (1,)}
    assert found["active"][minute] == (0,) and found["active"][at(480)] == (1,)


def test_request_state_is_shared_by_buckets(spark, tmp_path):
    """Many requests, one entry of state a bucket, and the figures of a batch job."""
    many = [
        (at(i % 300 + 7 * k), f"r{i}", k, 1, 1, None, 10.0 * i if k and i % 3 else None, "GET", "/", 200 if k and i % 5 else None)
        for i in range(4 * BUCKETS) for k in (0, 1)
    ]
    for half in (many[::2], many[1::2]):
        spark.createDataFrame(half, REQUEST_LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(REQUEST_LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = start_request_figures(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", interval=None)
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= BUCKETS
    log, found = spark.createDataFrame(many, REQUEST_LOG), _figures(spark, f"{tmp_path}/out")
    assert found["means"] == {r["window_start"]: tuple(r)[1:] for r in usage.usage_means(log).collect()}
    assert found["active"] == {r["window_start"]: tuple(r)[1:] for r in usage.usage_active(log).collect()}


def test_request_state_has_few_partitions(spark, tmp_path):
    """Whatever the session's shuffles have: each partition costs a commit a batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.createDataFrame(ROWS, REQUEST_LOG).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        stream = spark.readStream.schema(REQUEST_LOG).parquet(f"{tmp_path}/in")
        query = start_request_figures(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", interval=None)
        query.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] == PARTITIONS
    log = spark.createDataFrame(ROWS, REQUEST_LOG)
    means = {r["window_start"]: tuple(r)[1:] for r in usage.usage_means(log).collect()}
    assert _figures(spark, f"{tmp_path}/out")["means"] == means


class _State:
    """A bucket's entry of state, as the stream hands it to the update."""

    def __init__(self):
        self.exists, self.hasTimedOut, self.now, self.timer = False, False, 0, None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutDuration(self, duration):
        self.timer = self.now + duration

    def remove(self):
        self.exists = False


def test_requests_of_a_bucket_expire_one_by_one():
    nan, state, update = float("nan"), _State(), Requests(100)

    def came(now, *rows, timed_out=False):
        state.now, state.hasTimedOut = now, timed_out
        names = ["request_id", "started", "closed", "last", "rounds", "duration"]
        frames = iter([pd.DataFrame([row], columns=names) for row in rows])
        changes = pd.concat(list(update((0,), frames, state)))
        return sorted(map(repr, changes.itertuples(index=False, name=None)))

    assert came(0, ("a", 5, -1, 5, 1, nan), ("b", 6, -1, 6, 1, nan), ("a", 4, -1, 7, 2, nan)) == [
        repr(("a", 1, 4, -1, 2, nan, False)), repr(("b", 1, 6, -1, 1, nan, False))
    ]
    assert state.timer == 100
    # The same row again changes nothing, but the timer of its request.
    assert came(50, ("b", 6, -1, 6, 1, nan)) == [] and state.timer == 100
    assert came(101, timed_out=True) == [
        repr(("a", -1, 4, -1, 2, nan, False)), repr(("a", 1, 4, 7, 2, nan, True))
    ]
    assert state.timer == 150
    assert came(151, ("b", 8, 8, 8, 3, 9.0)) == [
        repr(("b", -1, 6, -1, 1, nan, False)), repr(("b", 1, 6, 8, 3, 9.0, False))
    ]
    # A closed request leaves without a trace.
    assert came(252, timed_out=True) == [] and not state.exists
