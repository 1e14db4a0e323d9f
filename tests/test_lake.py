import datetime
import glob
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from marketlake import testdata
from marketlake.operators import latest
from marketlake.operators.flatten import parse_listings, parse_sales
from marketlake.plans import registry
from marketlake.schemas import RAW_LISTINGS, RAW_SALES
from marketlake.sources import lake, topics
from marketlake.streaming import ingest

DAY = 86400
T0 = 1704067200


def listing(key, t, price=1, world=1, item=1):
    day = datetime.date(1970, 1, 1) + datetime.timedelta(days=t // DAY)
    return (item, t, price, 1, True, False, "r", key, price, 0, world, day)


def sale(ts, price, item=1, world=1):
    day = datetime.date(1970, 1, 1) + datetime.timedelta(days=ts // DAY)
    return (item, False, price, 1, ts, price, None, False, world, day)


def listings(spark, *rows):
    return spark.createDataFrame(rows, RAW_LISTINGS)


def state(table, spark):
    return {r["listingID"]: (r["pricePerUnit"], str(r["dt"])) for r in table.read(spark).collect()}


@pytest.fixture
def table(spark, tmp_path):
    return lake.listings_table(str(tmp_path / "listings")).create(spark)


def test_empty(spark, table):
    assert table.read(spark).count() == 0 and table.compact(spark) == 0


@pytest.mark.parametrize("compact_after", [(), (0,), (1,), (0, 1, 2)])
def test_upsert(spark, table, compact_after):
    batches = [
        [listing("a", T0, 10), listing("b", T0, 20)],
        [listing("a", T0 + DAY, 11), listing("b", T0 - DAY, 19), listing("c", T0, 30, world=2)],
        [listing("c", T0, 31, world=2)],
    ]
    for i, rows in enumerate(batches):
        table.append(listings(spark, *rows), i)
        if i in compact_after:
            table.compact(spark)
    # a moved to the next day, b kept its newer version, c ties: the later arrival wins
    assert state(table, spark) == {
        "a": (11, "2024-01-02"), "b": (20, "2024-01-01"), "c": (31, "2024-01-01"),
    }
    assert table.read_raw(spark).count() == 6


def test_repeated_batch_counts_once(spark, table):
    for _ in range(2):
        table.append(listings(spark, listing("a", T0)), 0)
    assert table.read_raw(spark).count() == 1


def test_uncommitted_batch_is_not_read(spark, table):
    table.append(listings(spark, listing("a", T0)), 0)
    table.write(listings(spark, listing("b", T0)), 1)
    assert set(state(table, spark)) == {"a"} and table.read_raw(spark).count() == 1


def test_compaction_leaves_other_partitions_alone(spark, table):
    table.append(listings(spark, listing("a", T0, world=1), listing("b", T0, world=2)), 0)
    table.compact(spark)
    before = table.read(spark)
    table.append(listings(spark, listing("a", T0 + 1, 5, world=1)), 1)
    version = table.compact(spark)
    assert [os.path.basename(p) for p in glob.glob(f"{table.path}/base/version={version}/world=*")] == ["world=1"]
    assert state(table, spark) == {"a": (5, "2024-01-01"), "b": (1, "2024-01-01")}
    # a reader that began before the compaction still finds its files
    assert before.count() == 2


def test_overlapping_compactions(spark, table, monkeypatch):
    table.append(listings(spark, listing("a", T0, 1), listing("b", T0, 2, world=2)), 0)
    table.compact(spark)
    table.append(listings(spark, listing("a", T0 + 1, 3)), 1)
    before = table._snapshot(spark)
    table.compact(spark)
    # a second one that began from the same snapshot
    with monkeypatch.context() as m:
        m.setattr(lake.LakeTable, "_snapshot", lambda self, spark: before)
        table.compact(spark)
    assert state(table, spark) == {"a": (3, "2024-01-01"), "b": (2, "2024-01-01")}


def test_large_merge_without_broadcast(spark, table, monkeypatch):
    table.append(listings(spark, *[listing(f"k{i}", T0 + i) for i in range(50)]), 0)
    table.compact(spark)
    table.append(listings(spark, *[listing(f"k{i}", T0 + 1000 + i, 9) for i in range(25, 75)]), 1)
    expected = state(table, spark)
    monkeypatch.setattr(lake, "BROADCAST_ROWS", 0)
    assert state(table, spark) == expected and len(expected) == 75
    table.compact(spark)
    assert state(table, spark) == expected


def test_sales_in_one_second_collapse(spark, tmp_path):
    table = lake.sales_table(str(tmp_path / "sales")).create(spark)
    table.append(spark.createDataFrame([sale(T0, 5), sale(T0, 9, item=2)], RAW_SALES), 0)
    table.append(spark.createDataFrame([sale(T0, 6), sale(T0 + 1, 7)], RAW_SALES), 1)
    table.compact(spark)
    got = sorted((r["item"], r["ts"], r["pricePerUnit"]) for r in table.read(spark).collect())
    assert got == [(1, T0, 6), (1, T0 + 1, 7), (2, T0, 9)]


def test_filters_prune_partitions(spark, table):
    rows = [listing(f"k{w}{d}", T0 + d * DAY, world=w) for w in range(3) for d in range(3)]
    path = f"{table.path}-plain"
    lake.write_partitioned(listings(spark, *rows), path)
    raw = lake.read_partitioned(spark, path, RAW_LISTINGS)
    day = F.lit("2024-01-02").cast("date")
    picked = raw.where((F.col("world") == 1) & (F.col("dt") == day)).select("listingID")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(world" in plan
    assert [r[0] for r in picked.collect()] == ["k11"]
    assert lake.peek(raw).columns == list(lake.PEEK_COLUMNS)


def test_base_scan_is_pruned_to_current_versions(spark, table):
    table.append(listings(spark, listing("a", T0)), 0)
    table.compact(spark)
    plan = table.read(spark)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_compaction_reads_touched_partitions_only(spark, table):
    table.append(listings(spark, *[listing(f"k{w}", T0, world=w) for w in range(4)]), 0)
    version = table.compact(spark)
    touched = table._touched(spark, version, listings(spark, listing("k1", T0 + 1, world=1)))
    old = table._base(spark, version, touched)
    # the files of the other partitions are not opened: without them all goes well
    for w in (0, 2, 3):
        for file in glob.glob(f"{table.path}/base/version={version}/world={w}/*/*.parquet"):
            os.remove(file)
    assert [r["listingID"] for r in old.collect()] == ["k1"]


def write_events(folder, name, events):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in events)


def event(item, world, *keys_times):
    return {
        "item": item, "world": world,
        "listings": [{"listingID": k, "lastReviewTime": t, "pricePerUnit": t - T0} for k, t in keys_times],
    }


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    table = lake.listings_table(str(tmp_path / "t"))

    def drain():
        raw = topics.read_topic_files(spark, source, maxFilesPerTrigger="1")
        ingest.start_ingest(
            raw, table, parse_listings, checkpoint, interval=None, compact_every=2
        ).awaitTermination()

    write_events(source, "0", [event(1, 1, ("a", T0 + 5), ("b", T0 + 7)), "{broken"])
    write_events(source, "1", [event(1, 1, ("a", T0 + 3)), event(2, 1)])
    drain()
    assert state(table, spark) == {"a": (5, "2024-01-01"), "b": (7, "2024-01-01")}
    write_events(source, "2", [event(1, 1, ("a", T0 + DAY)), event(3, 2, ("c", T0))])
    drain()
    batch, _ = parse_listings(spark.read.text(source))
    assert table.read_raw(spark).count() == batch.count() == 5
    assert state(table, spark) == {
        "a": (DAY, "2024-01-02"), "b": (7, "2024-01-01"), "c": (0, "2024-01-01"),
    }
    quarantine = table.read_quarantine(spark).collect()
    assert [(r["value"], r["reason"]) for r in quarantine] == [("{broken", "bad json")]
    # nothing new: nothing changes
    drain()
    assert table.read_raw(spark).count() == 5


def test_batch_that_fails_before_its_commit(spark, tmp_path, monkeypatch):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    table = lake.listings_table(str(tmp_path / "t"))
    write_events(source, "0", [event(1, 1, ("a", T0), ("b", T0))])

    def drain():
        ingest.start_ingest(
            topics.read_topic_files(spark, source), table, parse_listings, checkpoint, interval=None
        ).awaitTermination()

    def lost(self, spark, batch_id, rows):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(lake.LakeTable, "commit", lost)
        with pytest.raises(StreamingQueryException):
            drain()
    assert table.read_raw(spark).count() == 0
    drain()
    assert table.read_raw(spark).count() == 2 and table.read_quarantine(spark).count() == 0


def test_messages_keep_key_and_topic(spark):
    df = spark.createDataFrame([("t", "k", 1, "x")], "topic string, key string, a int, b string")
    row = topics.as_messages(df).first()
    assert (row["topic"], row["key"], json.loads(row["value"])) == ("t", "k", {"a": 1, "b": "x"})


def test_two_streams_in_one_session(spark, tmp_path):
    write_events(str(tmp_path / "l"), "0", [event(1, 1, ("a", T0))])
    write_events(str(tmp_path / "s"), "0", [{"item": 1, "world": 1, "sales": [{"timestamp": T0}]}])
    tables = lake.listings_table(str(tmp_path / "tl")), lake.sales_table(str(tmp_path / "ts"))
    streams = ingest.start_market_ingest(
        topics.read_topic_files(spark, str(tmp_path / "l")),
        topics.read_topic_files(spark, str(tmp_path / "s")),
        *tables, str(tmp_path / "c"), interval=None,
    )
    for stream in streams:
        stream.awaitTermination()
    assert [t.read(spark).count() for t in tables] == [1, 1]


def test_topic_sink(spark, tmp_path):
    from marketlake.operators.flatten import with_topic

    source = str(tmp_path / "in")
    write_events(source, "0", [{"event": "listings/add", "item": 1}, {"event": "sales/add"}, {"event": "x"}])
    routed = with_topic(topics.read_topic_files(spark, source)).select("topic", "value")
    topics.write_topic_files(routed, str(tmp_path / "out"), str(tmp_path / "c")).trigger(
        availableNow=True
    ).start().awaitTermination()
    out = spark.read.text(str(tmp_path / "out"))
    assert sorted((r["topic"], json.loads(r["value"])["event"]) for r in out.collect()) == [
        ("raw.listings_add", "listings/add"), ("raw.sales_add", "sales/add"),
    ]


def test_parse_sales_feeds_the_table(spark, tmp_path):
    raw = spark.createDataFrame(
        [(json.dumps({"item": 1, "world": 2, "sales": [{"timestamp": T0, "quantity": 3}]}),)], "value string"
    )
    table = lake.sales_table(str(tmp_path / "t")).create(spark)
    table.append(parse_sales(raw)[0], 0)
    (row,) = table.read(spark).collect()
    assert (row["world"], row["quantity"], row["ts"]) == (2, 3, T0)


def test_batches_are_appended_as_they_came(spark, tmp_path):
    """A batch is written compressed and without a shuffle; one in the layout before is read too."""
    table = lake.listings_table(str(tmp_path / "listings")).create(spark)
    rows = spark.createDataFrame([listing(f"k{i}", T0 + 86400 * (i % 3), 5, world=i % 4) for i in range(40)], RAW_LISTINGS)
    table.append(rows.coalesce(1), 0)
    written = [p.name for p in (tmp_path / "listings/appends/batch_id=0").iterdir() if p.suffix == ".parquet"]
    assert len(written) == 1 and written[0].endswith(".zstd.parquet")
    newer = spark.createDataFrame([listing(f"k{i}", T0 + 86400 * 9, 7) for i in range(5)], RAW_LISTINGS)
    before = lake._with_arrival(newer)
    before.write.partitionBy(*lake.PARTITION).parquet(str(tmp_path / "listings/log/batch_id=1"))
    table.commit(spark, 1, 5)
    for _ in range(2):
        found = {r["listingID"]: r["pricePerUnit"] for r in table.read(spark).collect()}
        assert found == {f"k{i}": 7 if i < 5 else 5 for i in range(40)}
        assert table.read_raw(spark).count() == 45
        table.compact(spark)
    base = [p.name for p in (tmp_path / "listings/base").rglob("*.parquet")]
    assert base and all(name.endswith(".zstd.parquet") for name in base)


def test_event_files_are_compressed(spark, sf_dir, tmp_path, monkeypatch):
    """In files small enough for many tasks, with all events in them."""
    monkeypatch.setattr(registry, "FILE_EVENTS", 100)
    registry._ingest(registry.Market(spark, sf_dir), str(tmp_path), "sales")
    events = testdata.sale_events(spark, sf_dir)
    files = [p for p in (tmp_path / "in/sales").iterdir() if p.name.startswith("part-")]
    assert len(files) >= events.count() / 100 and all(p.name.endswith(".txt.gz") for p in files)
    back = spark.read.text(f"{tmp_path}/in/sales")
    assert sorted(r[0] for r in back.collect()) == sorted(r[0] for r in events.collect())


def test_listing_events_are_dealt_whole(spark, tmp_path):
    """Each event is in one part, and neighbours are in different ones."""
    day = datetime.datetime(2024, 1, 1)
    lines = [(1, i, 1, 1, 1.0, float(i), 0.0, 0.1, "R", "F", day) for i in (1, 1, 2, 2, 3, 3, 4)]
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 2, "s")], "s_suppkey long, s_nationkey int, s_name string").write.parquet(
        str(tmp_path / "supplier.parquet")
    )
    whole = sorted(r[0] for r in testdata.listing_events(spark, str(tmp_path)).collect())
    parts = [[r[0] for r in testdata.listing_events(spark, str(tmp_path), k, 3).collect()] for k in range(3)]
    assert sorted(sum(parts, [])) == whole and len(whole) == 7
    assert [len(p) for p in parts] == [3, 2, 2]
    assert all(len(set(p)) == len(p) for p in parts)


def test_upsert_stream_has_five_batches_of_compressed_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "work_path", lambda spark, name: str(tmp_path / name))
    registry.stream_upsert(registry.Market(spark, sf_dir))
    files = [p.name for p in (tmp_path / "upsert/in").iterdir() if p.name.startswith("part-")]
    assert len(files) >= registry.BATCHES and all(name.endswith(".txt.gz") for name in files)
    back = spark.read.text(f"{tmp_path}/upsert/in")
    events = testdata.listing_events(spark, sf_dir)
    assert sorted(r[0] for r in back.collect()) == sorted(r[0] for r in events.collect())
    table = lake.listings_table(str(tmp_path / "upsert/listings"))
    batches = {r["batch_id"]: r["rows"] for r in table._commits(spark).collect()}
    assert sorted(batches) == [-1, 0, 1, 2, 3, 4] and all(batches[b] for b in range(5))
    assert table._snapshot(spark)[1] == 3


def test_compaction_writes_new_rows_once(spark, table, monkeypatch):
    """No table of the new rows is written on the way; where all is touched, no keys of the base are read."""
    table.append(listings(spark, listing("a", T0, 1), listing("b", T0, 2), listing("c", T0 + DAY, 3)), 0)
    table.compact(spark)
    written = []
    plain = lake.materialize
    monkeypatch.setattr(lake, "materialize", lambda df, name: written.append((name, df.columns)) or plain(df, name))
    table.append(listings(spark, listing("a", T0 + 1, 4), listing("a", T0 + 2, 5), listing("c", T0 + 2, 9)), 1)
    table.compact(spark)
    assert written and all(columns == lake.PARTITION for _, columns in written)
    # c had a newer version on another day, which no new row touches
    assert state(table, spark) == {"a": (5, "2024-01-01"), "b": (2, "2024-01-01"), "c": (3, "2024-01-02")}

    version, _ = table._snapshot(spark)
    both = listings(spark, listing("d", T0), listing("e", T0 + DAY))
    with monkeypatch.context() as m:
        m.setattr(lake.LakeTable, "_base", lambda *_: pytest.fail("the base is read"))
        assert table._touched(spark, version, both).count() == 2


def test_base_rows_of_other_keys_do_not_move_to_their_key(spark, table, monkeypatch):
    """Neither when reading nor when compacting, however many new rows there are."""
    monkeypatch.setattr(lake, "BROADCAST_ROWS", 0)
    table.append(listings(spark, *[listing(f"k{i}", T0 + i, world=i % 3) for i in range(300)]), 0)
    table.compact(spark)
    compared = []
    plain = latest.latest
    monkeypatch.setattr(latest, "latest", lambda df, *rest: compared.append(df.count()) or plain(df, *rest))
    table.append(listings(spark, *[listing(f"k{i}", T0 + 900, 7, world=i % 3) for i in range(290, 310)]), 1)
    expected = {f"k{i}": (7 if i >= 290 else 1, "2024-01-01") for i in range(310)}
    assert state(table, spark) == expected
    table.compact(spark)
    assert state(table, spark) == expected
    # 20 new rows, the 10 they replace, and few of the other 290
    assert len(compared) == 2 and all(30 <= n <= 40 for n in compared)
