"""Bucketed tables, logs and syncs: only touched buckets, replays, restarts, deletions."""

import glob
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.lexicon import LATIN
from lectern.operators import profiles
from lectern.streaming import profiles as live
from lectern.streaming import tables

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, path):
    return sorted(map(tuple, tables.read(spark, path, SCHEMA).collect()))


def put(spark, path, data, batch, **more):
    return tables.merged(spark.createDataFrame(data, "id long, v string, deleted boolean"), path, SCHEMA, ["id"], batch, buckets=8, **more)


def test_a_replay_rewrites_no_bucket_it_changes_nothing_in(spark, tmp_path):
    path = str(tmp_path / "t")
    files = lambda: {f.name for f in (tmp_path / "t").rglob("*.parquet")}
    put(spark, path, [(i, "a", False) for i in range(40)], 0)
    put(spark, path, [(i, "b", False) for i in range(20)], 1)
    before, kept = files(), rows(spark, path)
    assert put(spark, path, [(i, "x", False) for i in range(20)], 1) == [] and files() == before and rows(spark, path) == kept
    touched = put(spark, path, [*[(i, "x", False) for i in range(20)], (500, "late", False)], 1)  # the rest of a batch that failed half-way
    assert len(touched) == 1 and sorted(rows(spark, path)) == sorted([*kept, (500, "late")])


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    assert rows(spark, path) == [] and put(spark, path, [], 0) == []
    put(spark, path, [(i, "a", None) for i in range(40)], 0)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    touched = put(spark, path, [(3, "b", False), (100, "new", None)], 1)
    after = set(glob.glob(f"{path}/bucket=*/*.parquet"))
    changed = {f.split("bucket=")[1].split("/")[0] for f in set(before) ^ after}
    assert 1 <= len(touched) <= 2 and changed <= {str(t) for t in touched}
    assert rows(spark, path) == [(i, "b" if i == 3 else "a") for i in range(40)] + [(100, "new")]
    plan = tables.stored(spark, path, SCHEMA, touched)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_replays_and_deletions(spark, tmp_path):
    path = str(tmp_path / "t")
    add = lambda name: F.col(f"new.{name}") if name != "v" else F.concat(F.coalesce("old.v", F.lit("")), F.col("new.v"))
    for batch, data in enumerate([[(1, "x", None), (2, "y", None)], [(1, "z", None)], [(2, "", True)]]):
        for _ in range(2):  # each batch is sent twice
            put(spark, path, data, batch, combine=add)
    assert rows(spark, path) == [(1, "xz")]
    put(spark, path, [(1, "late", None)], 1, combine=add)
    assert rows(spark, path) == [(1, "xz")]


def test_log_stream_takes_each_event_once(spark, tmp_path):
    schema = "id long, created_at timestamp"
    make = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").withColumn("created_at", F.timestamp_seconds(F.col("id") * 60 + 86_000))
    for ids in ([1, 2, 3, 3], [3, 4, 20]):
        make(ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        tables.log_stream(stream, str(tmp_path / "log"), str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    tables.appended(make([1, 2, 3]), str(tmp_path / "log"), 0)  # the first batch again
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r.id for r in log.collect()) == [1, 2, 3, 4, 20] and log.select("day").distinct().count() == 2


def test_sync_publishes_changes_only(spark, tmp_path):
    path = str(tmp_path / "published")
    table = lambda data: spark.createDataFrame(data, "id string, vector array<double>, payload string")
    ops = lambda df: sorted((r.id, r.op) for r in df.collect())
    assert ops(tables.published(table([("a", [1.0], None), ("b", [2.0], "{}"), ("c", None, "{}")]), path, 0)) == [("a", "insert"), ("b", "insert"), ("c", "insert")]
    assert ops(tables.published(table([("a", [1.0], None), ("b", [2.0], "{1}"), ("d", [0.0], "")]), path, 1)) == [("b", "update"), ("c", "delete"), ("d", "insert")]
    assert ops(tables.published(table([("a", [1.0], None), ("b", [2.0], "{1}"), ("d", [0.0], "")]), path, 2)) == []
    assert ops(tables.published(table([("a", [1.0], None), ("c", [5.0], "{}")]), path, 3)) == [("b", "delete"), ("c", "insert"), ("d", "delete")]


def test_taste_in_batches_is_taste_at_once(spark, tmp_path):
    n = len(LATIN.feature_keys())
    books = spark.createDataFrame([(str(i), [float((i * 7 + j) % 5) for j in range(n)]) for i in range(6)], "book_id string, scores array<double>")
    actions = ["save", "swipe_right", "swipe_left", "skip", "like"]
    data = [(i, i % 4, str(i * 5 % 7), actions[i * 3 % 5], f"s{i % 3}" if i % 2 else "", i * 3000) for i in range(200)]
    events = spark.createDataFrame(data, "id long, user_id long, book_id string, action string, session_id string, at long").withColumn("created_at", F.timestamp_seconds("at"))
    path = str(tmp_path / "taste")
    for batch, (low, high) in enumerate([(0, 50), (50, 51), (51, 200)]):
        for _ in range(2):
            live.fold_taste(events.where((F.col("id") >= low) & (F.col("id") < high)), batch, path, books, n, buckets=4)
    known = events.join(books.select("book_id"), "book_id", "left_semi")
    key = lambda df: {(r.user_id, r.store, r.key): [round(x, 9) for x in r.scores] for r in df.collect()}
    assert key(live.stored_taste(spark, path)) == key(profiles.feature_stores(known, books, n))
