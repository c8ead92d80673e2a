"""Live interactions: per-user taste state, session state, saved lists, and event-time activity windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import product, profiles
from lectern.session import stage
from lectern.streaming import tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: A user's decayed feature stores, by name and, for sessions, their key.
TASTE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("store", T.StringType()), T.StructField("key", T.StringType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def fold_taste(events: DataFrame, batch: int, path: str, books: DataFrame, size: int, buckets: int = tables.BUCKETS) -> list[int]:
    """Bring the taste table at `path` up to date with a batch of events: one update per user and store. Returns the buckets rewritten."""
    steps = profiles.composed(events, books, size)
    schema = T.StructType([*TASTE.fields, T.StructField("decay", T.DoubleType())])

    def combine(name: str):
        if name != "scores":
            return F.col(f"new.{name}")
        return F.when(F.col("old").isNull(), F.col("new.scores")).otherwise(F.zip_with("old.scores", "new.scores", lambda o, n: o * F.col("new.decay") + n))

    return tables.merged(steps.withColumnRenamed("shift", "scores"), path, schema, ["user_id", "store", "key"], batch, combine, buckets)


def stored_taste(spark: SparkSession, path: str) -> DataFrame:
    """The taste table as (user_id, store, key, scores)."""
    return tables.read(spark, path, T.StructType([*TASTE.fields, T.StructField("decay", T.DoubleType())])).select(*TASTE.names)


#: The last action of each session, and the books a user saved.
SESSIONS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("session_id", T.StringType()), T.StructField("last_action", T.StringType()), T.StructField("last_book_id", T.StringType()),
                         T.StructField("updated_at", T.TimestampType()), T.StructField("id", T.LongType())])
SAVED = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("book_id", T.StringType()), T.StructField("first_at", T.TimestampType()), T.StructField("last_at", T.TimestampType())])
SESSION_HOURS = 2.0


def fold_sessions(events: DataFrame, batch: int, path: str, buckets: int = tables.BUCKETS) -> list[int]:
    """Bring the session table up to date: an event replaces what is stored only if it is later by time, then by id."""
    rows = events.where("session_id <> ''").select("user_id", "session_id", "action", "book_id", "created_at", "id")
    last = product.latest(rows, ["user_id", "session_id"], "created_at", "id").select(
        "user_id", "session_id", F.col("action").alias("last_action"), F.col("book_id").alias("last_book_id"), F.col("created_at").alias("updated_at"), "id")
    at = lambda side: F.struct(f"{side}.updated_at", f"{side}.id")
    keep = F.col("old").isNotNull() & ~F.coalesce("old.deleted", F.lit(False)) & (at("old") > at("new"))
    return tables.merged(last, path, SESSIONS, ["user_id", "session_id"], batch, lambda n: F.when(keep, F.col(f"old.{n}")).otherwise(F.col(f"new.{n}")), buckets)


def live_sessions(spark: SparkSession, path: str, now: Column, hours: float = SESSION_HOURS) -> DataFrame:
    """Sessions with an event within the last `hours`; older ones have expired."""
    seconds = F.unix_micros(now) - F.unix_micros("updated_at")
    return tables.read(spark, path, SESSIONS).where(seconds <= int(hours * 3_600_000_000)).drop("id")


def expire_sessions(spark: SparkSession, path: str, now: Column, batch: int, hours: float = SESSION_HOURS, buckets: int = tables.BUCKETS) -> list[int]:
    """Delete expired sessions from the table; only buckets that hold one are rewritten."""
    rows = tables.read(spark, path, SESSIONS)
    late = rows.where(F.unix_micros(now) - F.unix_micros("updated_at") > int(hours * 3_600_000_000)).withColumn("deleted", F.lit(True))
    return tables.merged(late, path, SESSIONS, ["user_id", "session_id"], batch, buckets=buckets)


def fold_saved(events: DataFrame, batch: int, path: str, buckets: int = tables.BUCKETS) -> list[int]:
    """Bring the table of saved books up to date with the likes and saves of a batch. Other actions, dislikes too, leave it as it is."""
    rows = events.where(F.col("action").isin("like", "save")).groupBy("user_id", "book_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    pick = {"first_at": F.least("old.first_at", "new.first_at"), "last_at": F.greatest("old.last_at", "new.last_at")}
    return tables.merged(rows, path, SAVED, ["user_id", "book_id"], batch, lambda n: pick[n], buckets)


def saved_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lists, items) of the saved books as they stand, as `product.saved_lists` gives them for a whole log."""
    rows = tables.read(spark, path, SAVED)
    both = rows.select("user_id", "book_id", F.lit("save").alias("action"), F.explode(F.array("first_at", "last_at")).alias("created_at"))
    return product.saved_lists(both)


def session_states(events: DataFrame) -> DataFrame:
    """Batch form: the latest action and book of every session."""
    rows = events.where("session_id <> ''").select("user_id", "session_id", "action", "book_id", "created_at", "id")
    last = product.latest(rows, ["user_id", "session_id"], "created_at", "id")
    return last.select("user_id", "session_id", F.col("action").alias("last_action"), F.col("book_id").alias("last_book_id"), F.col("created_at").alias("updated_at"))


def activity_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions of each user by inactivity gap, with a watermark for late rows. Works on tables and streams."""
    e = events.withWatermark("created_at", late) if events.isStreaming else events
    w = F.session_window("created_at", gap)
    out = e.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("action").isin("like", "save")).alias("n_saved"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "n_saved")


def refresh_feeds(batch: DataFrame, requests: DataFrame, build) -> DataFrame:
    """Recompute feeds only for users that appear in a micro-batch."""
    return build(requests.join(batch.select("user_id").distinct(), "user_id", "left_semi"))


def follow(events: DataFrame, root: str, checkpoint: str, books: DataFrame, size: int, refresh=None, trigger: dict | None = None):
    """One stream that keeps taste, sessions and saved books below `root` and then calls `refresh(batch)`, if given, for the feeds of its users.

    Each table skips what it has applied already, so a batch that failed half-way is finished by its replay.
    """
    def each(batch: DataFrame, n: int) -> None:
        rows = stage(batch, "events")
        fold_taste(rows, n, f"{root}/taste", books, size)
        fold_sessions(rows, n, f"{root}/sessions")
        fold_saved(rows, n, f"{root}/saved")
        if refresh is not None:
            refresh(rows)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()
