"""Tables that live jobs keep up to date: keyed ones in hash buckets, logs by day and batch, and what was last published.

All are plain Parquet folders. A batch rewrites the buckets it touches and no others; a batch that is replayed after a failure leaves what it left the first time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import stage

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replace just the partitions that `rows` has rows for; each is written by as many tasks as it has shuffled blocks worth splitting."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def stored(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a keyed table, deleted ones included, of all or the given buckets: the scan is pruned to their folders. Empty before the first batch."""
    full = T.StructType([*schema.fields, T.StructField("deleted", T.BooleanType()), T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(path)
    return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a keyed table as they stand."""
    return stored(spark, path, schema).where("NOT deleted").select(*schema.names)


def merged(changes: DataFrame, path: str, schema: T.StructType, key: list[str], batch: int, combine: Callable[[str], Column] | None = None, buckets: int = BUCKETS) -> list[int]:
    """Fold `changes`, one row per key, into the keyed table at `path`; returns the buckets rewritten.

    A row takes the place of the one with its key, field by field as `combine(name)` says: an expression over `old` and `new`, structs
    that are null where there is none. A change may have a boolean column `deleted`. Only touched buckets are read and written. Each row carries the number
    of the batch that wrote it, and a row of this batch or a later one is left alone, so that a fold is applied once however often its batch is replayed.
    Where all changes of a bucket were applied before, it is not rewritten.
    """
    spark = changes.sparkSession
    gone = F.col("deleted") if "deleted" in changes.columns else F.lit(False)
    new = stage(changes.select(*key, F.struct(*[F.col(n) for n in schema.names], F.coalesce(gone, F.lit(False)).alias("deleted")).alias("new"), bucket_of(key[0], buckets).alias("bucket")), "changes")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most `buckets`
    last = stored(spark, path, schema, touched).agg(F.max("batch")).first()[0] if touched else None
    if last is not None and last >= batch:
        seen = stored(spark, path, schema, touched).where(F.col("batch") >= batch).select(*key, "bucket")
        touched = sorted(r["bucket"] for r in new.join(seen, [*key, "bucket"], "left_anti").select("bucket").distinct().collect())
        new = new.where(F.col("bucket").isin(*touched)) if touched else new
    if not touched:
        return []
    old = stored(spark, path, schema, touched).select(*key, "bucket", F.struct(*schema.names, "deleted", "batch").alias("old"))
    both = old.join(new, [*key, "bucket"], "full_outer")
    took = F.col("new").isNotNull() & (F.coalesce("old.batch", F.lit(-1)) < batch)
    value = combine or (lambda name: F.col(f"new.{name}"))
    fields = [F.when(took, F.col(n) if n in key else value(n)).otherwise(F.col(f"old.{n}")).cast(f.dataType).alias(n) for n, f in zip(schema.names, schema.fields, strict=True)]
    rows = both.select(*fields, F.when(took, F.col("new.deleted")).otherwise(F.col("old.deleted")).alias("deleted"),
                       F.when(took, F.lit(batch)).otherwise(F.col("old.batch")).cast("long").alias("batch"), "bucket")
    _written(rows, path, "bucket")  # the old files of a bucket go when all new ones are written
    return touched


def appended(rows: DataFrame, path: str, batch: int, time: str = "created_at") -> None:
    """Add a batch to a log kept by day and batch. Written again, a batch replaces itself."""
    _written(rows.withColumn("day", F.to_date(time)).withColumn("batch", F.lit(batch)), path, "day", "batch")


def once(events: DataFrame, late: str = "1 hour", key: str = "id", time: str = "created_at") -> DataFrame:
    """Each event of a stream once, although its sender repeats it within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def log_stream(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, late: str = "1 hour"):
    """Append a stream of interactions to a log, each event once."""
    rows = once(events, late)
    return rows.writeStream.foreachBatch(lambda batch, n: appended(batch, path, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


# ---- what was published --------------------------------------------------------
PUBLISHED = T.StructType([T.StructField("id", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("payload", T.StringType())])


def with_digest(rows: DataFrame) -> DataFrame:
    """Vectors to publish (id, vector, payload as JSON) with a digest of what is published of each."""
    text = F.concat_ws("\x1f", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",", "null"), F.coalesce("payload", F.lit("")))
    return rows.select(F.col("id").cast("string").alias("id"), F.sha2(text, 256).alias("digest"), F.col("vector").cast("array<double>").alias("vector"), "payload")


def changed(current: DataFrame, published: DataFrame) -> DataFrame:
    """(PUBLISHED.., op): what has to be inserted, updated or deleted to bring `published` to `current`; rows alike are left out.

    Only ids and digests of the published side are read.
    """
    old = published.select("id", F.col("digest").alias("was"))
    both = with_digest(current).join(old, "id", "full_outer")
    op = F.when(F.col("was").isNull(), "insert").when(F.col("digest").isNull(), "delete").when(F.col("was") != F.col("digest"), "update")
    return both.withColumn("op", op).where("op IS NOT NULL").select(*PUBLISHED.names, "op")


def published(current: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> DataFrame:
    """One round of a periodic sync: publish what changed since the last round; returns the changes. `current` are all vectors that should be there."""
    spark = current.sparkSession
    changes = stage(changed(current, read(spark, path, PUBLISHED)), "vector-changes")
    merged(changes.withColumn("deleted", F.col("op") == "delete"), path, PUBLISHED, ["id"], batch, buckets=buckets)
    return changes
