"""Sharding by sampled splitters: shards of nearly equal bytes from one range partitioning of the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import stage

MAX_RANGES = 1 << 17


def sharded(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 250_000,
            samples_per_range: int = 8, rounds: int = 3) -> DataFrame:
    """Deal documents to `shards` shards whose sizes differ by less than about one document.

    Keys are (hash of the text, id), so equal texts lie side by side, yet a large group of them can be cut.
    A size-weighted sample of keys gives splitters at its quantiles; every key goes to the range between two
    splitters; ranges that hold over twice the mean get splitters from a sample of their own. Exact sizes of the
    ranges and running sums within each give every row its place in the whole order, and the place its shard:
    the splitters decide how the work is spread, never the result.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law = "bytes", shard, slot (gapless from 0 in a shard)
    and grown_shard (null: this law has none). A null text counts as empty; a null id sorts first; repeated rows are rows of
    their own; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    ), "shard-keys").withColumn("key", F.struct("h", "doc_id"))
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MAX_RANGES, max(16 * shards, rows // rows_per_range))

    splitters = _splitters(keys.withColumn("range", F.lit(0)), ranges, total, samples_per_range)
    dealt = _dealt(keys, splitters, ranges)
    for _ in range(rounds):
        sizes = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        over = sizes.where((F.col("bytes") > 2 * total / ranges) & (F.col("low") != F.col("high"))).select("range")
        if over.isEmpty():
            break
        inner = _splitters(dealt.join(F.broadcast(over), "range"), ranges, total, 4 * samples_per_range)  # `ranges` ids at most
        splitters = stage(splitters.union(inner).distinct(), "splitters")
        dealt = _dealt(keys, splitters, ranges)

    # A splitter is the first key of its range, so there are no more ranges than splitters: a few `MAX_RANGES` rows at most.
    sizes = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(
        "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
    )
    order = W.partitionBy("range").orderBy("h", "doc_id")
    placed = (
        dealt.join(F.broadcast(base), "range")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("place", F.col("rows_before") + F.row_number().over(order) - 1)
        .withColumn("shard", F.expr(f"CAST(least({shards - 1}, (2 * end - size) * {shards} DIV {max(1, 2 * total)}) AS INT)"))
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    placed = stage(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _splitters(keys: DataFrame, ranges: int, total: int, per_range: int) -> DataFrame:
    """First keys of ranges of about `total / ranges` bytes each, from a sample drawn by size: about `ranges * per_range` keys."""
    step = max(1, total // (ranges * per_range))  # a row of this size is always drawn, a smaller one in proportion
    drawn = keys.where(F.pmod(F.xxhash64("doc_id", "h", F.lit("sample")), F.lit(step)) < F.col("size"))
    weight = F.greatest(F.col("size"), F.lit(step))
    seen = F.sum(weight).over(W.partitionBy("range").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    quantile = F.floor((seen - weight) / F.lit(step * per_range))
    return drawn.select("range", "key", quantile.alias("q")).groupBy("range", "q").agg(F.min("key").alias("key")).select("key")


def _dealt(keys: DataFrame, splitters: DataFrame, ranges: int) -> DataFrame:
    """Each key with the number of splitters up to it, found by bisection in the sorted splitters (one row, bounded)."""
    table = splitters.agg(F.array_sort(F.collect_set("key")).alias("splitters")).select(F.lit(1).alias("one"), "splitters")
    steps = (4 * ranges).bit_length() + 2

    def halve(at, _):
        middle = ((at["low"] + at["high"]) / 2).cast("int")
        right = F.get(F.col("splitters"), middle) <= F.col("key")
        return F.struct(
            F.when((at["low"] < at["high"]) & right, middle + 1).otherwise(at["low"]).alias("low"),
            F.when((at["low"] < at["high"]) & ~right, middle).otherwise(at["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.size("splitters").alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["low"]
    return keys.withColumn("one", F.lit(1)).join(F.broadcast(table), "one").withColumn("range", found).drop("one", "splitters")
