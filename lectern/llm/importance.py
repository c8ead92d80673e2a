"""Importance resampling towards a target distribution: weights from arrays of bucket gains, ranks by parallel sorting with regular samples."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.arrow import slices
from lectern.session import ship, stage

BUCKETS = 10_000
MAX_RANGES = 1024  # runs and ranges of the sort; at most its square of samples reach the driver
MEMO = 200_000
#: ASCII letters in lower case; every other ASCII character but digits ends a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
ORDER = ("score", "id", "n_features", "row")
HALF = 1 << 33  # rows of a run are numbered below this


class _Memo(dict):
    """Bucket of a feature, remembered for a bounded number of them."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def _hashed(text: str | None, runs: int, memo: _Memo) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to `runs` consecutive words, repeats included."""
    words = text.encode().translate(FOLD).split() if text else []
    found = [memo[w] for w in words]
    for n in range(2, runs + 1):
        found += [memo[b" ".join(words[i:i + n])] for i in range(len(words) - n + 1)]
    return len(words), np.array(found, np.uint32)


def hashed(docs: DataFrame, *, runs: int = 1, buckets: int = BUCKETS, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, buckets: the feature buckets of each whole text as packed integers."""
    ship(docs.sparkSession)
    width = np.uint16 if buckets <= 1 << 16 else np.uint32
    ids = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")

    def run(batches):
        memo = _Memo(buckets)
        for batch in slices(batches):
            rows = [_hashed(t, runs, memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([len(f) for _, f in rows], pa.int64()),
                                              pa.array([f.astype(width).tobytes() for _, f in rows], pa.binary())], names=["id", "n_words", "n_features", "buckets"])

    return docs.select(ids.alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_words long, n_features long, buckets binary")


def _flat(column, buckets: int) -> np.ndarray:
    """All bucket numbers of a batch in a row, straight from the column's bytes."""
    width = np.uint16 if buckets <= 1 << 16 else np.uint32
    return np.frombuffer(b"".join(column.to_pylist()), width)


def counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts. A task sends one row per bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "buckets"):
            total += np.bincount(_flat(batch.column("buckets"), buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of a bucket's smoothed share in the target to that in the source, floored."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + size) / (float(s + 1) * float(t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int) -> int:
    """Thousandfold Gumbel noise of an id, floored: the same in every run."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """id, n_words, n_features, weight, score."""
    buckets = len(gain)

    def run(batches):
        for batch in slices(batches, "buckets"):
            n = batch.column("n_features").to_numpy()
            sums = np.zeros(len(n), np.int64)
            some = np.flatnonzero(n)
            if len(some):
                starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                sums[some] = np.add.reduceat(gain[_flat(batch.column("buckets"), buckets)], starts)
            weight = sums // np.maximum(n, 1)
            score = [None if i is None else int(w) + noise(seed, i) for i, w in zip(batch.column("id").to_pylist(), weight, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight), pa.array(score, pa.int64())],
                                             names=["id", "n_words", "n_features", "weight", "score"])

    return features.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def _range_of(columns: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """For each row the number of splitters that don't come after it, by bisection over several columns at once."""
    low, high = np.zeros(len(columns[0]), np.int64), np.full(len(columns[0]), len(splitters[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) // 2, 0)
        before, same = np.zeros(len(low), bool), np.ones(len(low), bool)
        for c, s in zip(columns, splitters, strict=True):
            before |= same & (s[mid] < c)
            same &= s[mid] == c
        goes = before | same
        low, high = np.where(open_ & goes, mid + 1, low), np.where(open_ & ~goes, mid, high)
    return low


def ranked(rows: DataFrame, wanted: int, *, ranges: int = MAX_RANGES) -> DataFrame:
    """`rows` (id, n_features, weight, score) with the exact rank, from 1, of the first `wanted` by score (high first, ties to the smaller id); null for the others.

    Parallel sorting by regular sampling. Every task sorts its rows and writes them as a run. From each of p runs p regular samples are
    taken; every pth of all samples in order is a splitter, so no range between splitters holds more than about twice its share, hot
    scores and repeated ids included, since a row's place in its run is the last part of its key. Rows of a range are exchanged and sorted in
    one task; the sizes of the ranges before it give its first rank. Ranges past the wanted ranks are not exchanged.
    """
    rows = rows.select(*[F.col(c).cast("long").alias(c) for c in ("id", "n_features", "weight", "score")])
    p = max(1, min(ranges, rows.rdd.getNumPartitions()))
    keys = [F.desc("score"), "id", F.desc("n_features")]
    sorted_ = rows.coalesce(p).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id())
    runs = stage(sorted_, "runs")
    sizes = runs.groupBy(F.floor(F.col("row") / HALF).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in sizes.collect()], "run long, n long"))  # one row per run
    regular = runs.withColumn("run", F.floor(F.col("row") / HALF)).join(sizes, "run").where(F.expr(f"row % {HALF} % CAST(ceil(n / {p}) AS LONG) = 0"))
    samples = regular.select(*[(-F.col(c) if c in ("score", "n_features") else F.col(c)).alias(c) for c in ORDER]).orderBy(*ORDER).toArrow()  # p * p rows at most
    chosen = samples.take(np.arange(p // 2 + p, samples.num_rows, p)) if samples.num_rows > p else samples.slice(0, 0)
    splitters = [chosen.column(c).to_numpy().astype(np.int64) for c in ORDER]

    def dealt(batches):
        for batch in batches:
            keyed = [batch.column(c).to_numpy().astype(np.int64) * (-1 if c in ("score", "n_features") else 1) for c in ORDER]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_range_of(keyed, splitters))], names=[*batch.schema.names, "range"])

    parts = runs.select("id", "n_features", "weight", "score", "row").mapInArrow(dealt, "id long, n_features long, weight long, score long, row long, range long")
    before, offsets = 0, []
    for r in sorted(parts.groupBy("range").count().collect()):  # one row per range
        offsets.append((r["range"], before))
        before += r["count"]
    first = rows.sparkSession.createDataFrame(offsets, "range long, first long")
    near = F.broadcast(first.where(F.col("first") < wanted))
    far = F.broadcast(first.where(F.col("first") >= wanted))
    place = F.col("first") + F.row_number().over(W.partitionBy("range").orderBy(*keys, "row"))
    columns = ["id", "n_features", "weight", "score"]
    drawn = parts.join(near, "range").select(*columns, place.alias("rank")).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    return drawn.union(parts.join(far, "range").select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = 10, seed: int = 2024, runs: int = 1, buckets: int = BUCKETS, least_words: int = 20,
              ranges: int = MAX_RANGES, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: every document's fit to the target texts and its place among the drawn ones.

    Features are the runs of 1 to `runs` words, hashed to buckets. A document's weight is the floored mean gain of its features' buckets, its score
    adds Gumbel noise of its id, and the highest `percent` of the documents with `least_words` words are drawn: a sample without replacement in
    proportion to the weights. Texts are read whole, once; their buckets are written as packed integers.
    A null text has no features and weight 0. A null id has no noise, so its score and rank are null and it doesn't count among those to draw from. Rows that repeat an
    id share its noise and are drawn each on its own; equal rows may change places. Empty tables give no rows; an empty target makes all gains follow the smoothing. Other columns are not read.
    """
    features = stage(hashed(docs, runs=runs, buckets=buckets, id_col=id_col, text_col=text_col), "features")
    wanted = counts(hashed(target, runs=runs, buckets=buckets, id_col=None, text_col=target_text), buckets)
    table = stage(scored(features, gains(counts(features, buckets), wanted), seed), "scores")
    able = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    n = table.where(able).count()
    columns = ["id", "n_features", "weight", "score"]
    rest = table.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    if n:
        rest = rest.union(ranked(table.where(able).select(*columns), percent * n // 100, ranges=ranges))
    return rest.withColumnRenamed("id", "doc_id")


def drawn(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The whole rows of the documents that `resampled` draws. Of rows that repeat an id all stay if one is drawn."""
    ranks = resampled(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ranks, docs[id_col].cast("long") == F.col("__drawn"), "left_semi")
