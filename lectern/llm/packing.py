"""Best-fit packing of documents into bins of fixed capacity, under conflicts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, words
from lectern.session import ship, stage

BIN_BITS = 32


class Bins:
    """Open bins by what they have left. A bin carries a bitmap of the sources and one of the duplicate clusters in it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at = [[] for _ in range(capacity + 1)]  # bins by residual, in the order they got there
        self.open = 0  # bit r is set if some bin has r left
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The tightest bin that holds `size` and neither the source nor the cluster yet, or a new one; and the place in it."""
        left = size
        while rest := self.open >> left:
            left += (rest & -rest).bit_length() - 1  # the next residual that a bin has
            for i, b in enumerate(self.at[left]):
                if not (self.sources[b] >> source & 1 or self.clusters[b] >> cluster & 1):
                    self._move(i, left, size, source, cluster)
                    return b, self.capacity - left
            left += 1
        self.sources.append(0)
        self.clusters.append(0)
        self.at[self.capacity].append(len(self.sources) - 1)
        self.open |= 1 << self.capacity
        self._move(len(self.at[self.capacity]) - 1, self.capacity, size, source, cluster)
        return len(self.sources) - 1, 0

    def _move(self, i: int, left: int, size: int, source: int, cluster: int) -> None:
        b = self.at[left].pop(i)
        if not self.at[left]:
            self.open ^= 1 << left
        self.sources[b] |= 1 << source
        self.clusters[b] |= 1 << cluster
        if left > size:
            self.at[left - size].append(b)
            self.open |= 1 << left - size


def pieces(docs: DataFrame, capacity: int, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, cluster, piece, start, n_words: whole texts cut into runs of at most `capacity` words.

    Texts with the same words in the same order (ASCII case aside) are one duplicate cluster. A text without words makes no piece.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    measured = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.size(words(text)).alias("n"),
        F.md5(F.trim(F.regexp_replace(F.lower(text), SPACE + "+", " "))).alias("cluster"),
    )
    starts = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(capacity)))
    cut = measured.where("n > 0").select("*", starts.alias("start"))
    return cut.select(
        "doc_id", "source", "cluster", (F.col("start") / capacity).cast("int").alias("piece"), F.col("start").cast("long").alias("start"),
        F.least(F.lit(capacity), F.col("n") - F.col("start")).cast("int").alias("n_words"),
    )


def packed_bins(docs: DataFrame, *, capacity: int = 2048, rows_per_group: int = 4096, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """A bin and a place in it for every piece: doc_id, piece, start, n_words, bin_id, place (first word's position in the bin).

    No bin holds more than `capacity` words, two pieces of one source or two of one duplicate cluster. Pieces are dealt by
    a hash to groups of about `rows_per_group`, so every group has the whole mix and a hot source or cluster is split evenly;
    within a group the largest goes first to the tightest compatible bin. Full pieces take a bin alone and need no search.
    A null source is one source with the empty one; null texts and texts without words have no piece and so no row;
    rows that repeat an id are packed one by one; null ids are packed too; an empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    cut = stage(pieces(docs, capacity, id_col=id_col, source_col=source_col, text_col=text_col), "pieces")
    groups = max(1, -(-cut.count() // rows_per_group))

    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "doc_id")] + [-table.column("n_words").to_numpy()])
        table = table.take(pa.array(order))
        columns = {c: table.column(c).to_pylist() for c in ("source", "cluster", "n_words", "group")}
        bins, sources, clusters = Bins(capacity), {}, {}
        found = [bins.place(n, sources.setdefault(s, len(sources)), clusters.setdefault(c, len(clusters)))
                 for s, c, n in zip(columns["source"], columns["cluster"], columns["n_words"], strict=True)]
        bin_ids = [(columns["group"][0] << BIN_BITS) + b for b, _ in found]
        kept = table.select(["doc_id", "piece", "start", "n_words"])
        return kept.append_column("bin_id", pa.array(bin_ids, pa.int64())).append_column("place", pa.array([p for _, p in found], pa.int32()))

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, "doc_id long, piece int, start long, n_words int, bin_id long, place int")
