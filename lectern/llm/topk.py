"""Exact top-k by inner product, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import ship, stage

LEVELS = (4, 16)  # segments per vector
CHUNK = 1024


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null for a vector that is null or has a null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean, scaled by the root of its length, and the deviation's length. The dot product of two such rows is at least that of the
    vectors, so |q|^2 + |v|^2 minus twice it is a lower bound of their squared distance."""
    parts = np.array_split(x.astype(np.float64), segments, axis=1)
    means = [p.sum(1) / np.sqrt(max(1, p.shape[1])) for p in parts]
    spread = [np.sqrt(np.maximum(0, (p * p).sum(1) - m * m)) for p, m in zip(parts, means, strict=True)]
    return np.stack([*means, *spread], axis=1)


class Best:
    """The k best candidates so far of each query, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.q, self.ids, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(queries, -np.inf)  # score that a candidate must reach

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        order = np.lexsort([ids, -score, q])
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.ids, self.score = q[keep], ids[keep], score[keep]
        last = place[keep] == self.k - 1
        self.least[self.q[last]] = self.score[last]


def _search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Best:
    best = Best(len(queries), k)
    levels = [(_statistics(queries, s), _statistics(vectors, s)) for s in LEVELS]
    order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(1), kind="stable")  # long vectors raise the bar early
    for low in range(0, len(order), CHUNK):
        some = order[low:low + CHUNK]
        slack = 1e-9 * np.abs(np.where(np.isfinite(best.least), best.least, 0)) + 1e-6 * (1 + np.abs(levels[0][0]).max(initial=0))
        bar = best.least - slack
        coarse_q, coarse_v = levels[0]
        q, v = np.nonzero(coarse_q @ coarse_v[some].T >= bar[:, None])
        v = some[v]
        for fine_q, fine_v in levels[1:]:
            keep = np.concatenate([np.einsum("ij,ij->i", fine_q[q[i:i + 65536]], fine_v[v[i:i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)]) >= bar[q]
            q, v = q[keep], v[keep]
        other = query_ids[q] != ids[v]
        q, v = q[other], v[other]
        score = np.concatenate([np.einsum("ij,ij->i", queries[q[i:i + 65536]], vectors[v[i:i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
        best.add(q, ids[v], score)
    return best


def nearest(vectors: DataFrame, wanted: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector", rows_per_group: int = 8192,
            queries_per_group: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest inner product for every row where `wanted` holds, exact, ties to the smaller id.

    Vectors hold integers whose scores fit a long. Groups of candidates meet groups of queries, both of bounded size. There, bounds
    from means and deviations of few segments leave out most pairs, those of more segments most of the rest, and the
    others get their exact score; the kth score so far is the bar. A group passes on k rows per query.
    Rows with a null id or vector take no part. An id stands for one row: of rows that repeat it the least vector counts. A row is never
    its own candidate. Shorter vectors count as filled up with zeros. An empty table, or one without queries, gives no rows; other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("vector"), wanted.alias("wanted"))
    rows = stage(rows.groupBy("id").agg(F.min("vector").alias("vector"), F.bool_or("wanted").alias("wanted")), "vectors")
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if("wanted"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    groups, query_groups = max(1, -(-n // rows_per_group)), max(1, -(-n_queries // queries_per_group))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        if not len(ids) or not len(query_ids):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        best = _search(query_ids, _matrix(right.column("vector"), width), ids, _matrix(left.column("vector"), width), k)
        return pa.table({"query_id": query_ids[best.q], "vec_id": best.ids, "score": best.score})

    def dealt(df, own, n_own, other, n_other):
        """Each row in its own group, beside each group of the other side."""
        part = F.pmod(F.xxhash64("id"), F.lit(n_own)).alias(own)
        return df.select("id", "vector", part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))).alias(other))

    left = dealt(rows, "g", groups, "qg", query_groups).groupBy("g", "qg")
    right = dealt(rows.where("wanted"), "qg", query_groups, "g", groups).select("id", "vector", "g", "qg").groupBy("g", "qg")
    found = left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_sql(table: str, every: int, k: int = 5, scale: int = 256) -> str:
    return f"""
WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM {table}
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sound),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM flat q JOIN flat c USING (i)
           WHERE q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {k}"""
