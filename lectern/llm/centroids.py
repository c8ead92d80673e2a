"""Centroid clustering with bounds: exact k-means rounds that look at few centroids per vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import ship, stage

LARGEST = 1 << 27  # greatest size of a component, so that squared distances of a thousand components fit a long
ROWS = 4096  # vectors taken up at once
SLACK = 1e-9  # relative, beyond what doubles lose
STATE = "id long, vector array<int>, cluster int, second int, upper double, lower double"


def scaled(vector: Column, scale: int = 64, width: int | None = None) -> Column:
    """floor(scale * x) of each component as an integer; null for a vector that is null, has another width, or has a null, non-finite or too large component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    if width is not None:
        sound = sound & (F.size(vector) == width)
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


class Search:
    """One round: the centroids, how far each moved since the bounds were made, and each one's neighbours by distance."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None):
        self.centres, self.k = centres, len(centres)
        apart = np.sqrt(np.stack([_squared(centres, c[None]) for c in centres]).astype(np.float64))
        order = np.argsort(apart, axis=1, kind="stable")
        # A centroid's own place comes first, also before others at the same point.
        self.near = np.stack([np.concatenate([[i], row[row != i]]) for i, row in enumerate(order)])
        self.apart = np.take_along_axis(apart, self.near, 1)
        self.half = self.apart[:, 1] / 2 if self.k > 1 else np.full(self.k, np.inf)
        self.moved = np.zeros(self.k) if before is None else np.sqrt(_squared(centres, before).astype(np.float64))

    def assign(self, x, cluster, second, upper, lower):
        """New (cluster, second, upper, lower). A vector keeps its centroid while the bound on the distance to it stays under that on all others."""
        cluster, second = cluster.copy(), second.copy()
        other = self.moved.max(initial=0)
        upper, lower = upper + self.moved[cluster], lower - other
        safe = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper * (1 + SLACK) >= safe)
        d = _squared(x[open_], self.centres[cluster[open_]])
        upper[open_] = np.sqrt(d.astype(np.float64))
        still = upper[open_] * (1 + SLACK) >= safe[open_]
        open_, d = open_[still], d[still]
        if len(open_) and self.k > 1:
            a, b, da, db = self._scan(x[open_], cluster[open_], second[open_], d)
            cluster[open_], second[open_] = a, b
            upper[open_], lower[open_] = np.sqrt(da.astype(np.float64)), np.sqrt(db.astype(np.float64))
        return cluster, second, upper, lower

    def _scan(self, x, first, second, d_first):
        """Nearest and second-nearest centroids. The scan starts at the closer of the two remembered ones and goes through that one's neighbours by
        distance; no centroid farther from it than its own distance plus that of the second best can come closer, and that ball shrinks as better ones are met."""
        d_second = _squared(x, self.centres[second])
        a, b, da, db = _ordered(first, second, d_first, d_second)
        start, start_second, reach = a.copy(), b.copy(), np.sqrt(da.astype(np.float64))
        live = np.arange(len(x))
        for step in range(1, self.k):
            ball = (reach[live] + np.sqrt(db[live].astype(np.float64))) * (1 + SLACK)
            live = live[self.apart[start[live], step] <= ball]
            if not len(live):
                break
            j = self.near[start[live], step]
            new = j != start_second[live]
            rows, j = live[new], j[new]
            d = _squared(x[rows], self.centres[j])
            beats_b = (d < db[rows]) | ((d == db[rows]) & (j < b[rows]))
            rows, j, d = rows[beats_b], j[beats_b], d[beats_b]
            a[rows], b[rows], da[rows], db[rows] = _ordered(a[rows], j, da[rows], d)
        return a, b, da, db


def _ordered(a, b, da, db):
    """Pairs with the closer one first, ties to the smaller number."""
    swap = (db < da) | ((db == da) & (b < a))
    return np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def _vectors(column) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _assigned(rows: DataFrame, centres: np.ndarray, before: np.ndarray | None) -> DataFrame:
    search = Search(centres, before)

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                state = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "second", "upper", "lower")]
                cluster, second, upper, lower = search.assign(_vectors(batch.column("vector")), *state)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cluster.astype(np.int32)), pa.array(second.astype(np.int32)),
                                                  pa.array(upper), pa.array(lower)], names=["id", "vector", "cluster", "second", "upper", "lower"])

    return rows.mapInArrow(run, STATE)


def _moved(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Each centroid's new place, floor(sum / count) per component; a centroid without vectors stays. A task sends one row per centroid at most."""
    k, width = centres.shape

    def run(batches):
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            x = _vectors(batch.column("vector"))
            for c in np.unique(cluster):
                mine = cluster == c
                sums[c] += x[mine].sum(0)
                counts[c] += mine.sum()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "vector").mapInArrow(run, "cluster int, n long, sums array<long>")
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    new = centres.copy()
    for r in flat.collect():  # centroids times components, both parameters
        new[r["cluster"], r["i"]] = r["x"] // r["n"]
    return new


def clustered(vectors: DataFrame, *, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vector_col: str = "vector"):
    """(rows, centroids): per vector its id, cluster and squared distance, and the list of the final centroids, each a list of integers.

    `vector_col` holds integers, all vectors of one width (`scaled` makes them so; null vectors take no part). The first centroids are the k vectors with
    the smallest SHA-256 of "seed:id", in that order. In each round every vector goes to its nearest centroid, ties to the smaller
    number, and every centroid with vectors goes to the floored mean of them; at the end vectors are assigned once more.
    A vector carries its nearest and second-nearest centroid with an upper bound for the one and a lower bound for all others. The bounds
    are doubles with slack and only tell which centroids need not be looked at; those that remain are compared in integers, so results are exact.
    A null id is kept but never becomes a first centroid; each of the rows that repeat an id counts; rows that repeat a first centroid's id may
    give several equal centroids, of which the first gets the vectors. Fewer than k vectors with an id give as many centroids. No vectors give no rows; no
    centroids (only null ids) give null clusters. Other columns are not read. Every round is a written table, so a lost executor costs its tasks only.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<int>").alias("vector"))
    state = stage(rows.select("id", "vector", F.lit(0).alias("cluster"), F.lit(0).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower")), "vectors")
    named = state.where("id IS NOT NULL").select("vector", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"))
    first = [r["vector"] for r in named.orderBy("h", "vector").limit(k).collect()]  # k rows
    if not first:
        return rows.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    centres, before = np.array(first, np.int64), None
    if len(first) > 1:
        state = state.withColumn("second", F.lit(1))
    for _ in range(rounds):
        state = stage(_assigned(state, centres, before), "assigned")
        before, centres = centres, _moved(state, centres)
    final = centres

    def measured(batches):
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            distance = _squared(_vectors(batch.column("vector")), final[cluster])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(distance)], names=["id", "cluster", "distance"])

    found = _assigned(state, centres, before if rounds else None).mapInArrow(measured, "id long, cluster int, distance long")
    return stage(found, "clusters"), [[int(x) for x in c] for c in final]


def digest(rows: DataFrame, centroids: list[list[int]], *, id_name: str = "vec_id") -> DataFrame:
    """Per vector its cluster and distance, the inertia of the cluster and of all, and the SHA-256 of the centroid's components."""
    found = rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # one row per centroid at most
    total = sum(r["inertia"] or 0 for r in found)
    table = [(r["cluster"], r["inertia"], total, ",".join(map(str, centroids[r["cluster"]])) if r["cluster"] is not None else None) for r in found]
    named = rows.sparkSession.createDataFrame(table, "number int, cluster_inertia long, inertia long, components string")
    joined = rows.join(F.broadcast(named), F.col("cluster").eqNullSafe(F.col("number")))
    return joined.select(F.col("id").alias(id_name), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))


def clustered_sql(table: str, *, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, width: int = 64) -> str:
    steps = [f"""v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM {table}
               WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS MATERIALIZED (SELECT row, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
first AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT c, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM first WHERE c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT row, c, sum((flat.x - c{r}.x) * (flat.x - c{r}.x)) AS d FROM flat JOIN c{r} USING (i) GROUP BY row, c),
a{r} AS MATERIALIZED (SELECT row, arg_min(c, (d, c)) AS c, CAST(min(d) AS BIGINT) AS d FROM d{r} GROUP BY row)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM flat JOIN a{r} USING (row) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((total - ((total % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN m{r} USING (c, i))""")
    last = f"""named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c),
inertia AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY c)"""
    return f"""
WITH {", ".join([*steps, last])}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM inertia) AS BIGINT) AS inertia, h AS centroid_sha256
FROM v JOIN a{rounds} USING (row) JOIN inertia USING (c) JOIN named USING (c)"""
