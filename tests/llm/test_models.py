"""Centroids, importance resampling and language-model scores against brute force, with nulls, ties, repeated rows, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import centroids, importance, lm
from tests.llm.test_operators import DOCS, SCHEMA, texts


def lloyd(rows, k, rounds, seed):
    """(id, vector) rows to (id, cluster, distance) by looking at every centroid, and the final centroids."""
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centres = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in rows], centres


@pytest.mark.parametrize("k, rounds, spread", [(16, 3, 40), (16, 6, 3), (1, 2, 5), (2, 4, 2), (400, 2, 9), (5, 0, 9)])
def test_centroids(spark, k, rounds, spread):
    rng = random.Random(k + rounds)
    middles = [[rng.randint(-90, 90) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + rng.randint(-spread, spread) for x in rng.choice(middles)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (900, rows[7][1]), (901, [0] * 6)]  # repeated rows, a null id, ties
    df = spark.createDataFrame([*rows, (950, None)], "vec_id long, vector array<int>").withColumn("cluster", F.lit("x")).repartition(3)
    found, centres = centroids.clustered(df, k=k, rounds=rounds, seed=1)
    want, want_centres = lloyd(rows, k, rounds, 1)
    assert centres == want_centres
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    total = sum(d for *_, d in want)
    for r in centroids.digest(found, centres).collect():
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centres[r.cluster])).encode()).hexdigest()


def test_centroids_look_at_few(spark):
    """Bounds settle most vectors of well-kept clusters, and the ball leaves most centroids out."""
    import numpy as np

    rng = np.random.default_rng(1)
    middles = rng.integers(-1000, 1000, (64, 8))
    x = middles[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 8))
    seen = []
    plain = centroids._squared
    search = centroids.Search(middles.astype(np.int64), None)
    state = search.assign(x, np.zeros(5000, int), np.ones(5000, int), np.full(5000, np.inf), np.full(5000, -np.inf))
    try:
        centroids._squared = lambda a, b: (seen.append(len(a)), plain(a, b))[1]
        again = centroids.Search((middles + 1).astype(np.int64), middles.astype(np.int64))
        seen.clear()
        new = again.assign(x, *state)
    finally:
        centroids._squared = plain
    assert sum(seen) < 5000  # of 320 000 distances
    assert (new[0] == np.argmin(((x[:, None] - (middles + 1)[None]) ** 2).sum(2), 1)).all()


def test_centroids_of_odd_vectors(spark):
    rows = [(1, [0.5] * 4), (2, None), (3, [0.5, None, 0.1, 0.2]), (4, [float("nan")] * 4), (5, [float("inf")] * 4), (6, [0.1] * 3), (7, []), (8, [1e30] * 4), (9, [-0.01, 0.0, 0.99, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", centroids.scaled(F.col("embedding"), 64, width=4).alias("vector"))
    assert {r.vec_id: r.vector for r in df.collect() if r.vector is not None} == {1: [32] * 4, 9: [-1, 0, 63, 64]}
    found, centres = centroids.clustered(df, k=3)
    assert len(centres) == 2 and sorted(r.distance for r in found.collect()) == [0, 0]
    for odd in (df.where("false"), df.where("vec_id = 2")):
        none, centres = centroids.clustered(odd, k=3)
        assert none.collect() == [] and centres == [] and centroids.digest(none, centres).collect() == []
    nameless, centres = centroids.clustered(df.where("vec_id = 1").withColumn("vec_id", F.lit(None).cast("long")), k=3)
    assert [tuple(r)[:3] for r in centroids.digest(nameless, centres).collect()] == [(None, None, None)]


PARTS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def importance_rows(docs, target, percent, seed, runs, buckets, least):
    def features(text):
        w = PARTS.findall((text or "").encode().lower())
        return len(w), [zlib.crc32(b" ".join(w[i:i + n])) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    sources = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in sources for b in f), Counter(b for text in target for b in features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in sources:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0], -r[2]))
    drawn = able[:percent * len(able) // 100]
    rest = Counter(out) - Counter(drawn)
    return [(i, f, w, x, k) for k, (i, _, f, w, x) in enumerate(drawn, 1)] + [(i, f, w, x, None) for i, _, f, w, x in rest.elements()]


@pytest.mark.parametrize("runs, buckets, percent, ranges, parts", [(1, 10_000, 10, 1024, 3), (2, 70_000, 37, 5, 9), (1, 50, 100, 1, 4), (3, 1000, 0, 7, 7)])
def test_importance(spark, runs, buckets, percent, ranges, parts):
    rows = [*DOCS, DOCS[0], DOCS[0], DOCS[1], (None, "a null id " * 9, "en", "src0", 1), *[DOCS[5]] * 40]
    target = [t for _, t in texts()[:9]] + [None, "", "tail Same words here"]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("range", F.lit(1)).repartition(parts)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resampled(docs, aims, percent=percent, seed=2024, runs=runs, buckets=buckets, least_words=20, ranges=ranges)
    want = importance_rows(texts(rows), target, percent, 2024, runs, buckets, 20)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_importance_of_nothing(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    none = spark.createDataFrame([], "text string")
    assert importance.resampled(docs.where("false"), none).collect() == []
    assert importance.resampled(docs, none).count() == len(DOCS)
    drawn = importance.drawn(docs, docs.select("text"), percent=25)
    ranks = importance.resampled(docs, docs.select("text"), percent=25).where("rank IS NOT NULL")
    assert drawn.columns == docs.columns and drawn.count() == ranks.count() > 10


def test_ranges_are_even(spark):
    """One score for a third of all rows, one id for another third: no range gets much more than its share."""
    rows = spark.range(0, 6000, 1, 8).selectExpr("if(id % 3 = 1, 5, id) AS id", "30L AS n_features", "0L AS weight", "if(id % 3 = 0, 77, hash(id) % 1000) AS score")
    ranks = importance.ranked(rows, 6000).withColumn("part", F.spark_partition_id())
    assert [r["rank"] for r in ranks.orderBy("rank").collect()] == list(range(1, 6001))
    order = [(-r.score, r.id) for r in ranks.orderBy("rank").collect()]
    assert order == sorted(order)


SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def lm_rows(rows, training):
    tokens = [SPLIT.findall((t or "").encode().lower()) + [None] for _, t in rows]
    words, pairs = Counter(), Counter()
    for (i, _), t in zip(rows, tokens, strict=True):
        if training(i):
            words.update(t)
            pairs.update(zip([0, *t], t))  # 0: the start
    n, v = sum(words.values()), len(words)
    middle = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0
    out = []
    for (i, _), t in zip(rows, tokens, strict=True):
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = 0.0
        for h, w in zip([0, *t], t):
            own, known = (middle(words[w]) + 0.5) / (n + 0.5 * (v + 1)), middle(words[h if h != 0 else None])
            p = (min(middle(pairs[h, w]), known, middle(words[w])) + lm.PRIOR * own) / (known + lm.PRIOR)
            score += math.log10(p)
        out.append((i, len(t), sum(words[w] > 0 for w in t), base, score))
    return n, out


@pytest.mark.parametrize("broadcast_bytes, frequent, segment", [(1 << 27, 1 << 18, 16 << 20), (0, 20, 20_000), (1 << 27, 0, 50_000)])
def test_scores(spark, monkeypatch, broadcast_bytes, frequent, segment):
    rows = [*DOCS, DOCS[0], (None, "a null id", "en", "src0", 1), (5000, "  lead\x0b\x0ctrail \x00 \x1c x\xa0y ", "en", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("slice", F.lit(1)).repartition(3)
    held = lm.held_out(F.col("doc_id"))
    model = lm.fit(docs.where(~held), segment=segment)
    n, want = lm_rows(texts(rows), lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 != 1)
    assert model.n_tokens == n
    found = lm.scored(docs, model, keep={"held_out": held}, broadcast_bytes=broadcast_bytes, frequent=frequent).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in found), key=key)
    off = []
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-6)
        off.append(abs(g[4] - w[4]) / g[1])
    assert sorted(off)[len(off) // 2] < 0.005 and max(off) < 0.7  # what the filter's errors may do to one token
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 1) for r in found)


def test_routed_scores_are_the_same(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(4)
    model = lm.fit(docs, segment=20_000)
    assert len(model.shape.widths) > 10
    near, far = (sorted(map(tuple, lm.scored(docs, model, broadcast_bytes=b).collect())) for b in (1 << 27, 0))
    assert near == far


def test_filter():
    import numpy as np

    rng = np.random.default_rng(2)
    key, level = rng.integers(0, 1 << 63, 4000).astype(np.uint64), rng.integers(1, 6, 4000)
    width = lm._width(int(level.sum()))
    bits = lm.filled(width, key, level)

    def levels(key):
        return lm.levels(bits, key, np.zeros(len(key), np.int64), np.full(len(key), width, np.uint64))

    found = levels(key)
    assert (found >= level).all() and (found > level).mean() < 0.02
    assert (levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.02
    assert [int(x) for x in lm.level_of(np.array([0, 1, 2, 3, 4, 7, 8, 1 << 40]))] == [0, 1, 2, 2, 3, 3, 4, 41]
    assert lm.expected(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_model_of_nothing(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    model = lm.fit(docs.where("false"))
    assert {(r.n_known, r.base_score, r.score) for r in lm.scored(docs, model).collect()} == {(0, 0.0, 0.0)}
    assert lm.scored(docs.where("false"), lm.fit(docs)).collect() == []
