"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import ship, stage

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)  # first letters of longer words: stems that come with many endings
SAMPLE = 20_000
VOCABULARY = 8192
FOLDS = 3
MEMO = 150_000
ROWS = 512  # texts taken up at once, so that a task holds few of them as Python objects


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def _small(batches):
    for b in batches:
        for low in range(0, b.num_rows, ROWS):
            yield b.slice(low, ROWS)


def _words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], size: int = SAMPLE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and 0/1 categories of the `size` labelled documents with the least hash of their id; one row per id and only full labels."""
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    known = known.groupBy("id").agg(*[F.max(c).alias(c) for c in categories])
    drawn = stage(known.orderBy(F.xxhash64("id", F.lit("fold")), "id").limit(size), "label-sample")  # at most `size` rows of a few numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(drawn), "id")
    return joined.groupBy("id", *categories).agg(F.max("text").alias("text"))


def _fit(rows: np.ndarray, cols: np.ndarray, n: int, width: int, y: np.ndarray, extra: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression with a ridge, over 0/1 features and a few dense ones, by accelerated gradient steps.

    The gradient of each feature is scaled by its count, which serves as the curvature along it. The rarer class weighs as much as the other, up to tenfold.
    """
    positive = max(1, int(y.sum()))
    weight = np.where(y > 0, min(10.0, max(1.0, (n - positive) / positive)), 1.0)
    dense = np.column_stack([extra, np.ones(n)])
    norm = np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))  # texts of all lengths count alike
    values = (1 / norm)[rows]
    curve = np.concatenate([np.bincount(cols, values * values * weight[rows], minlength=width), (dense**2 * weight[:, None]).sum(0)]) / 4
    curve = curve * 8 + 1.0
    w = np.zeros(width + dense.shape[1])
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(rows, values * ahead[cols], minlength=n) + dense @ ahead[width:]
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.concatenate([np.bincount(cols, values * slope[rows], minlength=width), dense.T @ slope]) + 0.01 * ahead
        new = ahead - grad / curve
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def _score(rows, cols, n, width, w, extra) -> np.ndarray:
    norm = np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))
    dense = np.column_stack([extra, np.ones(n)])
    return 1 / (1 + np.exp(-np.clip(np.bincount(rows, (1 / norm)[rows] * w[cols], minlength=n) + dense @ w[width:], -30, 30)))


def _chain(docs: list[list[int]], labels: np.ndarray, folds: np.ndarray, width: int):
    """Weights of each category's model, and each category's probabilities for rows that the model has not seen.

    The model of a category sees the probabilities of the categories before it. In training these come from
    models fitted without the row's fold, as they will at scoring time come from texts not seen before.
    """
    n = len(docs)
    rows = np.repeat(np.arange(n), [len(d) for d in docs])
    cols = np.concatenate([np.asarray(d, np.int64) for d in docs]) if n else np.zeros(0, np.int64)
    before, models = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        y, held = labels[:, k], np.zeros(n)
        for f in range(FOLDS):
            inside = folds == f
            index = np.cumsum(~inside) - 1
            use = ~inside[rows]
            w = _fit(index[rows[use]], cols[use], int((~inside).sum()), width, y[~inside], before[~inside])
            held[inside] = _score(rows, cols, n, width, w, before)[inside]
        models.append(_fit(rows, cols, n, width, y, before))
        before = np.column_stack([before, held])
    return models, before


def _best_threshold(held: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on probabilities of unseen rows, halfway to the next lower one."""
    order = np.argsort(-held, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    i = int(np.argmax(f1)) if len(y) else 0
    if not len(y) or not y.sum():
        return 1.0
    nxt = held[order[i + 1]] if i + 1 < len(y) else 0.0
    return float((held[order[i]] + nxt) / 2)


def fit(sampled: DataFrame, categories: list[str], *, least: int = 3, vocabulary: int = VOCABULARY):
    """The chain's model, of bounded size: feature -> weights, dense weights and threshold per category.

    The sample has a bounded number of rows. Spark counts features over it and keeps the `vocabulary` ones most tied to a category
    of those in `least` documents or more; one task then fits the chain on the features' numbers.
    """
    spark = sampled.sparkSession
    ship(spark)

    def listed(batches):
        for b in _small(batches):
            found = [sorted({f for w in _words(t) for f in _features(w)}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[b.column(c) for c in categories], pa.array(found, pa.list_(pa.string()))],
                                             names=["id", *categories, "features"])

    kinds = ", ".join(f"{c} int" for c in categories)
    texts = stage(sampled.select("id", *categories, "text").mapInArrow(listed, f"id long, {kinds}, features array<string>"), "toxicity-features")
    n, *hits = texts.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in categories]).first()
    counted = texts.select(F.explode("features").alias("feature"), *categories).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories])
    kept = counted.where(F.col("n") >= least)
    rates = [(c, min(max(h / max(1, n), 1e-6), 1 - 1e-6)) for c, h in zip(categories, hits, strict=True)]
    # How far a category is over- or under-represented among the documents with the feature, in squared standard errors.
    lift = [F.pow(F.col(c) - F.col("n") * r, 2) / (F.col("n") * (r * (1 - r))) for c, r in rates]
    kept = kept.orderBy(F.desc(F.greatest(*lift) if len(lift) > 1 else lift[0]), "feature").limit(vocabulary)
    kept = stage(kept.select("feature"), "toxicity-vocabulary")
    names = sorted(r["feature"] for r in kept.collect())  # `vocabulary` words at most
    numbered = spark.createDataFrame(list(enumerate(names)), "number int, feature string")
    known = texts.select("id", F.explode("features").alias("feature")).join(F.broadcast(numbered), "feature")
    known = known.groupBy("id").agg(F.sort_array(F.collect_list("number")).alias("known"))
    numbers = texts.drop("features").join(known, "id", "left").withColumn("fold", F.pmod(F.xxhash64("id", F.lit("oof")), F.lit(FOLDS)).cast("int"))

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        lists = table.column("known").combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        docs = np.split(pc.list_flatten(lists).to_numpy(), np.cumsum(sizes)[:-1])
        y = np.column_stack([table.column(c).to_numpy() for c in categories]).astype(float)
        models, held = _chain(docs, y, table.column("fold").to_numpy(), len(names))
        dense = [[float(v) for v in m[len(names):]] + [_best_threshold(held[:, k], y[:, k])] for k, m in enumerate(models)]
        weights = np.column_stack([m[: len(names)] for m in models])
        return pa.table({"number": pa.array([*range(len(names)), *[None] * len(dense)], pa.int32()), "weights": pa.array([*weights.tolist(), *dense], pa.list_(pa.float64()))})

    one = numbers.withColumn("one", F.lit(1)).groupBy("one")  # the bounded sample, as numbers
    rows = stage(one.applyInArrow(train, "number int, weights array<double>"), "toxicity-model").collect()
    dense = sorted((r["weights"] for r in rows if r["number"] is None), key=len)  # a later category has one more
    dense = dense or [[0.0] * k + [0.0, 1.0] for k in range(len(categories))]  # without a sample nothing is a hit
    return {names[r["number"]]: r["weights"] for r in rows if r["number"] is not None}, dense


def _scorer(sent):
    """A function from texts to the chain's probabilities and to hits of the last category, for use in a task."""
    at, table, dense = sent.value
    memo: dict[str, tuple] = {}

    def score(texts):
        every = []
        for text in texts:
            found = set()
            for w in _words(text):
                ids = memo.get(w)
                if ids is None:
                    if len(memo) > MEMO:
                        memo.clear()
                    ids = memo[w] = tuple(at[f] for f in _features(w) if f in at)
                found.update(ids)
            index = np.fromiter(sorted(found), np.int64, len(found))
            linear = table[index].sum(0) / np.sqrt(len(found)) if len(found) else np.zeros(len(dense))
            p: list[float] = []
            for k, d in enumerate(dense):
                z = linear[k] + sum(x * y for x, y in zip(p, d[:-2], strict=True)) + d[-2]
                p.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            every.append(p)
        return every, [p[-1] >= dense[-1][-1] for p in every]

    return score


def _sent(spark, model, categories: list[str]):
    """The model for the tasks; its size is bounded by the vocabulary."""
    weights, dense = model
    names = sorted(weights)
    table = np.array([weights[f] for f in names]).reshape(len(names), len(categories))
    return spark.sparkContext.broadcast(({f: i for i, f in enumerate(names)}, table, dense))


def targets(labels: DataFrame) -> DataFrame:
    """The categories of the chain from the label table: junk (quality 0), then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")


CATEGORIES = ["junk", "toxic"]


def classified(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, *, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> and toxic (the last category, at the threshold with the best F1 on unseen rows) for every document.

    `labels` has the id and a 0/1 column per category; a bounded sample of `size` rows trains the chain, every document is scored whole.
    A null or empty text has no features and gets the chain's constant; labels with a null or without a document don't train;
    without any positive label nothing is toxic; equal texts score alike, so repeated rows do; null ids are scored too;
    an empty table gives no rows; other columns are not read.
    """
    categories = categories or CATEGORIES
    model = fit(sample(docs, labels, categories, size, id_col=id_col, text_col=text_col), categories)
    sent = _sent(docs.sparkSession, model, categories)

    def run(batches):
        score = _scorer(sent)
        for b in _small(batches):
            p, hit = score(b.column("text").to_pylist())
            columns = [b.column("doc_id"), *[pa.array([x[k] for x in p], pa.float64()) for k in range(len(categories))], pa.array(hit, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"p_{c}" for c in categories], "toxic"])

    schema = "doc_id long, " + "".join(f"p_{c} double, " for c in categories) + "toxic boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, *, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that `classified` does not call toxic, whole rows in one pass."""
    categories = categories or CATEGORIES
    model = fit(sample(docs, labels, categories, size, id_col=id_col, text_col=text_col), categories)
    sent, at = _sent(docs.sparkSession, model, categories), docs.columns.index(text_col)

    def run(batches):
        score = _scorer(sent)
        for b in _small(batches):
            hit = score(b.column(at).to_pylist())[1]
            yield b.filter(pa.array([not h for h in hit], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
