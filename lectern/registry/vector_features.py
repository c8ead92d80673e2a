"""Registered queries: embeddings, nearest neighbours, lexicon features, themes and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import bindings as b
from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.lexicon import LATIN
from lectern.operators import features, terms, vectors
from lectern.registry import sql as q
from lectern.registry.base import query
from lectern.registry.search_terms import long_int
from lectern.session import stage

DIM = 64


def hash_sql(table: str, key: str, toks: str, name: str = "emb") -> str:
    """CTEs giving {name}(key, slot, x): unit hash vectors in long form."""
    return f"""{name}_f AS (SELECT {key}, unnest(list_concat({toks}, list_transform(range(1, len({toks})), lambda i: {toks}[i] || '__' || {toks}[i + 1]))) AS f FROM {table}),
{name}_h AS (SELECT {key}, sha1(f) AS h FROM {name}_f),
{name}_e AS (SELECT {key}, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {DIM} AS slot, CASE WHEN CAST(('0x' || substr(h, 17, 2)) AS BIGINT) % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM {name}_h
  UNION ALL SELECT {key}, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % {DIM}, CASE WHEN CAST(('0x' || substr(h, 17, 2)) AS BIGINT) % 2 = 1 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END FROM {name}_h),
{name}_s AS MATERIALIZED (SELECT {key}, slot, sum(v) AS v FROM {name}_e GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS n FROM {name}_s GROUP BY {key}),
{name} AS MATERIALIZED (SELECT {key}, slot, v / n AS x FROM {name}_s JOIN {name}_n USING ({key}) WHERE n > 0)"""


@query("hash_embedding", f"""WITH {q.DOCS}, t AS MATERIALIZED (SELECT book_id, {q.tokens('content')} AS toks FROM docs), {hash_sql('t', 'book_id', 'toks')}
SELECT book_id, CAST(slot AS BIGINT) AS slot, round(x, 6) AS x FROM emb WHERE x <> 0""")
def hash_embedding(spark, sf):
    docs = b.catalog(spark, sf).select("book_id", vx.hash_embedding(tx.tokens(F.col("content"), LATIN), DIM).alias("v"))
    # Written first: unfolding a computed array would evaluate it again for the filter Spark infers from the explode.
    rows = stage(docs, "vectors").select("book_id", F.posexplode("v").alias("slot", "x")).where("x <> 0")
    return rows.select("book_id", long_int("slot"), F.round("x", 6).alias("x"))


def embeddings(spark, sf):
    return b.table(spark, sf, "embeddings").select(F.col("vec_id"), F.col("label").cast("string").alias("book_id"), "embedding")


LONGVEC = """e AS MATERIALIZED (SELECT vec_id, CAST(label AS VARCHAR) AS book_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
en AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
u AS MATERIALIZED (SELECT vec_id, book_id, i, CASE WHEN n = 0 THEN x ELSE x / n END AS x FROM e JOIN en USING (vec_id)),
cm AS (SELECT book_id, i, avg(x) AS x FROM u GROUP BY ALL), cn AS (SELECT book_id, sqrt(sum(x * x)) AS n FROM cm GROUP BY book_id),
c AS MATERIALIZED (SELECT book_id, i, x / n AS x FROM cm JOIN cn USING (book_id) WHERE n > 0)"""


@query("book_centroid", f"WITH {LONGVEC} SELECT book_id, CAST(i AS BIGINT) AS i, round(x, 6) AS x FROM c")
def book_centroid(spark, sf):
    rows = vectors.centroids(embeddings(spark, sf)).select("book_id", F.posexplode("centroid").alias("i", "x"))
    return rows.select("book_id", long_int("i"), F.round("x", 6).alias("x"))


@query("book_centroid_raw_mean", """WITH e AS MATERIALIZED (SELECT CAST(label AS VARCHAR) AS book_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cm AS (SELECT book_id, i, avg(x) AS x FROM e GROUP BY ALL), cn AS (SELECT book_id, sqrt(sum(x * x)) AS n FROM cm GROUP BY book_id)
SELECT book_id, CAST(i AS BIGINT) AS i, round(x / n, 6) AS x FROM cm JOIN cn USING (book_id) WHERE n > 0""")
def book_centroid_raw_mean(spark, sf):
    rows = vectors.centroids(embeddings(spark, sf), normalize_rows=False).select("book_id", F.posexplode("centroid").alias("i", "x"))
    return rows.select("book_id", long_int("i"), F.round("x", 6).alias("x"))


@query("cosine_topk", f"""WITH {LONGVEC}, s AS (SELECT u.vec_id AS query_id, c.book_id, round(sum(u.x * c.x), 6) AS score FROM u JOIN c USING (i) GROUP BY ALL)
SELECT query_id, rank, book_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id) AS rank FROM s) WHERE rank <= 3""")
def cosine_topk(spark, sf):
    e = embeddings(spark, sf)
    asked = e.select(F.col("vec_id").alias("query_id"), vx.unit(F.col("embedding")).alias("vector"))
    books = vectors.centroids(e).select("book_id", F.col("centroid").alias("vector"))
    top = vectors.nearest(asked, books, 3)
    return top.select("query_id", long_int("rank"), "book_id", F.round("score", 6).alias("score"))


@query("vector_neighbours", """WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS book_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS BIGINT) AS rank, book_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id) AS rank FROM s) WHERE rank <= 5""")
def vector_neighbours(spark, sf):
    unit = embeddings(spark, sf).select("vec_id", vx.unit(F.col("embedding")).alias("vector"))
    asked = unit.withColumnRenamed("vec_id", "query_id")
    found = vectors.nearest(asked, unit.withColumnRenamed("vec_id", "book_id"), 6).where("query_id <> book_id")
    top = terms.top_per(found.drop("rank"), ["query_id"], [F.desc("score"), F.asc("book_id")], 5)
    return top.select("query_id", long_int("rank"), "book_id", F.round("score", 4).alias("score"))


@query("vector_gated_topk", """WITH e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v, (['theme', 'title', 'mixed', 'entity', 'recommendation'])[1 + (vec_id // 10) % 5] AS qtype FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS book_id, greatest(3 * (2 + a.vec_id % 7), 4) AS reach, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a JOIN e b ON a.label <> b.label
  WHERE a.vec_id % 10 = 0 AND a.qtype NOT IN ('title', 'entity') AND b.vec_id % 9 <> 4 AND NOT b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 60)
SELECT query_id, CAST(rank AS BIGINT) AS rank, book_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id) AS rank FROM s) WHERE rank <= reach""")
def vector_gated_topk(spark, sf):
    """Every tenth vector asks for books of other labels: the gate takes its nearest ones, those it has seen and unknown books before the cut."""
    e = b.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("kind"), vx.unit(F.col("embedding")).alias("vector"))
    i = F.col("vec_id")
    kinds = F.array(*[F.lit(x) for x in ("theme", "title", "mixed", "entity", "recommendation")])
    asked = e.where(i % 10 == 0).select(i.alias("query_id"), "vector", F.get(kinds, (F.floor(i / 10) % 5).cast("int")).alias("qtype"), (2 + i % 7).alias("k"), F.array("kind").alias("barred"))
    seen = asked.select("query_id", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + 60)).alias("book_id"))
    known = e.where(i % 9 != 4).withColumnRenamed("vec_id", "book_id")
    found = vectors.gated_nearest(asked, known, seen)
    return found.select("query_id", long_int("rank"), "book_id", F.round("score", 4).alias("score"))


@query("vector_pad_maxdim", """WITH v AS (SELECT vec_id, embedding[1:1 + (vec_id % 64)] AS s FROM embeddings), m AS (SELECT max(len(s)) AS d FROM v)
SELECT vec_id, CAST(len(s) AS BIGINT) AS old_dim, CAST(d AS BIGINT) AS new_dim, round(list_sum(s::DOUBLE[]), 6) AS total FROM v, m""")
def vector_pad_maxdim(spark, sf):
    e = embeddings(spark, sf)
    short = e.select("vec_id", F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 64).cast("int")).alias("embedding"))
    short = short.withColumn("old_dim", F.size("embedding").cast("long"))
    total = F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, x: a + x)
    return vectors.padded(short).select("vec_id", "old_dim", F.size("embedding").cast("long").alias("new_dim"), F.round(total, 6).alias("total"))


@query("vector_manifest", """SELECT CAST(label AS VARCHAR) AS book_id, count(*) AS count, CAST(max(len(embedding)) AS BIGINT) AS dim FROM embeddings GROUP BY ALL
UNION ALL SELECT '*', count(*), CAST(max(len(embedding)) AS BIGINT) FROM embeddings""")
def vector_manifest(spark, sf):
    per_book = vectors.manifest(embeddings(spark, sf))
    totals = vectors.manifest_totals(per_book).select(F.lit("*").alias("book_id"), F.col("chunks").alias("count"), "dim")
    return per_book.unionByName(totals).select("book_id", "count", long_int("dim"))


@query("vector_sync_report", """SELECT CASE WHEN count(*) = count(e.b) THEN 'ok' ELSE 'partial' END AS status, count(e.b) AS synced, count(*) - count(e.b) AS failed
FROM documents d LEFT JOIN (SELECT DISTINCT vec_id AS b FROM embeddings) e ON e.b = d.doc_id""")
def vector_sync_report(spark, sf):
    known = embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("book_id"), F.col("embedding").alias("vector"))
    return vectors.sync_report(b.catalog(spark, sf), known)


# ---- lexicon features ------------------------------------------------------
STEMS = f"lex(k, u) AS (VALUES {q.rows(LATIN.feature_stems())})"
KEYS = "keys(ord, k, category, feature) AS (VALUES " + q.rows(
    [(i, k, k.split(".", 1)[0], k.split(".", 1)[1]) for i, k in enumerate(LATIN.feature_keys())]) + ")"


def shares_sql(table: str, key: str, toks: str, name: str = "fs") -> str:
    """CTEs giving {name}(key, ord, k, category, feature, score) for every feature of every row."""
    return f"""{name}_t AS MATERIALIZED (SELECT {key}, unnest({toks}) AS t FROM {table}),
{name}_c AS (SELECT {key}, k, count(*) AS n FROM (SELECT {key}, t, count(*) AS m FROM {name}_t GROUP BY ALL) x, lex, range(x.m) WHERE starts_with(t, u) GROUP BY ALL),
{name}_a AS (SELECT r.{key}, ord, k, category, feature, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM (SELECT {key} FROM {table}) r CROSS JOIN keys LEFT JOIN {name}_c USING ({key}, k)),
{name} AS MATERIALIZED (SELECT {key}, ord, k, category, feature, CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END AS score FROM {name}_a WINDOW w AS (PARTITION BY {key}, category))"""


DOC_TOKS = f"{q.DOCS}, dt AS MATERIALIZED (SELECT book_id, {q.tokens('content')} AS toks FROM docs), {STEMS}, {KEYS}"


def doc_scores(spark, sf):
    return b.catalog(spark, sf).select("book_id", features.lexical_scores(tx.tokens(F.col("content"), LATIN), LATIN).alias("scores"))


@query("lexicon_features", f"""WITH {DOC_TOKS}, {shares_sql('dt', 'book_id', 'toks')}
SELECT book_id, category, feature, round(score, 6) AS score FROM fs""")
def lexicon_features(spark, sf):
    return features.long_form(doc_scores(spark, sf), "book_id", LATIN).select("book_id", "category", "feature", F.round("score", 6).alias("score"))


@query("feature_top2", f"""WITH {DOC_TOKS}, {shares_sql('dt', 'book_id', 'toks')}
SELECT book_id, category, string_agg(feature, '|' ORDER BY rn) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id, category ORDER BY score DESC, ord) AS rn FROM fs WHERE score >= 0.16) WHERE rn <= 2 GROUP BY ALL""")
def feature_top2(spark, sf):
    rows = doc_scores(spark, sf).select("book_id", F.explode(features.dominant(F.col("scores"), LATIN, 0.16)).alias("d"), F.monotonically_increasing_id().alias("i"))
    best = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d.score")).alias("n"), F.array_position(
        F.array(*[F.lit(k) for k in LATIN.feature_keys()]), F.concat_ws(".", "d.category", "d.feature")).alias("o"), F.col("d.feature").alias("f")))), lambda x: x["f"]), "|")
    return rows.groupBy("book_id", F.col("d.category").alias("category")).agg(best.alias("best"))


@query("book_feature_profile", f"""WITH RECURSIVE {q.TOKENED}, {STEMS}, {KEYS},
first AS (SELECT chunk_id, book_id, toks FROM tokened), {shares_sql('first', 'chunk_id', 'toks')}
SELECT book_id, category, feature, round(avg(score), 6) AS score FROM fs JOIN first USING (chunk_id) GROUP BY ALL""")
def book_feature_profile(spark, sf):
    profiles = features.book_profiles(b.chunks(spark, sf), LATIN)
    return features.long_form(profiles, "book_id", LATIN).select("book_id", "category", "feature", F.round("score", 6).alias("score"))


@query("feature_richness", f"""WITH RECURSIVE {q.TOKENED}, {STEMS}, {KEYS},
first AS (SELECT chunk_id, book_id, toks FROM tokened), {shares_sql('first', 'chunk_id', 'toks')},
p AS (SELECT book_id, k, round(avg(score), 9) AS score FROM fs JOIN first USING (chunk_id) GROUP BY ALL),
r AS (SELECT book_id, round(sum(greatest(score, 0)), 6) AS richness FROM p GROUP BY book_id)
SELECT book_id, richness, row_number() OVER (ORDER BY richness DESC, book_id) AS rank FROM r ORDER BY richness DESC, book_id LIMIT 18""")
def feature_richness(spark, sf):
    scored = features.book_profiles(b.chunks(spark, sf), LATIN).select("book_id", features.richness(F.col("scores")).alias("richness"))
    top = scored.orderBy(F.desc("richness"), F.asc("book_id")).limit(18)
    from pyspark.sql import Window as W
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("richness"), F.asc("book_id"))).cast("long"))


@query("semantic_features", f"""WITH {DOC_TOKS}, {shares_sql('dt', 'book_id', 'toks')}, {hash_sql('dt', 'book_id', 'toks')},
proto(k, toks) AS (VALUES {", ".join(f"({q.text(c + '.' + f)}, {q.words(LATIN.tokens(f'{c} {f} ' + ' '.join(ws)))})" for c, fs in LATIN.features.items() for f, ws in fs.items())}),
{hash_sql('proto', 'k', 'toks', 'pe')},
cosine AS (SELECT book_id, k, sum(emb.x * pe.x) AS c FROM emb JOIN pe USING (slot) GROUP BY ALL),
sem AS (SELECT book_id, ord, k, category, CASE WHEN coalesce(c, 0) >= 0.16 THEN c ELSE 0 END AS c FROM fs LEFT JOIN cosine USING (book_id, k)),
sn AS (SELECT *, CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w ELSE 0 END AS s FROM sem WINDOW w AS (PARTITION BY book_id, category)),
mix AS (SELECT fs.book_id, fs.category, fs.feature, fs.score * 0.7 + sn.s * 0.3 AS m FROM fs JOIN sn USING (book_id, k))
SELECT book_id, category, feature, round(CASE WHEN sum(m) OVER w > 0 THEN m / sum(m) OVER w ELSE 0 END, 6) AS score FROM mix WINDOW w AS (PARTITION BY book_id, category)""")
def semantic_features(spark, sf):
    protos = features.prototype_vectors(spark, LATIN, DIM)
    # Both written once: the tokens serve two scores, and the filter Spark infers from unfolding the scores would evaluate them again.
    docs = stage(b.catalog(spark, sf).select("book_id", tx.tokens(F.col("content"), LATIN).alias("tokens")), "tokens")
    docs = stage(docs.select("book_id", features.combined_scores(F.col("tokens"), protos, LATIN, DIM).alias("scores")), "feature-scores")
    return features.long_form(docs, "book_id", LATIN).select("book_id", "category", "feature", F.round("score", 6).alias("score"))


def gate_sql(units, table, rules, toks="dt") -> str:
    """SELECT body giving passed labels with scores, from rule data."""
    def cond(rule):
        parts = []
        for wanted, least in rule.groups:
            parts.append(f"len(list_intersect(matched, {q.words(wanted)})) >= {least}")
        if rule.min_matched:
            parts.append(f"len(matched) >= {rule.min_matched}")
        if rule.min_score:
            parts.append(f"score >= {rule.min_score}")
        return "(" + " AND ".join(parts) + ")"

    case = " ".join(f"WHEN {q.text(l)} THEN {' OR '.join(cond(r) for r in rs)}" for l, rs in rules.items())
    order = ", ".join(f"({q.text(l)}, {i})" for i, l in enumerate(table))
    return f"""gu(label, u) AS (VALUES {q.rows(units)}), go(label, ord) AS (VALUES {order}),
gn AS MATERIALIZED (SELECT book_id, toks, array_to_string(toks, ' ') AS t FROM {toks}),
g1 AS (SELECT book_id, label, u, CASE WHEN contains(u, ' ') THEN (length(t) - length(replace(t, u, ''))) // length(u)
  ELSE len(list_filter(toks, lambda w: starts_with(w, u))) END AS n FROM gn, gu),
g2 AS (SELECT book_id, label, CAST(sum(n) AS DOUBLE) AS score, list_distinct(list(u) FILTER (WHERE n > 0)) AS matched FROM g1 GROUP BY ALL),
gp AS MATERIALIZED (SELECT book_id, label, ord, score FROM g2 JOIN go USING (label) WHERE score > 0 AND CASE label {case} ELSE score >= 1.0 END)"""


@query("theme_gate", f"""WITH {DOC_TOKS}, {gate_sql(LATIN.theme_units(), LATIN.themes, LATIN.theme_rules)}
SELECT book_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, ord) AS rank FROM gp) WHERE rank <= 6""")
def theme_gate(spark, sf):
    found = b.catalog(spark, sf).select("book_id", F.posexplode(features.themes(tx.tokens(F.col("content"), LATIN), LATIN)).alias("i", "l"))
    return found.select("book_id", "l.label", "l.score", (F.col("i") + 1).cast("long").alias("rank"))


@query("scene_gate", f"""WITH {DOC_TOKS}, {gate_sql(LATIN.scene_units(), LATIN.scenes, LATIN.scene_rules)}
SELECT book_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, ord) AS rank FROM gp) WHERE rank <= 4""")
def scene_gate(spark, sf):
    found = b.catalog(spark, sf).select("book_id", F.posexplode(features.scenes(tx.tokens(F.col("content"), LATIN), LATIN)).alias("i", "l"))
    return found.select("book_id", "l.label", "l.score", (F.col("i") + 1).cast("long").alias("rank"))


@query("feature_key_lookup", f"""WITH {KEYS}, p AS (SELECT p_partkey AS id, CAST(i - 1 AS BIGINT) AS pos, lower(w) AS probe FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)
  UNION ALL SELECT -1 - ord, 0, feature FROM keys),
h AS (SELECT id, pos, k, row_number() OVER (PARTITION BY id, pos ORDER BY ord) AS rn FROM p JOIN keys
  ON probe = feature OR probe = k OR contains(feature, probe) OR contains(probe, feature))
SELECT CAST(id AS BIGINT) AS id, pos, k AS feature_key FROM p LEFT JOIN (SELECT * FROM h WHERE rn = 1) USING (id, pos)""")
def feature_key_lookup(spark, sf):
    """Every word of every part name, and every feature name, as a free-text label."""
    parts = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.split("p_name", " ")).alias("pos", "probe"))
    names = [(-1 - i, 0, k.split(".", 1)[1]) for i, k in enumerate(LATIN.feature_keys())]
    probes = parts.unionByName(spark.createDataFrame(names, "id long, pos int, probe string"))
    return probes.select("id", F.col("pos").cast("long").alias("pos"), features.feature_key(F.col("probe"), LATIN).alias("feature_key"))
