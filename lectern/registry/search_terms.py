"""Registered queries: tokens, term statistics, BM25, TF-IDF, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import bindings as b
from lectern.functions import text as tx
from lectern.lexicon import LATIN
from lectern.operators import passages, terms
from lectern.registry import sql as q
from lectern.registry.base import query
from lectern.session import spread, stage


def index(spark, sf):
    """The chunk table with tokens, written once and read by column."""
    return stage(terms.tokenized(b.chunks(spark, sf), LATIN), "chunks")


def long_int(name):
    return F.col(name).cast("long").alias(name)


@query("tokenize_counts", f"""WITH {q.DOCS}, t AS (SELECT book_id, {q.tokens('content')} AS toks FROM docs)
SELECT book_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(list_distinct(toks)) AS BIGINT) AS n_terms, md5(array_to_string(toks, ' ')) AS digest FROM t""")
def tokenize_counts(spark, sf):
    t = b.catalog(spark, sf).select("book_id", tx.tokens(F.col("content"), LATIN).alias("toks"))
    return t.select(
        "book_id", F.size("toks").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("toks")).cast("long").alias("n_terms"), F.md5(F.array_join("toks", " ")).alias("digest"),
    )


@query("term_stats_idf", f"""WITH RECURSIVE {q.POSTED}, n AS (SELECT count(*) AS n FROM tokened)
SELECT term, CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf, round(ln((n - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf
FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM posted GROUP BY term), n""")
def term_stats_idf(spark, sf):
    chunks = terms.tokenized(b.chunks(spark, sf), LATIN)
    stats = terms.term_stats(terms.postings(chunks), chunks.agg(F.count(F.lit(1))).scalar())
    return stats.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query("doc_length_stats", f"""WITH RECURSIVE {q.TOKENED}
SELECT lang, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(len(toks)) AS BIGINT) AS n_tokens, round(avg(len(toks)), 6) AS avg_len, CAST(max(len(toks)) AS BIGINT) AS max_len
FROM tokened JOIN docs USING (book_id) GROUP BY lang""")
def doc_length_stats(spark, sf):
    cat = b.catalog(spark, sf).withColumn("lang", F.get("genres", F.lit(0)))
    chunks = tx.chunk_texts(tx.clean_text(F.col("content")), b.LINE)
    sizes = cat.select("lang", F.explode(chunks).alias("content")).select("lang", F.size(tx.tokens(F.col("content"), LATIN)).alias("dl"))
    return sizes.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("dl").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avg_len"),
        F.max("dl").cast("long").alias("max_len"),
    )


@query("chunk_documents", f"""WITH RECURSIVE {q.CHUNKS}
SELECT chunk_id, book_id, position, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS digest FROM chunks""")
def chunk_documents(spark, sf):
    return b.chunks(spark, sf).select(
        "chunk_id", "book_id", long_int("position"), F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest")
    )


@query("bm25_topk", f"""WITH RECURSIVE {q.POSTED}, {q.BENCH}, {q.bm25('asked')},
best AS (SELECT query_id, book_id, max(score) AS score FROM scores GROUP BY ALL)
SELECT query_id, rank, book_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id) AS rank FROM best) WHERE rank <= 5""")
def bm25_topk(spark, sf):
    asked = terms.query_terms(b.benchmark_queries(spark, sf), LATIN)
    top = terms.top_books(terms.bm25(index(spark, sf), asked, by="book", limit=5), 5)
    return top.select("query_id", long_int("rank"), "book_id", F.round("score", 4).alias("score"))


@query("bm25_best_chunk", f"""WITH RECURSIVE {q.POSTED}, {q.BENCH}, {q.bm25('asked')}
SELECT query_id, book_id, chunk_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, book_id ORDER BY round(score, 9) DESC, position) AS rn FROM scores) WHERE rn = 1""")
def bm25_best_chunk(spark, sf):
    asked = terms.query_terms(b.benchmark_queries(spark, sf), LATIN)
    scores = terms.bm25(index(spark, sf), asked, by="book")
    return terms.best_chunks(scores).select("query_id", "book_id", "chunk_id", F.round("score", 4).alias("score"))


@query("bm25_multi_query", f"""WITH RECURSIVE {q.POSTED}, {q.TURNS}, {q.bm25('asked')},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id, position) AS rank FROM scores) WHERE rank <= 120)
SELECT query_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(count(DISTINCT book_id) AS BIGINT) AS n_books, round(max(score), 4) AS best, round(sum(score), 3) AS total
FROM top GROUP BY query_id""")
def bm25_multi_query(spark, sf):
    turns = b.user_turns(spark, sf).withColumn("search_text", F.col("query"))
    top = terms.top_chunks(terms.bm25(index(spark, sf), terms.query_terms(turns, LATIN), limit=120), 120)
    per_book = top.groupBy("query_id", "book_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("m"), F.sum("score").alias("s"))
    return per_book.groupBy("query_id").agg(
        F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_books"), F.round(F.max("m"), 4).alias("best"), F.round(F.sum("s"), 3).alias("total")
    )


TFIDF = f"""book_toks AS MATERIALIZED (SELECT book_id, {q.tokens('content')} AS toks FROM docs),
grams AS MATERIALIZED (SELECT book_id, list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS g FROM book_toks),
counted AS MATERIALIZED (SELECT book_id, term, count(*) AS tf FROM (SELECT book_id, unnest(g) AS term FROM grams) GROUP BY ALL),
vocab AS MATERIALIZED (SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (1 + df)) + 1.0 AS idf FROM (
  SELECT term, sum(tf) AS cf, count(*) AS df FROM counted GROUP BY term)),
raw AS MATERIALIZED (SELECT book_id, term, idf, tf * idf AS w FROM counted JOIN vocab USING (term)),
sized AS (SELECT book_id, sqrt(sum(w * w)) AS size FROM raw GROUP BY book_id),
weights AS MATERIALIZED (SELECT book_id, term, idf, w / size AS weight FROM raw JOIN sized USING (book_id))"""


def book_weights(spark, sf):
    books = b.catalog(spark, sf).select("book_id", tx.tokens(F.col("content"), LATIN).alias("tokens"))
    return terms.book_terms(books)


@query("tfidf_book_terms", f"""WITH {q.DOCS}, {TFIDF}
SELECT book_id, rank, term, round(weight, 6) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY round(weight, 9) DESC, term) AS rank FROM weights) WHERE rank <= 5""")
def tfidf_book_terms(spark, sf):
    weights = book_weights(spark, sf).withColumn("settled", F.round("weight", 9))  # once a row, not in every comparison of the sort
    top = terms.top_per(weights, ["book_id"], [F.desc("settled"), F.asc("term")], 5)
    return top.select("book_id", long_int("rank"), "term", F.round("weight", 6).alias("weight"))


@query("tfidf_query_score", f"""WITH {q.DOCS}, {TFIDF}, {q.BENCH},
qt AS (SELECT query_id, {q.tokens('query')} AS toks FROM asked),
qg AS (SELECT query_id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) AS term FROM qt),
qr AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM qg JOIN vocab USING (term) GROUP BY query_id, term),
qs AS (SELECT query_id, sqrt(sum(w * w)) AS size FROM qr GROUP BY query_id),
s AS (SELECT query_id, book_id, sum(qr.w / size * weight) AS score FROM qr JOIN qs USING (query_id) JOIN weights USING (term) GROUP BY ALL)
SELECT query_id, rank, book_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, book_id) AS rank FROM s) WHERE rank <= 5""")
def tfidf_query_score(spark, sf):
    scores = terms.tfidf_scores(book_weights(spark, sf), b.benchmark_queries(spark, sf), LATIN)
    top = terms.top_per(scores.withColumn("settled", F.round("score", 9)), ["query_id"], [F.desc("settled"), F.asc("book_id")], 5)
    return top.select("query_id", long_int("rank"), "book_id", F.round("score", 6).alias("score"))


@query("chunk_head_mid_tail", f"""WITH RECURSIVE {q.CHUNKS}, c AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM chunks),
picked AS (SELECT *, CASE WHEN n <= 22 THEN 1 WHEN position < 10 THEN 1
  WHEN position >= greatest((n - least(4, n - 18)) // 2, 10) AND position < greatest((n - least(4, n - 18)) // 2, 10) + least(4, n - 18) THEN 2
  WHEN position >= n - 8 THEN 3 ELSE 0 END AS part FROM c),
kept AS (SELECT *, row_number() OVER (PARTITION BY book_id, CASE WHEN n <= 22 THEN chunk_id ELSE left(content, 160) END ORDER BY position) AS rn FROM picked WHERE part > 0)
SELECT book_id, CAST(count(*) AS BIGINT) AS n_picked, CAST(sum(position) AS BIGINT) AS positions FROM kept WHERE rn = 1 GROUP BY book_id""")
def chunk_head_mid_tail(spark, sf):
    picked = passages.head_mid_tail(b.chunks(spark, sf))
    return picked.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_picked"), F.sum("position").cast("long").alias("positions"))


@query("chunk_first_n", f"""WITH RECURSIVE {q.CHUNKS} SELECT book_id, CAST(count(*) FILTER (WHERE position < 3) AS BIGINT) AS first3,
CAST(count(*) FILTER (WHERE position < 6) AS BIGINT) AS first6, CAST(count(*) FILTER (WHERE position < 24) AS BIGINT) AS first24 FROM chunks GROUP BY book_id""")
def chunk_first_n(spark, sf):
    first = passages.first_chunks(b.chunks(spark, sf), 24).groupBy("book_id")
    return first.agg(
        F.count_if(F.col("position") < 3).alias("first3"), F.count_if(F.col("position") < 6).alias("first6"), F.count(F.lit(1)).alias("first24")
    )


@query("chunk_collect", f"""WITH RECURSIVE {q.CHUNKS}
SELECT book_id, CAST(count(*) AS BIGINT) AS n_chunks, md5(string_agg(content, '|' ORDER BY position)) AS digest FROM chunks GROUP BY book_id""")
def chunk_collect(spark, sf):
    whole = passages.collected(b.chunks(spark, sf))
    return whole.select("book_id", F.size("chunks").cast("long").alias("n_chunks"), F.md5(F.array_join("chunks", "|")).alias("digest"))


@query("adaptation_pairs", f"""WITH RECURSIVE {q.CHUNKS}, c AS (
  SELECT chunk_id, book_id, title, position, trim(chunks.content, {q.BLANKS}) AS chunk, {q.tokens('chunks.content')} AS toks
  FROM chunks JOIN docs USING (book_id) WHERE title <> ''),
tc AS (SELECT chunk_id, term, count(*) AS n, min(i) AS first FROM (SELECT chunk_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS i FROM c) GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, first) AS rn FROM tc),
td AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY rn) AS k FROM tr WHERE rn <= 15 AND length(term) >= 4),
kw AS (SELECT chunk_id, list(term ORDER BY k) AS ks FROM td WHERE k <= 5 GROUP BY chunk_id),
p AS (SELECT book_id, position, chunk, unnest([title, trim(title || ' ' || array_to_string(coalesce(ks, [])[1:2], ' ')), trim('книга про ' || array_to_string(coalesce(ks, [])[1:3], ' ')), trim(array_to_string(coalesce(ks, [])[1:2], ' '))]) AS query,
  unnest([1, 2, 3, 4]) AS template FROM c LEFT JOIN kw USING (chunk_id)),
d AS (SELECT *, row_number() OVER (PARTITION BY lower(query), lower(trim(left(chunk, 180), {q.BLANKS})) ORDER BY book_id, position, template) AS rn FROM p WHERE query <> '')
SELECT query, md5(chunk) AS chunk_digest, book_id, CAST(position AS BIGINT) AS position FROM d WHERE rn = 1""")
def adaptation_pairs(spark, sf):
    pairs = passages.adaptation_pairs(b.catalog(spark, sf), b.chunks(spark, sf), LATIN)
    return pairs.select("query", F.md5("chunk").alias("chunk_digest"), "book_id", long_int("position"))


@query("repetition_filter", r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1))) AS part FROM documents),
k AS (SELECT doc_id, trim(part, chr(32)||chr(10)||chr(13)||chr(9)) AS part FROM s),
g AS (SELECT doc_id, part, count(*) AS n FROM k WHERE length(part) >= 24 GROUP BY ALL)
SELECT CAST(d.doc_id AS VARCHAR) AS book_id, CAST(coalesce(max(n), 0) AS BIGINT) AS max_repeats, coalesce(max(n), 0) >= 3 AS repetitive FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""")
def repetition_filter(spark, sf):
    docs = b.catalog(spark, sf).select("book_id", "content")
    most = passages.max_sentence_repeats(F.col("content"))
    return docs.select("book_id", most.cast("long").alias("max_repeats")).withColumn("repetitive", F.col("max_repeats") >= 3)


@query("dominant_terms", f"""WITH {q.DOCS}, t AS (SELECT book_id, term, count(*) AS n, min(i) AS first FROM (
  SELECT book_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS i FROM (SELECT book_id, {q.tokens('content')} AS toks FROM docs)) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, first) AS rn FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY rn) AS k FROM r WHERE rn <= 15 AND length(term) >= 4)
SELECT book_id, string_agg(term, '|' ORDER BY k) AS dominant FROM k WHERE k <= 5 GROUP BY book_id""")
def dominant_terms(spark, sf):
    docs = b.catalog(spark, sf).select("book_id", tx.tokens(F.col("content"), LATIN).alias("tokens"))
    dominant = F.array_join(passages.dominant_terms(F.col("tokens")), "|")
    return docs.select("book_id", dominant.alias("dominant")).where("dominant <> ''")
