"""Registered queries: product state, ingestion rules, references, generated texts."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from lectern import bindings as b
from lectern.functions import text as tx
from lectern.lexicon import LATIN, SLUG_AUTHORS, SLUG_ENDINGS, SLUG_LETTERS, SLUG_PAIRS
from lectern.operators import passages, product, understanding
from lectern.registry import sql as q
from lectern.registry.base import query
from lectern.registry.profile_queries import EV
from lectern.registry.search_terms import long_int
from lectern.session import spread
from lectern.sources import files, references
from lectern.streaming import ingest
from lectern.streaming import profiles as live


@query("upsert_latest", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_latest(spark, sf):
    ev = b.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    old, new = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")
    return product.upserted(product.latest(old, ["user_id"], "ts", "event_id"), new, ["user_id"], "ts").select("user_id", "event_id", "event_type", "value")


@query("keyed_lookup_chain", """WITH u AS (SELECT c_custkey AS user_id FROM customer)
SELECT user_id, CASE WHEN user_id % 2 = 0 THEN c_name WHEN user_id % 3 = 0 THEN c_mktsegment WHEN user_id % 5 = 0 THEN 'file' ELSE '{}' END AS profile,
 CASE WHEN user_id % 2 = 0 THEN 'primary' WHEN user_id % 3 = 0 THEN 'legacy' WHEN user_id % 5 = 0 THEN 'fallback' END AS source FROM u JOIN customer ON c_custkey = user_id""")
def keyed_lookup_chain(spark, sf):
    c = b.table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    i = F.col("user_id")
    primary = c.where((i % 2 == 0) | (i % 3 == 0)).select("user_id", F.when(i % 2 == 0, F.col("c_name")).otherwise("{}").alias("profile"))
    legacy = c.where(i % 3 == 0).select("user_id", F.col("c_mktsegment").alias("profile"))
    fallback = c.where(i % 5 == 0).select("user_id", F.lit("file").alias("profile"))
    return product.looked_up(c, primary, legacy, fallback)


@query("cascade_delete", f"""WITH RECURSIVE {q.CHUNKS}, del AS (SELECT DISTINCT CAST(vec_id * 3 AS VARCHAR) AS book_id FROM embeddings)
SELECT del.book_id, d.book_id IS NOT NULL AS deleted, CAST(coalesce(n, 0) AS BIGINT) AS removed_chunks, CAST((SELECT count(*) FROM chunks WHERE book_id NOT IN (SELECT book_id FROM del)) AS BIGINT) AS chunks_left
FROM del LEFT JOIN docs d USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS n FROM chunks GROUP BY book_id) USING (book_id)""")
def cascade_delete(spark, sf):
    chunks = b.chunks(spark, sf)
    gone = b.table(spark, sf, "embeddings").select((F.col("vec_id") * 3).cast("string").alias("book_id"))
    _, _, left, report = product.deleted_books(b.catalog(spark, sf), chunks, chunks, gone)
    return report.select("book_id", "deleted", "removed_chunks", left.agg(F.count(F.lit(1))).scalar().alias("chunks_left"))


@query("orphan_chunks", "SELECT CAST(e.vec_id AS BIGINT) AS vec_id, d.doc_id IS NOT NULL AS kept FROM embeddings e LEFT JOIN labels d ON d.doc_id = e.vec_id")
def orphan_chunks(spark, sf):
    vecs = b.table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("book_id"))
    known = b.table(spark, sf, "labels").select(F.col("doc_id").alias("book_id"))
    kept = product.only(vecs, known, "book_id").select("vec_id", F.lit(True).alias("kept"))
    return kept.unionByName(product.without(vecs, known).select("vec_id", F.lit(False).alias("kept")))


@query("chunk_upsert", f"""WITH RECURSIVE {q.CHUNKS} SELECT book_id, CAST(CASE WHEN CAST(book_id AS INT) % 3 = 0 THEN 1 ELSE count(*) END AS BIGINT) AS n FROM chunks GROUP BY book_id""")
def chunk_upsert(spark, sf):
    old = b.chunks(spark, sf)
    fresh = b.catalog(spark, sf).where(F.col("book_id").cast("int") % 3 == 0).select(
        F.concat("book_id", F.lit("_0")).alias("chunk_id"), "book_id", F.lit(0).alias("position"), F.col("title").alias("content"))
    return product.replaced(old, fresh).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))


@query("touch_on_read", f"""WITH {EV} SELECT CAST(doc_id AS VARCHAR) AS book_id, CAST(count(ev.id) AS BIGINT) AS open_count, epoch_us(max(created_at)) AS last_opened_us FROM documents LEFT JOIN ev ON ev.book_id = CAST(doc_id AS VARCHAR) AND action = 'skip' GROUP BY doc_id""")
def touch_on_read(spark, sf):
    cat = b.catalog(spark, sf).select("book_id", F.lit(None).cast("timestamp").alias("last_opened"), F.lit(0).cast("long").alias("open_count"))
    opens = b.interactions(spark, sf).where("action = 'skip'").select("book_id", F.col("created_at").alias("opened_at"))
    return product.opened(cat, opens).select("book_id", "open_count", F.unix_micros("last_opened").alias("last_opened_us"))


@query("catalog_point_update", """SELECT CAST(doc_id AS VARCHAR) AS book_id, CASE WHEN quality = 1 THEN 'good' ELSE source END AS author FROM documents LEFT JOIN labels USING (doc_id)""")
def catalog_point_update(spark, sf):
    changes = b.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("book_id"), F.when(F.col("quality") == 1, "good").alias("author"))
    return product.updated(b.catalog(spark, sf).select("book_id", "author"), changes)


@query("lookup_tables", f"""WITH {q.DOCS} SELECT author AS name, count(*) AS n_books, CAST(count(DISTINCT lang) AS BIGINT) AS n_langs FROM docs GROUP BY author UNION ALL SELECT lang, count(*), 1 FROM docs GROUP BY lang""")
def lookup_tables(spark, sf):
    cat = b.catalog(spark, sf)
    per = cat.select("author", F.explode_outer("genres").alias("genre")).groupBy("author", "genre").agg(F.count(F.lit(1)).alias("n"))
    authors = per.groupBy(F.col("author").alias("name")).agg(F.sum("n").alias("n_books"), F.count(F.lit(1)).alias("n_langs"))
    return authors.unionByName(per.groupBy(F.col("genre").alias("name")).agg(F.sum("n").alias("n_books"), F.lit(1).cast("long").alias("n_langs")))


SAVED = f"""{EV}, sv AS (SELECT * FROM ev WHERE action IN ('like', 'save')),
items AS MATERIALIZED (SELECT user_id, book_id, CAST(floor(epoch(max(created_at))) AS BIGINT) % 100000 AS position, min(created_at) AS created_at FROM sv GROUP BY ALL)"""


@query("saved_list_from_likes", f"""WITH {SAVED} SELECT user_id, book_id, position, 'list_' || left(sha1(user_id || '/saved'), 16) AS list_id FROM items""")
def saved_list_from_likes(spark, sf):
    lists, items = product.saved_lists(b.interactions(spark, sf))
    out = items.join(lists.select(F.col("id").alias("reading_list_id"), "user_id"), "reading_list_id")
    return out.select("user_id", "book_id", long_int("position"), F.col("reading_list_id").alias("list_id"))


@query("reading_list_items", f"""WITH {q.DOCS}, {SAVED} SELECT user_id, book_id, title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY position, created_at, book_id) AS BIGINT) AS place, count(*) OVER (PARTITION BY user_id) AS items_count FROM items LEFT JOIN docs USING (book_id)""")
def reading_list_items(spark, sf):
    lists, items = product.saved_lists(b.interactions(spark, sf))
    page = product.list_page(lists, items, b.catalog(spark, sf).select("book_id", "title"))
    return page.select("user_id", "book_id", "title", long_int("place"), "items_count")


@query("list_ownership", """SELECT o_orderkey AS ask_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % c_custkey < 40 AND c_custkey > 0""")
def list_ownership(spark, sf):
    lists = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("user_id"))
    o = b.table(spark, sf, "orders").where("o_custkey > 0")
    liar = F.when(F.col("o_orderkey") % F.col("o_custkey") < 40, F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    asked = o.select(F.col("o_orderkey").alias("ask_id"), F.col("o_custkey").alias("list_id"), liar.alias("user_id"))
    return product.owned(asked, lists).select("ask_id")


EVENTS = """re AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'query' ELSE 'profile' END AS ctx, o_orderdate AS made FROM orders),
rn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY made DESC, id DESC) AS age FROM re),
it AS (SELECT age, user_id, ctx, l_partkey AS book, l_linenumber AS pos, l_extendedprice AS score FROM rn JOIN lineitem ON l_orderkey = id WHERE age <= 5)"""


def rec_events(spark, sf):
    items = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("l_linenumber", F.col("l_partkey").alias("book"), F.col("l_extendedprice").alias("score")))),
        lambda x: F.struct(x["book"].cast("string").alias("book_id"), F.lit(None).cast("string").alias("recommendation_context"), x["score"].alias("score"))).alias("items"))
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                                            F.when(F.col("o_orderkey") % 3 == 0, "query").otherwise("profile").alias("recommendation_context"), F.col("o_orderdate").alias("created_at"))
    return o.join(items, "id", "left")


@query("explanation_lookup", f"""WITH {EVENTS}, a AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS book FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1)
SELECT user_id, book AS book_id, arg_min(score, (age, pos)) AS score FROM a JOIN it USING (user_id, book) WHERE ctx = 'profile' GROUP BY ALL""")
def explanation_lookup(spark, sf):
    ev = rec_events(spark, sf)
    li = b.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("book_id"))
    asked = ev.select("id", "user_id").join(li, "id").select("user_id", "book_id").distinct()
    asked = asked.withColumn("ask_id", F.concat_ws("/", F.col("user_id").cast("string"), "book_id")).withColumn("recommendation_context", F.lit("profile"))
    # the item order inside an order is by line number, as the SQL has it
    found = product.explanations(asked, ev, 5).join(asked, "ask_id")
    return found.select("user_id", F.col("book_id").cast("long").alias("book_id"), F.col("item.score").alias("score"))


@query("ingest_dedupe_hash", """WITH h AS (SELECT doc_id, 'doc/' || doc_id || '.txt' AS source_key, sha256(text) AS file_hash FROM documents),
done AS (SELECT file_hash, min(CAST(doc_id AS VARCHAR)) AS book_id FROM h WHERE doc_id % 2 = 0 GROUP BY file_hash)
SELECT source_key, 'dataset_' || left(sha1(source_key), 16) AS own_id, book_id AS duplicate_of FROM h LEFT JOIN done USING (file_hash) WHERE doc_id % 2 = 1""")
def ingest_dedupe_hash(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_key"), F.sha2("text", 256).alias("file_hash"))
    done = d.where("doc_id % 2 = 0").select("file_hash", F.col("doc_id").cast("string").alias("book_id"))
    rows = ingest.duplicates(d.where("doc_id % 2 = 1"), done, done.where("false"))
    return rows.select("source_key", tx.stable_book_id(F.col("source_key")).alias("own_id"), "duplicate_of")


@query("retry_backoff", """SELECT event_id, n AS retry_count, CASE WHEN event_type <> 'error' AND n < 9 THEN 'queued' ELSE 'failed' END AS status,
CASE WHEN event_type <> 'error' AND n < 9 THEN CAST(least(300, 5 * 2 ** (n - 1)) AS BIGINT) END AS wait_s FROM (SELECT *, event_id % 12 + 1 AS n FROM events)""")
def retry_backoff(spark, sf):
    ev = b.table(spark, sf, "events").select("event_id", (F.col("event_id") % 12).alias("retry_count"), (F.col("event_type") == "error").alias("terminal"), F.lit("x").alias("error"), F.col("ts").cast("timestamp").alias("ts"))
    out = ingest.failed(ev, F.col("ts"), max_retries=9)
    return out.select("event_id", "retry_count", "status", F.round((F.unix_micros("next_attempt_at") - F.unix_micros("ts")) / 1000000).cast("long").alias("wait_s"))


@query("ledger_summary", """SELECT count(*) AS discovered, count(*) FILTER (WHERE event_type = 'purchase') AS processed, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'view')) AS failed, count(*) FILTER (WHERE event_type = 'view') AS skipped FROM events""")
def ledger_summary(spark, sf):
    r = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "skipped").otherwise("failed")
    return ingest.scan_summary(b.table(spark, sf, "events").select(r.alias("result")))


@query("library_admission", """WITH RECURSIVE lib AS (SELECT CAST(sum(n_chars) AS BIGINT) AS held FROM documents), cap AS (SELECT (SELECT held FROM lib) + CAST(sum(length(html)) AS BIGINT) // 3 AS cap FROM pages),
up AS MATERIALIZED (SELECT page_id AS id, CAST(length(html) AS BIGINT) AS size, row_number() OVER (ORDER BY page_id % 10, page_id) AS i FROM pages),
walk(i, id, library_bytes, size, fits) AS (SELECT i, id, held, size, held + size <= cap FROM up, lib, cap WHERE i = 1
  UNION ALL SELECT up.i, up.id, w.library_bytes + CASE WHEN w.fits THEN w.size ELSE 0 END, up.size, w.library_bytes + CASE WHEN w.fits THEN w.size ELSE 0 END + up.size <= cap FROM walk w JOIN up ON up.i = w.i + 1, cap)
SELECT id, library_bytes, fits AS admitted FROM walk""")
def library_admission(spark, sf):
    """Every page as an upload, in the order of ten days; a third of their bytes still fit."""
    uploads = b.table(spark, sf, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 10).alias("uploaded_at"), F.length("html").cast("long").alias("size_bytes"))
    stored = b.table(spark, sf, "documents").select(F.col("n_chars").alias("size_bytes"))
    held, coming = stored.agg(F.sum("size_bytes")).first()[0], uploads.agg(F.sum("size_bytes")).first()[0]
    return files.library_admission(uploads, stored, held + coming // 3).select("id", "library_bytes", "admitted")


@query("session_activity_window", f"""WITH {EV}, g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ev),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, epoch_us(min(created_at)) AS started_us, epoch_us(max(created_at) + INTERVAL 6 HOUR) AS ended_us, count(*) AS n_events, count(*) FILTER (WHERE action IN ('like', 'save')) AS n_saved FROM s GROUP BY user_id, sid""")
def session_activity_window(spark, sf):
    w = live.activity_windows(b.interactions(spark, sf), "6 hours")
    return w.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n_events", "n_saved")


@query("session_state", f"""WITH {EV} SELECT user_id, session_id, last_action, last_book_id FROM (SELECT user_id, session_id, action AS last_action, book_id AS last_book_id, row_number() OVER (PARTITION BY user_id, session_id ORDER BY created_at DESC, id DESC) AS rn FROM ev) WHERE rn = 1""")
def session_state(spark, sf):
    return live.session_states(b.interactions(spark, sf)).select("user_id", "session_id", "last_action", "last_book_id")


# ---- pages, references, generated texts -----------------------------------------
#: Characters of the code points 128 to 159 in web pages, by hand.
HIGH = "€ \u0081 ‚ ƒ „ … † ‡ ˆ ‰ Š ‹ Œ \u008d Ž \u008f \u0090 ‘ ’ “ ” • – — ˜ ™ š › œ \u009d ž Ÿ".split(" ")


def char_sql(n: str) -> str:
    return (f"CASE WHEN {n} BETWEEN 128 AND 159 THEN ({q.words(HIGH)})[{n} - 127] WHEN {n} BETWEEN 1 AND 1114111 AND NOT {n} BETWEEN 55296 AND 57343 "
            f"THEN chr(CAST({n} AS INTEGER)) ELSE chr(65533) END")


def unescape_sql(x: str) -> str:
    names = ", ".join(f"'{name}': {n}" for name, n in sorted(name2codepoint.items()))
    dec, hexed, name = r"'^#([0-9]{1,9});?'", r"'^#[xX]([0-9a-fA-F]{1,8});?'", r"'^([A-Za-z][A-Za-z0-9]*);'"
    part = (f"CASE WHEN regexp_matches(p, {dec}) THEN {char_sql(f'CAST(regexp_extract(p, {dec}, 1) AS BIGINT)')} || regexp_replace(p, {dec}, '') "
            f"WHEN regexp_matches(p, {hexed}) THEN {char_sql(f"CAST('0x' || regexp_extract(p, {hexed}, 1) AS BIGINT)")} || regexp_replace(p, {hexed}, '') "
            f"WHEN MAP {{{names}}}[regexp_extract(p, {name}, 1)] IS NOT NULL THEN chr(MAP {{{names}}}[regexp_extract(p, {name}, 1)]) || regexp_replace(p, {name}, '') ELSE '&' || p END")
    return f"(string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: {part}), ''))"


def html_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<script\b[^>]*>.*?</(?:script|style)\s*>|<style\b[^>]*>.*?</(?:script|style)\s*>', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '<!?/?[A-Za-z][^>]*>', ' ', 'g')"
    return x


REFERENCES = """html || ' &#' || (page_id * 37 % 1200000) || '; &#x' || format('{:X}', page_id * 91 % 70000) || ';&mdash;&Eacute; &#' || (page_id % 400 + 127) || 'x &amp;lt; &nosuch; &'"""


@query("html_to_text", f"WITH t AS MATERIALIZED (SELECT page_id, {html_sql(REFERENCES)} AS t FROM pages), u AS MATERIALIZED (SELECT page_id, {unescape_sql('t')} AS t FROM t) SELECT page_id, {q.squeeze('t')} AS body FROM u")
def html_to_text(spark, sf):
    """Every page, with references of its own after it: decimal, hexadecimal, named, unterminated, escaped twice and broken ones."""
    i = F.col("page_id")
    more = F.concat(F.lit(" &#"), (i * 37 % 1200000).cast("string"), F.lit("; &#x"), F.hex(i * 91 % 70000), F.lit(";&mdash;&Eacute; &#"), (i % 400 + 127).cast("string"), F.lit("x &amp;lt; &nosuch; &"))
    return b.table(spark, sf, "pages").select("page_id", tx.html_text(F.concat("html", more)).alias("body"))


@query("url_classify", r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'gs://' || split_part(url, '://', 2) WHEN 2 THEN 'https://drive.google.com/file/d/abcdefghij' || page_id || '/view'
  WHEN 3 THEN 'https://storage.googleapis.com/' || split_part(url, '://', 2) ELSE split_part(url, '://', 2) END AS url FROM pages),
h AS (SELECT *, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM u)
SELECT page_id, CASE WHEN starts_with(url, 'gs://') THEN 'gcs' WHEN h LIKE '%drive.google.com' OR h LIKE '%docs.google.com' THEN 'gdrive' WHEN h = 'storage.googleapis.com' THEN 'gcs' WHEN regexp_matches(url, '^https?://') THEN 'http' ELSE 'unknown' END AS provider,
  nullif(CASE WHEN starts_with(url, 'gs://') THEN regexp_extract(substr(url, 6), '^([^/]+)/.+', 1) WHEN h = 'storage.googleapis.com' THEN regexp_extract(ltrim(p, '/'), '^([^/]+)/.+', 1) END, '') AS bucket,
  nullif(regexp_extract(url, '/(?:file|document|spreadsheets|presentation)/d/([a-zA-Z0-9_-]{10,})', 1), '') AS drive_id,
  nullif(list_extract(string_split(regexp_replace(p, '/+$', ''), '/'), -1), '') AS file_name FROM h""")
def url_classify(spark, sf):
    i, u = F.col("page_id"), F.col("url")
    bare = F.regexp_extract("url", "://(.*)$", 1)
    made = (F.when(i % 5 == 0, u).when(i % 5 == 1, F.concat(F.lit("gs://"), bare))
            .when(i % 5 == 2, F.concat(F.lit("https://drive.google.com/file/d/abcdefghij"), i.cast("string"), F.lit("/view")))
            .when(i % 5 == 3, F.concat(F.lit("https://storage.googleapis.com/"), bare)).otherwise(bare))
    p = b.table(spark, sf, "pages").select("page_id", made.alias("url"))
    c = F.col("url")
    return p.select("page_id", references.provider(c).alias("provider"), references.bucket_object(c)["bucket"].alias("bucket"),
                    references.drive_id(c).alias("drive_id"), references.file_name(c).alias("file_name"))


@query("page_keys", r"""SELECT page_id, 'dataset_' || left(sha1(url), 16) AS stable_id, sha256(html) AS file_hash,
 CASE WHEN starts_with(url, '/') THEN NULL ELSE array_to_string(list_filter(string_split(url, '/'), lambda p: p <> '' AND p <> '.'), '/') END AS member FROM pages""")
def page_keys(spark, sf):
    p = b.table(spark, sf, "pages")
    return p.select("page_id", tx.stable_book_id(F.col("url")).alias("stable_id"), F.sha2("html", 256).alias("file_hash"), tx.member_path(F.col("url")).alias("member"))


@query("json_repair", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events""")
def json_repair(spark, sf):
    ev = b.table(spark, sf, "events").select("event_id", "event_type", "props")
    ev = ev.repartition(4 * spark.sparkContext.defaultParallelism)  # small rows make long texts, and a split of a file may hold no rows
    deep = '{"a":' * 10 + '"}{ \\\\ \\" }"' + "}" * 10
    note = F.concat(F.lit("a } b "), F.lit('{x\\" ' * 5), F.repeat(F.lit("word "), 1500))  # long, with escapes
    body = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', “kind”: {"name": "'), F.col("event_type"), F.lit('", "deep": ' + deep + ', "note": "'), note, F.lit('",},}'))
    broken = F.concat(F.lit("<think>no {json} here</think>\n```json\n"), body, F.lit("\n```"))
    fixed = F.from_json(understanding.repaired_json(broken), "k long, kind struct<name string, note string>")
    return ev.select("event_id", fixed.alias("j")).select("event_id", "j.k", F.col("j.kind.name").alias("kind"))


@query("generated_answers", r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT id, trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, chr(32)||chr(9)||chr(13))), lambda l: l <> ''), ' '), '^$', '')) || ' [1]' AS answer
FROM t WHERE prev IS NOT NULL AND id NOT IN (SELECT id FROM (SELECT id, s, count(*) AS n FROM (SELECT id, trim(unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '\n+', ' ', 'g'), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM t) WHERE length(s) >= 24 GROUP BY ALL) WHERE n >= 3)
UNION ALL SELECT id, 'нет [1]' FROM t WHERE prev IS NOT NULL AND id IN (SELECT id FROM (SELECT id, s, count(*) AS n FROM (SELECT id, trim(unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '\n+', ' ', 'g'), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM t) WHERE length(s) >= 24 GROUP BY ALL) WHERE n >= 3)""")
def generated_answers(spark, sf):
    """Each turn wrapped as a generated answer with service lines, grounded on the turn before it."""
    t = b.table(spark, sf, "conversations")
    prev = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    t = t.join(prev, ["conv_id", "turn"])
    raw = F.concat(F.lit("QUERY:: x\n<answer>SOURCE [1] TITLE::t\n"), F.col("text"), F.lit("\nPLAN:: {}\n</answer> tail"))
    answer = understanding.clean_answer(raw, F.lit("нет"), F.array(F.col("prev")))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), understanding.cited(answer, F.lit(1)).alias("answer"))


def slug_sql(x: str) -> str:
    x = f"lower(trim(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')))"
    for a, c in SLUG_PAIRS:
        x = f"replace({x}, '{a}', '{c}')"
    for a, c in SLUG_ENDINGS:
        x = f"regexp_replace({x}, '{a}\\b', '{c}', 'g')"
    x = f"replace({x}, 'x', 'кс')"
    singles = {k: v for k, v in SLUG_LETTERS.items() if len(v) == 1}
    x = f"translate({x}, '{''.join(singles)}', '{''.join(singles.values())}')"
    x = f"replace(replace({x}, 'йа', 'я'), 'йу', 'ю')"
    return f"array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("slug_author_title", f"""WITH au(slug, name) AS (VALUES {q.rows(list(SLUG_AUTHORS.items()))}), lst AS (SELECT list(slug ORDER BY slug) AS l FROM au),
s AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE CASE WHEN p_partkey % 2 = 0 THEN l[1 + p_partkey % 16] ELSE replace(p_brand, '#', '') END || '_' || replace(p_name, ' ', '_') END AS slug FROM part, lst)
SELECT p_partkey, CASE WHEN contains(slug, ' ') THEN slug ELSE {slug_sql("substr(slug, strpos(slug, '_') + 1)")} END AS title,
  CASE WHEN contains(slug, ' ') THEN '' ELSE coalesce(name, {slug_sql("split_part(slug, '_', 1)")}) END AS author FROM s LEFT JOIN au ON au.slug = split_part(s.slug, '_', 1)""".replace("split_part(slug, '_', 1)", "split_part(s.slug, '_', 1)").replace("substr(slug, strpos(slug,", "substr(s.slug, strpos(s.slug,").replace("contains(slug, ' ') THEN slug", "contains(s.slug, ' ') THEN s.slug").replace("contains(slug, ' ') THEN ''", "contains(s.slug, ' ') THEN ''"))
def slug_author_title(spark, sf):
    p = b.table(spark, sf, "part")
    i = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in sorted(SLUG_AUTHORS)])
    author = F.when(i % 2 == 0, F.get(names, (i % 16).cast("int"))).otherwise(F.replace("p_brand", F.lit("#"), F.lit("")))
    slug = F.when(i % 4 == 0, F.col("p_name")).otherwise(F.concat(author, F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    out = p.select("p_partkey", slug.alias("slug")).select("p_partkey", tx.slug_author_title(F.col("slug"), F.lit("")).alias("s"))
    return out.select("p_partkey", "s.title", "s.author")


@query("source_lines", r"""SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, md5(array_to_string(l, '|')) AS digest FROM (
  SELECT doc_id, list_filter(x, lambda v, i: v <> '' AND list_position(x, v) = i) AS l FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda v: trim(v, chr(32)||chr(10)||chr(13)||chr(9))) AS x FROM documents))""")
def source_lines(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", tx.source_lines(F.col("text")).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "|")).alias("digest"))


@query("point_ids", """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1)) AS INT) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || CAST('dataset_' || doc_id AS BLOB)) AS h FROM documents)""")
def point_ids(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", tx.point_id(F.concat(F.lit("dataset_"), F.col("doc_id").cast("string"))).alias("point_id"))
