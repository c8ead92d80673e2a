"""Registered queries: interactions, taste profiles, feed ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import bindings as b
from lectern.functions import text as tx
from lectern.functions.vectors import settled
from lectern.lexicon import ACTION_STRENGTH, ACTIONS, LATIN
from lectern.operators import features, product, profiles, titles
from lectern.plans import feed
from lectern.registry import sql as q
from lectern.registry.base import query
from lectern.registry.search_terms import long_int
from lectern.registry.vector_features import KEYS, STEMS, shares_sql
from lectern.session import stage

NF = len(LATIN.feature_keys())
CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in b.EVENT_ACTIONS.items())
EV = f"""ev AS MATERIALIZED (SELECT event_id AS id, user_id, json_extract_string(props, '$.k') AS book_id, CASE event_type {CASES} END AS action,
  user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, ts AS created_at, value FROM events)"""
EFF = "eff(action, store, strength, decay) AS (VALUES " + q.rows(profiles.EFFECTS) + ")"
BOOKS = f"""{STEMS}, {KEYS}, first AS (SELECT chunk_id, book_id, toks FROM tokened), {shares_sql('first', 'chunk_id', 'toks')},
bf AS MATERIALIZED (SELECT book_id, ord, k, category, feature, round(avg(score), 9) AS score FROM fs JOIN first USING (chunk_id) GROUP BY ALL)"""
DECAYED = """sum(ln(decay)) OVER (PARTITION BY user_id, store, key ORDER BY created_at DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
STORES = f"""{EV}, {EFF}, {BOOKS},
se AS (SELECT user_id, store, CASE WHEN store = 'session' THEN session_id ELSE '' END AS key, book_id, created_at, id, strength, decay FROM ev JOIN eff USING (action)),
sw AS (SELECT *, strength * exp(coalesce({DECAYED}, 0)) AS weight FROM se),
st AS MATERIALIZED (SELECT user_id, store, key, ord, k, category, feature, sum(weight * score) AS v FROM sw JOIN bf USING (book_id) GROUP BY ALL)"""
AFF = f"""ae AS (SELECT user_id, CASE WHEN action = 'swipe_left' THEN 'negative' ELSE 'positive' END AS sign, created_at, id, author, lang,
  CASE action WHEN 'save' THEN {ACTION_STRENGTH['save']} WHEN 'swipe_right' THEN {ACTION_STRENGTH['swipe_right']} ELSE {ACTION_STRENGTH['swipe_left']} END AS s
  FROM ev JOIN docs USING (book_id) WHERE action IN ('save', 'swipe_right', 'swipe_left')),
ax AS (SELECT user_id, 'author_' || sign AS store, lower(author) AS key, created_at, id, 0.55 * s AS strength, 0.92 AS decay FROM ae
  UNION ALL SELECT user_id, 'genre_' || sign, lower(lang), created_at, id, 0.4 * s, 0.92 FROM ae),
aff AS MATERIALIZED (SELECT user_id, store, key, sum(w) AS value FROM (SELECT *, strength * exp(coalesce({DECAYED}, 0)) AS w FROM ax) GROUP BY ALL)"""


def books(spark, sf):
    scores = features.book_profiles(b.chunks(spark, sf), LATIN)
    return b.catalog(spark, sf).select("book_id", "title", "author", "genres").join(scores, "book_id")


def stores(spark, sf):
    return profiles.feature_stores(b.interactions(spark, sf), stage(books(spark, sf), "books"), NF)


def long_rows(df, keys, col="scores"):
    names = F.array(*[F.lit(k) for k in LATIN.feature_keys()])
    rows = df.select(*keys, F.posexplode(col).alias("i", "v"))
    return rows.select(*keys, F.get(names, F.col("i")).alias("feature"), settled(F.col("v")).alias("value"))


@query("interaction_counters", f"""WITH {EV} SELECT user_id, {', '.join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in ACTIONS)} FROM ev GROUP BY user_id""")
def interaction_counters(spark, sf):
    return profiles.counters(b.interactions(spark, sf))


@query("interaction_intake", f"""WITH {EV}, v AS (SELECT id, CASE WHEN id % 7 = 0 THEN ' Borrow ' WHEN id % 3 = 0 THEN upper(action) ELSE action END AS action, CASE WHEN id % 5 = 0 THEN book_id || 'x' ELSE book_id END AS book_id FROM ev)
SELECT id, lower(trim(action)) AS action, CASE WHEN lower(trim(action)) = 'borrow' THEN 'unsupported action' WHEN d.doc_id IS NULL THEN 'unknown book' ELSE 'accepted' END AS outcome
FROM v LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = v.book_id""")
def interaction_intake(spark, sf):
    e = b.interactions(spark, sf).select("id", "action", "book_id")
    action = F.when(F.col("id") % 7 == 0, " Borrow ").when(F.col("id") % 3 == 0, F.upper("action")).otherwise(F.col("action"))
    e = e.withColumn("action", action).withColumn("book_id", F.when(F.col("id") % 5 == 0, F.concat("book_id", F.lit("x"))).otherwise(F.col("book_id")))
    good, bad = profiles.validated(e, b.catalog(spark, sf))
    return good.select("id", "action", F.lit("accepted").alias("outcome")).unionByName(bad.select("id", "action", F.col("reason").alias("outcome")))


@query("recent_mru_list", f"""WITH {EV}, m(action, list) AS (VALUES ('like', 'seen'), ('save', 'seen'), ('skip', 'seen'), ('swipe_left', 'seen'), ('swipe_right', 'seen'),
  ('like', 'saved'), ('save', 'saved'), ('like', 'favorite'), ('save', 'favorite'), ('save', 'positive'), ('swipe_right', 'positive'), ('swipe_left', 'negative')),
lim(list, n) AS (VALUES ('seen', 128), ('saved', 48), ('favorite', 48), ('positive', 24), ('negative', 24)),
l AS (SELECT user_id, list, book_id, max(id) AS last FROM (SELECT * FROM ev JOIN m USING (action)) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, list ORDER BY last DESC) AS rank FROM l)
SELECT user_id, list, book_id, rank FROM r JOIN lim USING (list) WHERE rank <= n""")
def recent_mru_list(spark, sf):
    return profiles.recent_lists(b.interactions(spark, sf)).select("user_id", "list", "book_id", long_int("rank"))


@query("recent_interactions", """SELECT user_id, event_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 50""")
def recent_interactions(spark, sf):
    return product.recent(b.interactions(spark, sf)).select("user_id", "id", long_int("rank"))


@query("decayed_profile", f"WITH RECURSIVE {q.TOKENED}, {STORES} SELECT user_id, store, k AS feature, {q.rnd('v')} AS value FROM st WHERE store <> 'session'")
def decayed_profile(spark, sf):
    return long_rows(stores(spark, sf).where("store <> 'session'"), ["user_id", "store"])


@query("session_vector", f"WITH RECURSIVE {q.TOKENED}, {STORES} SELECT user_id, key AS session_id, k AS feature, {q.rnd('v')} AS value FROM st WHERE store = 'session'")
def session_vector(spark, sf):
    return long_rows(profiles.session_vectors(stores(spark, sf)), ["user_id", "session_id"], "session")


@query("author_affinity", f"WITH {q.DOCS}, {EV}, {AFF} SELECT user_id, store, key, {q.rnd('value')} AS value FROM aff")
def author_affinity(spark, sf):
    own = b.catalog(spark, sf).select("book_id", "author", "genres")
    return profiles.affinities(b.interactions(spark, sf), own).select("user_id", "store", "key", settled(F.col("value")).alias("value"))


TASTE = """ts AS MATERIALIZED (SELECT user_id, ord, k, category, feature, coalesce(sum(v) FILTER (WHERE store = 'positive'), 0) AS p, coalesce(sum(v) FILTER (WHERE store = 'negative'), 0) AS n,
  coalesce(sum(v) FILTER (WHERE store = 'recent_positive'), 0) AS rp, coalesce(sum(v) FILTER (WHERE store = 'recent_negative'), 0) AS rn FROM st GROUP BY user_id, ord, k, category, feature),
tc AS MATERIALIZED (SELECT *, 0.72 * (p - 0.8 * n) + 0.28 * (rp - 0.7 * rn) AS combined FROM ts)"""


def tastes(spark, sf):
    t = profiles.taste(stores(spark, sf), NF)
    return profiles.with_taste(t.withColumn("session", F.lit(None).cast("array<double>")))


@query("taste_combined", f"WITH RECURSIVE {q.TOKENED}, {STORES}, {TASTE} SELECT user_id, k AS feature, {q.rnd('combined')} AS value FROM tc")
def taste_combined(spark, sf):
    return long_rows(tastes(spark, sf), ["user_id"], "combined")


@query("taste_priorities", f"""WITH RECURSIVE {q.TOKENED}, {STORES}, {TASTE}
SELECT user_id, category, feature, {q.rnd('combined')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY combined DESC, ord) AS pick FROM tc WHERE combined >= 0.08) WHERE pick <= 2""")
def taste_priorities(spark, sf):
    rows = tastes(spark, sf).select("user_id", F.explode(features.dominant(F.col("combined"), LATIN, 0.08)).alias("d"))
    return rows.select("user_id", "d.category", "d.feature", settled(F.col("d.score")).alias("score"))


# ---- scores of (user, book) pairs --------------------------------------------
CAND = """cand AS MATERIALIZED (SELECT user_id, book_id, avg(value) AS search_score FROM (
  SELECT user_id, value, CASE WHEN id % 2 = 1 THEN CAST(CAST(book_id AS INT) + 50 AS VARCHAR) ELSE book_id END AS book_id FROM ev) GROUP BY ALL)"""
MODE = "CASE user_id % 3 WHEN 0 THEN 'similar' WHEN 1 THEN 'new' ELSE 'risk' END"


def cos_sql(a: str, b_: str) -> str:
    return f"CASE WHEN sum({a} * {a}) > 0 AND sum({b_} * {b_}) > 0 THEN round(sum({a} * {b_}) / sqrt(sum({a} * {a}) * sum({b_} * {b_})), 6) ELSE 0 END"


SIMS = f"""{CAND}, sim AS MATERIALIZED (SELECT c.user_id, c.book_id, {cos_sql('bf.score', 'tc.p')} AS pos, {cos_sql('bf.score', 'tc.n')} AS neg,
  {cos_sql('bf.score', 'tc.rp')} - 0.45 * {cos_sql('bf.score', 'tc.rn')} AS recent, {cos_sql('bf.score', '(tc.rp - 0.7 * tc.rn)')} AS sess
  FROM cand c JOIN bf USING (book_id) JOIN tc ON tc.user_id = c.user_id AND tc.k = bf.k GROUP BY c.user_id, c.book_id)"""
def pairs_sql(sims: str = SIMS, named: str = "FALSE") -> str:
    """Profile scores pm(user_id, book_id, mode, ps, ..) of the candidates; `named` tells whether the user named the genre of the book d."""
    return f"""{sims}, {AFF},
seen AS (SELECT DISTINCT user_id, book_id FROM ev), saved AS (SELECT DISTINCT user_id, book_id FROM ev WHERE action IN ('like', 'save')),
pair0 AS (SELECT c.*, pos, neg, recent, sess, coalesce(ap.value, 0) AS apv, coalesce(an.value, 0) AS anv, coalesce(gp.value, 0) AS gpv, coalesce(gn.value, 0) AS gnv, {named} AS named,
    s.book_id IS NOT NULL AS seen, sv.book_id IS NOT NULL AS saved
  FROM cand c JOIN sim USING (user_id, book_id) JOIN docs d USING (book_id)
  LEFT JOIN aff ap ON ap.user_id = c.user_id AND ap.store = 'author_positive' AND ap.key = lower(d.author)
  LEFT JOIN aff an ON an.user_id = c.user_id AND an.store = 'author_negative' AND an.key = lower(d.author)
  LEFT JOIN aff gp ON gp.user_id = c.user_id AND gp.store = 'genre_positive' AND gp.key = lower(d.lang)
  LEFT JOIN aff gn ON gn.user_id = c.user_id AND gn.store = 'genre_negative' AND gn.key = lower(d.lang)
  LEFT JOIN seen s ON s.user_id = c.user_id AND s.book_id = c.book_id LEFT JOIN saved sv ON sv.user_id = c.user_id AND sv.book_id = c.book_id),
pair AS MATERIALIZED (SELECT *, least(0.6, apv * 0.25) - least(0.8, anv * 0.3) AS aa, CASE WHEN named THEN 0.2 ELSE 0 END + least(0.15, gpv * 0.08) - least(0.18, gnv * 0.1) AS ga, CASE WHEN seen THEN 0.35 ELSE 0 END AS sp FROM pair0),
modes(mode) AS (VALUES ('similar'), ('new'), ('risk')),
pm AS MATERIALIZED (SELECT pair.*, mode, CAST(round(CAST(CASE mode
  WHEN 'new' THEN 0.38 * pos + 0.16 * recent + 0.28 * greatest(0, 1 - pos) - 0.22 * neg + 0.08 * sess + 0.08 * aa + 0.08 * ga - sp
  WHEN 'risk' THEN 0.26 * pos + 0.14 * recent + 0.36 * greatest(0, 1 - abs(pos - 0.55)) - 0.18 * neg + 0.12 * sess + 0.06 * aa + 0.08 * ga - 0.1 * sp
  ELSE 0.58 * pos + 0.2 * recent + 0.1 * sess + 0.08 * aa + 0.1 * ga - 0.32 * neg - sp END AS DECIMAL(28, 10)), 6) AS DOUBLE) AS ps FROM pair, modes)"""


PAIRS = pairs_sql()


def candidates(spark, sf):
    ev = b.interactions(spark, sf)
    book = F.when(F.col("id") % 2 == 1, (F.col("book_id").cast("int") + 50).cast("string")).otherwise(F.col("book_id"))
    return ev.withColumn("book_id", book).groupBy("user_id", "book_id").agg(F.avg("value").alias("search_score"))


def parts(spark, sf):
    """(events, books, taste, affinity, lists) of the interaction log."""
    ev = b.interactions(spark, sf)
    bk = stage(books(spark, sf), "books")
    st = profiles.feature_stores(ev, bk, NF)
    return ev, bk, st, profiles.affinities(ev, bk), profiles.memberships(ev)


@query("profile_book_cosine", f"""WITH RECURSIVE {q.TOKENED}, {STORES}, {TASTE}, {SIMS}
SELECT user_id, book_id, pos, neg, {q.rnd('recent', 9)} AS recent, sess FROM sim""")
def profile_book_cosine(spark, sf):
    _, bk, st, _, _ = parts(spark, sf)
    t = profiles.with_taste(profiles.taste(st, NF).withColumn("session", F.lit(None).cast("array<double>")))
    r = candidates(spark, sf).join(bk.select("book_id", "scores"), "book_id").join(t, "user_id")
    cos = lambda c: profiles.cosine(F.col("scores"), F.col(c))
    return r.select("user_id", "book_id", cos("positive").alias("pos"), cos("negative").alias("neg"),
                    F.round(cos("recent_positive") - cos("recent_negative") * 0.45, 9).alias("recent"), cos("session_taste").alias("sess"))


def paired(spark, sf):
    _, bk, st, affinity, lists = parts(spark, sf)
    t = profiles.with_taste(profiles.taste(st, NF).withColumn("session", F.lit(None).cast("array<double>")))
    r = candidates(spark, sf).join(bk.select("book_id", "scores"), "book_id").join(t, "user_id")
    seen = lists.where("list = 'seen'").select("user_id", "book_id", F.lit(True).alias("s"))
    r = r.join(seen, ["user_id", "book_id"], "left").withColumn("seen", F.col("s").isNotNull()).drop("s")
    return profiles.affinity_columns(r, affinity, bk)


@query("profile_score_modes", f"""WITH RECURSIVE {q.TOKENED}, {STORES}, {TASTE}, {PAIRS}
SELECT user_id, book_id, mode, ps AS score, {q.rnd('aa')} AS author_affinity, {q.rnd('ga')} AS genre_affinity FROM pm""")
def profile_score_modes(spark, sf):
    r = paired(spark, sf).withColumn("mode", F.explode(F.array(F.lit("similar"), F.lit("new"), F.lit("risk"))))
    return profiles.scored(r).select("user_id", "book_id", "mode", F.col("profile_score").alias("score"),
                                     settled(F.col("author_affinity")).alias("author_affinity"), settled(F.col("genre_affinity")).alias("genre_affinity"))


@query("feed_minmax", f"""WITH {EV}, {CAND} SELECT user_id, book_id, round(CASE WHEN max(search_score) OVER w - min(search_score) OVER w <= 1e-9 THEN CASE WHEN max(search_score) OVER w > 0 THEN 1 ELSE 0 END
  ELSE (search_score - min(search_score) OVER w) / nullif(max(search_score) OVER w - min(search_score) OVER w, 0) END, 6) AS search_norm FROM cand WINDOW w AS (PARTITION BY user_id)""")
def feed_minmax(spark, sf):
    return feed.min_max(candidates(spark, sf), "search_score", "search_norm", "user_id").select("user_id", "book_id", F.round("search_norm", 6).alias("search_norm"))


def feed_sql(pairs: str = PAIRS, match: str = "0") -> str:
    """Ranked feeds fk(user_id, book_id, score, place, total); `match` is the query match of a row of f3."""
    return f"""{pairs},
f0 AS (SELECT * FROM pm WHERE mode = {MODE}),
f1 AS (SELECT *, CASE WHEN max(search_score) OVER w - min(search_score) OVER w <= 1e-9 THEN CASE WHEN max(search_score) OVER w > 0 THEN 1 ELSE 0 END
  ELSE (search_score - min(search_score) OVER w) / nullif(max(search_score) OVER w - min(search_score) OVER w, 0) END AS sn FROM f0 WINDOW w AS (PARTITION BY user_id)),
f2 AS (SELECT *, greatest(0, least((ps + 1) / 2, 1)) AS pn, CASE WHEN seen THEN 0.24 ELSE 0 END AS sp2,
  CAST(round(CAST(greatest(-1, least(1, least(0.6, apv * 0.25) - least(0.7, anv * 0.3))) AS DECIMAL(28, 10)), 6) AS DOUBLE) AS ab, CAST(round(CAST(greatest(-1, least(1, CASE WHEN named THEN 0.55 ELSE 0 END + least(0.3, gpv * 0.12) - least(0.35, gnv * 0.15))) AS DECIMAL(28, 10)), 6) AS DOUBLE) AS gb,
  CAST(round(CAST(least(1, 0.58 * greatest(0, recent) + 0.42 * greatest(0, sess)) AS DECIMAL(28, 10)), 6) AS DOUBLE) AS fa FROM f1),
f3 AS (SELECT *, CAST(round(CAST(CASE mode WHEN 'new' THEN 0.6 * CASE WHEN sp2 > 0 THEN 0 ELSE 1 END + 0.35 * greatest(0, 1 - pn)
  WHEN 'risk' THEN 0.75 * greatest(0, 1 - abs(pn - 0.45)) + 0.2 * CASE WHEN sp2 > 0 THEN 0 ELSE 1 END ELSE 0.15 * CASE WHEN sp2 > 0 THEN 0 ELSE 1 END + 0.05 * greatest(0, 1 - pn) END AS DECIMAL(28, 10)), 6) AS DOUBLE) AS xb FROM f2),
fr AS MATERIALIZED (SELECT *, CAST(round(CAST(0.35 * sn + 0.25 * pn + 0.08 * ({match}) + 0.08 * greatest(0, ab) + 0.08 * greatest(0, gb) + 0.1 * fa + 0.06 * xb - sp2 AS DECIMAL(28, 10)), 6) AS DOUBLE) AS score FROM f3),
fk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM fr)"""


FEED = feed_sql()


def requests(spark, sf, offset=0, limit=10, exclude=None, mode=None):
    """One profile feed request per user of the log."""
    users = b.table(spark, sf, "events").select("user_id").distinct()
    m = F.element_at(F.array(F.lit("similar"), F.lit("new"), F.lit("risk")), (F.col("user_id") % 3 + 1).cast("int")) if mode is None else F.lit(mode)
    none = F.lit(None).cast("string")
    r = users.select(F.col("user_id").alias("req_id"), "user_id", m.alias("mode"), none.alias("search_context"), none.alias("recommendation_context"),
                     F.lit(limit).alias("limit"), none.alias("session_id"), none.alias("query"), none.alias("cursor"), F.lit(offset).alias("offset"),
                     (exclude if exclude is not None else F.array().cast("array<string>")).alias("exclude_book_ids"))
    return feed.with_contexts(r)


def plain_books(bk):
    """Book columns for ranking without passports: the text to match is the title."""
    none = F.array().cast("array<string>")
    return bk.select("book_id", "title", "author", "genres", none.alias("moods"), none.alias("hints"), none.alias("style"), none.alias("tags"),
                     F.lit("").alias("summary"), tx.normalize_label(F.col("title")).alias("matchable"), "scores")


def ranked(spark, sf, req):
    _, bk, st, affinity, lists = parts(spark, sf)
    cand = candidates(spark, sf).withColumnRenamed("user_id", "req_id")
    return feed.ranked_feed(req, cand, plain_books(bk), profiles.taste(st, NF), profiles.session_vectors(st), affinity, lists)


@query("feed_rank_profile", f"""WITH RECURSIVE {q.TOKENED}, {STORES}, {TASTE}, {FEED}
SELECT user_id, book_id, mode, score, {q.rnd('pn', 7)} AS profile_norm, xb AS exploration, fa AS feedback FROM fr""")
def feed_rank_profile(spark, sf):
    r = ranked(spark, sf, requests(spark, sf))
    return r.select("user_id", "book_id", "mode", "score", settled(F.col("profile_norm"), 7).alias("profile_norm"),
                    F.col("exploration_bonus").alias("exploration"), F.col("feedback_alignment").alias("feedback"))


@query("feed_page_2", f"""WITH RECURSIVE {q.TOKENED}, {STORES}, {TASTE}, {FEED}
SELECT user_id, book_id, place, CASE WHEN least(20, total) < total THEN CAST(least(20, total) AS VARCHAR) END AS next_cursor FROM fk WHERE place > 10 AND place <= 20""")
def feed_page_2(spark, sf):
    p = feed.page(ranked(spark, sf, requests(spark, sf, offset=10)))
    return p.select("user_id", "book_id", long_int("place"), "next_cursor")


@query("feed_exclude_seen", f"""WITH {EV}, {CAND}, ex AS (SELECT user_id, CAST(user_id % 100 AS VARCHAR) AS book_id FROM cand),
seen AS (SELECT DISTINCT user_id, book_id FROM ev), saved AS (SELECT DISTINCT user_id, book_id FROM ev WHERE action IN ('like', 'save'))
SELECT user_id, book_id FROM cand c WHERE book_id <> CAST(user_id % 100 AS VARCHAR)
  AND (NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = c.user_id AND s.book_id = c.book_id) OR EXISTS (SELECT 1 FROM saved s WHERE s.user_id = c.user_id AND s.book_id = c.book_id))""")
def feed_exclude_seen(spark, sf):
    req = requests(spark, sf, mode="similar", exclude=F.array((F.col("user_id") % 100).cast("string")))
    lists = profiles.memberships(b.interactions(spark, sf))
    cand = candidates(spark, sf).withColumnRenamed("user_id", "req_id")
    return feed.not_excluded(cand, req, lists).select(F.col("req_id").alias("user_id"), "book_id")


@query("cold_start_fill", f"""WITH RECURSIVE {q.TOKENED}, {EV}, {BOOKS}, us AS (SELECT DISTINCT user_id FROM ev),
rich AS (SELECT book_id, round(sum(greatest(score, 0)), 6) AS r FROM bf GROUP BY book_id),
cold AS (SELECT book_id, row_number() OVER (ORDER BY r DESC, book_id) AS i FROM rich),
c0 AS (SELECT user_id, book_id, 0 AS src FROM (SELECT DISTINCT user_id, book_id FROM ev WHERE action = 'save' AND book_id IN (SELECT book_id FROM docs)) WHERE (user_id + CAST(book_id AS INT)) % 4 = 0),
n0 AS (SELECT us.user_id, count(c0.book_id) AS n FROM us LEFT JOIN c0 USING (user_id) GROUP BY us.user_id),
c1 AS (SELECT user_id, book_id, src FROM c0 UNION ALL SELECT n0.user_id, cold.book_id, 1000 + i - 1 FROM n0, cold WHERE n <= 10 AND i <= 20
  AND NOT EXISTS (SELECT 1 FROM c0 x WHERE x.user_id = n0.user_id AND x.book_id = cold.book_id)),
seen AS (SELECT DISTINCT user_id, book_id FROM ev), saved AS (SELECT DISTINCT user_id, book_id FROM ev WHERE action IN ('like', 'save')),
blocked AS (SELECT user_id, book_id FROM seen EXCEPT SELECT user_id, book_id FROM saved),
ex AS (SELECT user_id, book_id FROM us, (SELECT book_id FROM cold WHERE i % 2 = 0 AND i <= 20)),
c2 AS MATERIALIZED (SELECT * FROM c1 WHERE NOT EXISTS (SELECT 1 FROM blocked k WHERE k.user_id = c1.user_id AND k.book_id = c1.book_id) AND NOT EXISTS (SELECT 1 FROM ex k WHERE k.user_id = c1.user_id AND k.book_id = c1.book_id)),
n2 AS (SELECT us.user_id, count(c2.book_id) AS n FROM us LEFT JOIN c2 USING (user_id) GROUP BY us.user_id),
m AS (SELECT n2.user_id, cold.book_id, n, row_number() OVER (PARTITION BY n2.user_id ORDER BY i) AS k FROM n2, cold WHERE n <= 10 AND i <= 30
  AND NOT EXISTS (SELECT 1 FROM c2 x WHERE x.user_id = n2.user_id AND x.book_id = cold.book_id)
  AND NOT EXISTS (SELECT 1 FROM blocked k WHERE k.user_id = n2.user_id AND k.book_id = cold.book_id) AND NOT EXISTS (SELECT 1 FROM ex k WHERE k.user_id = n2.user_id AND k.book_id = cold.book_id))
SELECT user_id, book_id, 'kept' AS origin FROM c2 WHERE src = 0 UNION ALL SELECT user_id, book_id, 'cold' FROM c2 WHERE src > 0 UNION ALL SELECT user_id, book_id, 'cold' FROM m WHERE k <= 20 - n""")
def cold_start_fill(spark, sf):
    ev = b.interactions(spark, sf)
    bk = stage(books(spark, sf), "books")
    saved = ev.where("action = 'save'").select(F.col("user_id").alias("req_id"), "book_id").distinct().join(bk.select("book_id"), "book_id", "left_semi")
    none = F.array().cast("array<string>")
    cand = saved.where((F.col("req_id") + F.col("book_id").cast("int")) % 4 == 0).select(
        "req_id", "book_id", F.lit(1.0).alias("search_score"), F.lit("").alias("snippet"), none.alias("matched_queries"), F.lit(0).alias("source"))
    cold = feed.cold_start(bk, 20).agg(F.array_sort(F.collect_list(F.struct((-F.col("richness")).alias("r"), "book_id"))).alias("c")).scalar()
    every_other = F.transform(F.filter("cold", lambda x, i: i % 2 == 1), lambda x: x["book_id"])
    req = requests(spark, sf, mode="similar").withColumn("cold", cold).withColumn("exclude_book_ids", every_other).drop("cold")
    out = feed.filled(cand, req, profiles.memberships(ev), bk)
    return out.select(F.col("req_id").alias("user_id"), "book_id", F.when(F.col("source") == 0, "kept").otherwise("cold").alias("origin"))


@query("context_resolution", """WITH r AS (SELECT event_id AS req_id, CASE event_id % 4 WHEN 0 THEN 'Query ' WHEN 1 THEN 'profile' WHEN 2 THEN '' ELSE 'other' END AS sc,
  CASE event_id % 3 WHEN 0 THEN 'query' WHEN 1 THEN NULL ELSE 'PROFILE' END AS rc, CASE WHEN event_id % 5 < 2 THEN event_type ELSE '  ' END AS qy FROM events),
n AS (SELECT *, CASE WHEN lower(trim(sc)) IN ('profile', 'query') THEN lower(trim(sc)) END AS s, CASE WHEN lower(trim(rc)) IN ('profile', 'query') THEN lower(trim(rc)) END AS r FROM r),
c AS (SELECT *, coalesce(s, r, CASE WHEN trim(qy) <> '' THEN 'query' ELSE 'profile' END) AS ctx FROM n)
SELECT req_id, ctx AS search_context, ctx AS recommendation_context, CASE WHEN ctx = 'query' THEN 'query_only' WHEN trim(qy) <> '' THEN 'profile_with_query' ELSE 'profile_only' END AS request_mode FROM c""")
def context_resolution(spark, sf):
    i = F.col("event_id")
    r = b.table(spark, sf, "events").select(
        i.alias("req_id"), F.element_at(F.array(F.lit("Query "), F.lit("profile"), F.lit(""), F.lit("other")), (i % 4 + 1).cast("int")).alias("search_context"),
        F.when(i % 3 == 0, "query").when(i % 3 == 2, "PROFILE").alias("recommendation_context"), F.when(i % 5 < 2, F.col("event_type")).otherwise("  ").alias("query"))
    return feed.with_contexts(r).select("req_id", "search_context", "recommendation_context", "request_mode")


@query("candidate_union_merge", """WITH c AS (SELECT user_id AS req_id, json_extract_string(props, '$.k') AS book_id, value, event_type AS mq, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS src,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || '-' || value END AS snip FROM events)
SELECT req_id, book_id, max(value) AS search_score, coalesce(arg_min(snip, (src, snip)) FILTER (WHERE snip <> ''), '') AS snippet, (SELECT string_agg(m, '|' ORDER BY s) FROM (SELECT DISTINCT x.mq AS m, x.src AS s FROM c x WHERE x.req_id = c.req_id AND x.book_id = c.book_id)) AS matched FROM c GROUP BY req_id, book_id""")
def candidate_union_merge(spark, sf):
    ev = b.table(spark, sf, "events")
    src = F.array_position(F.array(*[F.lit(x) for x in ("view", "click", "signup", "error", "purchase")]), F.col("event_type")) - 1
    snip = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat_ws("-", "event_type", F.col("value").cast("string")))
    rows = ev.select(F.col("user_id").alias("req_id"), F.get_json_object("props", "$.k").alias("book_id"), F.col("value").alias("search_score"),
                     snip.alias("snippet"), F.col("event_type").alias("matched_query"), src.alias("source"))
    m = feed.merge_candidates(rows)
    return m.select("req_id", "book_id", "search_score", "snippet", F.array_join("matched_queries", "|").alias("matched"))


# ---- profile life cycle ----------------------------------------------------------
TAGS = {0: ("that", "ORRE"), 1: ("inor", "sich")}  # favourite tags of the answers, by user


def onboarding(spark, sf):
    """Answers of every second user: tags, a tag to avoid, a language and a source."""
    none = F.array().cast("array<string>")
    u = b.table(spark, sf, "events").select("user_id").distinct().where("user_id % 2 = 0")
    tags = F.when(F.col("user_id") % 4 == 0, F.array(*[F.lit(x) for x in TAGS[0]])).otherwise(F.array(*[F.lit(x) for x in TAGS[1]]))
    lang = F.get(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (F.col("user_id") % 3).cast("int"))
    return u.select("user_id", tags.alias("favorite_moods"), none.alias("favorite_atmosphere"), none.alias("favorite_tone"), none.alias("favorite_style"), none.alias("favorite_plot"),
                    F.array(F.lit("ench")).alias("avoid_tags"), none.alias("favorite_books"), F.array(lang, F.upper(lang)).alias("favorite_genres"), F.array(F.lit("src1")).alias("favorite_authors"))


CUT = "cutoff AS (SELECT TIMESTAMP '2024-01-18 00:00:00' AS t)"


def snapshots(ev, bk):
    """Snapshots of every third user as of a day within the log; those of every sixth lack fields."""
    cut = F.lit("2024-01-18").cast("timestamp")
    early = stage(ev.where((F.col("user_id") % 3 == 0) & (F.col("created_at") <= cut)), "early-events")
    t = profiles.taste(profiles.feature_stores(early, bk, NF), NF)
    counts = F.map_from_arrays(F.array(*[F.lit(a) for a in ACTIONS]), F.array(*[F.col(a) for a in ACTIONS]))
    s = profiles.ensured(early, t, NF).join(profiles.counters(early).select("user_id", counts.alias("counters")), "user_id")
    one = lambda x: F.array(F.lit(x))
    return s.withColumn("preferred_genres", one("old")).withColumn("preferred_authors", one("older")).withColumn("complete", F.col("user_id") % 6 != 0).withColumn("recomputed_at", cut)


def lives(spark, sf):
    ev = b.interactions(spark, sf)
    bk = stage(books(spark, sf), "books")
    keys = titles.title_keys(b.catalog(spark, sf))
    return stage(profiles.rebuilt(stage(snapshots(ev, bk), "snapshots"), onboarding(spark, sf), ev, bk, keys, LATIN, fuzzy=False), "profiles")


ADDED = "coalesce(st.v, 0) + CASE WHEN blend AND store IN ('positive', 'negative') THEN coalesce(ld.d, 1) * (coalesce(ob.v, 0) - 0.08 * coalesce(es.v, 0)) ELSE 0 END"


@query("profile_snapshot", f"""WITH RECURSIVE {q.TOKENED}, {STORES}, {CUT},
old AS (SELECT DISTINCT user_id FROM ev, cutoff WHERE user_id % 3 = 0 AND created_at <= t), fx AS (SELECT * FROM se SEMI JOIN bf USING (book_id)),
ew AS (SELECT *, strength * exp(coalesce({DECAYED}, 0)) AS weight FROM (SELECT fx.* FROM fx SEMI JOIN old USING (user_id), cutoff WHERE created_at <= t)),
es AS (SELECT user_id, store, k, sum(weight * score) AS v FROM ew JOIN bf USING (book_id) WHERE store <> 'session' GROUP BY ALL),
ld AS (SELECT user_id, store, exp(sum(ln(decay))) AS d FROM fx, cutoff WHERE store <> 'session' AND (NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = fx.user_id) OR created_at > t) GROUP BY ALL),
ob AS (SELECT DISTINCT user_id, 'positive' AS store, unnest(CASE WHEN user_id % 4 = 0 THEN ['mood.that', 'plot.orre'] ELSE ['atmosphere.inor', 'style.sich'] END) AS k, 0.3::DOUBLE AS v FROM ev WHERE user_id % 2 = 0
  UNION ALL SELECT DISTINCT user_id, 'negative', 'characters.ench', 0.27::DOUBLE FROM ev WHERE user_id % 2 = 0),
us AS (SELECT DISTINCT user_id, user_id % 2 = 0 AND (user_id % 6 = 0 OR user_id NOT IN (SELECT user_id FROM old)) AS blend FROM ev),
cells AS (SELECT user_id, blend, store, k FROM us, (VALUES ('positive'), ('negative'), ('recent_positive'), ('recent_negative')) s(store), keys)
SELECT user_id, store, k AS feature, {q.rnd(ADDED)} AS value FROM cells LEFT JOIN st USING (user_id, store, k) LEFT JOIN es USING (user_id, store, k) LEFT JOIN ob USING (user_id, store, k) LEFT JOIN ld USING (user_id, store)""")
def profile_snapshot(spark, sf):
    """The stores of every user, rebuilt from snapshots of some, answers of some and the log."""
    rows = lives(spark, sf).select("user_id", F.explode(F.array(*[F.struct(F.lit(s).alias("store"), F.col(s).alias("scores")) for s in profiles.STORES])).alias("s"))
    return long_rows(rows.select("user_id", "s.store", "s.scores"), ["user_id", "store"])


@query("profile_summary", f"""WITH {EV}, {CUT}, old AS (SELECT DISTINCT user_id FROM ev, cutoff WHERE user_id % 3 = 0 AND created_at <= t),
u AS (SELECT user_id, {', '.join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in ACTIONS)}, count(*) FILTER (WHERE created_at > t) AS late FROM ev, cutoff GROUP BY user_id),
w AS (SELECT u.*, old.user_id IS NOT NULL AS kept, u.user_id % 2 = 0 AND (old.user_id IS NULL OR u.user_id % 6 = 0) AS blend FROM u LEFT JOIN old ON old.user_id = u.user_id)
SELECT user_id, {', '.join(f'"{a}"' for a in ACTIONS)}, CASE WHEN blend THEN (['en', 'de', 'fr'])[1 + user_id % 3] WHEN kept THEN 'old' ELSE '' END AS genres, CASE WHEN blend THEN 'src1' WHEN kept THEN 'older' ELSE '' END AS authors,
  concat_ws('+', CASE WHEN kept THEN 'snapshot' END, CASE WHEN blend THEN 'onboarding' END, CASE WHEN NOT kept OR late > 0 THEN 'events' END) AS source FROM w""")
def profile_summary(spark, sf):
    """Counters, named genres and authors and the origin of every rebuilt profile."""
    p = lives(spark, sf)
    return p.select("user_id", *[F.col("counters")[a].alias(a) for a in ACTIONS], F.array_join("preferred_genres", "|").alias("genres"), F.array_join("preferred_authors", "|").alias("authors"), "source")
