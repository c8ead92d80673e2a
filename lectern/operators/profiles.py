"""Taste profiles folded from interaction logs, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions import text as tx
from lectern.functions.binding import let
from lectern.functions.vectors import settled
from lectern.lexicon import ACTION_STRENGTH, ACTIONS, Lexicon, RUSSIAN
from lectern.operators import features, titles
from lectern.operators.terms import top_per
from lectern.session import stage

POSITIVE, NEGATIVE, FAVORITE = ("save", "swipe_right"), ("swipe_left",), ("like", "save")
STORES = ("positive", "negative", "recent_positive", "recent_negative")

# What an action adds to a store, and how much of the store it leaves.
EFFECTS = [
    (a, store, base * ACTION_STRENGTH[a], decay)
    for actions, store, base, decay in (
        (POSITIVE, "positive", 0.32, 0.985), (POSITIVE, "recent_positive", 0.55, 0.72), (POSITIVE, "session", 0.48, 0.68),
        (NEGATIVE, "negative", 0.34, 0.985), (NEGATIVE, "recent_negative", 0.58, 0.72), (NEGATIVE, "session", -0.28, 0.68),
    )
    for a in actions
] + [("skip", "recent_negative", 0.18 * ACTION_STRENGTH["skip"], 0.75), ("skip", "session", -0.06 * ACTION_STRENGTH["skip"], 0.72)]
AFFINITY_BASE = {"author": 0.55, "genre": 0.4}
AFFINITY_DECAY = 0.92
LIST_LIMITS = {"seen": 128, "saved": 48, "favorite": 48, "positive": 24, "negative": 24}


# ---- intake --------------------------------------------------------------------
def validated(events: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): the action must be one of six and the book must exist."""
    e = events.withColumn("action", F.lower(tx.strip(F.col("action"))))
    known = catalog.select("book_id", F.lit(True).alias("known")).distinct()
    e = e.join(known, "book_id", "left")
    reason = F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unsupported action").when(F.col("known").isNull(), "unknown book")
    e = e.withColumn("reason", reason).drop("known")
    return e.where("reason IS NULL").drop("reason"), e.where("reason IS NOT NULL")


def counters(events: DataFrame) -> DataFrame:
    """Interactions per user and action, zero-filled."""
    cols = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
    return events.groupBy("user_id").agg(*cols)


# ---- decayed folds ---------------------------------------------------------------
def decayed(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Add `weight` = strength times the decays of all later effects of the same key.

    `effects` has the keys, created_at, id, strength and decay. The sum over later
    effects is taken in two levels, days and then within a day, so a key that holds
    a large part of the log is split by day instead of being ordered in one task.
    """
    e = effects.withColumn("day", F.to_date("created_at")).withColumn("ld", F.log("decay"))
    days = e.groupBy(*keys, "day").agg(F.sum("ld").alias("ld"))
    later_days = W.partitionBy(*keys).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)
    days = days.select(*keys, "day", F.coalesce(F.sum("ld").over(later_days), F.lit(0.0)).alias("after"))
    same_day = W.partitionBy(*keys, "day").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("within", F.coalesce(F.sum("ld").over(same_day), F.lit(0.0))).join(days, [*keys, "day"])
    return e.withColumn("weight", F.col("strength") * F.exp(F.col("within") + F.col("after"))).drop("day", "ld", "within", "after")


def store_effects(events: DataFrame) -> DataFrame:
    """(user_id, store, key, book_id, created_at, id, strength, decay): the key is the session of a session store."""
    by_action = {}
    for action, store, strength, decay in EFFECTS:
        by_action.setdefault(action, []).append(F.struct(F.lit(store).alias("store"), F.lit(strength).alias("strength"), F.lit(decay).alias("decay")))
    table = F.create_map(*[x for a, rows in by_action.items() for x in (F.lit(a), F.array(*rows))])
    rows = events.select("user_id", "session_id", "book_id", "created_at", "id", F.explode(F.try_element_at(table, F.col("action"))).alias("e"))
    rows = rows.where((F.col("e.store") != "session") | (F.coalesce("session_id", F.lit("")) != ""))
    key = F.when(F.col("e.store") == "session", F.col("session_id")).otherwise("")
    return rows.select("user_id", F.col("e.store").alias("store"), key.alias("key"), "book_id", "created_at", "id", F.col("e.strength").alias("strength"), F.col("e.decay").alias("decay"))


def feature_stores(events: DataFrame, books: DataFrame, size: int) -> DataFrame:
    """(user_id, store, key, scores): the decayed sum of the features of the books behind each store.

    Weights are summed per book first, so the feature arrays are joined once per (store, book).
    """
    weights = decayed(store_effects(events), ["user_id", "store", "key"])
    per_book = weights.groupBy("user_id", "store", "key", "book_id").agg(F.sum("weight").alias("weight"))
    rows = per_book.join(books.select("book_id", "scores"), "book_id")
    sums = [F.sum(F.col("weight") * F.get("scores", F.lit(i))) for i in range(size)]
    return rows.groupBy("user_id", "store", "key").agg(F.array(*sums).alias("scores"))


def composed(events: DataFrame, books: DataFrame, size: int) -> DataFrame:
    """(user_id, store, key, decay, shift): what a batch does to each store, as one step: the store times `decay`, plus `shift`.

    Each event is such a step, and steps put one after the other are one again. Spark composes them per user, day and
    store, so a user with very many events in a batch is not one task's work.
    """
    # Only books that occur are joined: a log of few books against a large catalog is not shuffled by book.
    books = stage(books.select("book_id", "scores").join(events.select("book_id").distinct(), "book_id", "left_semi"), "books-met")
    known = events.join(books.select("book_id"), "book_id", "left_semi")
    shift = feature_stores(known, books, size).withColumnRenamed("scores", "shift")
    decay = store_effects(known).groupBy("user_id", "store", "key").agg(F.exp(F.sum(F.log("decay"))).alias("decay"))
    return shift.join(decay, ["user_id", "store", "key"])


def affinities(events: DataFrame, books: DataFrame) -> DataFrame:
    """(user_id, store, key, value): author_/genre_ positive/negative affinities; only the touched key decays."""
    strength = F.create_map(*[F.lit(x) for kv in ACTION_STRENGTH.items() for x in kv])
    e = events.where(F.col("action").isin(*POSITIVE, *NEGATIVE)).join(books.select("book_id", "author", "genres"), "book_id")
    sign = F.when(F.col("action").isin(*POSITIVE), "positive").otherwise("negative")
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), tx.normalize_label(c).alias("key"), F.lit(AFFINITY_BASE[kind]).alias("base"))
    touched = F.concat(F.array(one("author", F.col("author"))), F.transform("genres", lambda g: one("genre", g)))
    e = e.select("user_id", "created_at", "id", sign.alias("sign"), F.try_element_at(strength, F.col("action")).alias("s"), F.explode(touched).alias("t")).where("t.key <> ''")
    e = e.select("user_id", F.concat_ws("_", "t.kind", "sign").alias("store"), F.col("t.key").alias("key"), "created_at", "id",
                 (F.col("t.base") * F.col("s")).alias("strength"), F.lit(AFFINITY_DECAY).alias("decay"))
    return decayed(e, ["user_id", "store", "key"]).groupBy("user_id", "store", "key").agg(F.sum("weight").alias("value"))


def recent_lists(events: DataFrame) -> DataFrame:
    """(user_id, list, book_id, rank): distinct books, latest first, within the limit of each list. For show; to exclude books take `memberships`."""
    last = memberships(events)
    limit = F.create_map(*[F.lit(x) for kv in LIST_LIMITS.items() for x in kv])
    top = top_per(last, ["user_id", "list"], [F.desc("last")], max(LIST_LIMITS.values()))
    return top.where(F.col("rank") <= F.try_element_at(limit, F.col("list"))).select("user_id", "list", "book_id", "rank")


def memberships(events: DataFrame) -> DataFrame:
    """(user_id, list, book_id, last): every book a user has seen, saved, liked or disliked, however long ago."""
    member = F.array_compact(F.array(
        F.lit("seen"), F.when(F.col("action").isin(*FAVORITE), F.lit("saved")), F.when(F.col("action").isin(*FAVORITE), F.lit("favorite")),
        F.when(F.col("action").isin(*POSITIVE), F.lit("positive")), F.when(F.col("action").isin(*NEGATIVE), F.lit("negative"))))
    rows = events.select("user_id", "book_id", "created_at", "id", F.explode(member).alias("list"))
    return rows.groupBy("user_id", "list", "book_id").agg(F.max(F.struct("created_at", "id")).alias("last"))


# ---- taste -----------------------------------------------------------------------
def taste(stores: DataFrame, size: int) -> DataFrame:
    """One row per user with the four feature arrays, zeros where a store is empty."""
    zero = F.array_repeat(F.lit(0.0), size)
    cols = [F.coalesce(F.max(F.when(F.col("store") == s, F.col("scores"))), zero).alias(s) for s in STORES]
    return stores.groupBy("user_id").agg(*cols)


def session_vectors(stores: DataFrame) -> DataFrame:
    return stores.where("store = 'session'").select("user_id", F.col("key").alias("session_id"), F.col("scores").alias("session"))


def mix(a: Column, wa: float, b: Column, wb: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * wa + y * wb)


def long_term(positive: Column, negative: Column) -> Column:
    return mix(positive, 1.0, negative, -0.8)


def session_term(session: Column, recent_positive: Column, recent_negative: Column) -> Column:
    """The session's own vector when there is one, else what was liked less what was disliked recently."""
    return F.coalesce(session, mix(recent_positive, 1.0, recent_negative, -0.7))


def with_taste(profiles: DataFrame) -> DataFrame:
    """Add session_taste and combined taste; a null `session` column means no session was asked for."""
    s = session_term(F.col("session"), F.col("recent_positive"), F.col("recent_negative"))
    p = profiles.withColumn("session_taste", s).withColumn("long_term", long_term(F.col("positive"), F.col("negative")))
    return p.withColumn("combined", mix(F.col("long_term"), 0.72, F.col("session_taste"), 0.28))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two score arrays, zero when either is zero, six places."""
    def of(x, y):
        sums = F.aggregate(F.zip_with(x, y, lambda p, q: F.struct((p * q).alias("pq"), (p * p).alias("pp"), (q * q).alias("qq"))),
                           F.struct(F.lit(0.0).alias("pq"), F.lit(0.0).alias("pp"), F.lit(0.0).alias("qq")),
                           lambda acc, v: F.struct((acc["pq"] + v["pq"]).alias("pq"), (acc["pp"] + v["pp"]).alias("pp"), (acc["qq"] + v["qq"]).alias("qq")))
        return let(sums, lambda s: F.when((s["pp"] > 0) & (s["qq"] > 0), F.round(s["pq"] / F.sqrt(s["pp"] * s["qq"]), 6)).otherwise(0.0))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def affinity_columns(pairs: DataFrame, affinity: DataFrame, books: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """Add to (.., user_id, book_id) the raw affinity figures of the book's author and genres.

    Authors and genres are matched by equi-joins on (user, label). `preferred` is
    (user_id, kind, key) of authors and genres the user named.
    """
    author = books.select("book_id", tx.normalize_label(F.col("author")).alias("akey"))
    genres = books.select("book_id", F.explode(F.transform("genres", tx.normalize_label)).alias("gkey"))
    of = lambda store: affinity.where(F.col("store") == store).select("user_id", "key", "value")
    ids = pairs.select("user_id", "book_id").distinct()
    a = ids.join(author, "book_id")
    a = a.join(of("author_positive").withColumnsRenamed({"key": "akey", "value": "author_pos"}), ["user_id", "akey"], "left")
    a = a.join(of("author_negative").withColumnsRenamed({"key": "akey", "value": "author_neg"}), ["user_id", "akey"], "left")
    g = ids.join(genres, "book_id")
    g = g.join(of("genre_positive").withColumnsRenamed({"key": "gkey", "value": "gp"}), ["user_id", "gkey"], "left")
    g = g.join(of("genre_negative").withColumnsRenamed({"key": "gkey", "value": "gn"}), ["user_id", "gkey"], "left").fillna(0.0, ["gp", "gn"])
    if preferred is not None:
        named = preferred.select("user_id", "kind", "key").distinct()
        a = a.join(named.where("kind = 'author'").select("user_id", F.col("key").alias("akey"), F.lit(1).alias("author_named")), ["user_id", "akey"], "left")
        g = g.join(named.where("kind = 'genre'").select("user_id", F.col("key").alias("gkey"), F.lit(1).alias("named")), ["user_id", "gkey"], "left")
    else:
        a, g = a.withColumn("author_named", F.lit(0)), g.withColumn("named", F.lit(0))
    g = g.fillna(0, ["named"])
    c = F.col
    per = g.groupBy("user_id", "book_id").agg(
        F.sum(c("named") * 0.2 + F.least(F.lit(0.15), c("gp") * 0.08) - F.least(F.lit(0.18), c("gn") * 0.1)).alias("genre_affinity"),
        F.sum(F.least(F.lit(0.3), c("gp") * 0.12) - F.least(F.lit(0.35), c("gn") * 0.15)).alias("genre_lift"), F.max("named").alias("genre_named"))
    a = a.fillna(0.0, ["author_pos", "author_neg"]).fillna(0, ["author_named"]).where("akey <> ''")
    a = a.select("user_id", "book_id", "author_named",
                 (c("author_named") * 0.8 + F.least(F.lit(0.6), c("author_pos") * 0.25) - F.least(F.lit(0.8), c("author_neg") * 0.3)).alias("author_affinity"),
                 (F.least(F.lit(0.6), c("author_pos") * 0.25) - F.least(F.lit(0.7), c("author_neg") * 0.3)).alias("author_lift"))
    out = pairs.join(a, ["user_id", "book_id"], "left").join(per, ["user_id", "book_id"], "left")
    return out.fillna(0.0, ["author_affinity", "author_lift", "genre_affinity", "genre_lift"]).fillna(0, ["author_named", "genre_named"])


def scored(pairs: DataFrame) -> DataFrame:
    """Profile score of rows with scores, the four stores, session_taste, affinities, seen and mode."""
    c = F.col
    p = pairs.withColumn("positive_similarity", cosine(c("scores"), c("positive"))).withColumn("negative_similarity", cosine(c("scores"), c("negative")))
    p = p.withColumn("recent_similarity", cosine(c("scores"), c("recent_positive")) - cosine(c("scores"), c("recent_negative")) * 0.45)
    p = p.withColumn("session_similarity", cosine(c("scores"), c("session_taste")))
    pos, neg, recent, session = c("positive_similarity"), c("negative_similarity"), c("recent_similarity"), c("session_similarity")
    author, genre, seen = c("author_affinity"), c("genre_affinity"), F.when(c("seen"), 0.35).otherwise(0.0)
    fresh = pos * 0.38 + recent * 0.16 + F.greatest(F.lit(0.0), 1.0 - pos) * 0.28 - neg * 0.22 + session * 0.08 + author * 0.08 + genre * 0.08 - seen
    luck = F.greatest(F.lit(0.0), 1.0 - F.abs(pos - 0.55))
    risk = pos * 0.26 + recent * 0.14 + luck * 0.36 - neg * 0.18 + session * 0.12 + author * 0.06 + genre * 0.08 - seen * 0.1
    same = pos * 0.58 + recent * 0.2 + session * 0.1 + author * 0.08 + genre * 0.1 - neg * 0.32 - seen
    score = F.when(c("mode") == "new", fresh).when(c("mode") == "risk", risk).otherwise(same)
    return p.withColumn("profile_score", settled(score))


# ---- onboarding, defaults, summaries ------------------------------------------------
def from_onboarding(onboarding: DataFrame, keys: DataFrame, books: DataFrame, lex: Lexicon = RUSSIAN, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Profile state from onboarding answers: (feature state, affinities).

    Feature state is (user_id, store, scores) to be blended at .5/.45; favourite books
    are matched by title and lend their features, author and genres.
    """
    order = lex.feature_keys()
    tags = F.concat(*[F.coalesce(F.col(f), F.array().cast("array<string>")) for f in
                      ("favorite_moods", "favorite_atmosphere", "favorite_tone", "favorite_style", "favorite_plot")])
    likes = onboarding.select("user_id", F.lit("positive").alias("store"), F.explode(tags).alias("raw"))
    avoids = onboarding.select("user_id", F.lit("negative").alias("store"), F.explode("avoid_tags").alias("raw"))
    mapped = likes.unionByName(avoids).select("user_id", "store", features.feature_key(F.col("raw"), lex).alias("k")).where("k IS NOT NULL")
    tagged = mapped.withColumn("v", F.lit(0.6)).groupBy("user_id", "store", "k").agg(F.sum("v").alias("v"))
    wanted = onboarding.select("user_id", F.posexplode("favorite_books").alias("pos", "query"))
    wanted = wanted.withColumn("query_id", F.concat_ws("/", F.col("user_id").cast("string"), F.col("pos").cast("string")))
    hits = titles.title_matches(wanted.select("query_id", "query"), keys, limit=1, fuzzy=fuzzy)
    loved = wanted.join(hits, "query_id").select("user_id", "pos", "book_id").join(books, "book_id")
    ks = F.array(*[F.lit(k) for k in order])
    lent = loved.select("user_id", F.posexplode("scores").alias("i", "v")).select("user_id", F.lit("positive").alias("store"), F.get(ks, F.col("i")).alias("k"), (F.col("v") * 0.42).alias("v"))
    mystery = onboarding.where(F.lower(F.array_join("favorite_books", " ")).contains("тайн")).select(
        "user_id", F.lit("positive").alias("store"), F.lit("plot.тайна").alias("k"), F.lit(0.35).alias("v"))
    mystery = mystery.where(F.lit("plot.тайна" in order))
    state = tagged.unionByName(lent).unionByName(mystery).groupBy("user_id", "store", "k").agg(F.sum("v").alias("v"))
    sums = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)) for k in order]
    blend = F.when(F.col("store") == "positive", 0.5).otherwise(0.45)
    wide = state.groupBy("user_id", "store").agg(F.array(*sums).alias("raw"))
    stores = wide.withColumn("b", blend).select("user_id", "store", F.transform("raw", lambda x: x * F.col("b")).alias("scores"))

    def named(field, store, base, decay):
        rows = onboarding.select("user_id", F.explode(field).alias("x")).select("user_id", tx.normalize_label(F.col("x")).alias("key")).where("key <> ''")
        n = F.count(F.lit(1))
        return rows.groupBy("user_id", "key").agg(((1 - F.pow(F.lit(decay), n)) / (1 - decay) * base).alias("value")).withColumn("store", F.lit(store))

    lent_a = loved.select("user_id", tx.normalize_label(F.col("author")).alias("key"), F.lit(0.62).alias("value"), F.lit("author_positive").alias("store"))
    lent_g = loved.select("user_id", F.explode(F.transform("genres", tx.normalize_label)).alias("key"), F.lit(0.42).alias("value"), F.lit("genre_positive").alias("store"))
    parts = named("favorite_authors", "author_positive", 0.85, 0.96).unionByName(named("favorite_genres", "genre_positive", 0.8, 0.96))
    parts = parts.unionByName(lent_a).unionByName(lent_g).where("key <> ''")
    return stores, parts.groupBy("user_id", "store", "key").agg(F.sum("value").alias("value"))


def _times(factor: Column):
    return lambda x: x * factor


ONBOARDED, ONBOARDING_DECAY = ("positive", "negative"), 0.92  # fixed: the stores that answers are blended into, and what they leave of what was there


def rebuilt(stored: DataFrame, onboarding: DataFrame, events: DataFrame, books: DataFrame, keys: DataFrame, lex: Lexicon = RUSSIAN, fuzzy: bool = True) -> DataFrame:
    """One row per user known to any of the three tables: the four stores, counters, what the user named, and where the row comes from.

    `stored` is the last snapshot: user_id, the four stores, counters (map), preferred_genres, preferred_authors, complete and recomputed_at; `onboarding`
    the answers, `events` the whole log. Field by field: stores start from the snapshot, else from nothing; answers are blended in
    where there is no snapshot or it lacks fields; then the events since the snapshot follow, composed per user and store. Counters are those of the
    snapshot and of the events since; named genres and authors come from the answers if blended in, else from the snapshot.
    """
    c, size = F.col, len(lex.feature_keys())
    zero = F.array_repeat(F.lit(0.0), size)
    none = F.array().cast("array<string>")
    marks = stored.select("user_id", "recomputed_at")
    late = events.join(marks, "user_id", "left").where(c("recomputed_at").isNull() | (c("created_at") > c("recomputed_at"))).select(*events.columns)
    late = stage(late, "late-events")
    answers, _ = from_onboarding(onboarding, keys, books, lex, fuzzy)
    new = answers.groupBy("user_id").agg(*[F.max(F.when(c("store") == s, c("scores"))).alias(f"on_{s}") for s in ONBOARDED])
    steps = composed(late, books, size)
    folds = steps.groupBy("user_id").agg(*[F.max(F.when(c("store") == s, F.struct("decay", "shift"))).alias(f"by_{s}") for s in STORES])
    since = late.groupBy("user_id").agg(*[F.count_if(c("action") == a).alias(f"n_{a}") for a in ACTIONS])
    labels = lambda f: tx.unique_labels(c(f), 10)
    said = onboarding.select("user_id", labels("favorite_genres").alias("said_genres"), labels("favorite_authors").alias("said_authors"), F.lit(True).alias("answered"))
    p = stored.join(said, "user_id", "full_outer").join(since, "user_id", "full_outer").join(new, "user_id", "left").join(folds, "user_id", "left")
    p = p.withColumn("blend", c("answered").isNotNull() & ~F.coalesce("complete", F.lit(False)))
    for s in STORES:
        base = F.coalesce(c(s), zero)
        if s in ONBOARDED:
            base = F.when(c("blend"), mix(base, ONBOARDING_DECAY, F.coalesce(f"on_{s}", zero), 1.0)).otherwise(base)
        moved = mix(F.transform(s, _times(c(f"by_{s}.decay"))), 1.0, c(f"by_{s}.shift"), 1.0)
        p = p.withColumn(s, base).withColumn(s, F.when(c(f"by_{s}").isNull(), c(s)).otherwise(moved))
    count = lambda a: F.coalesce(F.try_element_at("counters", F.lit(a)), F.lit(0)) + F.coalesce(f"n_{a}", F.lit(0))
    counts = F.map_from_arrays(F.array(*[F.lit(a) for a in ACTIONS]), F.array(*[count(a).cast("long") for a in ACTIONS]))
    named = lambda said_, kept: F.when(c("blend"), c(said_)).otherwise(F.coalesce(c(kept), none))
    fresh = F.greatest(*[F.coalesce(f"n_{a}", F.lit(0)) for a in ACTIONS]) > 0
    source = F.concat_ws("+", F.when(c("recomputed_at").isNotNull(), "snapshot"), F.when(c("blend"), "onboarding"), F.when(fresh, "events"))
    return p.select("user_id", *STORES, counts.alias("counters"), named("said_genres", "preferred_genres").alias("preferred_genres"),
                    named("said_authors", "preferred_authors").alias("preferred_authors"), source.alias("source"))


def ensured(users: DataFrame, stored: DataFrame, size: int) -> DataFrame:
    """A profile for every user: the stored one, else zeros."""
    zero = F.array_repeat(F.lit(0.0), size)
    out = users.select("user_id").distinct().join(stored, "user_id", "left")
    for s in STORES:
        out = out.withColumn(s, F.coalesce(s, zero))
    return out


def coerced(raw: DataFrame, lex: Lexicon = RUSSIAN) -> DataFrame:
    """Profiles read from loose JSON in `profile_json`: wrong shapes become defaults, lists distinct and bounded."""
    num, text = "map<string,string>", "array<string>"
    fields = {**{f"{s}_features": num for s in STORES}, "seen_book_ids": text, "saved_books": text, "positive_books": text,
              "negative_books": text, "favorite_book_ids": text, "preferred_authors": text, "preferred_genres": text}
    limits = {"seen_book_ids": 128, "saved_books": 48, "positive_books": 24, "negative_books": 24, "favorite_book_ids": 12,
              "preferred_authors": 10, "preferred_genres": 10}
    p = raw
    for f, kind in fields.items():
        got = F.from_json(F.get_json_object("profile_json", f"$.{f}"), kind)
        if kind == num:
            cell = lambda k, g=got: F.round(F.coalesce(F.try_element_at(g, F.lit(k)).try_cast("double"), F.lit(0.0)), 6)
            p = p.withColumn(f, F.array(*[cell(k) for k in lex.feature_keys()]))
        else:
            kept = F.filter(F.transform(F.coalesce(got, F.array().cast(text)), tx.strip), lambda x: x != "")
            p = p.withColumn(f, F.slice(F.array_distinct(kept), 1, limits[f]))
    return p.drop("profile_json")


def taste_summary(profiles: DataFrame, lists: DataFrame, counts: DataFrame, lex: Lexicon = RUSSIAN) -> DataFrame:
    """Dominant labels, counters and the heads of the recent lists of each user."""
    j = lambda c, t: features.dominant(F.transform(c, lambda x: F.round(x, 6)), lex, t)
    p = with_taste(profiles.withColumn("session", F.lit(None).cast("array<double>")))
    p = p.select("user_id", j("combined", 0.1).alias("dominant_taste"), j("positive", 0.12).alias("positive_affinities"),
                 j("negative", 0.12).alias("avoidance_signals"), j("combined", 0.08).alias("priorities"))
    heads = {"positive": 5, "negative": 5, "saved": 8, "favorite": 8}
    rows = lists.where(F.col("list").isin(*heads) & (F.col("rank") <= 8)).groupBy("user_id").agg(*[
        F.transform(F.sort_array(F.collect_list(F.when((F.col("list") == k) & (F.col("rank") <= n), F.struct("rank", "book_id")))), lambda x: x["book_id"]).alias(f"{k}_books")
        for k, n in heads.items()])
    return p.join(counts, "user_id", "left").join(rows, "user_id", "left")
