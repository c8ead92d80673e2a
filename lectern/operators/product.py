"""Product state as tables: upserts, lookups, recent rows, reading lists, deletes, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.terms import top_per


def latest(rows: DataFrame, keys: list[str], at: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key. A mergeable maximum: a hot key is reduced in the map tasks."""
    order = [F.col(at)] + ([F.col(tie)] if tie else [])
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "r.*").select(*rows.columns)


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str], at: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows replaced by newer changes; columns in `keep` (such as created_at) stay as first stored."""
    out = latest(stored.unionByName(changes, allowMissingColumns=True), keys, at)
    if keep:
        first = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        out = out.join(first, keys, "left")
        for c in keep:
            out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def looked_up(users: DataFrame, primary: DataFrame, legacy: DataFrame, fallback: DataFrame, key: str = "user_id", value: str = "profile") -> DataFrame:
    """Value of each key from the first table that has a non-empty one, and which table it was."""
    out = users.select(key).distinct()
    for name, t in (("primary", primary), ("legacy", legacy), ("fallback", fallback)):
        out = out.join(t.select(key, F.nullif(value, F.lit("{}")).alias(f"_{name}")), key, "left")
    source = F.when(F.col("_primary").isNotNull(), "primary").when(F.col("_legacy").isNotNull(), "legacy").when(F.col("_fallback").isNotNull(), "fallback")
    return out.select(key, F.coalesce("_primary", "_legacy", "_fallback", F.lit("{}")).alias(value), source.alias("source"))


def snapshot(profiles: DataFrame, stored: DataFrame, onboarding: DataFrame, now: Column) -> DataFrame:
    """New profile rows; an empty onboarding is taken from the stored row, else from the onboarding table."""
    empty = F.lit("{}")
    s = stored.select("user_id", F.nullif("onboarding_json", empty).alias("_old"), F.col("created_at").alias("_created"))
    o = onboarding.select("user_id", F.nullif("payload", empty).alias("_state"))
    p = profiles.join(s, "user_id", "left").join(o, "user_id", "left")
    return p.select("user_id", F.coalesce(F.nullif("onboarding_json", empty), "_old", "_state", empty).alias("onboarding_json"), "profile_json",
                    now.alias("last_recomputed_at"), F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"))


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest interactions of each user."""
    return top_per(events, ["user_id"], [F.desc("created_at"), F.desc("id")], limit)


# ---- chunks and books -------------------------------------------------------------
def replaced(stored: DataFrame, fresh: DataFrame, key: str = "book_id") -> DataFrame:
    """Delete-by-book then insert."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def without(stored: DataFrame, gone: DataFrame, key: str = "book_id") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def only(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a set of ids (chunks by id, vectors of known books)."""
    return stored.join(ids.select(key).distinct(), key, "left_semi")


def deleted_books(catalog: DataFrame, vectors: DataFrame, chunks: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(catalog, vectors, chunks) without the deleted books, and a report per asked id with the removed chunk count."""
    removed = only(vectors, deletes, "book_id").groupBy("book_id").agg(F.count(F.lit(1)).alias("removed_chunks"))
    known = catalog.select("book_id", F.lit(True).alias("deleted"))
    report = deletes.select("book_id").distinct().join(known, "book_id", "left").join(removed, "book_id", "left")
    found = F.coalesce("deleted", F.lit(False))
    report = report.select("book_id", found.alias("deleted"), F.when(found, F.coalesce("removed_chunks", F.lit(0))).otherwise(0).alias("removed_chunks"))
    gone = report.where("deleted")
    return without(catalog, gone), without(vectors, gone), without(chunks, gone), report


def opened(catalog: DataFrame, opens: DataFrame) -> DataFrame:
    """Fold open events (book_id, opened_at) into last_opened and open_count."""
    o = opens.groupBy("book_id").agg(F.max("opened_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    c = catalog.join(o, "book_id", "left")
    return c.withColumn("last_opened", F.greatest("last_opened", "_last")).withColumn("open_count", F.coalesce("open_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_last", "_n")


def updated(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the non-null columns of the changes on the rows they name."""
    cols = [c for c in changes.columns if c != "book_id"]
    ch = changes.select("book_id", *[F.col(c).alias(f"_{c}") for c in cols])
    out = catalog.join(ch, "book_id", "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


# ---- reading lists -----------------------------------------------------------------
def saved_lists(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, items) from likes and saves: one 'saved' list per user; a repeated book keeps its first time and gets the latest position."""
    e = events.where(F.col("action").isin("like", "save"))
    list_id = F.concat(F.lit("list_"), F.left(F.sha1(F.concat(F.col("user_id").cast("string"), F.lit("/saved"))), F.lit(16)))
    lists = e.groupBy("user_id").agg(F.min("created_at").alias("created_at")).select(
        list_id.alias("id"), "user_id", F.lit("Saved Books").alias("name"), F.lit("saved").alias("kind"), "created_at")
    position = (F.unix_timestamp(F.max("created_at")) % 100000).cast("int").alias("position")
    items = e.groupBy("user_id", "book_id").agg(position, F.min("created_at").alias("created_at"))
    return lists, items.select(list_id.alias("reading_list_id"), "book_id", "position", "created_at")


def created_lists(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Lists per (user, kind): a stored list wins over a new one, the earliest asked otherwise; blank names are refused."""
    a = asked.where(tx.strip(F.coalesce("name", F.lit(""))) != "").withColumn("kind", F.when(F.coalesce("kind", F.lit("")) == "", "custom").otherwise(F.col("kind")))
    both = stored.withColumn("_new", F.lit(1)).withColumn("_new", F.lit(0)).unionByName(a.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in ("user_id", "kind")]
    pick = F.min_by(F.struct(*rest), F.struct("_new", "created_at", "id")).alias("r")
    return both.groupBy("user_id", "kind").agg(pick).select("user_id", "kind", "r.*").select(*stored.columns)


def list_page(lists: DataFrame, items: DataFrame, previews: DataFrame) -> DataFrame:
    """Items of every list in order with the book's preview columns and the list's item count."""
    counts = items.groupBy("reading_list_id").agg(F.count(F.lit(1)).alias("items_count"))
    own = items.join(lists.select(F.col("id").alias("reading_list_id"), "user_id", "name"), "reading_list_id")
    page = own.join(previews, "book_id", "left").join(counts, "reading_list_id")
    return top_per(page, ["reading_list_id"], [F.asc("position"), F.asc("created_at"), F.asc("book_id")], F.lit((1 << 31) - 1), "place")


def owned(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """Item changes (list_id, user_id, ..) on lists that belong to the asking user."""
    return asked.join(lists.select(F.col("id").alias("list_id"), "user_id"), ["list_id", "user_id"], "left_semi")


# ---- explanations ------------------------------------------------------------------
def explanations(asked: DataFrame, events: DataFrame, newest: int = 20) -> DataFrame:
    """The first item for (user, book, context) among each user's newest recommendation events.

    `asked` has (ask_id, user_id, book_id, recommendation_context); blank contexts match any.
    """
    new = top_per(events, ["user_id"], [F.desc("created_at"), F.desc("id")], newest, "age")
    rows = new.select("user_id", "age", F.col("recommendation_context").alias("event_context"), F.posexplode("items").alias("pos", "item"))
    a = asked.join(rows.where(F.col("item.book_id").isNotNull()).withColumn("book_id", F.col("item.book_id")), ["user_id", "book_id"])
    same = lambda c: (F.coalesce("recommendation_context", F.lit("")) == "") | (F.coalesce(c, F.lit("")) == "") | (F.col("recommendation_context") == c)
    a = a.where(same(F.col("event_context")) & same(F.col("item.recommendation_context")))
    first = a.groupBy("ask_id").agg(F.min_by("item", F.struct("age", "pos")).alias("item"))
    return first.withColumn("source", F.lit("recommendation_events"))


def explanations_with_fallback(asked: DataFrame, events: DataFrame, fresh: DataFrame, newest: int = 20) -> DataFrame:
    """As `explanations`; what the log does not have is taken from a freshly computed feed (user_id, book_id, item)."""
    logged = explanations(asked, events, newest)
    rest = asked.join(logged, "ask_id", "left_anti").join(fresh, ["user_id", "book_id"]).select("ask_id", "item").withColumn("source", F.lit("fresh_feed"))
    return logged.unionByName(rest)


def feed_defaults(payloads: DataFrame, requests: DataFrame) -> DataFrame:
    """Fill blank or unknown search_context and blank request_mode of a response from its request."""
    r = requests.select("req_id", F.col("search_context").alias("_s"), F.col("request_mode").alias("_m"))
    p = payloads.join(r, "req_id", "left")
    ctx = F.lower(tx.strip(F.coalesce("search_context", F.lit(""))))
    return p.withColumn("search_context", F.when(ctx.isin("profile", "query"), F.col("search_context")).otherwise(F.col("_s"))).withColumn(
        "request_mode", F.coalesce(F.nullif(tx.strip("request_mode"), F.lit("")), "_m")).drop("_s", "_m")


def profile_unions(profiles: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Ordered distinct unions of list columns: out -> columns."""
    out = profiles
    for name, cols in groups.items():
        out = out.withColumn(name, F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in cols])))
    return out


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), tx.strip), lambda v: v != "")


def non_negative_int(c: Column) -> Column:
    n = tx.strip(c).try_cast("int")
    return F.when(n >= 0, n)


def email_key(c: Column) -> Column:
    return F.lower(tx.strip(c))
