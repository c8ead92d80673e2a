"""The driver's tables seen as product tables: catalog, chunks, queries, interactions, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import terms
from lectern.session import spread

LINE = "\n"  # the test documents have no empty lines, so a line is a paragraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_sentence(c):
    """The opening sentence serves as the title of a document that has none."""
    return F.btrim(F.regexp_extract(c, r"^[^.\n]*", 0))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        F.col("doc_id").cast("string").alias("book_id"),
        first_sentence(F.col("text")).alias("title"),
        F.col("source").alias("author"),
        F.array("lang").alias("genres"),
        F.col("text").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.chunk_table(catalog(spark, sf_dir), separator=LINE)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("search_text")
    )


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of the conversations, whole, as a query."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


# Fixed binding of the event types of the test log to product actions.
EVENT_ACTIONS = {"purchase": "save", "click": "swipe_right", "error": "swipe_left", "view": "skip", "signup": "like"}


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    actions = F.create_map(*[F.lit(x) for kv in EVENT_ACTIONS.items() for x in kv])
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.get_json_object("props", "$.k").alias("book_id"),
        F.try_element_at(actions, F.col("event_type")).alias("action"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("value"),
    )
