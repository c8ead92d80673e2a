"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW, packed, uniform_52, unpacked
from lectern.session import attach, stage

ADDED = ("copy", "n_copies", "shuffle_key")


def flattened(docs: DataFrame, exponent: float, *, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Target weight of each source: its bytes to the power `exponent` (1 leaves the mix as it is, 0 makes all sources alike)."""
    sizes = _sizes(docs, source_col, text_col)
    return sizes.select("source", F.pow(F.col("bytes").cast("double"), F.lit(exponent)).alias("weight"))


def _sizes(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    bytes_ = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(bytes_).alias("bytes"))


def rates(docs: DataFrame, targets: DataFrame, *, budget: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, bytes, rate: the mean number of copies that gives each source its share of `budget` times the bytes at hand."""
    sizes = _sizes(docs, source_col, text_col)
    joined = sizes.join(targets.select(F.col("source").alias("of"), "weight"), F.col("source").eqNullSafe(F.col("of")), "left")
    joined = stage(joined.select("source", "bytes", "weight"), "source-sizes")
    total, weights = joined.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    share = F.col("weight") / F.lit(float(weights or 1.0)) * F.lit(float(budget * total))
    rate = F.when(F.col("weight").isNull() | (F.col("bytes") == 0), 1.0).otherwise(share / F.col("bytes"))
    return joined.select("source", "bytes", rate.cast("double").alias("rate"))


def _cumulative(rate):
    """P(count <= k) for k = 0, 1, ... of a Poisson variable, as far as a double can tell it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(
        (-rate).alias("log_p"), F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("all"),
    )

    def further(at, k):
        log_p = at["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        p = at["p"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), p.alias("p"), F.concat(at["all"], F.array(p)).alias("all"))

    table = F.aggregate(F.sequence(F.lit(1), last), start, further)["all"]
    return F.when(rate > 0, table).otherwise(F.array(F.lit(1.0)))


def mixed(docs: DataFrame, targets: DataFrame, *, budget: float = 1.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """Each document as often as a Poisson draw with its source's rate says, all in one global random order.

    `targets` has source and weight; the rate of a source is its weight's share of `budget` times all bytes, over
    the bytes it has. The draw inverts the Poisson distribution at a number hashed from seed and id, so a lost task
    draws again the same. Copies are dealt out by a hash of seed, id and copy, and sorted by it within each partition.

    Returns the columns of `docs` and copy (from 1), n_copies and shuffle_key; columns of `docs` with these names
    are replaced. A null source is a source of its own; a source without a target or without bytes has rate 1; a null text
    has no bytes; rows that repeat an id draw the same number; null ids count as one id; an empty table gives no rows.
    """
    table = stage(rates(docs, targets, budget=budget, source_col=source_col, text_col=text_col)
                  .select(F.col("source").alias("of"), _cumulative(F.col("rate")).alias("table")), "mixing-rates")
    columns = [c for c in docs.columns if c.lower() not in ADDED]
    rows = packed(docs.select(*[f"`{c}`" for c in columns]), docs[source_col].alias("from"), docs[id_col].alias("id"))
    drawn = uniform_52(F.lit(seed), F.col("id")) / F.lit(float(1 << 52))
    counted = attach(rows, table, F.col("from").eqNullSafe(F.col("of"))).withColumn("u", drawn)
    counted = counted.select(ROW, "id", F.size(F.filter("table", lambda p: p <= F.col("u"))).alias("n"))
    copies = counted.where("n > 0").select(ROW, "id", F.col("n").cast("long").alias("n_copies"), F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    copies = copies.withColumn("copy", F.col("copy").cast("long")).withColumn("shuffle_key", uniform_52(F.lit(seed), F.lit("order"), F.col("id"), F.col("copy")))
    ordered = copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "id", "copy")
    return unpacked(ordered, columns, F.col("copy"), F.col("n_copies"), F.col("shuffle_key"))


def mix_sql(table: str, exponent: float, seed: int) -> str:
    """The rows of `mixed` with `flattened` targets, in DuckDB's SQL."""
    return f"""
WITH docs AS (SELECT * FROM {table}),
sizes AS (SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS DOUBLE) AS bytes FROM docs GROUP BY source),
rated AS (SELECT source, CASE WHEN bytes = 0 THEN 1.0 ELSE pow(bytes, {exponent}) / sum(pow(bytes, {exponent})) OVER () * sum(bytes) OVER () / bytes END AS rate FROM sizes),
steps AS (SELECT source, rate, k, -rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) - lgamma(k + 1) END AS log_p
          FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rated)),
cdf AS (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS p FROM steps),
drawn AS (SELECT *, CAST(('0x' || substr(md5('{seed}:' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM docs),
counted AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, count(c.k) AS n_copies
            FROM drawn d LEFT JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.p <= d.u GROUP BY ALL),
copied AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies,
       CAST(('0x' || substr(md5('{seed}:order:' || doc_id || ':' || copy), 1, 13)) AS BIGINT) AS shuffle_key FROM copied"""
