"""Quality rules with thresholds that follow each language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, bound, words
from lectern.session import attach, stage

SHINGLE = 8
#: Rates in thousandths, with the least distance that a fence keeps from the upper or lower quartile.
RATES = {
    "word_length": ("1000 * word_chars DIV n_words", 2000),
    "symbols": ("1000 * n_symbols DIV n_words", 100),
    "marks": ("1000 * n_marks DIV n_words", 600),
    "capitals": ("1000 * n_capitals DIV greatest(1, word_chars)", 250),
    "dup_lines": ("1000 * n_dup_lines DIV greatest(1, n_lines)", 400),
    "repeats": ("1000 * n_repeat_words DIV n_words", 300),
    "echoes": ("1000 * n_echoes DIV n_words", 100),
}
TWO_SIDED = ("word_length",)
FENCE = 3  # quartile distances beyond a quartile
LEAST_GROUP = 50  # documents of a language and source; smaller groups take their language's sketch, then the one of all
BITS = 5  # leading bits that the sketch keeps of a value: it is right to 1/16


def repeat_words(tokens: Column) -> Column:
    """Words inside windows of eight words whose sequence is found twice or more. Windows compare by 64-bit hash within one text."""
    windows = F.transform(F.sequence(F.lit(1), F.size(tokens) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(tokens, i, SHINGLE)))

    def covered(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p):
            return F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))

        starts = bound(pairs, lambda p: F.array_sort(F.transform(repeated(p), lambda x: x["i"])))
        whole = bound(starts, lambda s: F.aggregate(
            F.transform(s, lambda at, k: F.least(F.lit(SHINGLE), F.coalesce(F.get(s, k + 1) - at, F.lit(SHINGLE)))), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(whole)

    return F.when(F.size(tokens) > SHINGLE, bound(windows, covered)).otherwise(0)


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of each whole text: words, characters in them, symbols, marks, capitals, lines, repeated lines, repeated words, words equal to the one before."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"), words(text).alias("tokens"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def only(chars):
        return F.length(F.regexp_replace("text", f"[^{chars}]+", ""))

    return rows.select(
        "doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        only(r"#*$%&|<>").cast("long").alias("n_symbols"), only(r"!-/:-@\[-`{-~").cast("long").alias("n_marks"), only("A-Z").cast("long").alias("n_capitals"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        repeat_words(F.col("tokens")).cast("long").alias("n_repeat_words"),
        bound(F.col("tokens"), lambda t: F.size(F.filter(t, lambda w, i: w == F.get(t, i - 1)))).cast("long").alias("n_echoes"),
    ).withColumns({"n_lines": F.col("lines")["n"], "n_dup_lines": F.col("lines")["dup"]}).drop("lines")


def _rounded(value: Column) -> Column:
    """A value cut to its leading bits: the cells of the sketch."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per lang, source, rate and cell. Sketches merge by adding counts, so tasks, languages and days can be joined at will."""
    rates = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), F.expr(rule).alias("value")) for name, (rule, _) in RATES.items()]))
    long = measured.where("n_words > 0").select("lang", "source", rates.alias("r"))
    return long.groupBy("lang", "source", F.col("r.rate").alias("rate"), _rounded(F.col("r.value")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Lower and upper quartile and the count of each rate, read from the sketches of the groups merged to `keys`."""
    merged = sketch.groupBy(*keys, "rate", "cell").agg(F.sum("n").alias("n"))
    cells = W.partitionBy(*keys, "rate")  # a few hundred cells at most
    ranked = merged.withColumn("upto", F.sum("n").over(cells.orderBy("cell"))).withColumn("all", F.sum("n").over(cells))
    return ranked.groupBy(*keys, "rate").agg(
        F.max("all").alias("n"), F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("cell"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("cell"))).alias("q3"),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """Per lang and source the least and most allowed of each rate: fences around the quartiles of the smallest group that is large enough."""
    own = _quartiles(sketch, "lang", "source")
    tongue = _quartiles(sketch, "lang").select(F.col("lang").alias("lang_"), F.col("rate").alias("rate_"), F.struct("n", "q1", "q3").alias("by_lang"))
    every = _quartiles(sketch).select(F.col("rate").alias("rate_all"), F.struct("n", "q1", "q3").alias("by_all"))
    joined = own.join(tongue, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("rate") == F.col("rate_"))).join(every, F.col("rate") == F.col("rate_all"))
    chosen = F.when(F.col("n") >= LEAST_GROUP, F.struct("n", "q1", "q3")).when(F.col("by_lang.n") >= LEAST_GROUP, F.col("by_lang")).otherwise(F.col("by_all"))
    slack = reduce(lambda c, name: c.when(F.col("rate") == name, RATES[name][1]), RATES, F.when(F.lit(False), 0))
    fenced = joined.select("lang", "source", "rate", chosen.alias("q"), slack.alias("slack"))
    margin = F.greatest(FENCE * (F.col("q.q3") - F.col("q.q1")), F.col("slack"))
    low = F.when(F.col("rate").isin(*TWO_SIDED), F.col("q.q1") - margin).otherwise(0)
    return fenced.select("lang", "source", "rate", low.alias("low"), (F.col("q.q3") + margin).alias("high"))


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of each whole text and whether it is kept.

    base_failed: under 20 words, or over 30 % of the words repeated. Of the rest a document is kept if every rate
    lies within the fences of its language and source, which come from quantile sketches over all documents.
    Null texts have no words; a null lang or source is a group of its own; rows are judged one by one, so repeated rows and null ids
    are judged alike; an empty table gives no rows; other columns are not read.
    """
    measured = stage(measures(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col), "measures")
    limits = thresholds(stage(sketches(measured), "sketches"))
    fences = limits.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rate", F.struct("low", "high")))).alias("fences"))
    fences = stage(fences.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "fences"), "fences")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    joined = attach(measured, fences, same, "left")
    within = reduce(lambda a, b: a & b, [
        F.expr(rule).between(F.col("fences")[name]["low"], F.col("fences")[name]["high"]) for name, (rule, _) in RATES.items()
    ])
    return joined.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, False).otherwise(F.coalesce(within, F.lit(True))).alias("kept"),
    )


def judged_sql(table: str) -> str:
    """The rows of `judged` without lang and source, in DuckDB's SQL."""
    rates = "\nUNION ALL ".join(
        f"SELECT doc_id, lang, source, '{name}' AS rate, CAST({rule.replace('DIV', '//')} AS BIGINT) AS value, {slack} AS slack, {str(name in TWO_SIDED).lower()} AS two_sided FROM counted WHERE n_words > 0"
        for name, (rule, slack) in RATES.items())

    def quartiles(keys):
        by = "".join(f"{k}, " for k in keys)
        return f"""SELECT {by}rate, max(a) AS n, min(cell) FILTER (upto * 4 >= a) AS q1, min(cell) FILTER (upto * 4 >= a * 3) AS q3 FROM
(SELECT {by}rate, cell, sum(count(*)) OVER (PARTITION BY {by}rate ORDER BY cell) AS upto, sum(count(*)) OVER (PARTITION BY {by}rate) AS a FROM cells GROUP BY {by}rate, cell) GROUP BY {by}rate"""

    return f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
wins AS (SELECT doc_id, unnest(range(1, len(w) - {SHINGLE - 2})) AS i, w FROM docs WHERE len(w) > {SHINGLE}),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM wins),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
reps AS (SELECT doc_id, sum(least({SHINGLE}, coalesce(next - i, {SHINGLE}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM again) GROUP BY doc_id),
lined AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
counted AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!-/:-@\\[-`{{-~]+', '', 'g')) AS n_marks,
            length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
            CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
            len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_echoes
            FROM docs d JOIN lined USING (doc_id) LEFT JOIN reps USING (doc_id)),
rates AS ({rates}),
cells AS (SELECT *, (value >> greatest(length(bin(value)) - {BITS}, 0)) << greatest(length(bin(value)) - {BITS}, 0) AS cell FROM rates),
own AS ({quartiles(["lang", "source"])}), tongue AS ({quartiles(["lang"])}), every AS ({quartiles([])}),
chosen AS (SELECT o.lang, o.source, o.rate, CASE WHEN o.n >= {LEAST_GROUP} THEN o.q1 WHEN t.n >= {LEAST_GROUP} THEN t.q1 ELSE e.q1 END AS q1,
           CASE WHEN o.n >= {LEAST_GROUP} THEN o.q3 WHEN t.n >= {LEAST_GROUP} THEN t.q3 ELSE e.q3 END AS q3
           FROM own o JOIN tongue t ON o.lang IS NOT DISTINCT FROM t.lang AND o.rate = t.rate JOIN every e ON o.rate = e.rate),
verdict AS (SELECT r.doc_id, bool_and(value <= q3 + greatest({FENCE} * (q3 - q1), slack) AND (NOT two_sided OR value >= q1 - greatest({FENCE} * (q3 - q1), slack))) AS fine
            FROM rates r JOIN chosen c ON r.lang IS NOT DISTINCT FROM c.lang AND r.source IS NOT DISTINCT FROM c.source AND r.rate = c.rate GROUP BY r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       CASE WHEN n_words < 20 OR 100 * n_repeat_words > 30 * n_words THEN false ELSE coalesce(fine, true) END AS kept
FROM counted LEFT JOIN verdict USING (doc_id)"""
