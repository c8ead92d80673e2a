"""Secret scans: three fixed kinds by pattern, and further strings by sliding-window entropy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Fixed patterns of the contract. The second number is the least length, the group it holds for comes first.
KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = {
    "assign": (rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
# A run shorter than this can't be a match that counts; a cheap test before the exact one.
HINTS = {"assign": f"(?:{KEYWORDS})", "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}"}

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]"
#: Character classes from the narrowest, with the entropy in bits that some window of a secret reaches.
CLASSES = (("hex", "[0-9A-Fa-f]+", 3.0), ("alnum", "[0-9A-Za-z]+", 3.6), ("base64", CANDIDATE + "+", 3.7))
#: Strings of high entropy that are no secrets: no digit or no letter, ids with dashes, paths, words joined by dashes, counting up, placeholders.
ALLOWED = (
    r"[^0-9]*", r"[^A-Za-z]*", r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", r"/?[a-z0-9_-]*(?:/[a-z0-9_-]+)+/?",
    r"[a-z]+[0-9]*(?:[-_][a-z]+[0-9]*)+", r"[A-Za-z0-9+/_=-]*(?:0123456789|abcdefghij|ABCDEFGHIJ|EXAMPLE|example)[A-Za-z0-9+/_=-]*",
)
MICRO = 1_000_000
#: n * log2(n) in millionths of a bit, so that sums are exact in every engine.
N_LOG_N = [0, *(round(n * math.log2(n) * MICRO) for n in range(1, WINDOW + 1))]


def _most(bits: float) -> int:
    """A window has at least `bits` bits when its sum of n log n over its characters' counts is at most this."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * MICRO)


def cut(pattern: str) -> str:
    """Pieces that end with a match each, and the rest: always a match where the search stands, so a text is read once."""
    return rf"(?s).*?(?:(?:{pattern})|\z)"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, hint: str) -> Column:
    """Spans (start, end, rank, kind, match) of leftmost matches that do not overlap and are long enough."""
    rank = [*KINDS, "entropy"].index(kind)
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,match:string>>")

    def step(at, piece):
        end = at["end"] + F.length(piece)
        match = F.regexp_extract(piece, rf"(?s)({pattern})\z", 1)
        checked = F.regexp_extract(piece, rf"(?s)(?:{pattern})\z", group) if group else match
        span = F.struct(
            (end - F.length(match)).cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"),
            F.lit(kind).alias("kind"), match.alias("match"),
        )
        spans = F.when(F.length(checked) >= least, F.concat(at["spans"], F.array(span))).otherwise(at["spans"])
        return F.struct(end.alias("end"), spans.alias("spans"))

    pieces = F.regexp_extract_all(text, F.lit(cut(pattern)), F.lit(0))
    found = F.aggregate(pieces, F.struct(F.lit(0).cast("bigint").alias("end"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(hint), found).otherwise(none)


def lowest_sum(candidate: Column) -> Column:
    """The least sum of n log n over a candidate's windows: counts change by one character in and one out at each step."""
    table = F.array(*[F.lit(x) for x in N_LOG_N])

    def of(chars):
        def start(alphabet):
            head = F.slice(chars, 1, WINDOW)
            counts = F.transform(alphabet, lambda a: F.size(F.filter(head, lambda c: c == a)))
            total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, n: s + F.get(table, n))
            return F.struct(counts.alias("counts"), total.cast("bigint").alias("sum"), total.cast("bigint").alias("least"))

        def slide(alphabet):
            def step(at, i):
                came, went = F.get(chars, i), F.get(chars, i - WINDOW)
                new = F.transform(F.arrays_zip(alphabet.alias("a"), at["counts"].alias("n")),
                                  lambda x: x["n"] + (x["a"] == came).cast("int") - (x["a"] == went).cast("int"))
                n_in = F.get(new, (F.array_position(alphabet, came) - 1).cast("int"))
                n_out = F.get(new, (F.array_position(alphabet, went) - 1).cast("int"))
                change = F.when(came == went, F.lit(0)).otherwise(F.get(table, n_in) - F.get(table, n_in - 1) + F.get(table, n_out) - F.get(table, n_out + 1))
                total = (at["sum"] + change).cast("bigint")
                return F.struct(new.alias("counts"), total.alias("sum"), F.least(at["least"], total).alias("least"))

            later = F.when(F.size(chars) > WINDOW, F.sequence(F.lit(WINDOW), F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(later, start(alphabet), step)["least"]

        return bound(F.array_distinct(chars), slide)

    return bound(F.filter(F.split(candidate, ""), lambda c: c != ""), of)


def _entropy_spans(spans: Column) -> Column:
    """Of candidate spans, those whose windows reach their class's entropy and that no allowed pattern covers."""
    def secret(span):
        match = span["match"]
        allowed = match.rlike("^(?:" + "|".join(ALLOWED) + ")$")
        most = F.coalesce(*[F.when(match.rlike(f"^{chars}$"), F.lit(_most(bits))) for _, chars, bits in CLASSES])
        return F.when(allowed, False).otherwise(lowest_sum(match) <= most)

    return F.filter(spans, secret)


def _listed(spans: Column) -> Column:
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
                          lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(ordered, ",")


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each whole text: doc_id, found (array of spans with start, end, kind and the matched text).

    Kinds assign, access and hex are the leftmost non-overlapping matches of their patterns. Kind entropy adds
    runs of 20 or more of [A-Za-z0-9+/_=-] in which some window of 20 characters reaches the Shannon entropy set for the run's
    character class, unless an allowed pattern matches the whole run or it overlaps a span of the other kinds.
    Positions are code points, ends exclusive. A null text counts as empty; rows are taken one by one, so repeated rows and null ids
    give rows alike; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = [_spans(F.col("text"), kind, *KINDS[kind], HINTS[kind]).alias(kind) for kind in KINDS]
    runs = _spans(F.col("text"), "entropy", CANDIDATE + f"{{{WINDOW},}}", 0, WINDOW, CANDIDATE + f"{{{WINDOW}}}")
    digits = F.filter(runs, lambda s: s["match"].rlike("[0-9]"))
    base = rows.select("doc_id", *found, digits.alias("runs"))
    base = base.withColumn("base", F.concat(*KINDS))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return base.select("doc_id", *KINDS, "base", F.when(F.size("runs") > 0, _entropy_spans(free)).otherwise(F.col("runs")).alias("entropy"))


def digest(scan: DataFrame) -> DataFrame:
    """One row per document: counts per kind, the base spans' hash and all spans as text."""
    return scan.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "entropy")).alias("spans"), F.size("entropy").cast("long").alias("n_entropy"),
    )


def digest_sql(table: str) -> str:
    quoted = {k: cut(KINDS[k][0]).replace("'", "''") for k in KINDS}

    def kind_sql(rank, kind):
        pattern, group, least = KINDS[kind]
        pattern = pattern.replace("'", "''")
        return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, stop - length(regexp_extract(piece, '(?s)({pattern})\\z', 1)) AS start, stop
FROM (SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
      FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{quoted[kind]}') AS p FROM docs)))
WHERE length(regexp_extract(piece, '(?s)({pattern})\\z', {group + 1})) >= {least}"""

    run = f"{CANDIDATE}{{{WINDOW},}}"
    classes = " ".join(f"WHEN regexp_full_match(run, '{chars}') THEN {_most(bits)}" for _, chars, bits in CLASSES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
base AS ({" UNION ALL ".join(kind_sql(i, k) for i, k in enumerate(KINDS))}),
runs AS (SELECT doc_id, regexp_extract(piece, '(?s)({run})\\z', 1) AS run, stop - length(regexp_extract(piece, '(?s)({run})\\z', 1)) AS start, stop
         FROM (SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
               FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{cut(run)}') AS p FROM docs)))),
free AS (SELECT * FROM runs r WHERE length(run) >= {WINDOW} AND NOT regexp_full_match(run, '{"|".join(f"(?:{a})" for a in ALLOWED)}')
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r.stop AND r.start < b.stop)),
windows AS (SELECT doc_id, start, stop, run, w, substr(run, CAST(w AS BIGINT) + 1, {WINDOW}) AS part FROM (SELECT *, unnest(range(0, length(run) - {WINDOW} + 1)) AS w FROM free)),
sums AS (SELECT doc_id, start, stop, run, w, sum({N_LOG_N}[n + 1]) AS s FROM
         (SELECT doc_id, start, stop, run, w, c, count(*) AS n FROM (SELECT *, unnest(string_split(part, '')) AS c FROM windows) WHERE c <> '' GROUP BY ALL) GROUP BY ALL),
entropy AS (SELECT doc_id, start, stop FROM sums GROUP BY doc_id, start, stop, run HAVING min(s) <= CASE {classes} END),
spans AS (SELECT doc_id, rank, kind, start, stop FROM base UNION ALL SELECT doc_id, 3, 'entropy', start, stop FROM entropy),
told AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         count(*) FILTER (kind = 'entropy') AS n_entropy,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (kind <> 'entropy') AS base FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM docs LEFT JOIN told USING (doc_id)"""
