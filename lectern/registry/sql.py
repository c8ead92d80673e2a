"""Fragments of DuckDB SQL shared by the oracles, written independently of the Spark expressions."""

from __future__ import annotations

from lectern.lexicon import LATIN

BLANKS = "chr(32)||chr(10)||chr(13)||chr(9)"
NN = "chr(10)||chr(10)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ",".join(text(v) for v in values) + "]::VARCHAR[]"


def rows(values) -> str:
    """VALUES list of tuples of str and numbers."""
    def cell(v):
        return text(v) if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in values)


def raw_words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+')"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ё', 'е')"


def stem(w: str) -> str:
    fit = f"list_filter({words(LATIN.suffixes)}, lambda s: suffix({w}, s) AND length({w}) - length(s) >= 3)[1]"
    return f"CASE WHEN length({w}) <= 3 THEN {w} ELSE coalesce(left({w}, length({w}) - length({fit})), {w}) END"


def tokens(x: str) -> str:
    stems = f"list_transform({raw_words(fold(x))}, lambda w: {stem('w')})"
    return f"list_filter({stems}, lambda t: NOT list_contains({words(LATIN.stop_words)}, t))"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), {BLANKS})"


def clean(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '\n{{3,}}', {NN}, 'g'), {BLANKS})"


DOCS = r"""docs AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) AS book_id, trim(regexp_extract(text, '^[^.\n]*')) AS title, source AS author, lang, text AS content
  FROM documents)"""

CHUNKS = f"""{DOCS},
paras AS MATERIALIZED (
  SELECT book_id, list_filter(list_transform(string_split({clean('content')}, chr(10)), lambda p: trim(p, {BLANKS})), lambda p: p <> '') AS ps
  FROM docs),
walk(book_id, i, done, cur, size) AS (
  SELECT book_id, 0, CAST([] AS VARCHAR[]), '', 0 FROM paras
  UNION ALL
  SELECT book_id, i + 1,
    CASE WHEN flush THEN list_append(done, cur) ELSE done END,
    CASE WHEN flush THEN restart WHEN cur = '' THEN p ELSE cur || {NN} || p END,
    CASE WHEN flush THEN length(restart) ELSE size + length(p) + 2 END
  FROM (SELECT *, CASE WHEN tail = '' THEN p ELSE tail || {NN} || p END AS restart FROM (
    SELECT w.book_id, w.i, w.done, w.cur, w.size, q.ps[w.i + 1] AS p,
      w.cur <> '' AND w.size + length(q.ps[w.i + 1]) + 2 > 1200 AS flush,
      trim(right(w.cur, 180), {BLANKS}) AS tail
    FROM walk w JOIN paras q ON q.book_id = w.book_id WHERE w.i < len(q.ps)))),
packed AS MATERIALIZED (
  SELECT w.book_id, list_append(w.done, w.cur) AS cs FROM walk w JOIN paras q ON q.book_id = w.book_id
  WHERE w.i = len(q.ps) AND w.cur <> ''),
chunks AS MATERIALIZED (
  SELECT book_id || '_' || CAST(pos - 1 AS VARCHAR) AS chunk_id, book_id, CAST(pos - 1 AS BIGINT) AS position, cs[pos] AS content
  FROM (SELECT book_id, cs, unnest(range(1, len(cs) + 1)) AS pos FROM packed))"""

TOKENED = f"""{CHUNKS},
tokened AS MATERIALIZED (SELECT chunk_id, book_id, position, content, {tokens('content')} AS toks FROM chunks)"""

POSTED = f"""{TOKENED},
posted AS MATERIALIZED (
  SELECT chunk_id, book_id, position, term, len(toks) AS dl, count(*) AS tf
  FROM (SELECT chunk_id, book_id, position, toks, unnest(toks) AS term FROM tokened) GROUP BY chunk_id, book_id, position, term, len(toks))"""


def bm25(query_table: str, name: str = "scores", text_col: str = "query") -> str:
    """CTEs that score `query_table(query_id, text)` against the chunks."""
    return f"""{name}_q AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (
  SELECT query_id, unnest({tokens(text_col)}) AS term FROM {query_table}) GROUP BY ALL),
{name}_n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tokened),
{name}_idf AS MATERIALIZED (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf
  FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), {name}_n),
{name} AS MATERIALIZED (
  SELECT query_id, chunk_id, book_id, position,
    round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM posted JOIN {name}_q USING (term) JOIN {name}_idf USING (term), {name}_n GROUP BY ALL)"""


BENCH = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TURNS = "asked AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user')"


def rnd(x: str, places: int = 6) -> str:
    """Round by decimal digits, ties away from zero."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), {places}) AS DOUBLE)"
