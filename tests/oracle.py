"""Compare a registered query with its SQL on the same parquet tables, ignoring row and column order."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """(matches, message)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return len(rows) > 0, f"rows={len(rows)} spark={t1 - t0:.1f}s (no SQL)"
    cur = con.execute(sql)
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    t2 = time.time()
    gc, gr = canonical(df.columns, rows)
    wc, wr = canonical(names, want)
    note = f"rows={len(gr)}/{len(wr)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s"
    if gc != wc:
        return False, f"{note} columns {gc} vs {wc}"
    if gr != wr:
        g, w = set(gr), set(wr)
        return False, f"{note}\n   only spark {sorted(g - w)[:3]}\n   only sql   {sorted(w - g)[:3]}  ({len(g - w)} rows differ)"
    return len(gr) > 0, note
