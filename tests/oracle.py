"""Compare a Spark result with its SQL twin run by DuckDB on the same files."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def run_sql(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    rows = [dict(zip(names, r)) for r in cur.fetchall()]
    con.close()
    return names, types, rows


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def bag(names, rows):
    return Counter(tuple(norm(r[n]) for n in names) for r in rows)


def compare(df, folder: str, sql: str) -> str | None:
    names, _, want_rows = run_sql(folder, sql)
    got = [r.asDict() for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    names = sorted(names)
    a, b = bag(names, got), bag(names, want_rows)
    if a == b:
        return None
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"rows {len(got)} vs {len(want_rows)}; differing {sum((a - b).values())}\n  {names}\n  spark {only_a}\n  sql   {only_b}"
