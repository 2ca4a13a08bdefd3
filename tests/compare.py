"""Side-by-side run of a registered query and its SQL; also a script over all keys."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda c: c.map(repr), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    # -0.0 and ints held as floats (nullable columns) compare by value.
    norm = lambda d: canonical(d.map(lambda v: v + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v))
    a, b = norm(got), norm(want)
    bad = [c for c in a.columns if not (a[c].map(repr) == b[c].map(repr)).all()]
    if not bad:
        return None
    rows = pd.concat([a, b]).map(repr)
    odd = rows[~rows.duplicated(keep=False)]
    return f"differs in {bad}: {len(odd)} unmatched rows, e.g.\n{odd.head(3)}\n{odd.tail(3)}"


def main(sf_dir: str, *keys: str) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from millwatch.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in keys or queries:
        t0 = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            note = difference(got, con.execute(sql[name]).df()) if name in sql else f"no SQL ({len(got)} rows)"
        except Exception as err:  # report and go on with the next key
            note, t1, got = f"{type(err).__name__}: {str(err)[:700]}", time.time(), ()
        failed += bool(note and not note.startswith("no SQL"))
        print(f"{name:24} {len(got):8} rows  {t1 - t0:6.1f}s  sql {time.time() - t1:5.1f}s  {note or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
