"""Run registered queries next to their SQL in DuckDB and report differences.

Usage: python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") + 0.0
    if v is not None and type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return float(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple(str(x) for x in r))


def difference(spark_df, con, sql) -> str | None:
    start = time.time()
    a_names, a = rows_of(spark_df.columns, spark_df.collect())
    mid = time.time()
    cur = con.execute(sql)
    b_names, b = rows_of([c[0] for c in cur.description], cur.fetchall())
    if "-v" in sys.argv:
        print(f"   spark {mid - start:.1f}s  sql {time.time() - mid:.1f}s")
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"{len(a)} vs {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from recspark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[2:] if a != "-v"]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = duck(sf_dir), entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracle:
                diff = difference(fn(spark, sf_dir), con, oracle[name])
                state = "ok" if diff is None else f"DIFF {diff}"
            else:
                state = f"rows-only {fn(spark, sf_dir).count()}"
        except Exception as err:  # report and go on with the next query
            state = f"ERROR {type(err).__name__}: {str(err)[:400]}"
        failed += state.startswith(("DIFF", "ERROR"))
        print(f"{name:30s} {time.time() - start:6.1f}s {state}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
