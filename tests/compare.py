"""Run registered queries next to their SQL in DuckDB: ``python -m tests.compare [sf] [name ...]``."""

import collections
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return repr(value)


def bag(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), collections.Counter(tuple(plain(r[i]) for i in at) for r in rows)


def difference(spark, con, folder, query, sql):
    """None when equal, else a short description."""
    frame = query(spark, folder)
    got = bag(frame.columns, frame.collect())
    if sql is None:
        return None if got[1] else "no rows"
    cursor = con.execute(sql)
    want = bag([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra, lost = list((got[1] - want[1]).items()), list((want[1] - got[1]).items())
        return (f"{sum(got[1].values())} vs {sum(want[1].values())} rows; only spark {len(extra)} {extra[:3]}; "
                f"only sql {len(lost)} {lost[:3]}")
    return None if got[1] else "no rows"


def main(argv):
    from marginalia.plans.catalog import CATALOG
    from marginalia.session import build_session
    folder = f"/root/testdata/{argv[0] if argv else 'sf0.01'}"
    names = argv[1:] or list(CATALOG)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-checkpoint-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    bad = 0
    for name in names:
        query, sql = CATALOG[name]
        started = time.time()
        try:
            problem = difference(spark, con, folder, query, sql)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {'' if sql else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
