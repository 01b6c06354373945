"""Runs every query with SQL against DuckDB on one scale: python tests/compare.py SF_DIR [NAME...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "is_integer") or v.__class__.__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) if v != int(v) else int(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, (int, str)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, names = df.collect(), df.columns
    rel = con.execute(sql)
    want_names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(want_names), (names, want_names)
    a, b = rows(names, got), rows(want_names, rel.fetchall())
    assert len(a) == len(b), f"{len(a)} rows, SQL {len(b)}; {[x for x in a if x not in b][:2]} {[x for x in b if x not in a][:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
    return len(a)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(sys.argv[1]), 0
    for name, sql in entry.oracle_sql().items():
        if sys.argv[2:] and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            n = compare(spark, con, entry.queries()[name], sql, sys.argv[1])
            print(f"ok {name} {n} {time.time() - t:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"BAD {name} {type(e).__name__} {str(e)[:600]}", flush=True)
    print("bad", bad)
