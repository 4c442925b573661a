"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".") if v == v else "nan"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def compare(spark, con, sf, name, fn, sql):
    df = fn(spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in names) for r in df.collect())
    if sql is None:
        return len(got), None, "rows only"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return len(got), None, f"columns {names} != {sorted(cols)}"
    want = sorted(tuple(canon(r[cols.index(c)]) for c in names) for r in cur.fetchall())
    if got == want:
        return len(got), len(want), "ok"
    a, b = set(got), set(want)
    return len(got), len(want), (f"MISMATCH only spark {sorted(a - b)[:3]} "
                                 f"only sql {sorted(b - a)[:3]} ({names})")


def connect(sf):
    import duckdb
    from workload.base import TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def main(sf, *names):
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), []
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            n, m, note = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            n, m, note = None, None, "ERROR " + str(e)[:700]
        if note not in ("ok", "rows only"):
            bad.append(name)
        print(f"{name:28s} {n!s:>8} {time.time() - t:6.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
