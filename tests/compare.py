"""Holds queries against their SQL, as the driver does: python tests/compare.py [sf] [names]."""

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(float(r[i]) if isinstance(r[i], float) else r[i]) for i in order) for r in records))


def compare(spark, name, f, sql, sf):
    df = f(spark, sf)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    want = rows(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    if got == want:
        return None
    odd = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} rows against {len(want)}; {str(odd)[:600]}"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    own, sql = e.queries(), e.oracle_sql()
    for k in sys.argv[2:] or [k for k in own if k in sql]:
        at = time.time()
        try:
            print(k, compare(session, k, own[k], sql[k], f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}") or "ok", round(time.time() - at, 1), flush=True)
        except Exception as x:  # noqa: BLE001
            print(k, "ERROR", str(x)[:700].replace("\n", " "), flush=True)
