"""Run registered queries against their oracles.  usage: python tests/compare.py [sf] [name-regex]"""
import datetime
import decimal
import math
import os
import re
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def spark_session(cpus=8):
    return (SparkSession.builder.master(f"local[{cpus}]").appName("placeproof")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
            .getOrCreate())


def canon(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != 0 else "0.0"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def kind(v):
    if isinstance(v, bool):
        return "bool"
    return "float" if isinstance(v, (float, decimal.Decimal)) else type(v).__name__


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    kinds = {}
    for r in rows:
        for i in order:
            if r[i] is not None:
                kinds.setdefault(cols[i], kind(r[i]))
    return [cols[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows), kinds


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def oracle(con, sql):
    res = con.execute(sql)
    return rows_of([d[0] for d in res.description], res.fetchall())


def main():
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pat = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    sf_dir = f"/root/testdata/sf{sf}"
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    good = bad = 0
    for name, fn in entry.queries().items():
        if not pat.search(name):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time() - t0
            plan = df._jdf.queryExecution().executedPlan().toString()
            if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
                print(f"      nested loop in {name}: {plan.count('CartesianProduct')} {plan.count('BroadcastNestedLoopJoin')}")
            if name not in sqls:
                print(f"rows  {name}: {len(got[1])} rows {t1:.1f}s")
                good += 1
                continue
            exp = oracle(con, sqls[name])
            t2 = time.time() - t0 - t1
            if got == exp:
                print(f"ok    {name}: {len(got[1])} rows {t1:.1f}s sql {t2:.1f}s")
                good += 1
                continue
            bad += 1
            print(f"DIFF  {name}: {len(got[1])} vs {len(exp[1])} rows {t1:.1f}s")
            if got[0] != exp[0]:
                print("   cols", got[0], exp[0])
            if got[2] != exp[2]:
                print("   kinds", {k: (v, exp[2].get(k)) for k, v in got[2].items()
                                   if exp[2].get(k) != v})
            a, b = set(got[1]), set(exp[1])
            for r in sorted(a - b)[:3]:
                print("   spark", r)
            for r in sorted(b - a)[:3]:
                print("   sql  ", r)
        except Exception as e:
            bad += 1
            msg = str(e)
            print(f"FAIL  {name}: {type(e).__name__} {msg[:700]}")
            if "-v" in sys.argv:
                traceback.print_exc()
        sys.stdout.flush()
    print(f"good {good} bad {bad}")


if __name__ == "__main__":
    main()
