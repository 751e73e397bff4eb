"""Run queries next to their SQL in DuckDB and compare names, row counts and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    found = df.collect()
    got_names, got = rows_of(df.columns, found)
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    out = []
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        out.append(f"{len(got)} rows != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad or len(got) != len(want):
        out.append(f"{len(bad)} rows differ; columns {got_names}")
        out += [f"  spark {str(g)[:400]}\n  sql   {str(w)[:400]}" for g, w in bad[:3]]
    kinds = dict(df.dtypes)
    for name in got_names:
        spark_t, sql_t = kinds[name], types[name].lower()
        same = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
        if spark_t in same and same[spark_t] not in sql_t and sql_t not in ("string", "number", "bool"):
            out.append(f"  type of {name}: {spark_t} != {sql_t}")
    if not want and not got:
        out.append("no rows at all")
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, bad = connect(folder), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            problems = differences(df, con, checks[name]) if name in checks else ([] if df.collect() else ["no rows at all"])
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        print(f"{'OK ' if not problems else 'BAD'} {name} {time.time() - start:.1f}s{'' if name in checks else ' (no sql)'}", flush=True)
        for p in problems:
            print("   ", p)
        if problems:
            bad.append(name)
    print("bad:", bad)
