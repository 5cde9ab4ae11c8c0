"""Run registered queries beside their SQL and compare the row sets.

``python -m verification.compare [folder] [query ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from crewmetrics.session import RECOMMENDED_CONF
from verification.oracles import ORACLES
from verification.queries import BY_NAME

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    return float(value) if hasattr(value, "__float__") and not isinstance(value, (int, str)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr)


def local_session() -> SparkSession:
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark, con = local_session(), duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in names or BY_NAME:
        try:
            start = time.time()
            df = BY_NAME[name](spark, folder)
            got = df.collect()
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:28s} {len(got):8d} {spent:6.2f}s", flush=True)
                continue
            start = time.time()
            result = con.execute(ORACLES[name])
            columns = [c[0] for c in result.description]
            expected = result.fetchall()
            slow = time.time() - start
            ours, theirs = rows_of(df.columns, got), rows_of(columns, expected)
            same = sorted(df.columns) == sorted(columns) and ours == theirs
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name:28s} {len(got):8d} {spent:6.2f}s  sql {slow:5.2f}s", flush=True)
            if not same:
                print("   columns", sorted(df.columns), sorted(columns), len(ours), len(theirs))
                shown = [(x, y) for x, y in zip(ours, theirs) if x != y][:3]
                for x, y in shown:
                    print("   ours  ", str(x)[:400])
                    print("   theirs", str(y)[:400])
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
