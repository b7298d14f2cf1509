"""Run registered queries next to their check SQL and compare whole results.

``python tests/compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def kind(value):
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def canonical(columns, rows):
    """Rows with columns in name order, sorted; comparison is exact."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def type_family(name):
    name = name.lower()
    for family, words in {
        "int": ("bigint", "int", "integer", "long", "hugeint", "smallint"),
        "double": ("double", "float"),
        "string": ("varchar", "string"),
        "boolean": ("boolean",),
    }.items():
        if name in words:
            return family if family != "int" else name.replace("integer", "int").replace("long", "bigint")
    return name


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    df = query(spark, sf_dir)
    columns, got = canonical(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    expected_columns, want = canonical(rel.columns, rel.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    spark_types = {f.name: type_family(f.dataType.simpleString()) for f in df.schema.fields}
    sql_types = {c: type_family(str(t)) for c, t in zip(rel.columns, rel.types)}
    if spark_types != sql_types:
        return f"types {[(c, spark_types[c], sql_types[c]) for c in columns if spark_types[c] != sql_types[c]]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not got:
        return "no rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {str(bad[0])[:600]}"
    return None


def main():
    from plumbline.registry import all_queries, all_sql
    from plumbline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = all_queries(), all_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
