"""Run a registered query in Spark and its SQL in DuckDB and compare the results exactly."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir) -> str | None:
    """``None`` when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    left = _canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    right = _canonical(columns, result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}: {left[1][:2]} / {right[1][:2]}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(left[1])} rows differ: {left[0]}\n  spark {bad[0][0]}\n  duck  {bad[0][1]}"
    return None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failures = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, fn, sqls[name], sf_dir)
                state = "ok" if problem is None else "DIFF " + problem
            else:
                problem = None
                state = f"rows {fn(spark, sf_dir).count()}"
        except Exception as exc:  # report and go on with the other queries
            problem = state = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        failures += problem is not None
        print(f"{name:38s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
