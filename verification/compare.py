"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python -m verification.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

import duckdb

from tripledger.session import build_session
from verification.queries import REGISTRY
from verification.sql import ORACLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)
    return [columns[i] for i in order], out


def oracle_rows(sf_dir: str, text: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(text)
    return canonical([d[0] for d in cur.description], cur.fetchall())


def spark_rows(spark, sf_dir: str, name: str):
    df = REGISTRY[name](spark, sf_dir)
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def compare(spark, sf_dir: str, name: str) -> str:
    """``ok``, ``rows only`` or a description of the difference."""
    cols, rows = spark_rows(spark, sf_dir, name)
    if name not in ORACLE:
        return f"rows only ({len(rows)})"
    ocols, orows = oracle_rows(sf_dir, ORACLE[name])
    if cols != ocols:
        return f"columns differ: {cols} / {ocols}"
    if len(rows) != len(orows):
        return f"row counts differ: {len(rows)} / {len(orows)}"
    bad = [(a, b) for a, b in zip(rows, orows) if a != b]
    return f"{len(bad)} rows differ, first: {bad[0][0]} / {bad[0][1]}" if bad else "ok"


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(REGISTRY)
    spark = build_session("compare", **{
        "spark.master": "local[8]", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        began = time.time()
        try:
            outcome = compare(spark, sf_dir, name)
        except Exception as exc:  # report and go on to the next query
            outcome = f"failed: {type(exc).__name__}: {str(exc)[:600]}"
        failed += outcome not in ("ok",) and not outcome.startswith("rows only")
        print(f"{name:28s} {time.time() - began:6.2f}s  {outcome}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
