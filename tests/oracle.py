"""Run registered queries next to DuckDB on the same parquet tables.

    python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import decimal
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value: object) -> str:
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        if value != value:
            return "~"
        return repr(round(float(value), 6))
    return str(value)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(r[n]) for n in names) for r in df.select(*names).collect())


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    wide = [c for c, k in kinds.items() if k in ("HUGEINT", "UBIGINT") or k.startswith("DECIMAL") or "[]" in k]
    if wide:
        raise AssertionError(f"cast these columns: {wide}")
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = sorted(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())
    return [cols[i] for i in order], rows


def compare(spark, sf_dir: str, name: str, plans, sqls) -> str:
    began = time.time()
    names, got = spark_rows(plans[name](spark, sf_dir))
    took = time.time() - began
    if name not in sqls:
        return f"rows-only {len(got)} rows {took:.1f}s" if got else "EMPTY"
    began = time.time()
    want_names, want = duck_rows(sf_dir, sqls[name])
    duck = time.time() - began
    if names != want_names:
        return f"FAIL columns {names} vs {want_names}"
    if got != want:
        only = [r for r in got if r not in set(want)][:3]
        miss = [r for r in want if r not in set(got)][:3]
        return f"FAIL rows {len(got)} vs {len(want)}\n   spark only: {str(only)[:600]}\n   duck only: {str(miss)[:600]}"
    return f"ok {len(got)} rows {took:.1f}s duck {duck:.1f}s" + ("  EMPTY" if not got else "")


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]").appName("cueloom-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--dir", default="")
    args.add_argument("prefix", nargs="*")
    opts = args.parse_args()
    import __spark_entry__ as entry

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    plans, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in plans:
        if opts.prefix and not any(name.startswith(p) for p in opts.prefix):
            continue
        try:
            line = compare(spark, opts.dir or f"/root/testdata/sf{opts.sf}", name, plans, sqls)
        except Exception as exc:  # noqa: BLE001
            line = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        bad += not (line.startswith("ok") or line.startswith("rows-only"))
        print(f"{name}: {line}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
