"""Compare registered queries with their SQL: `python tests/check.py [folder] [name ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[sorted(rows.columns)]
    text = rows.astype(object).where(rows.notna(), None).map(repr_value)
    return text.sort_values(list(text.columns), ignore_index=True)


def repr_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None when columns, types and values agree."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    for column in got:  # pandas holds whole numbers with nulls as floats, DuckDB hands them out as Int64
        if column in want and str(want[column].dtype).startswith("Int") and got[column].dtype == "float64":
            got = got.assign(**{column: got[column].astype(want[column].dtype)})
    kinds = [(c, got[c].dtype, want[c].dtype) for c in sorted(got.columns) if got[c].dtype != want[c].dtype]
    kinds = [k for k in kinds if "str" not in str(k[1:]) or "int" in str(k[1:]) or "float" in str(k[1:])]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    left, right = canonical(got), canonical(want)
    if not left.equals(right):
        off = (left != right).any(axis=1)
        return f"{int(off.sum())} rows differ\n{left[off].head(3)}\n{right[off].head(3)}"
    return f"types {kinds}" if kinds else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = contract.oracle_sql()
    bad = []
    for name, run in contract.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - started
            if name not in sql:
                print(f"{name}: {len(got)} rows, no SQL, {took:.1f}s", flush=True)
                continue
            problem = differences(got, con.sql(sql[name]).df())
        except Exception as error:  # report and go on with the next query
            took, problem = time.time() - started, f"{type(error).__name__}: {str(error)[:1500]}"
            got = []
        if problem:
            bad.append(name)
        print(f"{name}: {problem or 'ok'} ({len(got)} rows, {took:.1f}s)", flush=True)
    print("FAILED " + " ".join(bad) if bad else "ALL OK")


if __name__ == "__main__":
    main()
