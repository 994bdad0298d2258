"""Compare queries with their SQL twins: python tests/check.py DIR [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both sides give the same columns and rows."""
    cursor = con.execute(sql)
    expected_columns = [x[0] for x in cursor.description]
    expected = rows_of(expected_columns, cursor.fetchall())
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} against {sorted(expected_columns)}"
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return None
    extra, missing = actual - expected, expected - actual
    return (
        f"{sum(actual.values())} against {sum(expected.values())} rows; "
        f"only here {sum(extra.values())} {str(list(extra)[:2])[:600]}; "
        f"only there {sum(missing.values())} {str(list(missing)[:2])[:600]}"
    )


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from ringside import build_session

    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                       "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, oracles = connect(sf_dir), oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                verdict = "ok" if problem is None else f"DIFF {problem}"
                count = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchall()[0][0]
            else:
                count, verdict = len(df.collect()), "rows only"
        except Exception as error:  # noqa: BLE001
            count, verdict = 0, f"FAIL {str(error)[:700]}"
        print(f"{name:22s} {time.time() - start:6.2f}s {count:8d} {verdict}", flush=True)


if __name__ == "__main__":
    main()
