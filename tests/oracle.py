"""Compares queries with their SQL in DuckDB: names, rows and values, whatever their order."""

from __future__ import annotations

import decimal
import sys

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else x


def differences(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    df, rel = query(spark, sf_dir), con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {df.columns} and {rel.columns}"]
    order = sorted(df.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    out = [f"type of {c}: {t} and {types[c]}" for c, t in df.dtypes if t in kinds and kinds[t] != types[c]]
    a = sorted((tuple(map(_plain, r)) for r in df.select(*order).collect()), key=repr)
    b = sorted((tuple(map(_plain, r)) for r in rel.select(*[f'"{c}"' for c in order]).fetchall()), key=repr)
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    out += [f"{x} and {y}"[:600] for x, y in zip(a, b, strict=False) if x != y][:3]
    return out


def main(names: list[str]) -> int:
    """python tests/oracle.py [NAME...]: prints what differs at sf0.01."""
    import time

    import __spark_entry__ as entry
    from tests.conftest import session

    spark, sf_dir, bad = session(), "/root/testdata/sf0.01", 0
    con, sql = connection(sf_dir), entry.oracle_sql()
    for name, q in entry.queries().items():
        if name in sql and (not names or name in names):
            began = time.time()
            try:
                found = differences(spark, con, sf_dir, q, sql[name])
            except Exception as e:  # noqa: BLE001 - reported and counted
                found = [f"{type(e).__name__}: {str(e)[:700]}"]
            bad += bool(found)
            print(f"{name}: {'ok' if not found else found} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
