"""Compare catalog queries with their SQL on one scale: python tests/compare.py SF [name...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def _kind(name: str) -> str:
    name = str(name).lower()
    return {"string": "varchar", "bigint": "bigint", "int": "integer"}.get(name, name)


def normalise(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree on names, types and every value."""
    rel = con.sql(sql)
    want_types = {c: _kind(t) for c, t in zip(rel.columns, rel.types)}
    got_types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    if want_types != got_types:
        return f"schema: spark-only {set(got_types.items()) - set(want_types.items())}, sql-only {set(want_types.items()) - set(got_types.items())}"
    got = normalise(df.columns, [tuple(r) for r in df.collect()])
    want = normalise(rel.columns, rel.fetchall())
    if got == want:
        return None
    missing, extra = sorted(set(want) - set(got))[:3], sorted(set(got) - set(want))[:3]
    return f"rows {len(got)} vs {len(want)}; columns {sorted(df.columns)}; spark {extra}; sql {missing}"


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as e
    from lanewise.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connection(sf_dir)
    queries, sql = e.queries(), e.oracle_sql()
    print("sql without query:", sorted(set(sql) - set(queries)), "query without sql:", sorted(set(queries) - set(sql)))
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            diff = difference(df, con, sql[name]) if name in sql else f"ROWS {df.count()}"
        except Exception as exc:  # report and go on
            diff = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(diff) and not str(diff).startswith("ROWS")
        print(f"{name:30s} {time.time() - start:6.2f}s {'ok' if diff is None else diff}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
