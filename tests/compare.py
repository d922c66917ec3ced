"""Runs registered queries beside their SQL in DuckDB and compares whole results."""

import os
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value + 0.0:.6g}"
    if isinstance(value, (list, tuple)):
        return tuple(norm(x) for x in value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(norm(r[k]) for k in order) for r in data)


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = db.execute(sql)
    names = [c[0] for c in out.description]
    theirs = rows(names, out.fetchall())
    assert sorted(df.columns) == sorted(names), f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    assert mine == theirs, f"{name}: {sum(mine.values())} and {sum(theirs.values())} rows; only mine {list((mine - theirs).items())[:3]}; only theirs {list((theirs - mine).items())[:3]}"
    return sum(mine.values())


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import time

    from conftest import spark as fixture

    import __spark_entry__ as entry

    spark, queries, sqls = fixture.__wrapped__(), entry.queries(), entry.oracle_sql()
    sf = os.environ.get("TEST_SF", "/root/testdata/sf0.01")
    for name in sys.argv[1:] or list(queries):
        began = time.time()
        try:
            n = compare(spark, name, queries[name], sqls[name], sf) if name in sqls else queries[name](spark, sf).count()
            print("ok" if name in sqls else "no SQL", name, n, f"{time.time() - began:.1f} s", flush=True)
        except Exception as error:  # noqa: BLE001
            print("FAILED", name, str(error)[:1500], flush=True)
