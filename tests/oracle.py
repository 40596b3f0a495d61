"""Compare a query with its DuckDB SQL: same columns, same rows in any order."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19]
    return str(x)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def compare(spark, con, make, sql, sf_dir):
    got = make(spark, sf_dir)
    names = sorted(got.columns)
    have = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    ref = con.execute(sql)
    rows = ref.fetchall()
    columns = [d[0] for d in ref.description]
    assert sorted(columns) == names, (sorted(columns), names)
    kinds = {d[0]: str(d[1]).upper() for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = {c: (k, kinds[c]) for c, k in got.dtypes if SAME.get(k, kinds[c]) != kinds[c]}
    assert not wrong, wrong
    order = [columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rows)
    assert len(have) == len(want), (len(have), len(want))
    differ = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    assert not differ, (len(differ), differ[:3])
    return len(have)
