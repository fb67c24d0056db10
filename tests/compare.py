"""Run a registered query and its oracle and compare rows without regard to order."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "float": "FLOAT", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def differences(spark, db, sf_dir, fn, sql):
    """Text of the first difference, or None."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    types = dict(zip(names, (str(d[1]) for d in cursor.description)))
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    bad = {c: (t, types[c]) for c, t in df.dtypes if KINDS.get(t) != types[c]}
    if bad:
        return f"types {bad}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} / {b}"[:1500]
    return None if got else "no rows"
