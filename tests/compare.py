"""Run a query and its SQL on the same tables and compare columns, types and rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FAMILIES = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "DOUBLE": "double", "FLOAT": "double",
    "VARCHAR": "text", "TIMESTAMP": "time", "DATE": "date", "BOOLEAN": "bool",
    "byte": "int", "short": "int", "int": "int", "bigint": "int", "double": "double", "float": "double",
    "string": "text", "timestamp_ntz": "time", "timestamp": "time", "date": "date", "boolean": "bool",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, list):
        return tuple(_norm(v) for v in value)
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9) + 0.0
    return value


def compare(df, con, sql):
    """Differences as a list of texts; empty when equal."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    theirs = cursor.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns: {sorted(df.columns)} / {sorted(names)}"]
    for name, dtype in df.dtypes:
        a, b = FAMILIES.get(dtype, dtype), FAMILIES.get(types[name], types[name])
        if a != b and not (a.startswith("array") and "[]" in b):
            problems.append(f"type of {name}: {dtype} / {types[name]}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    ours = Counter(tuple(_norm(row[n]) for n in order) for row in df.collect())
    wanted = Counter(tuple(_norm(row[i]) for i in at) for row in theirs)
    if ours != wanted:
        extra, missing = list((ours - wanted).items())[:3], list((wanted - ours).items())[:3]
        problems.append(
            f"rows {sum(ours.values())} / {sum(wanted.values())}; {order}; only ours {extra}; only theirs {missing}"
        )
    return problems
