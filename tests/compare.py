"""Order-insensitive comparison of a Spark result with the same query in SQL."""

import datetime
import math

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


def _cell(value):
    if isinstance(value, float):
        return 0.0 if value == 0 or math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def differences(df, con, sql: str) -> list[str]:
    mine, my_columns = _rows(df.columns, df.collect())
    result = con.execute(sql)
    theirs, their_columns = _rows([d[0] for d in result.description], result.fetchall())
    if my_columns != their_columns:
        return [f"columns {my_columns} vs {their_columns}"]
    problems = []
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
    if mine and theirs:
        for i, name in enumerate(my_columns):
            kinds = {type(r[i]) for r in mine if r[i] is not None}, {type(r[i]) for r in theirs if r[i] is not None}
            if kinds[0] and kinds[1] and kinds[0] != kinds[1]:
                problems.append(f"{name}: {kinds[0]} vs {kinds[1]}")
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    problems += [f"only spark: {x}" for x in sorted(a - b)[:3]] + [f"only sql: {x}" for x in sorted(b - a)[:3]]
    return problems
