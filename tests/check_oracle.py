"""Compare every registered query with its SQL on one scale.

    python -m tests.check_oracle /root/testdata/sf0.01 [name ...]
"""

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a short description of the first difference."""
    mine_cols, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    odd = [d[0] for d in cur.description if "HUGEINT" in str(d[1]) or "DECIMAL" in str(d[1])]
    if odd:
        return f"SQL gives wide numbers for {odd}"
    theirs_cols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine_cols != theirs_cols:
        return f"columns {mine_cols} != {theirs_cols}"
    if mine == theirs:
        return None
    extra = [r for r in mine if r not in set(theirs)][:3]
    lost = [r for r in theirs if r not in set(mine)][:3]
    return f"{len(mine)} vs {len(theirs)} rows; only spark {extra}; only sql {lost}"


def main():
    from annotary.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        conf={
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                diff = compare(df, con, sqls[name])
            else:
                diff = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            diff = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += diff is not None
        state = "ok" if diff is None else "DIFF"
        if diff is None and name not in sqls:
            state = "ok (rows only)"
        print(f"{name:28s} {time.time() - start:6.2f}s {state} {diff or ''}", flush=True)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
