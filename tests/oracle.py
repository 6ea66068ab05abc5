"""Order-insensitive comparison of a Spark query with DuckDB SQL over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    shown = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(shown(x) for x in row) for row in df.itertuples(index=False))


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
