"""Runs a registered query and its DuckDB twin and compares the rows in any order."""

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v.tolist()) if hasattr(v, "tolist") else repr(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, sf_dir, query, sql):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = canonical(query(spark, sf_dir).toPandas()), canonical(db.sql(sql).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)
