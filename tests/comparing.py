"""Rows of a Spark query against those of its SQL, in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark, folder: str, query, sql: str) -> None:
    got = query(spark, folder).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)

    def text(v) -> str:
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return repr(round(float(v), 6) + 0.0)

    rows = [sorted(map(tuple, df[sorted(got.columns)].astype(object).map(text).itertuples(index=False))) for df in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]
