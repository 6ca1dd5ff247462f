"""Every registered query of the library against its SQL in DuckDB, and that those without SQL give rows of a fixed schema."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from larkspur.plans import decision_queries, index_queries, more_queries  # noqa: F401
from larkspur.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):  # a column of whole numbers with nulls comes as doubles
        return int(v) if v.is_integer() and abs(v) < 2**53 else round(v, 6) + 0.0
    return v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, duck, small):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, small):
    first = QUERIES[name](spark, small)
    assert first.columns
    first.collect()


def test_old_vectors_of_the_runs_moment(spark, tmp_path):
    """Vectors 240, 480, ... have the time of the maintenance run itself, and still are old ones."""
    docs = spark.range(0, 3000, 10).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'s' AS source", "CAST(9 AS BIGINT) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(240, 3000, 240).selectExpr("id AS vec_id", "array(1F, CAST(id AS FLOAT)) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = c.execute(ORACLE_SQL["maintain_vectors"]).df()
    assert "old" in set(want.origin)
    assert rows_of(QUERIES["maintain_vectors"](spark, str(tmp_path)).toPandas()) == rows_of(want)
