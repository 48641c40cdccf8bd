"""Every query with SQL against DuckDB, and the streaming twin against the batch ledger."""

import duckdb
import pandas as pd
import pytest

from lumenlake import catalog
from lumenlake.streaming import ledger

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v)[:19].removesuffix(" 00:00:00") for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs) > 0
    for c in ours.columns:
        if str(ours[c].dtype).startswith(("int", "float")) and str(theirs[c].dtype).startswith(("int", "float")):
            ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    assert canonical(ours) == canonical(theirs)


def test_ledger_stream_equals_batch(spark, tmp_path):
    rows = catalog._ledger(spark, SF).where("kind is not null").groupBy("key", "at", "kind").agg({"value": "max"}).withColumnRenamed("max(value)", "value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledger.grade_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, ledger.grade(rows).collect())) and got
