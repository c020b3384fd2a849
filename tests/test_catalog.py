import duckdb
import pytest

from maskwright.plans import catalog
from maskwright.streaming import watch

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(None if v is None else str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    df = catalog.queries()[name](spark, AT)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(df.select(columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    df = catalog.queries()[name](spark, AT)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    watch.watch(spark, f"{tmp_path}/in", docs.schema.simpleString()[7:-1].replace(":", " "), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    keys = ["doc_id", "line_index", "type", "text", "start"]
    assert plain(spark.read.parquet(f"{tmp_path}/out").select(keys).collect()) == plain(watch.detections(docs).select(keys).collect())
