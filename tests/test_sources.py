import json

from pyspark.sql import functions as F

from weftjoin.functions import predicates as P
from weftjoin.sources.catalog import Catalog, estimated_bytes
from weftjoin.streaming.static_join import stream_query


def test_folder_with_parquet_csv_and_pointer(spark, tmp_path):
    folder = tmp_path / "tables"
    spark.range(3).write.parquet(str(folder / "one.parquet"))
    (tmp_path / "data.csv").write_text('id,name\n1,"a \\"q\\" b"\n')
    (folder / "two.table").write_text(f"{tmp_path}/data.csv\n")
    c = Catalog.from_dir(spark, str(folder))
    assert sorted(c.tables) == ["one", "two"]
    assert c["one"].count() == 3 and c["two"].first()["name"] == 'a "q" b'
    assert spark.table("one").count() == 3 and estimated_bytes(c["one"]) > 0
    c.clear()
    assert not spark.catalog.tableExists("one") and not c.tables


def test_schema_json(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\n1,a\n")
    schema = spark.createDataFrame([], "k int, v string").schema
    (tmp_path / "db.json").write_text(json.dumps({"tables": [{"name": "x", "file": "x.csv", "schema": json.loads(schema.json())}]}))
    assert Catalog.from_schema_json(spark, str(tmp_path / "db.json"))["x"].dtypes == [("k", "int"), ("v", "string")]


def test_predicates(spark):
    df = spark.createDataFrame([("alpha", 1), ("beta", 2), (None, 3)], "s string, n int")
    keep = lambda p, c="s": sorted(r["n"] for r in df.filter(p(F.col(c))).collect())
    assert keep(P.eq("beta")) == [2] and keep(P.ne("beta")) == [1]
    assert keep(P.between(2, 3), "n") == [2, 3] and keep(P.is_in([1, 3]), "n") == [1, 3]
    assert keep(P.contains("ph")) == [1] and keep(P.prefix("be")) == [2]
    assert keep(P.like("%l%a")) == [1] and keep(P.not_like("%l%a")) == [2]
    assert keep(P.is_null()) == [3] and keep(P.is_not_null()) == [1, 2]
    assert keep(lambda c: P.gt("a")(c) & P.lt("b")(c)) == [1]
    assert sorted(r["n"] for r in P.mark_join(df, "s", ["beta", "beta", "x"]).collect()) == [2]


def test_stream_static_join(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 6)], "k bigint, v bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k bigint, v bigint").parquet(str(tmp_path / "in"))
    static = spark.createDataFrame([(1, "one")], "k bigint, name string")
    out = stream_query("e", stream, {"d": static}).join("e.k=d.k").select("e.v", "d.name").to_df()
    q = out.writeStream.format("memory").queryName("joined").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("joined").collect()] == [(5, "one")]
