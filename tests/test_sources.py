import pytest
from pyspark.sql import types as T

from tabsight.operators.splits import spotlight_ids, spotlight_sample
from tabsight.sources import files as S
from tabsight.sources import predictions as P


@pytest.mark.parametrize("sep", [";", ","])
def test_delimiter_is_sniffed_and_headers_cleaned(spark, tmp_path, sep):
    f = tmp_path / "t.csv"
    f.write_text(sep.join([" ID", "Weight "]) + "\n" + sep.join(["1", "70.5"]) + "\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    assert [tuple(r) for r in S.read_delimited(spark, str(f), schema).collect()] == [(1, 70.5)]
    assert S.read_delimited(spark, str(f)).columns == ["id", "weight"]


def test_columns_are_found_by_header_name(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("Weight , ID\n70.5,1\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    assert [tuple(r) for r in S.read_delimited(spark, str(f), schema).collect()] == [(1, 70.5)]
    for bad in (T.StructType(schema.fields[:1]), T.StructType([*schema.fields, T.StructField("age", T.IntegerType())])):
        with pytest.raises(ValueError, match="does not match"):
            S.read_delimited(spark, str(f), bad)


def test_id_list_keeps_digit_lines(spark, tmp_path):
    f = tmp_path / "ids.txt"
    f.write_text("3\n x\n 12 \n\n-4\n5a\n3\n")
    ids = S.read_id_list(spark, str(f))
    assert [r["id"] for r in ids.collect()] == [3, 12, 3]
    df = spark.range(10)
    assert [r["id"] for r in spotlight_ids(df, "id", ids).collect()] == [3]
    assert spotlight_ids(df, "id", ids.filter("id > 10"), n=4).count() == 4
    assert spotlight_sample(df, "id", 4).count() == 4


def test_partitioned_sink_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id int, model string, fold int")
    S.write_table(df, str(tmp_path / "p"), partition_by=["model", "fold"])
    back = spark.read.parquet(str(tmp_path / "p")).filter("fold = 1")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(fold" in back._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="already exists"):
        S.write_table(df, str(tmp_path / "p"))


def test_materialised_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [2.0])], "a int, b array<double>")
    back = S.materialised(df)
    assert back.schema == df.schema and back.collect() == df.collect()


def test_normalised_predictions(spark):
    raw = spark.createDataFrame([(7, None, 1.5), (8, 1, None), (9, 1, float("nan"))], "sid int, label int, prob double")
    got = [tuple(r) for r in P.normalise_predictions(raw, key="sid", model="z").collect()]
    assert got == [(7, -1, "z", 0, 1.0), (8, -1, "z", 1, 0.5), (9, -1, "z", 1, 0.5)]
    with pytest.raises(ValueError, match="no prediction"):
        P.normalise_predictions(raw.select("sid", "label"), key="sid")


def test_first_available_source_wins(spark):
    df = spark.createDataFrame([("m", 1, 0.1, "root"), ("m", 1, 0.2, "final"), ("m", 2, 0.3, "else"), ("m", 2, 0.4, "root")],
                               "model string, id int, y_pred double, source string")
    got = {r["id"]: (r["y_pred"], r["source"]) for r in P.prefer_source(df, ["final", "root"]).collect()}
    assert got == {1: (0.2, "final"), 2: (0.4, "root")}


def test_manifest(spark):
    df = spark.createDataFrame([("m", 1, 0, 1), ("m", 2, 1, 0), ("m", 2, 1, 0)], "model string, id int, fold int, y_true int")
    r = P.prediction_manifest(df).first()
    assert (r["rows"], r["ids"], r["folds"], r["columns"]) == (3, 2, "0,1", 4)
    assert r["positive_ratio"] == pytest.approx(1 / 3)


def test_shared_folder_is_below_the_named_one(spark, tmp_path, monkeypatch):
    class Session:
        conf = {"spark.checkpoint.dir": str(tmp_path)}

    with monkeypatch.context() as m:
        m.setattr(S, "_hadoop", lambda *a: None)
        a, b = S.shared_folder(Session()), S.shared_folder(Session())
    assert a != b and a.startswith(str(tmp_path)) and S.shared_folder(spark) != S.shared_folder(spark)


def test_discard_deletes_what_was_written(spark):
    kept, gone = S.materialised(spark.range(3).toDF("a")), S.materialised(spark.range(4).toDF("a"))
    S.discard(gone)
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone._tabsight_path).count()
