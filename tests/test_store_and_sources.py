"""Store semantics, files of all kinds, and the streaming extension."""

import io as std
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.store import Store
from tidemark.sources import io
from tidemark.streaming.features import streaming_features, windowed_volume


def run(model, score, status="ok", seed=1):
    return ("clf", model, "none", "grid", seed, status, None, score, 0.1, 5, 1.0, 0.5, [0.1, 0.2], {"a": "1"}, [{"a": "1"}], [[0.1], [0.2, 0.3]], "m", "now")


def test_store_upsert(spark, tmp_path):
    s = Store(spark, str(tmp_path / "runs"))
    rows = lambda *r: spark.createDataFrame(list(r), s.schema)
    assert s.load().count() == 0
    s.add(rows(run("tree", 0.8), run("knn", 0.7, "error")))
    with pytest.raises(ValueError, match="already"):
        s.add(rows(run("tree", 0.9)))
    with pytest.raises(ValueError, match="repeats"):
        s.add(rows(run("svm", 0.9), run("svm", 0.8)))
    s.add(rows(run("tree", 0.9), run("svm", 0.6)), overwrite=True)
    got = {r.model: (r.mean_score, r.traces) for r in s.load().collect()}
    assert got == {"tree": (0.9, [[0.1], [0.2, 0.3]]), "knn": (0.7, [[0.1], [0.2, 0.3]]), "svm": (0.6, [[0.1], [0.2, 0.3]])}
    assert s.status(model="knn") == "error" and s.status(model="nope") is None
    plan = s.load().select("task", "model", "balancing", "optimizer", "seed").union(spark.createDataFrame([("clf", "new", "none", "grid", 1)], "a string, b string, c string, d string, e long"))
    assert {r.model for r in s.pending(plan).collect()} == {"knn", "new"}


def test_csv_json_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    io.write_csv(df, str(tmp_path / "c"), "made here", "by hand")
    assert sorted(map(tuple, io.csv(spark, f"{tmp_path}/c/part*", "k int, v string").collect()), key=str) == [(1, "a"), (2, None)]
    assert spark.read.json(f"{tmp_path}/c/_provenance").head().source == "made here"
    io.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    for n in (2, 1):
        io.replace_parquet(df.limit(n), str(tmp_path / "p"))
        assert io.parquet(spark, str(tmp_path / "p"), ["k"]).count() == n
    (tmp_path / "h.csv").write_text("1,x\n2,y\n")
    assert io.csv(spark, str(tmp_path / "h.csv"), "n int, w string", header=False).count() == 2
    assert io.shared(spark, str(tmp_path / "p")) is io.shared(spark, str(tmp_path / "p"))


def test_locate_unzips(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.csv.zip", "w") as z:
        z.writestr("t.csv", "k\n1\n")
    path = io.locate(spark, [str(tmp_path / "none"), str(tmp_path)], "t.csv")
    assert io.csv(spark, path, "k int").head().k == 1
    with pytest.raises(FileNotFoundError):
        io.locate(spark, [str(tmp_path)], "other")


def test_xlsx(spark, tmp_path):
    buf = std.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>2.5</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>1,5</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(buf.getvalue())
    got = sorted((r.row, r.column, r.text, r.number) for r in io.xlsx(spark, str(tmp_path / "b.xlsx")).collect())
    assert got == [(1, 1, "name", None), (1, 28, "2.5", 2.5), (2, 1, "ab", None), (2, 2, "1,5", 1.5)]


def test_manifest_and_fingerprint(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("abc")
    known = spark.createDataFrame([("a.txt", "typed")], "name string, source string")
    m = io.manifest(spark, str(tmp_path / "f"), known).head()
    assert (m.bytes, m.source) == (3, "typed") and m.sha256.startswith("ba7816bf")
    (tmp_path / "f" / "b.txt").write_text("x")
    with pytest.raises(Exception, match="no provenance"):
        io.manifest(spark, str(tmp_path / "f"), known).collect()
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    d = lambda x: io.fingerprint(x).head().digest
    assert d(df) == d(df.repartition(3)) != d(df.distinct()) and d(df.limit(0)) == d(df.limit(0))


def test_registry_refuses_bad_numbers(spark):
    good = {"g": lambda s, r: s.createDataFrame([(1.0,)], "x double")}
    bad = {"b": lambda s, r: s.createDataFrame([(float("inf"),)], "x double")}
    assert io.registry(good, "g", spark, "").count() == 1
    with pytest.raises(Exception, match="non-finite"):
        io.registry(bad, "b", spark, "").collect()


def test_models_save_and_load(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    io.save_model(Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df), str(tmp_path / "m"))
    assert io.load_pipeline(str(tmp_path / "m")).transform(df).head().v.toArray().tolist() == [1.0, 2.0]


def test_streaming_features(spark, tmp_path):
    rows = [("a", datetime(2023, 1, 1, 1), 1.0, "x"), ("a", datetime(2023, 1, 2, 1), 3.0, "y"), ("b", datetime(2023, 1, 9), 5.0, "x")]
    schema = "customer_id string, date timestamp, amount double, type string"
    for k in range(3):
        spark.createDataFrame(rows[k : k + 1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_features(stream, ["x", "y"]).writeStream.outputMode("complete").format("memory").queryName("tm_features").start()
    q.processAllAvailable()
    q.stop()
    got = {r.customer_id: r for r in spark.table("tm_features").collect()}
    assert got["a"].n_tx == 2 and got["a"].share_x == 0.5 and got["b"].total_amount == 5
    q = windowed_volume(stream).writeStream.outputMode("append").format("memory").queryName("tm_volume").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tm_volume").select(F.sum("n")).head()[0] >= 1
