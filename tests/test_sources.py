import pytest
from pyspark.sql import functions as F

from cubewright.plans import layout, tuner
from cubewright.functions.schema import sales_schema
from cubewright.operators.mutations import MutableCube
from cubewright.sources import hpds
from cubewright.sources.generators import generate
from cubewright.streaming import append


def test_dataset_round_trip(spark, tmp_path):
    records = [(i << 40 | i, i) for i in range(1000)] + [(1 << 70, 7)]
    hpds.write_dataset(str(tmp_path / "x.bin"), iter(records), len(records))
    got = hpds.read_dataset(spark, str(tmp_path / "x.bin")).collect()
    assert sorted(((r["key_hi"] << 64) | r["key_lo"], r["value"]) for r in got) == sorted(records)


@pytest.mark.parametrize("raw", [b"HPDS0002" + b"\0" * 8, b"HPDS0001" + (3).to_bytes(8, "little") + b"\0" * 24])
def test_bad_datasets(spark, tmp_path, raw):
    (tmp_path / "x.bin").write_bytes(raw)
    with pytest.raises(Exception, match="no dataset|cut short"):
        hpds.read_dataset(spark, str(tmp_path / "x.bin")).collect()


def test_spec_and_results(spark, tmp_path):
    spec = {"n_records": 3, "point_lookup_keys": [1, 1 << 70], "narrow_range": {"lo": 5, "hi": 9}, "moving_windows": [{"lo": 1, "hi": 2}], "insert_keys": [], "delete_keys": [4], "hypercube": [{"dim": 0, "lo": 1, "hi": 2}]}
    hpds.write_spec(str(tmp_path / "s.json"), spec)
    assert hpds.read_spec(str(tmp_path / "s.json")) == spec
    hpds.write_results(str(tmp_path / "r.json"), "cube", "uniform", [{"name": "Q1", "elapsed_ms": 1.5, "count": 3, "sum": 2.0, "checksum": 9, "extra": ""}])
    assert hpds.results_frame(spark, str(tmp_path / "r.json")).select("name", "count").collect() == [("Q1", 3)]


def test_stream_equals_table(spark, data, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = append.windowed_sums(append.event_stream(spark, str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    want = append.windowed_sums(spark.read.parquet(f"{data}/events.parquet"))
    assert sorted(spark.table("w").collect()) == sorted(want.collect())


def test_stream_appends(spark, tmp_path):
    cube = MutableCube(layout.bulk_load(generate(spark, "uniform", 100, partitions=2), sales_schema(), str(tmp_path / "c")))
    generate(spark, "skewed", 60, seed=9, partitions=3).withColumn("value", F.col("value") + 500).write.parquet(str(tmp_path / "in"))
    batches = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append.append_to(cube, batches, str(tmp_path / "ck")).awaitTermination()
    assert cube.count() == 160


def test_tuner(spark):
    runs = spark.createDataFrame([("x", "q1", 2.0, 1.0), ("x", "q2", 1.0, 1.0), ("y", "q1", 1.0, 2.0)], "run string, query string, base_ms double, own_ms double")
    scores = {r["run"]: r["score"] for r in tuner.score(runs, {"q1": 1.0, "q2": 0.5}).collect()}
    assert scores["x"] > 0 > scores["y"]
    features = tuner.data_features(generate(spark, "uniform", 500, partitions=2))
    samples = features.crossJoin(spark.range(10, 36).select((F.col("id") / 10).alias("k"))).withColumn("score", -((F.col("k") - 2) ** 2))
    for model in ("gbt", "polynomial"):
        assert abs(tuner.best_k(tuner.fit(samples, model, rounds=20), features) - 2) < 0.35
    assert tuner.timings([3.0, 1.0, 2.0])["p95"] == 3.0
