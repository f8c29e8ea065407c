from wordwave.operators import words
from wordwave.operators.words import Param
from wordwave.sources.series import DAY
from wordwave.streaming import write_bags


def test_stream_equals_batch(spark, tmp_path):
    rows = [(o, "b", 0, k * DAY, float(k), float((k * 7 + len(o)) % 5), k) for o in ("x", "yy") for k in range(15)]
    df = spark.createDataFrame(rows, "object_id string, band string, band_idx int, tus long, t double, value double, ord long")
    for o in ("x", "yy"):
        df.where(df.object_id == o).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    params = [Param(6, 1, ("min_max",))]
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_bags(stream, params, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select("object_id", "word", "tf").collect()
    want = words.bag(words.words(df, params)).select("object_id", "word", "tf").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
