from atlas.operators import chunk
from atlas.streaming import index


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r", f"f{i}", "\n".join(f"l{i} {k}" for k in range(n)), f"2024-01-01 00:0{i}:00") for i, n in enumerate([1, 60, 130])]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, content string, at string").selectExpr("repo_id", "file_path", "content", "cast(at as timestamp) at")
    source = f"file://{tmp_path}/in"
    df.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(df.schema).parquet(source)
        index.write(index.chunks(stream, "at"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    df.write.mode("append").parquet(source)  # the same versions again
    index.write(index.chunks(spark.readStream.schema(df.schema).parquet(source), "at"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    got = sorted((r.file_path, r.start_line, r.end_line) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == sorted((r.file_path, r.start_line, r.end_line) for r in chunk.windows(df).collect())
