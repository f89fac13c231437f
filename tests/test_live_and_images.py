"""Requests that time out, probes and waits; images from pixels to lines; equal files are read once."""

import numpy as np
from pyspark.sql import functions as F

from lantern.operators import ocr
from lantern.sources import text as sources
from lantern.streaming import live


def test_waits_and_probes(spark):
    rows = spark.range(1, 9).select(live.reconnect_delay_ms(F.col("id"), F.lit(False)).alias("a"), live.reconnect_delay_ms(F.col("id"), F.lit(True)).alias("b"), "id").orderBy("id").collect()
    assert [r.a for r in rows] == [400, 400, 800, 1600, 3200, 5000, 5000, 5000]
    assert [r.b for r in rows] == [800, 800, 1600, 3200, 5000, 5000, 5000, 5000]
    assert spark.range(1).select(live.reconnect_delay_ms(F.lit(10**6), F.lit(True)).alias("a")).first().a == 5000
    cases = [("a", "a", "ok", 9000, "skip"), ("a", "b", "ok", 0, "send"), ("a", "a", "offline", 3000, "probe"), ("a", "a", "offline", 2999, "skip"), ("a", "a", "error", 3000, "probe"), (" ", " ", "error", 9000, "skip"), (None, "a", "offline", 9000, "send"), ("a", None, "ok", None, "send")]
    frame = spark.createDataFrame(cases, "text string, last string, state string, ms long, want string")
    assert all(r.got == r.want for r in frame.select("want", live.to_send(F.col("text"), F.col("last"), F.col("state"), F.col("ms")).alias("got")).collect())


def test_timeout_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "key long, request_id long, kind string"
    rows = [(1, 1, "request"), (1, 2, "request"), (1, 1, "answer"), (2, 5, "request"), (2, 5, "answer"), (3, 9, "answer")]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.timeout_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), wait_ms=100)
    seen = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.select("key", "request_id", "status").collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if len(seen) >= 2:
                break
    finally:
        query.stop()
    assert sorted(seen) == [(1, 2, "error"), (2, 5, "ok")]


def _models():
    # bright pixels are text; a line is read as the letter of its mean brightness
    def detect(planes):
        return (planes[0] > 0.5).astype(np.float32)

    def recognise(lines):
        steps = np.zeros((len(lines), 3, 3))
        for i, x in enumerate(lines):
            steps[i, :, 1 if x[0].max() > 2 else 2] = 1
        return steps

    return detect, recognise, ["a", "b"]


def test_images_to_lines(spark):
    image = np.zeros((64, 96, 4), np.uint8)
    image[10:20, 10:60] = 255
    image[40:50, 10:60] = 180
    planes, sx, sy = ocr.detection_input(image)
    assert planes.shape == (3, 64, 96) and (sx, sy) == (1, 1)
    assert ocr.detection_input(np.zeros((2000, 1000, 4), np.uint8))[0].shape == (3, 960, 480)
    assert (ocr.resize(image, 96, 64) == image).all() and (ocr.resize(image[10:20, 10:60], 7, 3) == 255).all()
    assert [x.shape for x in ocr.line_inputs(image, [{"x": 0, "y": 0, "w": 96, "h": 48}, {"x": 95, "y": 0, "w": 9, "h": 9}, {"x": 0, "y": 0, "w": 2, "h": 60}])] == [(3, 48, 96), (3, 48, 4)]
    rows = [(1, 64, 96, image.tobytes()), (2, 64, 96, np.zeros((64, 96, 4), np.uint8).tobytes()), (3, 64, 96, b"short"), (4, None, None, None)]
    got = ocr.read_images(spark.createDataFrame(rows, "id int, h int, w int, rgba binary"), ["id"], _models)
    assert dict(got.collect()) == {1: "a\nb", 2: "", 3: "", 4: ""}
    assert ocr.read_image(image, lambda p: 1 / 0, None, []) == ""


def test_equal_files_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def reader(data):
        read.add(1)
        return data.decode(), []

    rows = [(f"p{i}", "a.pdf", None, 3, b"abc") for i in range(5)] + [("q", "b.pdf", None, 3, b"xyz"), ("r", "n.txt", None, None, b" plain "), ("s", "n.txt", None, None, b" plain ")]
    files = spark.createDataFrame(rows, "path string, label string, mime string, length int, content binary")
    got = {r.path: r.text for r in sources.extract_once(files, ["label", "length"], {"pdf": reader}).collect()}
    assert got == {f"p{i}": "abc" for i in range(5)} | {"q": "xyz", "r": "plain", "s": "plain"}
    assert read.value == 2
