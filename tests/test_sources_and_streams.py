import pytest
from pyspark.sql import functions as F

from corpuskit.sources import files as S
from corpuskit.streaming import sessions as R


def test_log_keeps_every_line(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿a\r\nb\n\n".encode())
    got = S.read_log(spark, f"{tmp_path}/a.txt").orderBy("line").collect()
    assert [(r.line, r.text) for r in got] == [(1, "a"), (2, "b"), (3, ""), (4, "")]


def test_json_and_embedded_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\nbroken\n')
    got = S.read_json(spark, f"{tmp_path}/a.json", "a int").collect()
    assert sorted((r.a is None, r._corrupt) for r in got) == [(False, None), (True, "broken")]
    df = spark.createDataFrame([('x.push(...[{"id": 1}, {"id": 2}])',), ("none",)], "t string")
    assert [r.x for r in df.select(S.embedded_array("t", "struct<id:int>").alias("x")).collect()][0][1].id == 2


def test_pages_in_another_encoding(spark, tmp_path):
    (tmp_path / "p.html").write_bytes("<p>日本</p>".encode("shift_jis"))
    assert S.read_pages(spark, f"{tmp_path}/p.html", "shift_jis").first().html == "<p>日本</p>"


def test_reports(spark, tmp_path):
    assert not S.write_csv(spark.createDataFrame([], "a int"), f"{tmp_path}/c")
    assert S.write_csv(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/c")
    with pytest.raises(ValueError):
        S.write_report(spark.createDataFrame([(float("nan"),)], "a double"), f"{tmp_path}/r")
    assert len(S.file_digests(spark, f"{tmp_path}/c").collect()) >= 1


def test_snapshots(spark, tmp_path):
    s = S.Snapshots(spark, f"{tmp_path}/snap")
    one = s.publish({"t": spark.createDataFrame([(1,), (2,)], "a int")})
    assert s.publish({"t": spark.createDataFrame([(2,), (1,)], "a int")}) == one
    two = s.publish({"t": spark.createDataFrame([(3,)], "a int")})
    assert two != one and s.load()["t"].count() == 1
    assert s.rollback() == one and s.load()["t"].count() == 2
    spark.createDataFrame([(9,)], "a int").write.mode("overwrite").parquet(f"{tmp_path}/snap/{one}/t.parquet")
    with pytest.raises(ValueError):
        s.load()


def test_stream_gives_what_the_table_gives(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").orderBy("ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = R.session_stream(stream).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user_id, r.begin): r.n_events for r in spark.table("sess").collect()}
    want = {(r.user_id, r.begin): r.n_events for r in R.session_stream(events).collect()}
    assert got and all(want[k] == v for k, v in got.items())
