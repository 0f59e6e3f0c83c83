from __future__ import annotations

from datetime import datetime, timedelta

from tests.conftest import rows
from tidemark.streaming import incremental

T0 = datetime(2021, 1, 1)


def feed(spark, tmp_path, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_change_signals_over_batches(spark, tmp_path):
    batches = [[("A", T0, 1.0), ("B", T0, 5.0)], [("A", T0 + timedelta(days=1), 3.0)], [("A", T0 + timedelta(hours=1), 9.0), ("A", T0 + timedelta(days=2), 2.0)]]
    src = feed(spark, tmp_path, batches, "e string, t timestamp, v double")
    out = drain(incremental.change_signals(src, entity="e", time="t", value="v"), "changes", spark)
    got = {(r["e"], r["value"]): r["change"] for r in out.collect()}
    assert got == {("A", 1.0): None, ("B", 5.0): None, ("A", 3.0): 2.0, ("A", 9.0): None, ("A", 2.0): -1.0}


def test_windows_agree_between_stream_and_table(spark, tmp_path):
    data = [("k", T0 + timedelta(minutes=7 * i), float(i)) for i in range(40)]
    schema = "e string, t timestamp, v double"
    kw = {"time": "t", "keys": ["e"], "value": "v", "width": "1 hour"}
    table = rows(incremental.windowed_counts(spark.createDataFrame(data, schema), **kw))
    src = feed(spark, tmp_path, [data[:20], data[20:], [("k", T0 + timedelta(days=9), 0.0)]], schema)
    stream = rows(drain(incremental.windowed_counts(src, **kw), "windows", spark))
    assert stream == table
