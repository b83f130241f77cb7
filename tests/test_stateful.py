"""State with expiry and timers, and emission that survives a restart."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import discover, moderators, windows
from tidemark.operators.canonical import CHANNELS
from tidemark.sources import sinks
from tidemark.streaming import emission, stateful

FRAMES = "session_id string, frame long, ts timestamp, is_event boolean, window int"


def _frame(s, f, event, window, at=None):
    return (s, f, datetime(2026, 1, 1) + timedelta(seconds=f if at is None else at), event, window)


def _run(spark, df, folder, query="q", **options):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    with stateful.rocksdb(spark):
        emission.emit(df, folder, query, **options)
    return emission.committed(spark, folder, query, schema)


def _stream(spark, parts, schema, folder):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_coherence_equals_batch_for_any_cut(spark, tmp_path):
    rng = random.Random(2)
    rows = [_frame(s, f, rng.random() < 0.08, rng.randint(2, 6)) for s in ("a", "b") for f in range(60)]
    want = {(r["session_id"], r["frame"]): r["coherence_active"] for r in moderators.coherence(spark.createDataFrame(rows, FRAMES), F.col("window")).collect()}
    cuts = [0, 7, 8, 30, 60]
    parts = [[r for r in rows if a <= r[1] < b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for p in parts:
        rng.shuffle(p)
    parts.append([_frame("a", 3, True, 5, 60), _frame("a", 60, False, 5), _frame("a", 60, True, 5)])  # late, new and repeated
    got = _run(spark, stateful.live_coherence(_stream(spark, parts, FRAMES, str(tmp_path))), str(tmp_path)).collect()
    frames = {(r["session_id"], r["frame"]): r["coherence_active"] for r in got if r["kind"] == "FRAME"}
    assert {k: v for k, v in frames.items() if k != ("a", 60)} == want and ("a", 60) in frames
    assert sorted(r["frame"] for r in got if r["kind"] == "LATE") == [3, 60]


def test_state_goes_after_its_time(spark, tmp_path):
    parts = [[_frame("a", 0, True, 500)], [_frame("a", 1, False, 500), _frame("b", 0, True, 500)], [_frame("b", 200, False, 500)], [_frame("a", 2, False, 500, 210)]]
    for ttl, want in ((10_000_000, True), (50_000, False)):
        folder = str(tmp_path / str(ttl))
        got = _run(spark, stateful.live_coherence(_stream(spark, parts, FRAMES, folder), delay="1 second", ttl_ms=ttl), folder).collect()
        own = {r["frame"]: r["coherence_active"] for r in got if r["session_id"] == "a" and r["kind"] == "FRAME"}
        assert own == {0: True, 1: True, 2: want}
        assert any(r["kind"] == "FORGOTTEN" for r in got) is not want


def test_edges_equal_batch_with_a_decay_of_each_frame(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4))
    x[:, 1] += 0.8 * x[:, 0]
    x[40:70, 2] = 1.0  # constant for more than a window
    rows = [("s", f, datetime(2026, 1, 1) + timedelta(seconds=f), 0.9 + 0.09 * (f % 2), *map(float, x[f])) for f in range(120)]
    schema = "session_id string, frame long, ts timestamp, decay double, " + ", ".join(f"{c} double" for c in CHANNELS)
    batch = spark.createDataFrame(rows, schema)
    maxima = discover.edge_maxima(discover.discoveries(windows.pair_correlations(batch, CHANNELS, ["session_id"], "frame", 20), 0.3))
    want = {(r["frame"], r["edge"]): r["confidence"] for r in discover.edge_decay(batch, maxima, "decay").collect()}
    parts = [rows[a:b] for a, b in ((0, 5), (5, 60), (60, 61), (61, 120))] + [rows[7:8]]
    got = _run(spark, stateful.live_edges(_stream(spark, parts, schema, str(tmp_path)), window=20, threshold=0.3, decay="decay"), str(tmp_path)).collect()
    edges = {(r["frame"], r["edge"]): r["confidence"] for r in got if r["kind"] == "EDGE"}
    assert edges.keys() == want.keys() and all(abs(edges[k] - want[k]) < 1e-9 for k in want) and len(want) > 50
    assert {r["frame"] for r in got if r["kind"] == "LATE"} <= {7}


SAMPLES = "stream_id string, sequence long, ts timestamp, payload string"


def _sample(s, i):
    return (s, i, datetime(2026, 1, 1) + timedelta(seconds=i), f"p{i}")


def test_permuted_samples_come_out_in_order(spark, tmp_path):
    rng = random.Random(5)
    order = sorted(range(90), key=lambda i: i + rng.uniform(0, 12))
    parts = [[_sample(s, i) for s in ("a", "b") for i in order[k : k + 18]] for k in range(0, 90, 18)] + [[_sample(s, 10_000) for s in ("a", "b")], [_sample("a", 20_000)]]
    got = _run(spark, stateful.reordered(_stream(spark, parts, SAMPLES, str(tmp_path)), delay="30 seconds", capacity=100), str(tmp_path)).toPandas()
    assert set(got["kind"]) == {"ROW"}
    for s in ("a", "b"):
        own = got[got["stream_id"] == s]
        by_batch = [own[own["batch"] == b]["sequence"].tolist() for b in sorted(own["batch"].unique())]
        out = [i for b in by_batch for i in sorted(b)]
        assert [i for i in out if i < 90] == list(range(90)) and len(by_batch) > 2


def test_overflow_is_counted(spark, tmp_path):
    parts = [[_sample("a", i) for i in range(25)], [_sample("a", i) for i in range(25, 32)], [_sample("a", 5000)], [_sample("a", 4)], [_sample("a", 9000)]]
    got = _run(spark, stateful.reordered(_stream(spark, parts, SAMPLES, str(tmp_path)), delay="10 minutes", capacity=20), str(tmp_path)).toPandas()
    over = got[got["kind"] == "OVERFLOW"].sort_values("batch")
    assert list(zip(over["sequence"], over["last_sequence"], over["n"], strict=True)) == [(20, 24, 5), (25, 31, 7), (5000, 5000, 1)]
    assert sorted(got[got["kind"] == "ROW"]["sequence"]) == list(range(20)) and set(got[got["kind"] == "LATE"]["sequence"]) <= {4}


def test_emission_survives_a_restart(spark, tmp_path):
    rows = [[(i,) for i in range(k, k + 5)] for k in range(0, 25, 5)]
    stream = _stream(spark, rows, "v long", str(tmp_path))
    out = stream.select("v", sinks.dashboard_line(F.col("v"), F.col("v") * 2, F.lit("a->b"), F.lit(1.0)).alias("line"))
    failed = []

    def stop(batch):
        if batch == 2 and not failed:
            failed.append(batch)
            raise RuntimeError("killed between write and commit")

    with pytest.raises(Exception, match="killed"):
        emission.emit(out, str(tmp_path), "lines", before_commit=stop)
    first = emission.committed(spark, str(tmp_path), "lines", "v long, line string")
    assert sorted(r["v"] for r in first.collect()) == list(range(10))
    emission.emit(out, str(tmp_path), "lines")
    emission.emit(out, str(tmp_path), "lines")
    got = emission.committed(spark, str(tmp_path), "lines", "v long, line string").collect()
    assert sorted(r["v"] for r in got) == list(range(25)) and all("a->b" in r["line"] for r in got)
    emission.committed_sink(str(tmp_path), "lines")(spark.range(3).selectExpr("id as v", "'again' as line"), 2)
    assert emission.committed(spark, str(tmp_path), "lines", "v long, line string").count() == 25
