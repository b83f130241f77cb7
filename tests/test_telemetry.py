"""Readers, canonicalisation, windows, moderators, discovery."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import crc32c, number, t_critical
from tidemark.operators import canonical, discover, moderators, windows
from tidemark.operators.canonical import CHANNELS
from tidemark.sources import readers, sinks


def test_crc_vectors(spark):
    got = spark.createDataFrame([("123456789",), ("",), (None,), ("a" * 1000,)], "s string").select("s", crc32c("s").alias("c")).toPandas().set_index("s", drop=False)
    assert got["c"].tolist()[:3] == ["E3069283", "00000000", None]


def test_number_is_strict(spark):
    texts = ["1.5", "-2e3", ".5", "7.", "1d", "nan", "", "x", None, " 4 "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(number(F.col("s"))).collect()]
    assert got == [1.5, -2000.0, 0.5, 7.0, None, None, None, None, None, 4.0]


def test_t_critical(spark):
    got = {r.df: r.t for r in spark.createDataFrame([(d,) for d in (0, 1, 4, 11, 13, 14, 28, 30, 100)], "df int").select("df", t_critical(F.col("df")).alias("t")).collect()}
    assert got == {0: 12.706, 1: 12.706, 4: 2.776, 11: 2.228, 13: 2.179, 14: 2.131, 28: 2.042, 30: 2.042, 100: 1.984}


def test_csv_is_canonicalised(spark, tmp_path):
    (tmp_path / "t.csv").write_text("time, Magnetometer ,pixel_variance,entropy,kp,control_baseline\n2026-01-01T00:00:00Z,1,x,3,2,9\n2026-01-01T00:01:00Z,,5,bad,,8\n2026-01-01T00:02:00Z,4,6,7,3,7\n")
    raw = readers.telemetry_csv(spark, str(tmp_path / "t.csv"))
    got = canonical.canonicalise(raw, "time").orderBy("frame").toPandas()
    assert got["em_rf"].tolist() == [1, 1, 4] and got["optical_ir"].tolist() == [5, 5, 6] and got["consciousness_proxy"].tolist() == [3, 3, 7]
    assert got["kp_index"].tolist() == [2, 2, 3] and got["xray_flux"].tolist() == [0, 0, 0] and got["control_baseline"].tolist() == [9, 8, 7]
    assert set(got["control_source"]) == {"supplied"}
    noisy = canonical.canonicalise(raw, "time", parity=True).toPandas()
    assert set(noisy["control_source"]) == {"noise"} and noisy["control_baseline"].tolist() != [9, 8, 7]


def test_time_falls_back_to_a_grid(spark):
    got = canonical.canonicalise(spark.createDataFrame([(i, float(i)) for i in range(3)], "i int, em_rf double"), "i").orderBy("frame").select(F.unix_timestamp("ts")).collect()
    assert [r[0] for r in got] == [0, 60, 120]


def test_bridge_takes_the_last_stream(spark):
    rows = [(0, 100.0, 200.0, 2.5, "0.1"), (20000, 102.0, 201.0, None, "x"), (40000, 101.0, 202.0, 2.5, "0.2")]
    got = canonical.bridge(spark.createDataFrame(rows, "device_time_us long, ppg_red double, ppg_ir double, eda_conductance double, imu_accel_x string")).orderBy("frame").toPandas()
    assert got["optical_ir"].tolist() == [200, 201, 202] and got["consciousness_proxy"].tolist() == [2.5, 0, 2.5] and got["em_rf"].tolist() == [0.1, 0, 0.2]
    assert got["ts"].astype("int64").diff().dropna().nunique() == 1


def test_bridge_ignores_case_and_fills_times(spark):
    rows = [("2026-01-01 00:00:00", 1.0, 0), ("never", 2.0, 20000), ("2026-01-01 00:00:02", 3.0, 40000)]
    got = canonical.bridge(spark.createDataFrame(rows, "timestamp string, PPG_RED double, device_time_us long")).orderBy("frame").select("optical_ir", F.unix_timestamp("ts").alias("s")).collect()
    assert [r.optical_ir for r in got] == [1, 2, 3]
    assert [r.s - got[0].s for r in got] == [0, 0, 2]


def test_decay_of_each_frame(spark):
    import numpy as np

    from tidemark.operators import discover

    rng = np.random.default_rng(3)
    decay = rng.uniform(0.7, 0.99, 60)
    found = {int(t): float(rng.uniform(0.3, 1)) for t in rng.choice(60, 12, replace=False)}
    state, want = 0.0, {}
    for t in range(60):
        state = max(state, found.get(t, 0.0)) * decay[t]
        if state < 0.05:
            state = 0.0
        else:
            want[t] = state
    frames = spark.createDataFrame([("s", t, float(decay[t])) for t in range(60)], "session_id string, frame long, decay double")
    maxima = spark.createDataFrame([("s", t, "a->b", c) for t, c in found.items()], "session_id string, frame long, edge string, confidence double")
    got = {r.frame: r.confidence for r in discover.edge_decay(frames, maxima, "decay").collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_session_records_in_both_layouts(spark, tmp_path):
    record = '{"schema_version":"2.0.0","record_type":"SAMPLE_CHUNK","session_id":"s","device_time_start_us":5,"payload":{"a":1.5,"b":true,"c":"text"}}'
    (tmp_path / "lines.json").write_text(f"{record}\n\n{record}\n")
    (tmp_path / "array.json").write_text(f"  [{record},\n{record}]")
    for name in ("lines", "array"):
        records = readers.session_records(spark, str(tmp_path / f"{name}.json"))
        assert records.count() == 2
        long = readers.samples_of(records)
        assert sorted((r.stream, r.value) for r in long.distinct().collect()) == [("a", 1.5), ("b", 1.0)]
        assert readers.wide_samples(long, ["a", "b"]).count() == 1


def test_null_control_discovers_nothing(spark):
    frames = readers.null_control(spark, 80)
    assert windows.pair_correlations(frames, CHANNELS, ["session_id"], "frame", 50).count() == 0
    assert readers.initial_field(spark, 8).count() == 256


def test_sliding_correlation_of_a_line(spark):
    rows = [("s", i, float(i), 1.5 * i, 0.0, 0.0) for i in range(60)]
    frames = spark.createDataFrame(rows, "session_id string, frame long, " + ", ".join(f"{c} double" for c in CHANNELS))
    found = discover.discoveries(windows.pair_correlations(frames, CHANNELS, ["session_id"], "frame", 50), 0.30).toPandas()
    assert set(found["edge"]) == {"em_rf->optical_ir"} and len(found) == 11 and np.allclose(found["confidence"], 1.0)


def test_sliding_correlation_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 4))
    frames = spark.createDataFrame(pd.DataFrame(x, columns=CHANNELS).assign(session_id="s", frame=range(90)))
    for lag in (0, 3):
        got = windows.pair_correlations(frames, CHANNELS, ["session_id"], "frame", 20, lag).where("frame = 70 and channel_a = 'em_rf' and channel_b = 'optical_ir'").first()
        assert got.pearson_r == pytest.approx(np.corrcoef(x[51:71, 0], x[51 - lag : 71 - lag, 1])[0, 1])


def test_moderators_known_answer(spark):
    rows = [("s", 5, 4.5, 0.5, 12.0, 1e-6)]
    got = moderators.moderated(spark.createDataFrame(rows, "session_id string, frame long, kp_index double, lunar_phase double, sidereal_time double, xray_flux double")).first()
    assert got.pressure == pytest.approx(0.45) and got.m == pytest.approx(1.2475) and got.discovery_threshold == pytest.approx(0.256513, abs=1e-6)
    assert got.confidence_decay == pytest.approx(0.9888125) and got.coherence_window == 20 and got.is_event and got.coherence_active


def test_edge_decay_against_the_recurrence(spark):
    rng = np.random.default_rng(3)
    m = np.where(rng.random(400) < 0.03, rng.uniform(0.3, 1, 400), np.nan)
    frames = spark.range(400).select(F.lit("s").alias("session_id"), F.col("id").alias("frame"))
    maxima = spark.createDataFrame([("s", i, "a->b", float(v)) for i, v in enumerate(m) if v == v], "session_id string, frame long, edge string, confidence double")
    got = {r.frame: r.confidence for r in discover.edge_decay(frames, maxima, decay=0.97).collect()}
    c = 0.0
    for t in range(400):
        c = (max(c, m[t]) if m[t] == m[t] else c) * 0.97
        c = c if c >= 0.05 else 0.0
        assert got.get(t, 0.0) == pytest.approx(c, abs=1e-12)


def test_fill_matches_pandas(spark):
    values = [None, 1.0, None, None, 4.0, None]
    got = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "session_id string, frame int, v double").select("frame", canonical.fill(F.col("v"), "frame").alias("v")).orderBy("frame").toPandas()
    assert got["v"].tolist() == pd.Series(values).ffill().bfill().tolist()


def test_basis_means(spark):
    grid = canonical.basis(spark, 16).toPandas()
    assert abs(grid["w2"].mean()) < 1e-12 and len(grid) == 256
    assert grid["w0"].abs().max() <= 1 + 1e-12 and math.isclose(grid.query("x == 0 and y == 0")["w3"].iloc[0], 0, abs_tol=1e-9)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0.5, {"b": 1.0, "a": 2.0}), (1, 0.0, None)], "frame int, confidence double, m map<string,double>")
    sinks.longitudinal_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.run_metadata(rows, {"run": "x", "alpha": "1"}, str(tmp_path / "meta"))
    text = spark.read.text(str(tmp_path / "meta")).first()[0]
    assert text == '{"alpha":"1","discovery_rows":1,"row_count":2,"run":"x"}'
    sinks.json_records(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_file_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.md").write_text("TODO later")
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.size) for r in readers.file_manifest(spark, str(tmp_path), ["*.json", "*.md", "*.json"]).collect()}
    assert got == {"a.json": (hashlib.sha256(b"{}").hexdigest(), 2), "b.md": (hashlib.sha256(b"TODO later").hexdigest(), 10)}
    assert readers.whole_texts(spark, [str(tmp_path)]).where(F.col("text").contains("TODO")).count() == 1
    (tmp_path / "c.json").write_text('{"configurations": [{"id": 1}, {"id": 2}]}')
    assert readers.documents(spark, str(tmp_path / "c.json"), "configurations").count() == 2
