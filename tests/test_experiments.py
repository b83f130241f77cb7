"""Trials, factorial models, contracts, gates, intervals, spectra."""

import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts, factorial, gates, intervals, spectrum, trials
from tidemark.sources import readers

CELLS = [("GOLDEN_RATIO_SPHERES", "DUAL_TETRAHEDRON_MERKABA"), ("GOLDEN_RATIO_SPHERES", "SPHERICAL_CORE"), ("EQUAL_SPHERES", "DUAL_TETRAHEDRON_MERKABA"), ("EQUAL_SPHERES", "SPHERICAL_CORE")]


def _trials(spark, rows):
    df = spark.createDataFrame([("all", s, g, c, y) for s, (g, c), y in rows], "grp string, session string, geometry string, core string, y double")
    return factorial.confirmatory(df)


def test_factorial_known_answer(spark):
    rows = [("s", cell, y) for cell, y in zip(CELLS, (0.8, 0.5, 0.4, 0.2), strict=True) for _ in range(2)]
    got = factorial.ols(_trials(spark, rows), ["grp"]).first()
    assert (got.status, got.n, got.df, got.kappa) == ("IDENTIFIED_OLS", 8, 4, 1.0)
    assert [got.b0, got.bg, got.bc, got.bgc, got.contrast_g, got.contrast_c, got.contrast_gc, got.sse] == pytest.approx([0.475, 0.175, 0.125, 0.025, 0.35, 0.25, 0.10, 0.0])


def test_factorial_without_full_rank(spark):
    got = factorial.ols(_trials(spark, [("s", CELLS[0], y) for y in (0.7, 0.72, 0.68, 0.71)]), ["grp"]).first()
    assert got.status == "MODEL_NOT_IDENTIFIABLE" and got["rank"] < 4 and got.bg is None


def test_factorial_unbalanced_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("s", CELLS[i], float(rng.normal())) for i, n in enumerate((3, 7, 2, 5)) for _ in range(n)]
    got = factorial.ols(_trials(spark, rows), ["grp"]).first()
    g = np.array([1 if c[0] == CELLS[0][0] else -1 for _, c, _ in rows])
    k = np.array([1 if c[1] == CELLS[0][1] else -1 for _, c, _ in rows])
    x, y = np.column_stack([np.ones(len(rows)), g, k, g * k]), np.array([r[2] for r in rows])
    beta, sse, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert [got.b0, got.bg, got.bc, got.bgc] == pytest.approx(beta.tolist()) and got.sse == pytest.approx(sse[0])
    assert got.kappa == pytest.approx(np.linalg.cond(x.T @ x))
    assert got.se == pytest.approx(math.sqrt(sse[0] / (len(rows) - 4) * np.linalg.inv(x.T @ x)[1, 1]))


def test_session_components_known_answer(spark):
    rows = [(s, c, y) for s, ys in (("s1", (0.9, 0.6, 0.5, 0.3)), ("s2", (0.7, 0.4, 0.3, 0.1))) for c, y in zip(CELLS, ys, strict=True)]
    got = factorial.session_components(_trials(spark, rows), ["grp"], "session").first()
    assert (got.status, got.sessions, got.n) == ("CONVERGED", 2, 8)
    assert [got.var_u, got.b1, got.b2, got.b3] == pytest.approx([0.02, 0.175, 0.125, 0.025])


def test_condition_roles(spark):
    rows = [("GOLDEN_RATIO_SPHERES", "DUAL_TETRAHEDRON_MERKABA", 3.0), ("EQUAL_SPHERES", "NO_CORE", 3.0), ("RANDOM_SPHERES", "DUAL_TETRAHEDRON_MERKABA", 3.0), ("SHAM_OFF", "SHAM_OFF", 0.0), ("GOLDEN_RATIO_SPHERES", "OTHER", 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "g string, c string, a double").select(factorial.condition_role(F.col("g"), F.col("c"), F.col("a"))).collect()]
    assert got == ["TARGET_HYPOTHESIS", "ACTIVE_CONTROL", "ACTIVE_CONTROL", "SHAM", "EXPLORATORY"]


def _ar1(mean, n, seed):
    rng = np.random.default_rng(seed)
    x = [mean]
    for _ in range(n - 1):
        x.append(mean + 0.8 * (x[-1] - mean) + rng.normal(0, 0.5))
    return x


def _signals(spark, trial, **series):
    rows = [(trial, *k.split("_"), i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "trial_id string, arm string, phase string, idx int, value double")


def test_autocorrelated_trial_is_significant(spark):
    s = _signals(spark, "t", active_baseline=_ar1(10, 65, 1), active_intervention=_ar1(15, 62, 2), sham_baseline=_ar1(10, 60, 3), sham_intervention=_ar1(10.1, 68, 4))
    tau = trials.autocorrelation_time(s.where("arm = 'active'"), ["trial_id", "phase"], "idx", "value").groupBy("trial_id").agg(F.max("tau").alias("tau"))
    assert tau.first().tau >= 1
    p = trials.permutation_p(trials.block_differences(s, tau), 200).first()
    risk = trials.artifacts(trials.effects(s), F.lit(0.1), F.lit(0.02))
    ci = trials.bootstrap_interval(s, tau, risk, 200).first()
    assert p.p_value < 0.05 and 0 < ci.ci_low < ci.ci_high <= 1 and risk.first().valid_signal


def test_bootstrap_in_arrays_and_joined(spark, monkeypatch):
    """Series in arrays and series joined by place give the same intervals."""
    s = _signals(spark, "t", active_baseline=_ar1(10, 65, 1), active_intervention=_ar1(15, 62, 2), sham_baseline=_ar1(10, 60, 3), sham_intervention=_ar1(10.1, 68, 4))
    tau, risk = spark.createDataFrame([("t", 4)], "trial_id string, tau long"), spark.createDataFrame([("t", 0.1)], "trial_id string, em_risk double")
    got = [trials.bootstrap_interval(s, tau, risk, 40).first()]
    for long in (0, 63):  # all joined, and two of four
        monkeypatch.setattr(trials, "LONG", long)
        got.append(trials.bootstrap_interval(s, tau, risk, 40).first())
    assert all(r.ci_low == pytest.approx(got[0].ci_low) and r.ci_high == pytest.approx(got[0].ci_high) for r in got)


def test_phantom_offset_is_no_artifact(spark):
    s = _signals(spark, "t", active_baseline=[10.0, 10.1, 10.0, 10.2, 10.0], active_intervention=[14.0, 14.2, 14.1, 14.0, 14.3], phantom_baseline=[50.0] * 5, phantom_intervention=[50.01, 50.0, 50.02, 50.01, 50.0])
    got = trials.artifacts(trials.effects(s), F.lit(0.2), F.lit(0.0)).first()
    assert got.phantom_delta == pytest.approx(0.008) and got.phantom_match and got.valid_signal and got.net_delta == got.raw_delta


def test_autocorrelation_time_against_a_loop(spark):
    for seed, n in ((1, 30), (2, 9), (3, 3)):
        x = np.array(_ar1(0, n, seed))
        d = x - x.mean()
        want, limit = None, min(20, n // 2)
        for k in range(1, limit + 1):
            if (d[:-k] * d[k:]).sum() / (n - k) / (d * d).mean() <= 1 / math.e:
                want = k
                break
        want = 1 if n < 4 else (want or max(1, limit // 2))
        s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i int, v double")
        assert trials.autocorrelation_time(s, ["k"], "i", "v").first().tau == want


def test_record_contract(spark):
    good = {"schema_version": "2.0.0", "record_type": "EVENT", "provenance": "DERIVED", "device_time_start_us": 0, "device_time_end_us": 1, "status_flags": ["OK"], "crc32c": "0A1B2C3D"}
    bad = {
        "lineage": {"record_type": "MODEL_RESULT", "provenance": "MODEL_INFERRED"}, "evidence": {"provenance": "INTERVENTION"}, "gap": {"record_type": "GAP"},
        "unique:status_flags": {"status_flags": ["OK", "OK"]}, "pattern:crc32c": {"crc32c": "1234567"}, "enum:provenance": {"provenance": "GUESSED"}, "required:crc32c": {"crc32c": None}, "range:device_time_end_us": {"device_time_end_us": -1},
    }
    rows = [{**good, "session_id": "good"}] + [{**good, **change, "session_id": rule} for rule, change in bad.items()]
    records = spark.createDataFrame([[r.get(f.name) for f in readers.SESSION_RECORD] for r in rows], readers.SESSION_RECORD)
    got = {(r.session_id, r.rule) for r in contracts.violations(records, "session_id", contracts.session_record()).collect()}
    assert got == {(rule, rule) for rule in bad}
    assert contracts.unknown_fields(records.withColumn("extra", F.lit(1)), readers.SESSION_RECORD.names) == ["extra"]


def test_document_contracts_compile_and_catch(spark):
    intervention = {
        "schema_version": "1.0.0", "experiment_id": "exp", "configuration_id": "cfg", "geometry": {"geometry_type": "GOLDEN_RATIO_SPHERES", "core_geometry": "NO_CORE", "outer_diameter_mm": 300.0, "middle_diameter_mm": 185.41, "inner_diameter_mm": 120.0, "scaling_factor": 1.0},
        "drive_channels": "x", "power_and_energy": {"input_power_w": 1.0, "measured_output_power_w": 2.0, "dissipated_thermal_power_w": 0.0}, "timing": {"device_time_start_us": 0, "device_time_end_us": 1, "duration_ms": 1.0, "baseline_duration_ms": 1.0, "washout_duration_ms": 1.0},
        "provenance": "INTERVENTION", "interpretation_level": "MEASURED", "status_flags": ["OK"], "condition_role": "SHAM", "decision_id": None, "command_id": "c", "actuation_evidence_id": "e", "factorial_block_id": "b", "factorial_block_index": None, "randomization_id": "r", "simulated": True,
    }
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(intervention)]))
    for missing in ("decision_id", "factorial_block_index"):
        df = df.withColumn(missing, F.lit(None).cast("string"))
    got = {r.rule for r in contracts.violations(df, "experiment_id", contracts.intervention_document() + contracts.physics_gate()).collect()}
    assert got == {"evidence", "block", "energy", "golden_ratio", "simulated_not_measured"}
    analysis = {"experiment_id": "EXP-1", "conclusion": "MAYBE", "conclusion_confidence": 1.5}
    names = {r.name for r in contracts.analysis_document() + contracts.manifest_document() + contracts.result_document() + contracts.discovery_document()}
    assert {"enum:conclusion", "pattern:experiment_id", "range:conclusion_confidence", "human_review"} <= names
    few = spark.createDataFrame([analysis])
    rules = [r for r in contracts.analysis_document() if r.name in ("enum:conclusion", "pattern:experiment_id", "range:conclusion_confidence")]
    assert contracts.violations(few, "experiment_id", rules).count() == 3


def test_gates(spark):
    found = spark.createDataFrame([("f1", "warning"), ("f2", "error"), ("f3", "warning")], "fingerprint string, severity string")
    allow = spark.createDataFrame([("f1", "long enough to count as one"), ("f2", "short"), ("f9", None)], "fingerprint string, rationale string")
    assert {(r.fingerprint, r.verdict) for r in gates.allowlisted(found, allow, "fingerprint").collect()} == {("f1", "ALLOWED"), ("f2", "ALLOWED"), ("f3", "UNALLOWLISTED"), ("f9", "STALE")}
    assert ("f2", "ERROR") in {(r.fingerprint, r.verdict) for r in gates.allowlisted(found, allow, "fingerprint", errors_pass=False).collect()}
    assert {r.fingerprint for r in gates.thin_rationales(allow).collect()} == {"f2", "f9"}
    want = hashlib.sha256(json.dumps({"board": 'b"1\\', "type": "t", "net": "N1"}, sort_keys=True).encode()).hexdigest()
    row = spark.createDataFrame([('b"1\\', "pad [N1] of U2")], "board string, d string")
    assert row.select(gates.fingerprint({"board": F.col("board"), "type": F.lit("t"), "net": gates.net_of(F.col("d"))})).first()[0] == want
    odd = ["Ünet", 'q"\\', "tab\tnl\nzero\x01del\x7f", "plain", "\U0001f600 é", ""]
    rows = spark.createDataFrame([(i, t, [t, "b", "a"]) for i, t in enumerate(odd)], "i int, t string, l array<string>")
    got = {r.i: r.f for r in rows.select("i", gates.fingerprint({"description": F.col("t")}, {"items": F.col("l")}).alias("f")).collect()}
    assert all(got[i] == hashlib.sha256(json.dumps({"description": t, "items": sorted([t, "b", "a"])}, sort_keys=True).encode()).hexdigest() for i, t in enumerate(odd))
    bare = spark.createDataFrame([(None, "error"), ("f1", "warning")], "fingerprint string, severity string")
    strict = gates.allowlisted(bare, allow.union(spark.createDataFrame([(None, "x")], allow.schema)), "fingerprint", errors_pass=False)
    assert sorted((r.fingerprint or "", r.verdict) for r in strict.collect()) == [("", "ERROR"), ("", "STALE"), ("f1", "ALLOWED"), ("f2", "STALE"), ("f9", "STALE")]
    parts = spark.createDataFrame([("U1", "main", "a"), ("U1", "main", "a"), ("U2", "main", "zz")], "ref string, board string, sheet string")
    sheets = spark.createDataFrame([("main", "a")], "board string, sheet string")
    connectors = spark.createDataFrame([("J1", "LAB_ISO", ["SIG", "PPG_LOGIC_GND"]), ("J2", "LAB_ISO", ["LAB_ISO_GND"])], "name string, domain string, pins array<string>")
    assert {tuple(r) for r in gates.manifest_violations(parts, sheets, connectors).collect()} == {("DUPLICATE_REF", "U1"), ("UNKNOWN_SHEET", "U2"), ("HUMAN_GROUND_ON_LAB", "J1")}
    assert gates.forbidden(spark.createDataFrame([("A_CHAMBER_HV",), ("VCC",)], "net string"), "net").count() == 1
    assert spark.range(1).select(gates.same_order(F.array(F.lit("a"), F.lit("b")), ("a", "b"))).first()[0]


def test_covered_by_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = [(f"s{rng.integers(3)}", int(v)) for v in rng.integers(0, 500, 200)]
    ranges = [(f"s{rng.integers(3)}", i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(0, 480, 30), rng.integers(0, 90, 30), strict=True))]
    got = intervals.covered_by(spark.createDataFrame(points, "k string, v long"), spark.createDataFrame(ranges, "k string, id long, a long, b long"), "k", "v", "a", "b", 32)
    want = sorted((k, v, i) for k, v in points for q, i, a, b in ranges if k == q and a <= v <= b)
    assert sorted((r.k, r.v, r.id) for r in got.collect()) == want


def test_spectrum_finds_a_tone(spark):
    n = 128
    x = [math.sin(2 * math.pi * 10 * t / n) + 0.5 * math.sin(2 * math.pi * 20 * t / n) for t in range(n)]
    series = spark.createDataFrame([("s", t, v) for t, v in enumerate(x)], "k string, t long, v double")
    spec = spectrum.dft(series, "k", "t", "v", 64)
    got = spec.orderBy("bin").toPandas()["magnitude"].to_numpy()
    assert np.allclose(got, np.abs(np.fft.rfft(x))[:64] / n, atol=1e-9)
    peaks = spectrum.peaks(spec, "k")
    assert {r.bin for r in peaks.collect()} == {10, 20}
    base = spark.createDataFrame([("s", 10.0)], "k string, fundamental double")
    assert {(r.bin, r.kind, r.order) for r in spectrum.harmonics(peaks, base, "k", "bin").collect()} == {(20, "harmonic", 2)}
    lines = spark.createDataFrame([("s", 0, 10.0), ("s", 1, 30.0), ("s", 2, 17.0)], "k string, i int, f double")
    assert {r["product"] for r in spectrum.intermodulation(lines, peaks, "k", "bin").collect()} == {20.0, 10.0}
    assert spectrum.mode_splits(lines, peaks, "k", "bin").count() == 1


def test_geometry(spark):
    row = spark.range(1).select(factorial.diameters(F.lit("GOLDEN_RATIO_SPHERES"), F.lit(300.0), F.lit(1)).alias("a"), factorial.diameters(F.lit("SHAM_OFF"), F.lit(300.0), F.lit(1)).alias("b")).first()
    assert row.a == pytest.approx([300.0, 185.41, 114.59]) and row.b == [0, 0, 0]
    with pytest.raises(Exception, match="unknown geometry"):
        spark.range(1).select(factorial.diameters(F.lit("CUBE"), F.lit(1.0), F.lit(1))).collect()


def test_conclusions(spark):
    rows = [(0.01, 1.0, True, 1.0, "OK"), (0.01, -1.0, True, 1.0, "OK"), (0.2, 1.0, True, 1.0, "OK"), (0.01, 1.0, True, 1.0, "PROTOCOL_CHANGED")]
    df = spark.createDataFrame(rows, "p double, effect double, valid boolean, registered double, protocol_status string")
    assert [r[0] for r in df.select(intervals.conclusion("p", "effect", "valid", "registered")).collect()] == ["SUPPORTS", "REFUTES", "INCONCLUSIVE", "INCONCLUSIVE"]
