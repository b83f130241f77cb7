"""Record contracts as rules: each rule is a boolean column, and violations are rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`holds` must be true or null; a null field is the business of `required` alone."""

    name: str
    holds: Column


def required(*fields: str) -> list[Rule]:
    return [Rule(f"required:{f}", F.col(f).isNotNull()) for f in fields]


def one_of(field: str, values: Sequence[str]) -> Rule:
    return Rule(f"enum:{field}", F.col(field).isin(*values))


def matches(field: str, pattern: str) -> Rule:
    return Rule(f"pattern:{field}", F.col(field).rlike(pattern))


def between(field: str, low: float | None = None, high: float | None = None) -> Rule:
    c = F.col(field)
    return Rule(f"range:{field}", (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True)))


def not_empty(*fields: str) -> list[Rule]:
    return [Rule(f"empty:{f}", F.length(f) >= 1) for f in fields]


def unique(field: str) -> Rule:
    return Rule(f"unique:{field}", F.size(F.array_distinct(field)) == F.size(field))


def items(field: str, least: int = 1) -> Rule:
    return Rule(f"items:{field}", F.size(field) >= least)


def filled(field: str) -> Rule:
    return Rule(f"blank_item:{field}", F.forall(field, lambda x: F.length(x) >= 1))


def implies(name: str, when: Column, then: Column) -> Rule:
    return Rule(name, ~F.coalesce(when, F.lit(False)) | F.coalesce(then, F.lit(False)))


def violations(rows: DataFrame, key: str, rules: Iterable[Rule]) -> DataFrame:
    """key and rule of every rule that a row breaks: one pass, no shuffle."""
    broken = F.array_compact(F.array(*[F.when(~r.holds, F.lit(r.name)) for r in rules]))
    return rows.select(key, F.explode(broken).alias("rule"))


def unknown_fields(rows: DataFrame, known: Sequence[str]) -> list[str]:
    """Columns that a closed root does not allow."""
    return sorted(set(rows.columns) - set(known))


#: Enumerations of the record and document contracts (fixed values).
PROVENANCE = ("RAW_MEASURED", "DERIVED", "MODEL_INFERRED", "SIMULATED", "TEST", "INTERVENTION")
RECORD_TYPES = ("SESSION_HEADER", "STREAM_DESCRIPTOR", "SAMPLE_CHUNK", "EVENT", "CLOCK_MAPPING", "CONFIG_CHANGE", "GAP", "FAULT", "MODEL_RESULT", "INTERVENTION", "SESSION_TRAILER")
INTERPRETATION = ("MEASURED", "DERIVED", "MODEL_INFERRED", "HYPOTHESIS_LABEL")
CONCLUSIONS = ("SUPPORTS", "REFUTES", "INCONCLUSIVE")
HASH, VERSION = "^[0-9a-fA-F]{64}$", r"^[0-9]+\.[0-9]+\.[0-9]+$"
GEOMETRY_TYPES = ("GOLDEN_RATIO_SPHERES", "EQUAL_SPHERES", "RANDOM_SPHERES", "SHAM_OFF")
CORE_TYPES = ("DUAL_TETRAHEDRON_MERKABA", "SPHERICAL_CORE", "CUBIC_CORE", "NO_CORE", "SHAM_OFF")


def session_record() -> list[Rule]:
    """Session records: fields, enumerations, uniqueness, checksum format, and what each kind of record must carry."""
    c = F.col
    has = lambda f: c(f).isNotNull()
    return [
        *required("schema_version", "record_type", "provenance", "device_time_start_us", "device_time_end_us", "status_flags", "crc32c"),
        *not_empty("schema_version", "decision_id", "cause"), one_of("record_type", RECORD_TYPES), one_of("provenance", PROVENANCE),
        between("device_time_start_us", 0), between("device_time_end_us", 0), between("dropped_first_sequence", 0), between("dropped_last_sequence", 0),
        unique("status_flags"), filled("status_flags"), items("source_stream_ids"), unique("source_stream_ids"), items("source_sequence_ranges"), items("actuation_evidence_ids"), unique("actuation_evidence_ids"),
        matches("crc32c", "^[0-9A-Fa-f]{8}$"),
        implies("lineage", c("provenance") == "MODEL_INFERRED", has("model") & has("source_stream_ids") & has("source_sequence_ranges")),
        implies("evidence", c("provenance") == "INTERVENTION", has("decision_id") & has("actuation_evidence_ids")),
        implies("gap", c("record_type") == "GAP", has("dropped_first_sequence") & has("dropped_last_sequence") & has("cause")),
    ]


def discovery_document() -> list[Rule]:
    inside = [("field_parameters.field_res", 8, 1024), ("field_parameters.channels", 2, 16), ("operator_parameters.agent_count", 1, None), ("operator_parameters.memory_depth", 10, None), ("operator_parameters.corr_window", 5, None), ("operator_parameters.discovery_threshold", 0.01, 0.99), ("operator_parameters.confidence_decay", 0.5, 1.0), ("metrics_summary.total_discoveries", 0, None), ("metrics_summary.coherence_frame_count", 0, None)]
    return [
        *required("schema_version", "experiment_id", "run_id", "preset", "field_parameters", "operator_parameters", "moderator_parameters", "metrics_summary", "provenance", "interpretation_level", "status_flags"),
        one_of("preset", ("synthetic", "baseline", "empirical")), one_of("provenance", PROVENANCE), one_of("interpretation_level", INTERPRETATION), *[between(*x) for x in inside], unique("status_flags"),
        Rule("length:experiment_id", F.length("experiment_id") >= 3), Rule("length:run_id", F.length("run_id") >= 3),
        Rule("discoveries", F.forall("discoveries", lambda d: (d["confidence"] >= 0) & (d["confidence"] <= 1) & (d["frame"] >= 0) & (F.size(d["edge"]) == 2))),
    ]


def intervention_document() -> list[Rule]:
    """Interventions; a missing provenance counts as an intervention where the ids are concerned."""
    c = F.col
    ids = c("decision_id").isNotNull() & c("command_id").isNotNull() & c("actuation_evidence_id").isNotNull()
    return [
        *required("schema_version", "experiment_id", "configuration_id", "geometry", "drive_channels", "power_and_energy", "timing", "provenance", "interpretation_level", "status_flags"),
        one_of("provenance", PROVENANCE), one_of("interpretation_level", INTERPRETATION), one_of("condition_role", ("TARGET_HYPOTHESIS", "ACTIVE_CONTROL", "SHAM", "EXPLORATORY")), unique("status_flags"),
        one_of("geometry.geometry_type", GEOMETRY_TYPES), one_of("geometry.core_geometry", CORE_TYPES), *[between(f"geometry.{d}", 0) for d in ("outer_diameter_mm", "middle_diameter_mm", "inner_diameter_mm", "scaling_factor")],
        *[between(f"power_and_energy.{p}", 0) for p in ("input_power_w", "measured_output_power_w", "dissipated_thermal_power_w")], *[between(f"timing.{t}", 0) for t in ("device_time_start_us", "device_time_end_us", "duration_ms", "baseline_duration_ms", "washout_duration_ms")],
        implies("evidence", F.coalesce(c("provenance"), F.lit("INTERVENTION")) == "INTERVENTION", ids),
        implies("block", c("factorial_block_id").isNotNull(), c("factorial_block_index").isNotNull() & c("randomization_id").isNotNull()),
    ]


def physics_gate() -> list[Rule]:
    """Interventions: energy is conserved, golden diameters hold to 0.1 mm, and simulation is never called measurement."""
    c, phi = F.col, (1 + 5**0.5) / 2
    outer = c("geometry.outer_diameter_mm")
    golden = (F.abs(c("geometry.middle_diameter_mm") - outer / phi) <= 0.1) & (F.abs(c("geometry.inner_diameter_mm") - outer / phi**2) <= 0.1)
    return [
        Rule("energy", c("power_and_energy.measured_output_power_w") <= c("power_and_energy.input_power_w")),
        implies("golden_ratio", c("geometry.geometry_type") == "GOLDEN_RATIO_SPHERES", golden),
        implies("simulated_not_measured", c("simulated"), (c("provenance") != "RAW_MEASURED") & (c("interpretation_level") == "MODEL_INFERRED")),
    ]


_IDS = {"experiment_id": "^EXP-[0-9a-fA-F]{8,}$", "trial_id": "^TRL-[0-9a-fA-F]{8,}$", "execution_id": "^EXEC-[0-9a-fA-F]{8,}$", "protocol_version": VERSION}


def manifest_document() -> list[Rule]:
    texts = ("created_by", "research_question", "hypothesis", "null_hypothesis", "alternative_hypothesis", "experimental_design")
    lists = ("independent_variables", "dependent_variables", "control_conditions", "sham_conditions", "confounders", "exclusion_criteria", "stopping_rules")
    return [
        *required("protocol_version", "experiment_id", "trial_id", "created_at", *texts, *lists, "preregistered_analysis", "expected_measurements", "required_sensor_channels", "intervention_description", "randomization", "blinding", "provenance_requirements", "safety_requirements", "software_versions", "hardware_versions", "requires_human_review"),
        *[matches(f, p) for f, p in _IDS.items() if f != "execution_id"], *not_empty(*texts), *[filled(f) for f in lists], unique("independent_variables"), unique("dependent_variables"),
        *[items(f) for f in ("expected_measurements", "required_sensor_channels", "provenance_requirements", "safety_requirements")],
        between("preregistered_analysis.alpha_threshold", 0, 1), between("preregistered_analysis.min_sample_size", 1), between("preregistered_analysis.effect_size_threshold", 0),
        one_of("blinding.condition_role", ("ACTIVE", "CONTROL", "SHAM", "PHANTOM", "UNKNOWN")), Rule("enum:provenance_requirements", F.forall("provenance_requirements", lambda x: x.isin(*PROVENANCE))),
    ]


def result_document(references: Sequence[str] = ()) -> list[Rule]:
    """Result documents.  references: the columns that point to sessions and interventions, as the schema document names them."""
    texts = ("instrument_identity", "hardware_revision", "firmware_version", "software_version")
    return [
        *required("protocol_version", "experiment_id", "trial_id", "execution_id", "started_at", "ended_at", "executor_type", *texts, *references, "raw_artifact_references", "quality_flags", "calibration_status", "synchronization_status", "environmental_metadata", "deviations_from_protocol", "failed_measurements", "manifest_sha256", "provenance", "checksums"),
        *[matches(f, p) for f, p in _IDS.items()], matches("manifest_sha256", HASH), *not_empty(*texts), one_of("provenance", PROVENANCE),
        one_of("executor_type", ("SIMULATED", "PHYSICAL_DISABLED", "REPLAY")), one_of("calibration_status", ("CALIBRATED", "UNCALIBRATED", "CALIBRATION_EXPIRED", "SIMULATED_IDEAL")), one_of("synchronization_status", ("SYNCHRONIZED", "UNSYNCHRONIZED", "DEGRADED", "SIMULATED_PERFECT")),
        Rule("artifacts", F.forall("raw_artifact_references", lambda a: a["sha256"].rlike(HASH) & (F.length(a["path"]) >= 1) & (F.length(a["type"]) >= 1))),
        Rule("deviations", F.forall("deviations_from_protocol", lambda d: d["severity"].isin("INFO", "WARNING", "CRITICAL"))),
    ]


def analysis_document() -> list[Rule]:
    texts = ("hypothesis", "null_hypothesis", "evidence_summary", "model_identity", "model_version")
    stats = ("sample_size", "variance_control", "variance_active")
    return [
        *required("protocol_version", "experiment_id", "trial_id", "execution_id", "manifest_sha256", "result_sha256", *texts, "preregistered_analysis", "observed_effects", "statistical_results", "effect_sizes", "confidence_intervals", "quality_assessment", "protocol_deviations", "artifact_analysis", "alternative_explanations", "conclusion", "conclusion_confidence", "initial_analysis", "adversarial_critique", "recommended_next_experiment", "analysis_timestamp", "provenance", "post_hoc_analysis"),
        *[matches(f, p) for f, p in _IDS.items()], matches("manifest_sha256", HASH), matches("result_sha256", HASH), *not_empty(*texts), one_of("conclusion", CONCLUSIONS), one_of("provenance", PROVENANCE),
        one_of("initial_analysis.preliminary_conclusion", CONCLUSIONS), between("conclusion_confidence", 0, 1), between("statistical_results.p_value", 0, 1), *[between(f"statistical_results.{s}", 0) for s in stats],
        between("confidence_intervals.confidence_level", 0, 1), between("quality_assessment.data_quality_score", 0, 1), Rule("human_review", F.col("recommended_next_experiment.requires_human_review")),
    ]


def timing_status(stream: Column, uncertainty_us: Column) -> Column:
    """OK or DEGRADED: at most 100 microseconds for EDA and motion streams, 1 ms for PPG."""
    limit = F.when(F.upper(stream).rlike("PPG"), 1000).when(F.upper(stream).rlike("EDA|IMU"), 100)
    return F.when(limit.isNull(), "UNBOUNDED").when(uncertainty_us <= limit, "OK").otherwise("DEGRADED")
