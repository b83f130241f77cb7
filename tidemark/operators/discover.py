"""From pair correlations to discoveries, edges and their decay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.windows import running

OPERATOR_TYPES = ("perceiver", "forecaster", "integrator")


def agents(spark, n: int) -> DataFrame:
    """agent_id and operator_type, dealt in turn."""
    kinds = F.array(*[F.lit(t) for t in OPERATOR_TYPES])
    return spark.range(n).select(F.col("id").alias("agent_id"), F.element_at(kinds, (F.col("id") % 3 + 1).cast("int")).alias("operator_type"))


def effective_threshold(calibrated: Column, moderated: Column) -> Column:
    """The calibrated threshold unless it is null or 0."""
    return F.coalesce(F.nullif(calibrated, F.lit(0.0)), moderated)


def discoveries(pairs: DataFrame, threshold: Column | float) -> DataFrame:
    """Pairs with |r| above the threshold, with edge and confidence."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    found = pairs.where("pearson_r is not null and not isnan(pearson_r)").where(F.abs("pearson_r") > limit)
    return found.withColumns({"edge": F.concat_ws("->", "channel_a", "channel_b"), "confidence": F.abs("pearson_r")})


def edge_maxima(found: DataFrame, by: str = "session_id") -> DataFrame:
    """Greatest confidence of each edge in each frame."""
    return found.groupBy(by, "frame", "edge").agg(F.max("confidence").alias("confidence"))


def edge_decay(frames: DataFrame, maxima: DataFrame, decay: float | str = 0.995, least: float = 0.05, by: str = "session_id") -> DataFrame:
    """Confidence of every live edge in every frame: c = max(c, m) * decay, gone below `least`; weight as last discovered.

    decay is a number, or the column of frames that holds the decay of each frame.  Closed form: c_t = max over s <= t of
    m_s * decay_s * ... * decay_t, a running maximum in logarithms: with L the running sum of log decay,
    log c_t = L_t + max (log m_s - L_(s-1)).
    """
    edges = maxima.select(by, "edge").distinct()
    rate = F.log(F.col(decay)) if isinstance(decay, str) else F.lit(math.log(decay))
    summed = frames.select(by, "frame", rate.alias("_rate")).withColumn("_sum", F.sum("_rate").over(running(by, "frame")))
    grid = summed.join(edges, by).join(maxima, [by, "frame", "edge"], "left")
    w = running([by, "edge"], "frame")
    peak = F.max(F.log("confidence") - F.col("_sum") + F.col("_rate")).over(w)
    state = grid.withColumn("c", F.exp(peak + F.col("_sum")))
    before = F.lag("c").over(Window.partitionBy(by, "edge").orderBy("frame"))
    state = state.withColumn("before", F.when(before >= least, before).otherwise(0.0))
    weight = F.last(F.when(F.col("confidence").isNotNull(), F.greatest("before", "confidence")), ignorenulls=True).over(w)
    return state.withColumn("weight", weight).where(F.col("c") >= least).select(by, "frame", "edge", F.col("c").alias("confidence"), "weight")


def per_frame_counts(frames: DataFrame, found: DataFrame, by: str = "session_id") -> DataFrame:
    """Discoveries of every frame, 0 where there are none, and their running total."""
    counts = found.groupBy(by, "frame").agg(F.count("*").alias("n"))
    full = frames.select(by, "frame").join(counts, [by, "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("total", F.sum("n").over(running(by, "frame")))


def last_edges(frames: DataFrame, found: DataFrame, order: Column, by: str = "session_id") -> DataFrame:
    """The last edge discovered in each frame, null where there is none."""
    last = found.groupBy(by, "frame").agg(F.max_by("edge", order).alias("last_edge"))
    return frames.select(by, "frame").join(last, [by, "frame"], "left")


def operator_density(agents: Column, size: Column) -> Column:
    """Agents for each cell of a square grid."""
    return agents / (size * size).cast("double")


def field_measures(cells: DataFrame, by: list[str], dispersed: str, measured: tuple[str, ...], control: str) -> DataFrame:
    """Of a frame's cells: deviation of one channel, and mean absolute values of others by that of the control channel."""
    floor = F.greatest(F.avg(F.abs(control)), F.lit(1e-12))
    return cells.groupBy(*by).agg(F.stddev_pop(dispersed).alias("reg_variance_deviation"), *[(F.avg(F.abs(c)) / floor).alias(f"{c}_short_long") for c in measured])


def density(pairs: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Share of windows above the threshold."""
    return pairs.groupBy(*by).agg(F.avg((F.abs("pearson_r") > threshold).cast("double")).alias("density"), F.count("*").alias("n"))


def holm(tests: DataFrame, by: list[str], name: str, p: str) -> DataFrame:
    """Holm-Bonferroni adjusted p-values within a family of tests."""
    order = Window.partitionBy(*by).orderBy(p, name)
    family = Window.partitionBy(*by)
    ranked = tests.withColumn("_k", F.row_number().over(order)).withColumn("_m", F.count("*").over(family))
    scaled = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_k") + 1))
    return ranked.withColumn("p_holm", F.max(scaled).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_k", "_m")


def longitudinal(frames: DataFrame, found: DataFrame, by: str = "session_id") -> DataFrame:
    """One row a discovery, and one with null correlation and confidence 0 for a frame without any."""
    rows = frames.join(found.select(by, "frame", "channel_a", "channel_b", "pearson_r", "confidence", "operator_type"), [by, "frame"], "left")
    return rows.fillna({"channel_a": "", "channel_b": "", "operator_type": "", "confidence": 0.0})


def run_summary(found: DataFrame, frames: DataFrame, by: str = "session_id") -> DataFrame:
    """Totals of a session: discoveries, by operator type, coherence frames."""
    kinds = found.groupBy(by, "operator_type").agg(F.count("*").alias("n")).groupBy(by).agg(F.sum("n").alias("total_discoveries"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("operator_type", "n")))).alias("discoveries_by_operator_type"))
    coherent = frames.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("is_event"), F.col("frame")))).alias("coherence_frames"), F.count("*").alias("frames"))
    return coherent.join(kinds, by, "left").withColumns({"coherence_frame_count": F.size("coherence_frames"), "total_discoveries": F.coalesce("total_discoveries", F.lit(0))})


def run_metrics(found: DataFrame, frames: DataFrame, run: dict, by: str = "session_id") -> DataFrame:
    """The fifteen keys of a session's metrics; `run` gives those that no data hold: output_path, preset, experiment,
    agents, field_res, seed, backend, calibration_threshold and generated_at."""
    history = per_frame_counts(frames, found, by).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "n"))), lambda x: x["n"]).alias("discovery_rate_history"))
    given = {k: F.lit(v) for k, v in run.items()}
    return run_summary(found, frames, by).join(history, by).withColumns(given)
