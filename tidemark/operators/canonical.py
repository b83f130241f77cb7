"""Telemetry of any header to four channels and four covariates, by frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import number

CHANNELS = ("em_rf", "optical_ir", "consciousness_proxy", "control_baseline")
COVARIATES = ("kp_index", "lunar_phase", "sidereal_time", "xray_flux")

#: Accepted header names by target column, first match wins (fixed values).
SENSOR_ALIASES = {
    "em_rf": ("em_rf", "electromagnetic_rf", "magnetometer", "magnetometer_noise", "rf_noise", "rf_spectrum_noise", "channel_0"),
    "optical_ir": ("optical_ir", "optical_ir_anomaly", "pixel_variance", "sky_pixel_variance", "ir_anomaly", "channel_1"),
    "consciousness_proxy": ("consciousness_proxy", "reg_variance", "reg_entropy", "egg_variance", "raw_entropy", "entropy", "channel_2"),
}
COVARIATE_ALIASES = {
    "kp_index": ("kp_index", "kp", "geomagnetic_kp", "geomagnetic_index"),
    "lunar_phase": ("lunar_phase", "moon_phase", "lunar_cycle_phase"),
    "sidereal_time": ("sidereal_time", "local_sidereal_time", "lst"),
    "xray_flux": ("xray_flux", "solar_xray_flux", "solar_flare_xray_flux"),
}
TIME_ALIASES = ("timestamp", "time", "datetime", "date", "utc")
#: Stream names by channel; of several streams of a channel the last column wins (fixed values).
STREAM_CHANNELS = (
    dict.fromkeys(("ppg_accel", "imu_accel_x", "imu_accel_y", "imu_accel_z", "imu_gyro_x", "imu_gyro_y", "imu_gyro_z", "rf_noise", "em_rf", "electromagnetic_rf"), "em_rf")
    | dict.fromkeys(("ppg_red", "ppg_ir", "optical_ir", "optical_raw", "pixel_variance"), "optical_ir")
    | dict.fromkeys(("eda_raw", "eda_conductance", "eda_admittance", "reg_variance", "consciousness_proxy", "resonance_amplitude", "resonance_score"), "consciousness_proxy")
    | dict.fromkeys(("control_baseline", "sham_control"), "control_baseline")
)


def resolve(df: DataFrame, aliases: Sequence[str]) -> str | None:
    """The first alias that names a column, whatever its case and outer spaces; of two such columns the later."""
    by_name = {c.lower().strip(): c for c in df.columns}
    return next((by_name[a.lower()] for a in aliases if a.lower() in by_name), None)


def fill(c: Column, order: str, default: Column | float = 0.0, by: str = "session_id") -> Column:
    """Last known value, else next known value, else default."""
    w = Window.partitionBy(by).orderBy(order)
    back = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(back, ahead, F.lit(default) if not isinstance(default, Column) else default)


def _session(df: DataFrame) -> DataFrame:
    return df if "session_id" in df.columns else df.withColumn("session_id", F.lit("session"))


def canonicalise(df: DataFrame, order: str, parity: bool = False, seed: int = 42) -> DataFrame:
    """Wide telemetry to session_id, frame, ts, channels, covariates and control_source.

    `order` names the column that orders samples.  A supplied control channel is kept; parity=True replaces it with
    standard normal noise, as does a missing one.  Missing columns are 0; unreadable values are filled.
    """
    df = _session(df)
    frames = df.withColumn("frame", F.row_number().over(Window.partitionBy("session_id").orderBy(order)).cast("long") - 1)
    columns = {name: resolve(df, aliases) for name, aliases in (SENSOR_ALIASES | COVARIATE_ALIASES).items()}
    values = [fill(number(F.col(f"`{c}`")), "frame").alias(n) if c else F.lit(0.0).alias(n) for n, c in columns.items()]
    control = None if parity else resolve(df, ("control_baseline", "sham_control"))
    noise = F.randn(seed)
    time = resolve(df, TIME_ALIASES)
    stamp = F.try_to_timestamp(F.col(f"`{time}`").cast("string")) if time else F.lit(None).cast("timestamp")
    grid = F.timestamp_seconds(F.col("frame") * 60)
    return frames.select(
        "session_id", "frame", fill(stamp, "frame", grid).alias("ts"), *values,
        (fill(number(F.col(f"`{control}`")), "frame") if control else noise).alias("control_baseline"), F.lit("supplied" if control else "noise").alias("control_source"),
    )


def bridge(df: DataFrame, order: str = "device_time_us") -> DataFrame:
    """Flattened stream samples to the channel schema: last mapped column wins, unreadable values are 0 before any fill."""
    df = _session(df)
    source = {STREAM_CHANNELS[c.lower()]: c for c in df.columns if c.lower() in STREAM_CHANNELS}
    present = order if order in df.columns else resolve(df, TIME_ALIASES)
    frames = df.withColumn("frame", F.row_number().over(Window.partitionBy("session_id").orderBy(present)).cast("long") - 1)
    zero = lambda c: F.coalesce(number(F.col(f"`{c}`")), F.lit(0.0)) if c and c in df.columns else F.lit(0.0)
    if "timestamp" in df.columns:  # unreadable ones are filled as in canonicalise, not from the device's clock
        stamp = fill(F.try_to_timestamp(F.col("timestamp").cast("string")), "frame", F.timestamp_seconds(F.col("frame") * 60))
    elif "device_time_us" in df.columns:
        stamp = F.timestamp_micros(F.coalesce(F.col("device_time_us").cast("long"), F.lit(0)))
    else:
        stamp = F.timestamp_micros(F.col("frame") * 20_000)
    return frames.select("session_id", "frame", stamp.alias("ts"), *[zero(source.get(c)).alias(c) for c in CHANNELS], *[zero(c).alias(c) for c in COVARIATES])


def zscored(df: DataFrame, channels: Sequence[str] = CHANNELS, by: str = "session_id") -> DataFrame:
    """Channels as population z-scores of their session; a constant channel is 0.  Statistics are joined, not windowed."""
    stats = df.groupBy(by).agg(*[F.avg(c).alias(f"{c}_m") for c in channels], *[F.stddev_pop(c).alias(f"{c}_s") for c in channels])
    z = {c: F.when(F.col(f"{c}_s") < 1e-12, 0.0).otherwise((F.col(c) - F.col(f"{c}_m")) / F.greatest(F.col(f"{c}_s"), F.lit(1e-12))) for c in channels}
    return df.join(stats, by).withColumns(z).drop(*[f"{c}_{x}" for c in channels for x in "ms"])


def basis(spark, size: int) -> DataFrame:
    """x, y and the four spatial weights w0..w3 of a size x size grid on [-1, 1]."""
    step = 2.0 / (size - 1)
    cells = spark.range(size * size).select((F.floor(F.col("id") / size)).cast("int").alias("x"), (F.col("id") % size).cast("int").alias("y"))
    u, v = F.col("x") * step - 1.0, F.col("y") * step - 1.0
    cells = cells.select(
        "x", "y", (F.sin(math.pi * u) * F.cos(math.pi * v)).alias("w0"), (F.cos(2 * math.pi * u) + F.sin(math.pi * v)).alias("w1"),
        F.exp(-3.0 * (u * u + v * v)).alias("radial"), F.sin(2 * math.pi * (u + v)).alias("w3"),
    )
    mean = cells.agg(F.avg("radial").alias("mean"))
    return cells.crossJoin(F.broadcast(mean)).select("x", "y", "w0", "w1", (F.col("radial") - F.col("mean")).alias("w2"), "w3")  # one row


def sampled(positions: DataFrame, frames: DataFrame, grid: DataFrame) -> DataFrame:
    """Values that agents see: positions (session_id, agent_id, frame, x, y) x z-scored frames x grid weights.

    The grid has size^2 rows by its parameter, whatever the data, so it is broadcast.
    """
    joined = positions.join(frames, ["session_id", "frame"]).join(F.broadcast(grid), ["x", "y"])
    return joined.withColumns({c: (F.col(c) * F.col(f"w{i}")).cast("float").cast("double") for i, c in enumerate(CHANNELS)}).drop("w0", "w1", "w2", "w3")


def at_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `wanted` (session_id, frame) with the frame's values; frames out of range are clamped."""
    last = frames.groupBy("session_id").agg(F.max("frame").alias("last"))
    clamped = wanted.join(last, "session_id").withColumn("frame", F.least(F.greatest("frame", F.lit(0)), "last")).drop("last")
    return clamped.join(frames, ["session_id", "frame"])


def control_only(frames: DataFrame) -> DataFrame:
    """Measured channels zeroed; control channel, times and covariates stay."""
    return frames.withColumns({c: F.lit(0.0) for c in CHANNELS[:3]})
