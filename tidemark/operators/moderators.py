"""Environment moderators: pressure, thresholds, decay and coherence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip
from tidemark.operators.windows import running


def pressure(kp: Column, lunar: Column, sidereal: Column, flux: Column) -> Column:
    """Weighted sum of the four covariates, each scaled to [0, 1]."""
    tide = 0.5 + 0.5 * F.cos(2 * math.pi * F.pmod(lunar, F.lit(1.0)))
    star = 0.5 + 0.5 * F.sin(2 * math.pi * F.pmod(sidereal, F.lit(24.0)) / 24.0)
    flare = clip((F.log10(F.greatest(F.abs(flux), F.lit(1e-12))) + 8.0) / 3.0, 0.0, 1.0)
    return 0.35 * clip(kp / 9.0, 0.0, 1.0) + 0.20 * tide + 0.15 * star + 0.30 * flare


def moderated(df: DataFrame, threshold: float = 0.32, decay: float = 0.995, window: int = 15, by: str = "session_id") -> DataFrame:
    """Adds pressure, m, discovery_threshold, confidence_decay, coherence_window, is_event, coherence_active, modulation."""
    p, m = F.col("pressure"), F.col("m")
    out = df.withColumn("pressure", pressure(F.col("kp_index"), F.col("lunar_phase"), F.col("sidereal_time"), F.col("xray_flux"))).withColumn("m", 1.0 + 0.55 * p)
    out = out.withColumns({
        "discovery_threshold": F.greatest(F.lit(0.05), threshold / m),
        "confidence_decay": F.greatest(F.lit(0.90), decay - (m - 1.0) * 0.025),
        "coherence_window": F.bround(window * (1.0 + 0.75 * p), 0).cast("int"),
        "is_event": (p >= 0.35) | (F.col("frame") == 0),
    })
    return coherence(out, F.col("coherence_window"), by).withColumn("modulation", F.when(F.col("coherence_active"), m * 1.15).otherwise(m))


def coherence(df: DataFrame, window: Column, by: str = "session_id", strict: bool = False) -> DataFrame:
    """coherence_active: the latest event is at most `window` frames back (fewer, if strict).  Only the latest can matter."""
    since = F.col("frame") - F.last(F.when(F.col("is_event"), F.col("frame")), ignorenulls=True).over(running(by, "frame"))
    return df.withColumn("coherence_active", F.coalesce(since < window if strict else since <= window, F.lit(False)))


def synthetic_modulation(frame: Column, active: Column) -> Column:
    """Slow two-wave modulation with a boost while coherent."""
    wave = 1 + 0.03 * F.sin(frame / 31.8) + 0.02 * F.cos(frame / 55.7)
    return F.when(active, wave * 1.3).otherwise(wave)


def snapshot(df: DataFrame, names: tuple[str, ...] = ("coherence_window", "confidence_decay", "discovery_threshold", "m", "modulation", "pressure")) -> DataFrame:
    """All moderator values of a frame as one map."""
    return df.withColumn("moderators", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))]))
