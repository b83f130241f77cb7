"""Queries by name, each with SQL that gives the same rows where SQL can express it.

The star-schema tables stand in for telemetry and trials: hourly means of four event types are the channels of one
session, users are streams, and suppliers are trials (return flag = arm, line status = phase).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import crc32c, lcg
from tidemark.operators import canonical, contracts, discover, factorial, gates, intervals, moderators, regression, spectrum, trials, windows
from tidemark.operators.canonical import CHANNELS
from tidemark.plans.parameters import resolved
from tidemark.sources import framed, readers, release, sinks
from tidemark.sources.shared import work_folder
from tidemark.streaming import emission, stateful

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


EVENT_OF = dict(zip(CHANNELS, ("view", "click", "purchase", "error"), strict=True))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """session_id, frame and four channels on a gapless spine of hours; the spine's length is that of the recording."""
    epoch = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    events = table(spark, sf, "events").select(epoch.alias("h"), "event_type", "value")
    cells = events.groupBy("h").agg(*[F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(c) for c, e in EVENT_OF.items()])
    bounds = events.agg(F.min("h").alias("low"), F.max("h").alias("high"))
    spine = bounds.select("low", F.explode(F.sequence("low", "high")).alias("h"))
    frames = spine.join(cells, "h", "left").select(F.lit("hourly").alias("session_id"), (F.col("h") - F.col("low")).alias("frame"), *CHANNELS)
    return frames.select("session_id", "frame", *[canonical.fill(F.col(c), "frame").alias(c) for c in CHANNELS])


def pairs(spark: SparkSession, sf: str, lag: int = 0) -> DataFrame:
    return windows.pair_correlations(hourly(spark, sf), CHANNELS, ["session_id"], "frame", 50, lag)


_FILL = ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS {c}"
    for c in CHANNELS
)
_CH = f"""hours AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, event_type, value, props FROM events),
cells AS (SELECT h, {", ".join(f"avg(value) FILTER (event_type = '{e}') AS {c}" for c, e in EVENT_OF.items())} FROM hours GROUP BY h),
spine AS (SELECT unnest(generate_series((SELECT min(h) FROM hours), (SELECT max(h) FROM hours))) AS h),
raw AS (SELECT s.h - (SELECT min(h) FROM hours) AS frame, {", ".join(CHANNELS)} FROM spine s LEFT JOIN cells USING (h)),
ch AS (SELECT frame, {_FILL} FROM raw)"""
_Z = "z AS (SELECT frame, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in CHANNELS) + " FROM ch)"
_PAIR = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]]


def _corr_sql(lag: int = 0) -> str:
    source = "ch" if not lag else "(SELECT frame, " + ", ".join(CHANNELS) + ", " + ", ".join(f"lag({c}, {lag}) OVER (ORDER BY frame) AS l_{c}" for c in CHANNELS) + " FROM ch)"
    p = "l_" if lag else ""
    parts = [
        f"SELECT frame, '{a}' AS channel_a, '{b}' AS channel_b, covar_pop({a}, {p}{b}) OVER w / nullif(stddev_pop({a}) OVER w * stddev_pop({p}{b}) OVER w, 0) AS pearson_r, count({p}{CHANNELS[1]}) OVER w AS k FROM {source} WINDOW w AS (ORDER BY frame ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
        for a, b in _PAIR
    ]
    return "r AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE k = 50 AND pearson_r IS NOT NULL)"


_R = f"{_CH}, {_corr_sql()}"
_D = f"{_R}, d AS (SELECT frame, channel_a || '->' || channel_b AS edge, abs(pearson_r) AS confidence FROM r WHERE abs(pearson_r) > 0.32)"


@query(f"WITH {_CH} SELECT frame, {', '.join(f'round({c}, 6) AS {c}' for c in CHANNELS)} FROM ch")
def canonical_channels(spark, sf):
    return _rounded(hourly(spark, sf).drop("session_id"))


@query(f"WITH {_CH}, {_Z} SELECT frame, {', '.join(f'round({c}, 6) AS {c}' for c in CHANNELS)} FROM z")
def channel_zscore(spark, sf):
    return _rounded(canonical.zscored(hourly(spark, sf)).select("frame", *CHANNELS))


@query(f"WITH {_R} SELECT frame, channel_a, channel_b, round(pearson_r, 6) AS pearson_r FROM r")
def sliding_pair_corr(spark, sf):
    return _rounded(pairs(spark, sf).drop("session_id"))


@query(f"WITH {_CH}, {_corr_sql(5)} SELECT frame, channel_a, channel_b, round(pearson_r, 6) AS pearson_r FROM r")
def lagged_pair_corr(spark, sf):
    return _rounded(pairs(spark, sf, lag=5).drop("session_id"))


@query(f"WITH {_D} SELECT edge, count(*) AS n, round(max(confidence), 6) AS max_confidence FROM d GROUP BY edge")
def discoveries_by_edge(spark, sf):
    found = discover.discoveries(pairs(spark, sf), 0.32)
    return found.groupBy("edge").agg(F.count("*").alias("n"), _r(F.max("confidence")).alias("max_confidence"))


_DECAY = "ln(0.995)"


@query(
    f"""WITH {_D}, e AS (SELECT DISTINCT edge FROM d), g AS (SELECT ch.frame, e.edge, d.confidence AS m FROM ch CROSS JOIN e LEFT JOIN d ON d.frame = ch.frame AND d.edge = e.edge),
s AS (SELECT *, exp(max(ln(m) - frame * {_DECAY}) OVER (PARTITION BY edge ORDER BY frame ROWS UNBOUNDED PRECEDING) + (frame + 1) * {_DECAY}) AS c FROM g),
b AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY edge ORDER BY frame) >= 0.05 THEN lag(c) OVER (PARTITION BY edge ORDER BY frame) ELSE 0 END AS before FROM s),
w AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN greatest(before, m) END IGNORE NULLS) OVER (PARTITION BY edge ORDER BY frame ROWS UNBOUNDED PRECEDING) AS weight FROM b)
SELECT frame, edge, round(c, 6) AS confidence, round(weight, 6) AS weight FROM w WHERE c >= 0.05"""
)
def edge_decay(spark, sf):
    frames = hourly(spark, sf)
    maxima = discover.edge_maxima(discover.discoveries(pairs(spark, sf), 0.32))
    return _rounded(discover.edge_decay(frames, maxima).drop("session_id"))


@query(
    f"""WITH {_D}, f AS (SELECT frame, sum(ln(0.9 + 0.095 * ((frame * 7) % 11) / 10.0)) OVER (ORDER BY frame) AS total, ln(0.9 + 0.095 * ((frame * 7) % 11) / 10.0) AS rate FROM ch),
m AS (SELECT frame, edge, max(confidence) AS m FROM d GROUP BY ALL), g AS (SELECT f.frame, e.edge, total, rate, m FROM f CROSS JOIN (SELECT DISTINCT edge FROM m) e LEFT JOIN m ON m.frame = f.frame AND m.edge = e.edge),
c AS (SELECT frame, edge, exp(total + max(ln(m) - total + rate) OVER (PARTITION BY edge ORDER BY frame)) AS c FROM g)
SELECT frame, edge, round(c, 6) AS confidence FROM c WHERE c >= 0.05"""
)
def edge_decay_by_frame(spark, sf):
    frames = hourly(spark, sf).withColumn("decay", 0.9 + 0.095 * ((F.col("frame") * 7) % 11) / 10.0)
    maxima = discover.edge_maxima(discover.discoveries(pairs(spark, sf), 0.32))
    return _rounded(discover.edge_decay(frames, maxima, "decay").select("frame", "edge", "confidence"))


@query(f"WITH {_D}, n AS (SELECT ch.frame, count(d.edge) AS n FROM ch LEFT JOIN d ON d.frame = ch.frame GROUP BY ch.frame) SELECT frame, n, CAST(sum(n) OVER (ORDER BY frame) AS BIGINT) AS total FROM n")
def edge_decay_running_total(spark, sf):
    return discover.per_frame_counts(hourly(spark, sf), discover.discoveries(pairs(spark, sf), 0.32)).drop("session_id")


@query(f"WITH {_R} SELECT channel_a, channel_b, round(avg(CASE WHEN abs(pearson_r) > 0.32 THEN 1.0 ELSE 0.0 END), 6) AS density, count(*) AS n FROM r GROUP BY ALL")
def discovery_density(spark, sf):
    return _rounded(discover.density(pairs(spark, sf), 0.32, ["channel_a", "channel_b"]))


@query(
    f"""WITH {_R}, t AS (SELECT channel_a || '->' || channel_b AS edge, exp(-10 * avg(abs(pearson_r))) AS p FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (ORDER BY p, edge) AS k, count(*) OVER () AS m FROM t)
SELECT edge, round(p, 6) AS p, round(max(least(1.0, p * (m - k + 1))) OVER (ORDER BY p, edge), 6) AS p_holm FROM k"""
)
def holm_bonferroni(spark, sf):
    tests = pairs(spark, sf).groupBy("session_id", F.concat_ws("->", "channel_a", "channel_b").alias("edge")).agg(F.exp(-10 * F.avg(F.abs("pearson_r"))).alias("p"))
    return _rounded(discover.holm(tests, ["session_id"], "edge", "p").drop("session_id"))


@query(f"WITH {_R}, f AS (SELECT ch.frame, r.channel_a, r.channel_b, r.pearson_r FROM ch LEFT JOIN r ON r.frame = ch.frame AND abs(r.pearson_r) > 0.32) SELECT frame, coalesce(channel_a, '') AS channel_a, coalesce(channel_b, '') AS channel_b, round(pearson_r, 6) AS pearson_r, round(coalesce(abs(pearson_r), 0.0), 6) AS confidence FROM f")
def longitudinal_rows(spark, sf):
    found = discover.discoveries(pairs(spark, sf), 0.32).withColumn("operator_type", F.lit("perceiver"))
    return _rounded(discover.longitudinal(hourly(spark, sf).select("session_id", "frame"), found).select("frame", "channel_a", "channel_b", "pearson_r", "confidence"))


_USER = "PARTITION BY user_id ORDER BY event_id"


@query(f"WITH s AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS ({_USER} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT event_id, round(CASE WHEN s < 1e-12 THEN 0 ELSE (value - m) / greatest(s, 1e-12) END, 6) AS z FROM s")
def rolling_zscore(spark, sf):
    w = windows.trailing("user_id", "event_id", 50)
    return table(spark, sf, "events").select("event_id", _r(windows.rolling_zscore(F.col("value"), w)).alias("z"))


@query(f"SELECT event_id, round(avg(abs(value)) OVER ({_USER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / greatest(avg(abs(value)) OVER ({_USER} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 1e-12), 6) AS ratio FROM events")
def short_long_ratio(spark, sf):
    short, long = (windows.trailing("user_id", "event_id", n) for n in (5, 50))
    return table(spark, sf, "events").select("event_id", _r(windows.short_long_ratio(F.col("value"), short, long)).alias("ratio"))


def _covariates(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("frame")
    return hourly(spark, sf).select("session_id", "frame", F.pmod(f, F.lit(10)).cast("double").alias("kp_index"), (f / 708.7).alias("lunar_phase"), F.pmod(f, F.lit(24)).cast("double").alias("sidereal_time"), (1e-8 * F.pow(F.lit(10.0), F.pmod(f, F.lit(31)) / 10.0)).alias("xray_flux"))


@query(
    f"""WITH {_CH}, c AS (SELECT frame, CAST(frame % 10 AS DOUBLE) AS kp, frame / 708.7 AS lunar, CAST(frame % 24 AS DOUBLE) AS star, 1e-8 * pow(10.0, (frame % 31) / 10.0) AS flux FROM ch),
p AS (SELECT frame, 0.35 * least(greatest(kp / 9.0, 0), 1) + 0.20 * (0.5 + 0.5 * cos(2 * pi() * (lunar % 1.0))) + 0.15 * (0.5 + 0.5 * sin(2 * pi() * star / 24.0)) + 0.30 * least(greatest((log10(greatest(abs(flux), 1e-12)) + 8.0) / 3.0, 0), 1) AS pressure FROM c),
m AS (SELECT *, 1 + 0.55 * pressure AS m, pressure >= 0.35 OR frame = 0 AS is_event FROM p),
w AS (SELECT *, CAST(round_even(15 * (1 + 0.75 * pressure), 0) AS INTEGER) AS coherence_window, frame - max(CASE WHEN is_event THEN frame END) OVER (ORDER BY frame) AS since FROM m)
SELECT frame, round(pressure, 6) AS pressure, round(m, 6) AS m, round(greatest(0.05, 0.32 / m), 6) AS discovery_threshold, round(greatest(0.90, 0.995 - (m - 1) * 0.025), 6) AS confidence_decay, coherence_window, is_event,
coalesce(since <= coherence_window, false) AS coherence_active, round(CASE WHEN since <= coherence_window THEN m * 1.15 ELSE m END, 6) AS modulation FROM w"""
)
def moderator_pressure(spark, sf):
    out = moderators.moderated(_covariates(spark, sf))
    return _rounded(out.select("frame", "pressure", "m", "discovery_threshold", "confidence_decay", "coherence_window", "is_event", "coherence_active", "modulation"))


@query(f"WITH {_CH}, {_Z}, e AS (SELECT frame, em_rf > 2 AS is_event, frame - max(CASE WHEN em_rf > 2 THEN frame END) OVER (ORDER BY frame) AS since FROM z) SELECT frame, is_event, coalesce(since < 15, false) AS coherence_active, round((1 + 0.03 * sin(frame / 31.8) + 0.02 * cos(frame / 55.7)) * CASE WHEN since < 15 THEN 1.3 ELSE 1 END, 6) AS modulation FROM e")
def coherence_active(spark, sf):
    z = canonical.zscored(hourly(spark, sf)).select("session_id", "frame", (F.col("em_rf") > 2).alias("is_event"))
    out = moderators.coherence(z, F.lit(15), strict=True)
    return out.select("frame", "is_event", "coherence_active", _r(moderators.synthetic_modulation(F.col("frame"), F.col("coherence_active"))).alias("modulation"))


_TERMS = ("kp_index", "lunar", "sidereal", "flux")


def _sweeps(names: tuple[str, ...]) -> str:
    """Moments of all pairs as rows (i, j, v), swept by one predictor after the other."""
    every = [*names, "y"]
    moments = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_pop({a}, {b}) * count(*) AS v FROM x" for i, a in enumerate(every) for j, b in enumerate(every))
    parts = [f"s0 AS ({moments})"]
    for k in range(len(names)):
        parts.append(
            f"s{k + 1} AS (SELECT a.i, a.j, CASE WHEN a.i = {k} AND a.j = {k} THEN 1 / p.v WHEN a.i = {k} THEN a.v / p.v WHEN a.j = {k} THEN -a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v "
            f"FROM s{k} a JOIN s{k} p ON p.i = {k} AND p.j = {k} JOIN s{k} c ON c.i = a.i AND c.j = {k} JOIN s{k} r ON r.i = {k} AND r.j = a.j)"
        )
    return ", ".join(parts)


@query(
    f"""WITH {_D}, q AS (SELECT frame, CAST(frame % 10 AS DOUBLE) AS kp_index, 0.5 + 0.5 * cos(2 * pi() * ((frame / 708.7) % 1.0)) AS lunar, 0.5 + 0.5 * sin(2 * pi() * CAST(frame % 24 AS DOUBLE) / 24.0) AS sidereal, (frame % 31) / 10.0 - 8 AS flux FROM ch),
e AS (SELECT ch.frame, count(d.edge) AS n FROM ch LEFT JOIN d ON d.frame = ch.frame GROUP BY ch.frame), o AS (SELECT frame, CAST(sum(n) OVER (ORDER BY frame) AS DOUBLE) AS y FROM e),
x AS (SELECT kp_index, lunar, sidereal, flux, y FROM q JOIN o USING (frame)), {_sweeps(_TERMS)},
z AS (SELECT b.i, b.v AS coefficient, v.v * m.v AS vif, v.v AS spread FROM s4 b JOIN s4 v ON v.i = b.i AND v.j = b.i JOIN s0 m ON m.i = b.i AND m.j = b.i WHERE b.j = 4 AND b.i < 4),
t AS (SELECT v AS sse FROM s4 WHERE i = 4 AND j = 4), w AS (SELECT v AS total FROM s0 WHERE i = 4 AND j = 4), c AS (SELECT count(*) AS n FROM x)
SELECT ['kp_index', 'lunar', 'sidereal', 'flux'][i + 1] AS term, round(coefficient, 4) AS coefficient, round(sqrt(sse / (n - 5) * spread), 4) AS std_error, round(vif, 4) AS vif, n, round(1 - sse / total, 4) AS r_squared FROM z, t, w, c"""
)
def moderator_regression(spark, sf):
    """Cumulative discoveries on the environment's moderators, with inflation factors."""
    f = F.col("frame")
    cov = _covariates(spark, sf)
    x = cov.select("frame", "kp_index", (0.5 + 0.5 * F.cos(2 * math.pi * F.pmod("lunar_phase", F.lit(1.0)))).alias("lunar"), (0.5 + 0.5 * F.sin(2 * math.pi * F.col("sidereal_time") / 24.0)).alias("sidereal"), F.log10("xray_flux").alias("flux"))
    total = discover.per_frame_counts(hourly(spark, sf), discover.discoveries(pairs(spark, sf), 0.32)).select(f, F.col("total").cast("double").alias("y"))
    model = regression.linear_model(x.join(total, "frame"), [], "y", _TERMS).where("term <> 'intercept'")
    return _rounded(model.select("term", "coefficient", "std_error", "vif", "n", "r_squared"), 4)


def _in_thirds(frames: DataFrame, path: str) -> DataFrame:
    """A stream over frames that are written in three parts, one after the other."""
    third = (frames.agg(F.max("frame")).first()[0] or 0) // 3 + 1
    for k in range(3):
        frames.where((F.col("frame") >= k * third) & (F.col("frame") < (k + 1) * third)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return frames.sparkSession.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@query(
    f"""WITH {_D}, e AS (SELECT DISTINCT edge FROM d), g AS (SELECT ch.frame, e.edge, d.confidence AS m FROM ch CROSS JOIN e LEFT JOIN d ON d.frame = ch.frame AND d.edge = e.edge),
s AS (SELECT *, exp(max(ln(m) - frame * {_DECAY}) OVER (PARTITION BY edge ORDER BY frame ROWS UNBOUNDED PRECEDING) + (frame + 1) * {_DECAY}) AS c FROM g)
SELECT frame, edge, round(c, 6) AS confidence FROM s WHERE c >= 0.05"""
)
def streaming_edges(spark, sf):
    """Edges of the recording as a stream in three parts; windows and decay reach over the cuts."""
    frames = hourly(spark, sf).withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("frame") * 3600))
    path = work_folder(spark, "stream")
    with stateful.rocksdb(spark):
        emission.emit(stateful.live_edges(_in_thirds(frames, path), ttl_ms=10**13), path, "edges")
    return _rounded(emission.committed(spark, path, "edges", stateful.LIVE_EDGES).where("kind = 'EDGE'").select("frame", "edge", "confidence"))


@query(f"WITH {_CH}, {_Z}, e AS (SELECT frame, em_rf > 2 AS is_event, frame - max(CASE WHEN em_rf > 2 THEN frame END) OVER (ORDER BY frame) AS since FROM z) SELECT frame, coalesce(since <= 15, false) AS coherence_active FROM e")
def streaming_coherence(spark, sf):
    """The recording written in three parts and read as a stream: state passes from batch to batch, and each batch is committed once."""
    frames = canonical.zscored(hourly(spark, sf)).select("session_id", "frame", F.timestamp_seconds(1_700_000_000 + F.col("frame") * 3600).alias("ts"), (F.col("em_rf") > 2).alias("is_event"), F.lit(15).alias("window"))
    path = work_folder(spark, "stream")
    stream = _in_thirds(frames, path)
    with stateful.rocksdb(spark):
        emission.emit(stateful.live_coherence(stream, ttl_ms=10**13), path, "coherence")
    return emission.committed(spark, path, "coherence", stateful.COHERENT).where("kind = 'FRAME'").select("frame", "coherence_active")


_LCG = "((1103515245 * (({}) % 2147483648) + 12345) % 2147483648)"


def _lcg2(seed: str) -> str:
    return _LCG.format(_LCG.format(seed))


_WALK = f"steps AS (SELECT a.agent_id, f.frame, CAST(floor({_lcg2('a.agent_id * 7919 + f.frame * 104729 + 1')} / 268435456) AS BIGINT) % 7 - 3 AS dx, CAST(floor({_lcg2('a.agent_id * 6101 + f.frame * 15485863 + 2')} / 268435456) AS BIGINT) % 7 - 3 AS dy FROM range(20) a(agent_id) CROSS JOIN ch f), walk AS (SELECT agent_id, frame, ((agent_id + sum(dx) OVER w) % 32 + 32) % 32 AS x, ((agent_id * 3 + sum(dy) OVER w) % 32 + 32) % 32 AS y FROM steps WINDOW w AS (PARTITION BY agent_id ORDER BY frame))"


def _walk(frames: DataFrame, agents: int = 20) -> DataFrame:
    """Positions of `agents` agents over all frames of each session, on a 32 x 32 ring."""
    cells = frames.select("session_id", "frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(agents - 1).cast("long"))).alias("agent_id"))
    step = lambda a, f, s: F.pmod(F.floor(lcg(lcg(F.col("agent_id") * a + F.col("frame") * f + s)) / 2**28), F.lit(7)) - 3
    steps = cells.select("session_id", "agent_id", "frame", step(7919, 104729, 1).alias("dx"), step(6101, 15485863, 2).alias("dy"), F.col("agent_id").alias("x0"), (F.col("agent_id") * 3).alias("y0"))
    x = windows.walk(steps, ["session_id", "agent_id"], "frame", "x0", "dx", 32).withColumnRenamed("position", "x")
    return windows.walk(x, ["session_id", "agent_id"], "frame", "y0", "dy", 32).withColumnRenamed("position", "y").select("session_id", "agent_id", "frame", "x", "y")


@query(f"WITH {_CH}, {_WALK} SELECT agent_id, frame, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM walk")
def agent_walk_positions(spark, sf):
    return _walk(hourly(spark, sf)).drop("session_id")


@query(
    f"""WITH {_CH}, {_Z}, {_WALK}, g AS (SELECT i // 32 AS x, i % 32 AS y, (i // 32) * (2.0 / 31) - 1 AS u, (i % 32) * (2.0 / 31) - 1 AS v FROM range(1024) r(i)),
b AS (SELECT x, y, sin(pi() * u) * cos(pi() * v) AS w0, cos(2 * pi() * u) + sin(pi() * v) AS w1, exp(-3 * (u * u + v * v)) - avg(exp(-3 * (u * u + v * v))) OVER () AS w2 FROM g),
s AS (SELECT agent_id, frame, CAST(CAST(em_rf * w0 AS FLOAT) AS DOUBLE) AS a, CAST(CAST(optical_ir * w1 AS FLOAT) AS DOUBLE) AS c, CAST(CAST(consciousness_proxy * w2 AS FLOAT) AS DOUBLE) AS e FROM walk JOIN b USING (x, y) JOIN z USING (frame)),
r AS (SELECT agent_id, frame, covar_pop(a, c) OVER w / nullif(stddev_pop(a) OVER w * stddev_pop(c) OVER w, 0) AS r, count(*) OVER w AS k FROM s WINDOW w AS (PARTITION BY agent_id ORDER BY frame ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT agent_id, count(*) AS n, round(avg(abs(r)), 4) AS mean_confidence FROM r WHERE k = 50 AND r IS NOT NULL GROUP BY agent_id"""
)
def agent_sampled_corr(spark, sf):
    frames = canonical.zscored(hourly(spark, sf))
    seen = canonical.sampled(_walk(frames), frames, canonical.basis(spark, 32))
    r = windows.pair_correlations(seen, CHANNELS[:2], ["session_id", "agent_id"], "frame", 50)
    return r.groupBy("agent_id").agg(F.count("*").alias("n"), _r(F.avg(F.abs("pearson_r")), 4).alias("mean_confidence"))


@query(
    """WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT s.user_id, covar_pop(s.value, t.value) OVER w / nullif(stddev_pop(s.value) OVER w * stddev_pop(t.value) OVER w, 0) AS r, count(*) OVER w AS k
FROM s JOIN s t ON t.user_id = s.user_id AND (t.i + 12) % s.n = s.i WINDOW w AS (PARTITION BY s.user_id ORDER BY s.i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))
SELECT user_id, round(least(greatest(quantile_cont(abs(r), 0.95), 0.05), 0.99), 6) AS threshold FROM r WHERE k = 25 AND r IS NOT NULL GROUP BY user_id"""
)
def null_threshold_calibration(spark, sf):
    null = windows.rolled_null_correlation(table(spark, sf, "events"), "value", "user_id", "event_id", 25)
    return _rounded(windows.null_threshold(null, "user_id"))


@query(
    f"""WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, k, max(n) AS n, sum(value * cos(2 * pi() * ((k * t) % n) / n)) AS re, -sum(value * sin(2 * pi() * ((k * t) % n) / n)) AS im, CASE WHEN k = 0 OR 2 * k = max(n) THEN 0 ELSE 2 * pi() * {_lcg2('user_id * 7919 + k * 104729 + 5')} / 2147483648.0 END AS phi
  FROM s JOIN range(1000000) q(k) ON k <= n // 2 GROUP BY user_id, k),
g AS (SELECT s.user_id, t, max(value) AS value, sum(CASE WHEN k = 0 OR 2 * k = f.n THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((k * t) % f.n) / f.n + phi) - im * sin(2 * pi() * ((k * t) % f.n) / f.n + phi)) / f.n) AS scrambled FROM s JOIN f ON f.user_id = s.user_id GROUP BY s.user_id, t),
r AS (SELECT user_id, covar_pop(value, scrambled) OVER w / nullif(stddev_pop(value) OVER w * stddev_pop(scrambled) OVER w, 0) AS r, count(*) OVER w AS k FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))
SELECT user_id, round(least(greatest(quantile_cont(abs(r), 0.95), 0.05), 0.99), 6) AS threshold FROM r WHERE k = 25 AND r IS NOT NULL GROUP BY user_id"""
)
def surrogate_null_threshold(spark, sf):
    """Threshold that correlations with a phase-scrambled surrogate of the same spectrum stay under."""
    order = windows.Window.partitionBy("user_id").orderBy("event_id")
    series = table(spark, sf, "events").select("user_id", (F.row_number().over(order) - 1).alias("t"), "value")
    turn = lambda key, k: lcg(lcg(key * 7919 + k * 104729 + 5)) / 2147483648.0
    null = windows.surrogate_null_correlation(series, "value", "user_id", "t", 25, turn)
    return _rounded(windows.null_threshold(null, "user_id"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Trial samples: supplier x return flag (A active, R sham, N phantom) x line status (O baseline, F intervention)."""
    arm = F.when(F.col("l_returnflag") == "A", "active").when(F.col("l_returnflag") == "R", "sham").otherwise("phantom")
    phase = F.when(F.col("l_linestatus") == "O", "baseline").otherwise("intervention")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("trial_id"), arm.alias("arm"), phase.alias("phase"), F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = windows.Window.partitionBy("trial_id", "arm", "phase").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.select("trial_id", "arm", "phase", (F.row_number().over(order) - 1).alias("idx"), "value")


_S = "s AS (SELECT l_suppkey AS trial_id, CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'R' THEN 'sham' ELSE 'phantom' END AS arm, CASE l_linestatus WHEN 'O' THEN 'baseline' ELSE 'intervention' END AS phase, l_quantity AS value, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx FROM lineitem)"
_M = ", ".join(f"avg(value) FILTER (arm = '{a}' AND phase = '{p}') AS m_{p[0]}_{a}, coalesce(var_samp(value) FILTER (arm = '{a}' AND phase = '{p}'), 0) AS v_{p[0]}_{a}" for a in ("active", "sham", "phantom") for p in ("baseline", "intervention"))
_E = f"""{_S}, g AS (SELECT trial_id, {_M} FROM s GROUP BY trial_id),
e AS (SELECT trial_id, m_i_active - m_b_active AS raw_delta, m_i_active - m_b_active - (m_i_sham - m_b_sham) AS net_delta, sqrt(greatest(1e-6, (v_b_active + v_i_active + v_b_sham + v_i_sham) / 4)) AS pooled_sd, m_i_phantom - m_b_phantom AS phantom_delta FROM g)"""


@query(f"WITH {_E} SELECT trial_id, round(raw_delta, 6) AS raw_delta, round(net_delta, 6) AS net_delta, round(pooled_sd, 6) AS pooled_sd, round(net_delta / pooled_sd, 6) AS effect_size_d, round(phantom_delta, 6) AS phantom_delta FROM e WHERE net_delta IS NOT NULL AND phantom_delta IS NOT NULL")
def trial_effect_size(spark, sf):
    return _rounded(trials.effects(samples(spark, sf)).where("net_delta is not null"))


@query(
    f"""WITH {_E}, x AS (SELECT *, (trial_id % 60) / 10.0 AS rf, (trial_id % 11) / 10.0 AS temp, abs(phantom_delta) > 0.4 * abs(raw_delta) AND abs(phantom_delta) > 0.1 AS pickup FROM e),
k AS (SELECT *, CASE WHEN pickup THEN greatest(least(1.0, rf / 10), 0.8) ELSE least(1.0, rf / 10) END AS risk FROM x)
SELECT trial_id, round(risk, 6) AS em_risk, concat_ws(',', CASE WHEN pickup THEN 'DIRECT_EM_INSTRUMENTATION_PICKUP' END, CASE WHEN rf > 5 THEN 'HIGH_NEAR_FIELD_RF' END, CASE WHEN temp > 0.8 THEN 'THERMAL_DRIFT_INTERFERENCE' END) AS flags,
round(risk, 3) < 0.35 AND NOT temp > 0.8 AS valid_signal, round(abs(net_delta / pooled_sd) / (1 + abs(net_delta / pooled_sd)) * (1 - risk), 6) AS rri FROM k"""
)
def artifact_flags_status(spark, sf):
    e = trials.effects(samples(spark, sf))
    marked = trials.artifacts(e, (F.col("trial_id") % 60) / 10.0, (F.col("trial_id") % 11) / 10.0)
    return _rounded(marked.select("trial_id", "em_risk", F.concat_ws(",", "flags").alias("flags"), "valid_signal", trials.response_index(F.col("effect_size_d"), F.col("em_risk")).alias("rri")))


def taus(spark: SparkSession, sf: str) -> DataFrame:
    """Larger autocorrelation time of a trial's two active phases."""
    active = samples(spark, sf).where("arm = 'active'")
    return trials.autocorrelation_time(active, ["trial_id", "phase"], "idx", "value").groupBy("trial_id").agg(F.max("tau").alias("tau"))


def _tau_sql(source: str, by: str, order: str) -> str:
    return f"""o AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS i, value - avg(value) OVER (PARTITION BY {by}) AS d, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
lags AS (SELECT {', '.join('a.' + x.strip() for x in by.split(','))}, max(a.n) AS n, k, sum(a.d * b.d) / (max(a.n) - k) AS cov FROM o a CROSS JOIN range(1, 21) l(k) JOIN o b ON {' AND '.join(f'a.{x.strip()} = b.{x.strip()}' for x in by.split(','))} AND b.i = a.i + k WHERE k <= least(20, a.n // 2) GROUP BY {', '.join('a.' + x.strip() for x in by.split(','))}, k),
va AS (SELECT {by}, avg(d * d) AS var, max(n) AS n FROM o GROUP BY {by}),
fi AS (SELECT {by}, min(k) FILTER (cov / nullif(var, 0) <= 0.36787944117144233) AS k FROM lags JOIN va USING ({by}) GROUP BY {by}),
ta AS (SELECT {by}, CASE WHEN n < 4 OR var < 1e-12 THEN 1 ELSE coalesce(k, greatest(1, least(20, n // 2) // 2)) END AS tau, n FROM va LEFT JOIN fi USING ({by}))"""


@query(f"WITH {_tau_sql('events', 'user_id', 'event_id')} SELECT user_id, CAST(tau AS BIGINT) AS tau, n FROM ta")
def autocorr_tau(spark, sf):
    return trials.autocorrelation_time(table(spark, sf, "events"), ["user_id"], "event_id", "value")


@query(f"WITH {_tau_sql('events', 'user_id', 'event_id')} SELECT user_id, n, round(n / (2.0 * tau + 1), 6) AS n_effective FROM ta")
def effective_sample_size(spark, sf):
    tau = trials.autocorrelation_time(table(spark, sf, "events"), ["user_id"], "event_id", "value")
    return _rounded(tau.select("user_id", "n", trials.effective_n(F.col("n"), F.col("tau")).alias("n_effective")))


_T = _S + ", act AS (SELECT * FROM s WHERE arm = 'active'), " + _tau_sql("act", "trial_id, phase", "idx") + ", tt AS (SELECT trial_id, max(tau) AS tau FROM ta GROUP BY trial_id)"
_B = f"""{_T}, ln AS (SELECT trial_id, arm, phase, count(*) AS n FROM s WHERE arm IN ('active', 'sham') GROUP BY ALL),
bl AS (SELECT trial_id, n, greatest(2, least(greatest(2, n // 4), greatest(2, 2 * tau))) AS size FROM (SELECT trial_id, min(n) AS n, count(*) AS k FROM ln GROUP BY trial_id) JOIN tt USING (trial_id) WHERE k = 4),
bd AS (SELECT s.trial_id, s.idx // size AS block, sum(CASE arm WHEN 'active' THEN 1 ELSE -1 END * CASE phase WHEN 'intervention' THEN 1 ELSE -1 END * value) AS d, max((n // size) * size) AS used FROM s JOIN bl USING (trial_id) WHERE arm IN ('active', 'sham') AND idx < (n // size) * size GROUP BY ALL)"""


@query(
    f"""WITH {_B}, st AS (SELECT trial_id, perm, abs(sum(CASE WHEN {_lcg2('perm * 7919 + block * 104729 + 1')} >= 1073741824 THEN -d ELSE d END) / max(used)) AS stat FROM bd CROSS JOIN range(200) p(perm) GROUP BY ALL),
ob AS (SELECT trial_id, abs(sum(d) / max(used)) AS observed FROM bd GROUP BY trial_id)
SELECT trial_id, round(max(observed), 6) AS observed, round(avg(CASE WHEN stat >= observed - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM st JOIN ob USING (trial_id) GROUP BY trial_id"""
)
def block_permutation_p(spark, sf):
    blocks = trials.block_differences(samples(spark, sf), taus(spark, sf))
    return _rounded(trials.permutation_p(blocks, 200))


@query(
    f"""WITH {_S}, a AS (SELECT trial_id, CASE phase WHEN 'baseline' THEN 0 ELSE 1 END AS late, value, row_number() OVER (PARTITION BY trial_id ORDER BY CASE phase WHEN 'baseline' THEN 0 ELSE 1 END, idx) - 1 AS i FROM s WHERE arm = 'active'),
z AS (SELECT trial_id, count(*) AS n, sum(1 - late) AS nb, sum(value) AS total FROM a GROUP BY trial_id HAVING sum(1 - late) BETWEEN 1 AND count(*) - 1),
sh AS (SELECT z.*, perm, 1 + CAST(floor({_lcg2('perm * 7919 + 1')} / 256) AS BIGINT) % (n - 1) AS shift FROM z CROSS JOIN range(100) p(perm)),
fs AS (SELECT sh.trial_id, perm, max(n) AS n, max(nb) AS nb, max(total) AS total, sum(value) AS first FROM sh JOIN a ON a.trial_id = sh.trial_id AND (a.i - shift + n) % n < nb GROUP BY ALL),
ob AS (SELECT trial_id, abs(avg(value) FILTER (late = 1) - avg(value) FILTER (late = 0)) AS observed FROM a GROUP BY trial_id)
SELECT trial_id, round(max(observed), 6) AS observed, round(avg(CASE WHEN abs((total - first) / (n - nb) - first / nb) >= observed - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM fs JOIN ob USING (trial_id) GROUP BY trial_id"""
)
def circular_shift_p(spark, sf):
    return _rounded(trials.circular_shift_p(samples(spark, sf), 100))


@query(
    f"""WITH {_T}, f AS (SELECT * FROM s WHERE arm IN ('active', 'sham')), nn AS (SELECT trial_id, arm, phase, count(*) AS n FROM f GROUP BY ALL),
pl AS (SELECT nn.*, least(nn.n, greatest(5, least(b.n // 2, 2 * tau))) AS size FROM nn JOIN nn b ON b.trial_id = nn.trial_id AND b.arm = 'active' AND b.phase = 'baseline' JOIN tt ON tt.trial_id = nn.trial_id),
dr AS (SELECT pl.*, boot, k, CAST(floor({_lcg2("boot * 7919 + k * 104729 + (CASE arm WHEN 'active' THEN 0 ELSE 2 END + CASE phase WHEN 'baseline' THEN 0 ELSE 1 END) * 1299709 + 1")} / 256) AS BIGINT) % (n - size + 1) AS fr FROM pl CROSS JOIN range(40) b(boot) CROSS JOIN range(400) q(k) WHERE k < ceil(n / size)),
rs AS (SELECT dr.trial_id, dr.arm, dr.phase, boot, max(n) AS n, sum(value) AS a, sum(value * value) AS q FROM dr JOIN f ON f.trial_id = dr.trial_id AND f.arm = dr.arm AND f.phase = dr.phase AND f.idx >= fr AND f.idx < fr + least(size, n - k * size) GROUP BY ALL),
ms AS (SELECT *, a / n AS m, greatest(0, q - a * a / n) / greatest(1, n - 1) AS v FROM rs),
ea AS (SELECT trial_id, boot, sum(CASE arm WHEN 'active' THEN 1 ELSE -1 END * CASE phase WHEN 'intervention' THEN 1 ELSE -1 END * m) / sqrt(greatest(1e-6, sum(v) / 4)) AS d FROM ms GROUP BY ALL HAVING count(*) = 4),
li AS (SELECT trial_id, list_sort(list(abs(d) / (1 + abs(d)) * 0.9)) AS r FROM ea GROUP BY trial_id)
SELECT trial_id, round(r[2], 6) AS ci_low, round(r[40], 6) AS ci_high FROM li"""
)
def block_bootstrap_ci(spark, sf):
    t = taus(spark, sf)
    risk = t.select("trial_id", F.lit(0.1).alias("em_risk"))
    return _rounded(trials.bootstrap_interval(samples(spark, sf), t, risk, 40))


@query(f"WITH {_E}, d AS (SELECT trial_id, abs(net_delta / pooled_sd) / (1 + abs(net_delta / pooled_sd)) AS rri FROM e), p AS (SELECT trial_id // 10 * 10 AS trial_id, avg(rri) AS prior FROM d WHERE trial_id % 10 <> 0 GROUP BY 1) SELECT d.trial_id, round(rri, 6) AS rri, round(coalesce(greatest(0, 1 - abs(rri - prior)), 0.5), 6) AS repeatability FROM d LEFT JOIN p USING (trial_id)")
def trial_repeatability(spark, sf):
    e = trials.effects(samples(spark, sf)).select("trial_id", trials.response_index(F.col("effect_size_d"), F.lit(0.0)).alias("rri"))
    priors = e.where("trial_id % 10 <> 0").select((F.floor(F.col("trial_id") / 10) * 10).alias("trial_id"), F.col("rri").alias("score"))
    return _rounded(trials.repeatability(e, priors))


@query(f"WITH {_E}, x AS (SELECT trial_id, net_delta / pooled_sd AS d, trial_id % 7 <> 0 AS ok, (trial_id % 100) / 1000.0 AS p FROM e) SELECT CASE WHEN NOT ok THEN 'ARTIFACT_LIKELY' WHEN p < 0.01 AND abs(d) > 0.8 THEN 'REPEATABLE_DIFFERENCE' WHEN p < 0.05 AND abs(d) >= 0.2 THEN 'EXPLORATORY' ELSE 'INCONCLUSIVE' END AS status, count(*) AS n FROM x GROUP BY 1")
def evidence_status(spark, sf):
    e = trials.effects(samples(spark, sf))
    status = trials.evidence_status(F.col("trial_id") % 7 != 0, (F.col("trial_id") % 100) / 1000.0, F.lit(0.3), F.lit(0.9), F.col("effect_size_d"))
    return e.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')")
    return rows.select((F.col("l_suppkey") % 10).alias("grp"), F.col("l_suppkey").alias("session"), F.when(F.col("l_returnflag") == "A", 1).otherwise(-1).alias("g"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("c"), F.col("l_discount").alias("y"))


_C = "c0 AS (SELECT l_suppkey % 10 AS grp, l_suppkey AS session, CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END AS g, CASE l_linestatus WHEN 'O' THEN 1 ELSE -1 END AS c, l_discount AS y FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


@query(
    f"""WITH {_C}, ce AS (SELECT grp, g, c, count(*) AS n, avg(y) AS m, coalesce(var_samp(y), 0) AS v FROM c0 GROUP BY ALL),
f AS (SELECT grp, sum(n) AS n, count(*) AS rank, max(n) / min(n) AS kappa, sum(v * (n - 1)) AS sse, sum(1.0 / n) / 16 AS inverse, sum(m) / 4 AS b0, sum(g * m) / 4 AS bg, sum(c * m) / 4 AS bc, sum(g * c * m) / 4 AS bgc FROM ce GROUP BY grp)
SELECT grp, 'IDENTIFIED_OLS' AS status, CAST(n AS BIGINT) AS n, rank, round(kappa, 6) AS kappa, round(sse, 6) AS sse, round(sqrt(sse / (n - 4) * inverse), 6) AS se, round(b0, 6) AS b0, round(bg, 6) AS bg, round(bc, 6) AS bc, round(bgc, 6) AS bgc, round(4 * bgc, 6) AS contrast_gc,
round(bg - round(1.95996 + 2.378 / (n - 4) + 2.82 / ((n - 4) * (n - 4)), 3) * sqrt(sse / (n - 4) * inverse), 6) AS bg_low FROM f WHERE rank = 4"""
)
def factorial_2x2_ols(spark, sf):
    fit = factorial.ols(_coded(spark, sf), ["grp"]).where("rank = 4")
    return _rounded(fit.select("grp", "status", "n", "rank", "kappa", "sse", "se", "b0", "bg", "bc", "bgc", "contrast_gc", "bg_low"))


@query(
    f"""WITH {_C}, me AS (SELECT grp, session, avg(y) AS mean FROM c0 GROUP BY ALL), be AS (SELECT grp, count(*) AS sessions, avg(mean) AS grand_mean, coalesce(var_samp(mean), 0) AS var_u FROM me GROUP BY grp),
q AS (SELECT grp, count(*) AS n, sum((y - mean) * (y - mean)) AS rr, sum(g * (y - mean)) AS r1, sum(c * (y - mean)) AS r2, sum(g * c * (y - mean)) AS r3, CAST(sum(g * c) AS DOUBLE) AS s12, CAST(sum(c) AS DOUBLE) AS s13, CAST(sum(g) AS DOUBLE) AS s23 FROM c0 JOIN me USING (grp, session) GROUP BY grp),
d AS (SELECT *, n * (n * n - s23 * s23) - s12 * (s12 * n - s23 * s13) + s13 * (s12 * s23 - n * s13) AS det FROM q),
b AS (SELECT *, ((n * n - s23 * s23) * r1 + (s13 * s23 - s12 * n) * r2 + (s12 * s23 - n * s13) * r3) / det AS b1, ((s13 * s23 - s12 * n) * r1 + (n * n - s13 * s13) * r2 + (s12 * s13 - n * s23) * r3) / det AS b2, ((s12 * s23 - n * s13) * r1 + (s12 * s13 - n * s23) * r2 + (n * n - s12 * s12) * r3) / det AS b3 FROM d)
SELECT grp, sessions, n, round(grand_mean, 6) AS grand_mean, round(var_u, 8) AS var_u, round(greatest(0, rr - b1 * r1 - b2 * r2 - b3 * r3) / greatest(1, n - sessions - 3), 8) AS var_e, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3, 6) AS b3 FROM b JOIN be USING (grp)"""
)
def session_variance_components(spark, sf):
    c = factorial.session_components(_coded(spark, sf), ["grp"], "session")
    return c.select("grp", "sessions", "n", _r("grand_mean").alias("grand_mean"), _r("var_u", 8).alias("var_u"), _r("var_e", 8).alias("var_e"), *[_r(b).alias(b) for b in ("b1", "b2", "b3")])


#: How parts stand in for configurations: type -> geometry, brand number -> core (fixed values).
_GEOMETRY = {"STANDARD": "GOLDEN_RATIO_SPHERES", "LARGE": "EQUAL_SPHERES", "SMALL": "RANDOM_SPHERES", "PROMO": "SHAM_OFF"}


def configurations(spark: SparkSession, sf: str) -> DataFrame:
    geometry = F.lit("OTHER")
    for t, g in _GEOMETRY.items():
        geometry = F.when(F.col("p_type") == t, g).otherwise(geometry)
    cores = F.array(*[F.lit(c) for c in factorial.CORES])
    part = table(spark, sf, "part").select("p_partkey", "p_brand", geometry.alias("geometry"), F.element_at(cores, (F.col("p_size") % 5 + 1).cast("int")).alias("core"), F.col("p_retailprice").alias("freq_hz"), ((F.col("p_size") - 1) / 5.0).alias("amp_v"))
    return part.select("*", F.element_at(F.array(*[F.lit(m) for m in factorial.MODULATIONS]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("modulation"), (F.col("freq_hz") / 1000.0).alias("response"))


_CONF = (
    "conf AS (SELECT p_partkey, p_brand, CASE p_type " + " ".join(f"WHEN '{t}' THEN '{g}'" for t, g in _GEOMETRY.items()) + " ELSE 'OTHER' END AS geometry, [" + ", ".join(f"'{c}'" for c in factorial.CORES) + "][p_size % 5 + 1] AS core, p_retailprice AS freq_hz, (p_size - 1) / 5.0 AS amp_v, ["
    + ", ".join(f"'{m}'" for m in factorial.MODULATIONS) + "][p_partkey % 5 + 1] AS modulation, p_retailprice / 1000.0 AS response FROM part)"
)


@query(f"WITH {_CONF} SELECT CASE WHEN geometry = 'SHAM_OFF' OR amp_v <= 0 THEN 'SHAM' WHEN geometry = 'GOLDEN_RATIO_SPHERES' AND core = 'DUAL_TETRAHEDRON_MERKABA' THEN 'TARGET_HYPOTHESIS' WHEN geometry IN ('EQUAL_SPHERES', 'RANDOM_SPHERES') OR core IN ('SPHERICAL_CORE', 'CUBIC_CORE', 'NO_CORE') THEN 'ACTIVE_CONTROL' ELSE 'EXPLORATORY' END AS role, count(*) AS n FROM conf GROUP BY 1")
def condition_role_mix(spark, sf):
    role = factorial.condition_role(F.col("geometry"), F.col("core"), F.col("amp_v"))
    return configurations(spark, sf).groupBy(role.alias("role")).agg(F.count("*").alias("n"))


_HOT = " + ".join(f"CASE WHEN (o.{k} = c.{k}) OR (o.{k} NOT IN ({names}) AND c.{k} NOT IN ({names})) THEN 0 WHEN o.{k} IN ({names}) AND c.{k} IN ({names}) THEN 2 ELSE 1 END" for k, v in (("geometry", factorial.GEOMETRIES), ("core", factorial.CORES), ("modulation", factorial.MODULATIONS)) for names in [", ".join(f"'{x}'" for x in v)])


@query(
    f"""WITH {_CONF}, c AS (SELECT * FROM conf WHERE p_partkey < 30),
k AS (SELECT o.p_brand, c.p_partkey AS candidate_id, exp(-0.5 * (pow((log10(greatest(1, o.freq_hz)) - log10(greatest(1, c.freq_hz))) / 0.5, 2) + pow((o.amp_v - c.amp_v) / 2, 2) + ({_HOT}))) AS k, o.response FROM conf o CROSS JOIN c),
s AS (SELECT p_brand, candidate_id, sum(k * response) / greatest(sum(k), 1e-12) AS score FROM k GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, candidate_id) AS n FROM s) SELECT p_brand, candidate_id, round(score, 6) AS score FROM t WHERE n = 1"""
)
def one_hot_rbf_top1(spark, sf):
    conf = factorial.features(configurations(spark, sf))
    candidates = conf.where("p_partkey < 30").select(F.col("p_partkey").alias("candidate_id"), "features")  # the library of 30 candidates
    return _rounded(factorial.kernel_top1(conf, candidates, ["p_brand"]))


@query()
def gaussian_process_bound(spark, sf):
    conf = factorial.features(configurations(spark, sf))
    history = conf.select("p_brand", "features", "response")
    candidates = conf.where("p_partkey < 30").select(F.col("p_partkey").alias("candidate_id"), "features").toPandas()  # 30 rows
    return _rounded(factorial.best_candidate(factorial.gaussian_process(history, candidates, "p_brand"), "p_brand"))


@query(
    """WITH c AS (SELECT vec_id AS candidate_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 30),
s AS (SELECT v.vec_id, c.candidate_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), c.e) AS score, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_dot_product(CAST(v.embedding AS DOUBLE[]), c.e) DESC, c.candidate_id) AS n FROM embeddings v CROSS JOIN c)
SELECT vec_id, candidate_id, CAST(n AS INTEGER) AS n, round(score, 6) AS score FROM s WHERE n <= 3"""
)
def embedding_kernel_topk(spark, sf):
    """The three library vectors nearest to each embedding; the library is the first 30 vectors, so it is broadcast."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    library = e.where("vec_id < 30").select(F.col("vec_id").alias("candidate_id"), F.col("e").alias("c"))
    dot = F.aggregate(F.zip_with("e", "c", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    scored = e.crossJoin(F.broadcast(library)).select("vec_id", "candidate_id", dot.alias("score"))
    best = scored.groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("candidate_id")).alias("id"))), asc=False), 1, 3).alias("b"))  # 30 each
    return best.select("vec_id", F.posexplode("b").alias("n", "x")).select("vec_id", (-F.col("x.id")).alias("candidate_id"), (F.col("n") + 1).alias("n"), _r("x.score").alias("score"))


@query("SELECT CASE WHEN d.doc_id IS NULL THEN 'STALE' WHEN l.doc_id IS NULL THEN 'UNALLOWLISTED' ELSE 'ALLOWED' END AS verdict, count(*) AS n FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1")
def allowlist_gate(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.lit("warning").alias("severity"))
    return gates.allowlisted(found, table(spark, sf, "labels"), "doc_id").groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return gates.duplicates(table(spark, sf, "documents").select(F.md5("text").alias("digest")), "digest")


@query(r"SELECT doc_id, regexp_extract(text, '(Licensed|password|token)', 1) AS found FROM documents WHERE regexp_matches(text, '(Licensed|password|token)')")
def placeholder_scan(spark, sf):
    return gates.placeholders(table(spark, sf, "documents"), "doc_id", "text", ("Licensed", "password", "token"))


@query("SELECT page_id, sha256(html) AS sha256, strlen(html) AS size FROM pages")
def sha256_manifest(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"))


_CRC_STEPS = "list_reduce(list_prepend(c.v, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 2197175160) ELSE a >> 1 END)"


@query(
    f"""WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, {_CRC_STEPS} AS v FROM (SELECT i, CAST(i AS BIGINT) AS v FROM range(256) r(i)) c)),
b AS (SELECT item_id, list_transform(range(octet_length(encode(text))), lambda i: CAST(instr('0123456789ABCDEF', substr(hex(encode(text)), 2 * i + 1, 1)) * 16 - 16 + instr('0123456789ABCDEF', substr(hex(encode(text)), 2 * i + 2, 1)) - 1 AS BIGINT)) AS b FROM benchmark)
SELECT item_id, printf('%08X', xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295)) AS crc32c FROM b, t"""
)
def crc32c_records(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", crc32c("text").alias("crc32c"))


@query(
    """WITH e AS (SELECT user_id % 64 AS log, event_id AS sequence, props AS payload FROM events),
d AS (SELECT log, min(sequence) FILTER (sequence % 211 = 7) AS damaged FROM e GROUP BY log)
SELECT CAST(log AS VARCHAR) AS log, sequence, payload FROM e JOIN d USING (log) WHERE damaged IS NULL OR sequence < damaged"""
)
def framed_log_recovery(spark, sf):
    """Events written as framed logs, some frames damaged, and what recovery keeps: all before the first damage of each log."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 64).cast("string").alias("log"), F.col("event_id").alias("sequence"), "props")
    whole = rows.withColumn("frame", framed.frame("sequence", "props"))
    torn = F.concat(F.expr("substring(frame, 1, octet_length(frame) - 1)"), F.lit(b"\x00"))
    path = work_folder(spark, "framed")
    framed.write_log(whole.withColumn("frame", F.when(F.col("sequence") % 211 == 7, torn).otherwise(F.col("frame"))), path)
    kept = framed.recovered(framed.read_log(spark, path, splitbytes=1 << 20))
    return kept.select(F.regexp_extract("path", r"(\d+)\.[^/]*$", 1).alias("log"), "sequence", F.col("payload").cast("string").alias("payload"))


@query("SELECT url AS path, sha256(html) AS sha256, strlen(html) AS size_bytes FROM pages")
def release_manifest(spark, sf):
    """Entries of a manifest that was written, committed and read back against its digests."""
    files = table(spark, sf, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size_bytes"))
    path = f"{work_folder(spark, 'release')}/manifest.json"
    release.write_manifest(files, path, {"schema": 2, "release_class": "ENGINEERING_REVIEW_ONLY"})
    return release.read_section(spark, path, "files", "path string, sha256 string, size_bytes long")


@query(
    """WITH r AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'GAP' WHEN 1 THEN 'UNKNOWN' ELSE 'EVENT' END AS record_type, CASE event_id % 7 WHEN 0 THEN 'MODEL_INFERRED' WHEN 1 THEN 'INTERVENTION' ELSE 'RAW_MEASURED' END AS provenance, CASE WHEN event_id % 13 = 0 THEN '1234567' ELSE '0A1B2C3D' END AS crc, event_id % 17 - 1 AS start, event_id % 5 = 0 AS twice, event_id % 22 = 0 AS cause FROM events)
SELECT event_id, 'enum:record_type' AS rule FROM r WHERE record_type = 'UNKNOWN' UNION ALL SELECT event_id, 'pattern:crc32c' FROM r WHERE crc = '1234567' UNION ALL SELECT event_id, 'range:device_time_start_us' FROM r WHERE start < 0
UNION ALL SELECT event_id, 'unique:status_flags' FROM r WHERE twice UNION ALL SELECT event_id, 'lineage' FROM r WHERE provenance = 'MODEL_INFERRED' UNION ALL SELECT event_id, 'evidence' FROM r WHERE provenance = 'INTERVENTION' UNION ALL SELECT event_id, 'gap' FROM r WHERE record_type = 'GAP' AND NOT cause"""
)
def record_contract_violations(spark, sf):
    i = F.col("event_id")
    none = {f.name: F.lit(None).cast(f.dataType) for f in readers.SESSION_RECORD}
    made = none | {
        "schema_version": F.lit("2.0.0"), "record_type": F.when(i % 11 == 0, "GAP").when(i % 11 == 1, "UNKNOWN").otherwise("EVENT"), "provenance": F.when(i % 7 == 0, "MODEL_INFERRED").when(i % 7 == 1, "INTERVENTION").otherwise("RAW_MEASURED"),
        "device_time_start_us": i % 17 - 1, "device_time_end_us": i, "status_flags": F.when(i % 5 == 0, F.array(F.lit("OK"), F.lit("OK"))).otherwise(F.array(F.lit("OK"))), "crc32c": F.when(i % 13 == 0, "1234567").otherwise("0A1B2C3D"),
        "dropped_first_sequence": F.lit(1).cast("long"), "dropped_last_sequence": F.lit(2).cast("long"), "cause": F.when(i % 22 == 0, "OVERFLOW"),
    }
    records = table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in made.items()])
    return contracts.violations(records, "event_id", contracts.session_record())


@query("WITH s AS (SELECT l_orderkey AS stream_id, l_linenumber AS sequence, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) SELECT stream_id, before + 1 AS first_missing, sequence - 1 AS last_missing FROM s WHERE sequence - before > 1")
def sequence_gaps(spark, sf):
    return windows.gaps(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").alias("sequence")), "stream_id", "sequence")


@query("SELECT p.event_id, arg_max(v.event_id, v.ts) AS view_id, round(arg_max(v.value, v.ts), 6) AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts GROUP BY p.event_id")
def asof_order_event(spark, sf):
    events = table(spark, sf, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    purchases = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return _rounded(intervals.as_of(purchases, views, ["user_id"], "ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value"))


@query("SELECT e.event_id, r.n_nationkey AS range_id FROM events e JOIN nation r ON e.event_type = ['view', 'click', 'purchase', 'error', 'signup'][r.n_nationkey % 5 + 1] AND e.event_id BETWEEN r.n_nationkey * 150 AND r.n_nationkey * 150 + 900")
def range_lineage(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "purchase", "error", "signup")]), F.col("n_nationkey") % 5 + 1)
    ranges = table(spark, sf, "nation").select(kind.alias("event_type"), F.col("n_nationkey").alias("range_id"), (F.col("n_nationkey") * 150).alias("first"), (F.col("n_nationkey") * 150 + 900).alias("last"))
    return intervals.covered_by(table(spark, sf, "events"), ranges, "event_type", "event_id", "first", "last", 512).select("event_id", "range_id")


_SPEC = f"""{_CH}, {_Z}, n AS (SELECT count(*) AS n FROM z), f AS (SELECT bin, sqrt(pow(sum(em_rf * cos(2 * pi() * ((bin * frame) % n) / n)), 2) + pow(sum(em_rf * sin(2 * pi() * ((bin * frame) % n) / n)), 2)) / max(n) AS magnitude FROM z CROSS JOIN n JOIN range(100000) b(bin) ON bin < n // 2 GROUP BY bin),
l AS (SELECT bin, magnitude, lag(magnitude) OVER (ORDER BY bin) AS b, lead(magnitude) OVER (ORDER BY bin) AS a, max(magnitude) OVER () AS m FROM f), pk AS (SELECT bin, magnitude FROM l WHERE magnitude > b AND magnitude > a AND magnitude > 0.05 * m)"""


def _peaks(spark: SparkSession, sf: str) -> DataFrame:
    z = canonical.zscored(hourly(spark, sf))
    return spectrum.peaks(spectrum.dft(z, "session_id", "frame", "em_rf"), "session_id")


@query(f"WITH {_SPEC} SELECT CAST(bin AS INTEGER) AS bin, round(magnitude, 6) AS magnitude FROM pk")
def spectral_peaks(spark, sf):
    return _rounded(_peaks(spark, sf).drop("session_id"))


@query(f"WITH {_SPEC}, t AS (SELECT 'harmonic' AS kind, k AS ord, 15.0 * k AS target FROM range(2, 5) q(k) UNION ALL SELECT 'subharmonic', k, 15.0 / k FROM range(2, 4) q(k)) SELECT DISTINCT CAST(bin AS INTEGER) AS bin, kind, CAST(ord AS INTEGER) AS ord FROM pk JOIN t ON abs(bin - target) < 2")
def spectral_harmonics(spark, sf):
    base = spark.range(1).select(F.lit("hourly").alias("session_id"), F.lit(15.0).alias("fundamental"))
    return spectrum.harmonics(_peaks(spark, sf), base, "session_id", "bin").select("bin", "kind", F.col("order").alias("ord"))


@query(f"WITH {_SPEC}, ln AS (SELECT k AS i, 12.0 + 9.5 * k AS f FROM range(5) q(k)), pr AS (SELECT unnest([abs(a.f - b.f), a.f + b.f, abs(2 * a.f - b.f)]) AS product FROM ln a JOIN ln b ON a.i < b.i) SELECT DISTINCT CAST(product AS DOUBLE) AS product FROM pr WHERE EXISTS (SELECT 1 FROM pk WHERE abs(product - bin) < 2)")
def spectral_intermodulation(spark, sf):
    lines = spark.range(5).select(F.lit("hourly").alias("session_id"), F.col("id").alias("i"), (12.0 + 9.5 * F.col("id")).alias("f"))
    return spectrum.intermodulation(lines, _peaks(spark, sf), "session_id", "bin").select("product")


@query("SELECT user_id, round(sqrt(pow(avg(cos(value)), 2) + pow(avg(sin(value)), 2)), 6) AS coherence, sqrt(pow(avg(cos(value)), 2) + pow(avg(sin(value)), 2)) > 0.7 AS locked FROM events GROUP BY user_id")
def phase_order(spark, sf):
    return _rounded(spectrum.order_parameter(table(spark, sf, "events"), "user_id", "value"))


@query("SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS value, event_type AS session_id, count(*) AS n FROM events GROUP BY ALL")
def json_numeric_payload(spark, sf):
    payload = F.from_json("props", "map<string,string>")
    records = table(spark, sf, "events").select(F.col("event_type").alias("session_id"), F.lit(None).cast("long").alias("device_time_start_us"), payload.alias("payload"))
    return readers.samples_of(records).where("stream = 'k'").groupBy("value", "session_id").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS command, bool_or(l_returnflag = 'R') AS electrical, bool_or(l_returnflag = 'N') AS physical FROM lineitem GROUP BY 1) SELECT CASE WHEN NOT coalesce(command, false) THEN 'command' WHEN NOT electrical THEN 'electrical' WHEN NOT physical THEN 'physical' END AS missing_link, count(*) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1")
def evidence_chain(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("decision_id"), "l_returnflag")
    links = [(n, lines.where(F.col("l_returnflag") == f)) for n, f in (("command", "A"), ("electrical", "R"), ("physical", "N"))]
    decisions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("decision_id"))
    return intervals.evidence_chain(decisions, links).groupBy("missing_link").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN n_name IS NULL THEN 'UNREGISTERED' WHEN c_custkey % 10 = 0 THEN 'PROTOCOL_CHANGED' ELSE 'OK' END AS protocol_status, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey GROUP BY 1")
def protocol_check(spark, sf):
    digest = lambda c: F.sha2(c.cast("string"), 256).alias("protocol_sha256")
    manifests = table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("experiment_id"), digest(F.col("n_nationkey")))
    results = table(spark, sf, "customer").select(F.col("c_nationkey").alias("experiment_id"), digest(F.when(F.col("c_custkey") % 10 == 0, F.lit(-1)).otherwise(F.col("c_nationkey"))))
    return intervals.protocol_check(manifests, results).groupBy("protocol_status").agg(F.count("*").alias("n"))


@query("SELECT p_type, CASE WHEN p_type IN ('STANDARD') THEN CASE WHEN p_size * 40 <= 1000 THEN 'OK' ELSE 'DEGRADED' END WHEN p_type IN ('LARGE', 'SMALL') THEN CASE WHEN p_size * 40 <= 100 THEN 'OK' ELSE 'DEGRADED' END ELSE 'UNBOUNDED' END AS status, count(*) AS n FROM part GROUP BY ALL")
def timing_bounds(spark, sf):
    stream = F.when(F.col("p_type") == "STANDARD", "PPG_RED").when(F.col("p_type") == "LARGE", "EDA").when(F.col("p_type") == "SMALL", "IMU_ACCEL").otherwise("OTHER")
    return table(spark, sf, "part").groupBy("p_type", contracts.timing_status(stream, F.col("p_size") * 40).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'ring|gear')")
def forbidden_nets(spark, sf):
    return gates.forbidden(table(spark, sf, "part"), "p_name", ("ring", "gear")).select("p_partkey")


@query("WITH m AS (SELECT * FROM (VALUES ('harmonic', 1, 1.0), ('harmonic', 2, 2.0), ('harmonic', 3, 3.0), ('harmonic', 4, 4.0), ('harmonic', 5, 5.0), ('equal', 1, 1.0), ('equal', 2, 1.5), ('equal', 3, 2.0), ('equal', 4, 2.5), ('equal', 5, 3.0), ('sham', 1, 0.0), ('sham', 2, 0.0), ('sham', 3, 0.0), ('sham', 4, 0.0), ('sham', 5, 0.0)) t(mode, i, k)) SELECT n_nationkey, ['R_outer', 'R_middle', 'R_inner', 'R_core_up', 'R_core_down'][i] AS resonator, CAST(round((n_nationkey + 1) * 7.25 * k, 3) AS DOUBLE) AS freq_hz FROM nation JOIN m ON m.mode = ['harmonic', 'equal', 'sham'][n_nationkey % 3 + 1]")
def frequency_ladder(spark, sf):
    mode = F.element_at(F.array(*[F.lit(m) for m in ("harmonic", "equal", "sham")]), F.col("n_nationkey") % 3 + 1)
    base = table(spark, sf, "nation").select("n_nationkey", ((F.col("n_nationkey") + 1) * 7.25).alias("base_freq_hz"), mode.alias("mode"))
    return factorial.frequency_ladder(base).select("n_nationkey", "resonator", "freq_hz")


@query("SELECT p_partkey, round(CASE p_type WHEN 'LARGE' THEN p_retailprice * 2 / 3 WHEN 'PROMO' THEN 0 ELSE p_retailprice / ((1 + sqrt(5)) / 2) END, 3) AS middle_mm, round(CASE WHEN p_size > 10 THEN p_retailprice / p_size ELSE 0 END, 6) AS bandwidth_hz FROM part")
def geometry_diameters(spark, sf):
    kind = F.when(F.col("p_type") == "LARGE", "EQUAL_SPHERES").when(F.col("p_type") == "PROMO", "SHAM_OFF").otherwise("GOLDEN_RATIO_SPHERES")
    d = factorial.diameters(kind, F.col("p_retailprice"), F.col("p_partkey"))
    q = F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0)
    return table(spark, sf, "part").select("p_partkey", d[1].alias("middle_mm"), _r(factorial.bandwidth(F.col("p_retailprice"), q)).alias("bandwidth_hz"))


@query("WITH p AS (SELECT p_brand, sum(p_size / 100.0) AS i, sum(p_size / 100.0 * (0.05 + 0.1 * (p_partkey % 12))) AS o FROM part GROUP BY 1) SELECT p_brand, round(i, 6) AS power_in_w, round(least(o, 0.99 * i), 6) AS power_out_w, round(greatest(0, i - least(o, 0.99 * i)), 6) AS dissipated_w, round(0.4 * greatest(0, i - least(o, 0.99 * i)), 6) AS temperature_rise_c FROM p")
def power_budget(spark, sf):
    p = F.col("p_size") / 100.0
    channels = table(spark, sf, "part").select("p_brand", p.alias("power_in_w"), (p * (0.05 + 0.1 * (F.col("p_partkey") % 12))).alias("power_out_w"))
    return _rounded(factorial.power_budget(channels, "p_brand"))


@query(f"WITH ok AS (SELECT *, bool_and(value < 250) OVER ({_USER} ROWS UNBOUNDED PRECEDING) AS ok FROM events) SELECT user_id, count(*) AS n FROM ok WHERE ok GROUP BY 1")
def valid_prefix(spark, sf):
    return windows.valid_prefix(table(spark, sf, "events"), "user_id", "event_id", F.col("value") < 250).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH b AS (SELECT *, max(value) OVER ({_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT event_id FROM b WHERE value < before")
def backward_time(spark, sf):
    return windows.backward_time(table(spark, sf, "events"), "user_id", "event_id", "value").select("event_id")


@query(f"WITH {_CH}, w AS (SELECT n_nationkey, least(greatest(n_nationkey * 60 - 300, 0), (SELECT max(frame) FROM ch)) AS frame FROM nation) SELECT n_nationkey, w.frame, round(em_rf, 6) AS em_rf FROM w JOIN ch USING (frame)")
def clamped_lookup(spark, sf):
    wanted = table(spark, sf, "nation").select("n_nationkey", F.lit("hourly").alias("session_id"), (F.col("n_nationkey") * 60 - 300).cast("long").alias("frame"))
    return _rounded(canonical.at_frames(hourly(spark, sf), wanted).select("n_nationkey", "frame", "em_rf"))


@query(f"WITH {_CH} SELECT frame, 0.0::DOUBLE AS em_rf, 0.0::DOUBLE AS optical_ir, 0.0::DOUBLE AS consciousness_proxy, round(control_baseline, 6) AS control_baseline FROM ch")
def control_only_view(spark, sf):
    return _rounded(canonical.control_only(hourly(spark, sf)).drop("session_id"))


@query(f"WITH {_CONF}, t AS (SELECT sha256('secret|' || p_partkey) AS trial_token, geometry FROM conf) SELECT trial_token, geometry FROM t")
def blinded_trials(spark, sf):
    blinded, sealed = factorial.blind(configurations(spark, sf).withColumnRenamed("p_partkey", "trial_id"), "secret")
    return factorial.unblind(blinded, sealed).select("trial_token", "geometry")


@query(f"SELECT event_id, lead(value) OVER ({_USER}) AS next_score FROM events")
def score_changes(spark, sf):
    return factorial.score_changes(table(spark, sf, "events"), "user_id", "event_id", "value").select("event_id", "next_score")


@query("SELECT doc_id, array_to_string(list_sort(list_filter(['alpha', 'of', 'the', 'zeta'], lambda x: NOT list_contains(string_split(text, ' '), x))), ',') AS missing FROM documents")
def required_members(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(gates.missing_members(F.split("text", " "), ("alpha", "of", "the", "zeta"))), ",").alias("missing"))


@query("SELECT count(*) AS checks, CAST(sum(CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed, bool_and(n_regionkey <> 0) AS all_passed FROM nation")
def gate_summary(spark, sf):
    return gates.gate_summary(table(spark, sf, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") != 0).alias("passed")))


@query("""SELECT p_partkey, sha256('{"board": "' || p_brand || '", "net": "' || p_name || '", "type": "unconnected_items"}') AS fingerprint FROM part""")
def net_fingerprints(spark, sf):
    part = table(spark, sf, "part").withColumn("description", F.concat(F.lit("pad ["), "p_name", F.lit("] of U1")))
    return part.select("p_partkey", gates.fingerprint({"board": F.col("p_brand"), "type": F.lit("unconnected_items"), "net": gates.net_of(F.col("description"))}).alias("fingerprint"))


@query()
def model_result_records(spark, sf):
    z = canonical.zscored(hourly(spark, sf)).withColumn("is_event", F.col("em_rf") > 2)
    found = discover.discoveries(pairs(spark, sf), 0.32).withColumn("operator_type", F.lit("perceiver"))
    summary = discover.run_summary(found, z)
    return sinks.model_result(summary, "2.0.0", "tidemark", F.lit("run.json"), F.lit(0).cast("long"), F.col("frames") * 3_600_000_000, ("PPG", "EDA"))


@query(f"WITH {_D}, o AS (SELECT frame, arg_max(edge, edge) AS last_edge FROM d GROUP BY frame) SELECT ch.frame, last_edge FROM ch LEFT JOIN o USING (frame)")
def last_edge_by_frame(spark, sf):
    return discover.last_edges(hourly(spark, sf), discover.discoveries(pairs(spark, sf), 0.32), F.col("edge")).drop("session_id")


@query("SELECT user_id, round(stddev_pop(CASE WHEN event_type = 'purchase' THEN value END), 6) AS deviation, round(avg(abs(CASE WHEN event_type = 'view' THEN value END)) / greatest(avg(abs(CASE WHEN event_type = 'error' THEN value END)), 1e-12), 4) AS ratio FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0")
def field_measures(spark, sf):
    cells = table(spark, sf, "events").select("user_id", *[F.when(F.col("event_type") == e, F.col("value")).alias(c) for c, e in EVENT_OF.items()])
    measured = cells.groupBy("user_id").agg(F.count("control_baseline").alias("n")).where("n > 0").select("user_id")
    out = discover.field_measures(cells.join(measured, "user_id"), ["user_id"], "consciousness_proxy", ("em_rf",), "control_baseline")
    return out.select("user_id", _r("reg_variance_deviation").alias("deviation"), _r("em_rf_short_long", 4).alias("ratio"))


@query("WITH s AS (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, round(arg_max(value, event_id), 6) AS last, round(arg_max(d, event_id), 6) AS difference FROM s GROUP BY user_id")
def last_difference(spark, sf):
    return _rounded(windows.last_difference(table(spark, sf, "events"), "user_id", "event_id", "value"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def next_scheduled(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    begun = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(orders, "o_orderkey")
    return windows.next_scheduled(orders, begun, "o_custkey", "o_orderkey")


@query("SELECT p_partkey, CAST(p_size + p_retailprice AS DOUBLE) AS row_0, CAST(2.0 * p_size + 1 AS DOUBLE) AS row_1, CAST(3.0 * p_size AS DOUBLE) AS column_0, CAST(p_retailprice + 1 AS DOUBLE) AS column_1, CAST((p_size % 50) / 1024.0 AS DOUBLE) AS density FROM part")
def coupling_sums(spark, sf):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    rows, columns = factorial.coupling_sums(F.array(F.array(size, price), F.array(2.0 * size, F.lit(1.0))))
    density = discover.operator_density(F.col("p_size") % 50, F.lit(32))
    return table(spark, sf, "part").select("p_partkey", rows[0].alias("row_0"), rows[1].alias("row_1"), columns[0].alias("column_0"), columns[1].alias("column_1"), density.alias("density"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 1000 - (max(l_linenumber) OVER (PARTITION BY l_orderkey) - l_linenumber) * 250 AS device_time_us FROM lineitem")
def sample_times(spark, sf):
    last = windows.Window.partitionBy("l_orderkey")
    batches = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 1000).alias("anchor"), F.max("l_linenumber").over(last).alias("last"), F.lit(250).alias("period"))
    return batches.select("l_orderkey", "l_linenumber", windows.sample_times(batches, "anchor", "last", "l_linenumber", "period").alias("device_time_us"))


@query(
    f"""WITH {_D}, t AS (SELECT count(*) AS total FROM d), h AS (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY frame) AS history, count(*) AS frames FROM (SELECT ch.frame, count(d.edge) AS n FROM ch LEFT JOIN d USING (frame) GROUP BY 1)),
{_Z}, e AS (SELECT count(*) AS n, coalesce(string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame), '') AS list FROM z WHERE em_rf > 2)
SELECT 'hourly' AS session_id, 'out/run.html' AS output_path, 'balanced' AS preset, 'balanced' AS experiment, frames, CAST(300 AS INTEGER) AS agents, CAST(128 AS INTEGER) AS field_res, CAST(42 AS INTEGER) AS seed, 'CPU' AS backend, total AS total_discoveries,
total AS perceiver, e.list AS coherence_frames, CAST(e.n AS INTEGER) AS coherence_frame_count, history AS discovery_rate_history, 0.32::DOUBLE AS calibration_threshold, '1970-01-01T00:00:00+00:00' AS generated_at FROM t, h, e""".replace(f"{_D}, t AS", f"{_D}, t AS")
)
def run_metrics_record(spark, sf):
    run = resolved("balanced")
    z = canonical.zscored(hourly(spark, sf)).withColumn("is_event", F.col("em_rf") > 2)
    found = discover.discoveries(pairs(spark, sf), run.threshold).withColumn("operator_type", F.lit("perceiver"))
    given = {"output_path": "out/run.html", "preset": "balanced", "experiment": "balanced", "agents": run.agents, "field_res": run.grid, "seed": run.seed, "backend": "CPU", "calibration_threshold": run.threshold, "generated_at": "1970-01-01T00:00:00+00:00"}
    out = discover.run_metrics(found, z, given)
    text = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("coherence_frames", "discovery_rate_history")}
    return out.withColumns(text).withColumn("perceiver", F.col("discoveries_by_operator_type")["perceiver"]).drop("discoveries_by_operator_type")


@query(f"WITH {_CH} SELECT session_id, frame, round(em_rf, 6) AS em_rf, round(control_baseline, 6) AS control_baseline FROM (SELECT 'hourly' AS session_id, * FROM ch)")
def telemetry_roundtrip(spark, sf):
    """The recording written as CSV, read as text and made canonical again."""
    path = work_folder(spark, "telemetry")
    frames = hourly(spark, sf).withColumn("timestamp", F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("frame") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    frames.write.option("header", True).csv(path)
    back = canonical.canonicalise(readers.telemetry_csv(spark, path).drop("frame"), "timestamp")
    return _rounded(back.select("session_id", "frame", "em_rf", "control_baseline"))


_PHI = "((1 + sqrt(5)) / 2)"


@query(
    f"""WITH d AS (SELECT p_partkey AS k, p_type = 'STANDARD' AS golden, p_retailprice AS outer_mm, p_retailprice / {_PHI} + CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0.01 END AS middle, p_retailprice / ({_PHI} * {_PHI}) AS inner_mm, p_size AS w_in, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1.0 ELSE -0.5 END AS w_out,
p_partkey % 5 = 0 AS simulated, p_partkey % 10 = 0 AS raw, p_partkey % 20 = 5 AS measured FROM part)
SELECT k AS p_partkey, 'energy' AS rule FROM d WHERE w_out > w_in UNION ALL SELECT k, 'golden_ratio' FROM d WHERE golden AND (abs(middle - outer_mm / {_PHI}) > 0.1 OR abs(inner_mm - outer_mm / ({_PHI} * {_PHI})) > 0.1)
UNION ALL SELECT k, 'simulated_not_measured' FROM d WHERE simulated AND (raw OR measured)"""
)
def physics_gate_violations(spark, sf):
    phi, k, outer = (1 + 5**0.5) / 2, F.col("p_partkey"), F.col("p_retailprice").cast("double")
    size = F.col("p_size").cast("double")
    geometry = F.struct(F.when(F.col("p_type") == "STANDARD", "GOLDEN_RATIO_SPHERES").otherwise("EQUAL_SPHERES").alias("geometry_type"), outer.alias("outer_diameter_mm"), (outer / phi + F.when(k % 3 == 0, 0.5).otherwise(0.01)).alias("middle_diameter_mm"), (outer / phi**2).alias("inner_diameter_mm"))
    power = F.struct(size.alias("input_power_w"), (size + F.when(k % 7 == 0, 1.0).otherwise(-0.5)).alias("measured_output_power_w"))
    documents = table(spark, sf, "part").select("p_partkey", geometry.alias("geometry"), power.alias("power_and_energy"), (k % 5 == 0).alias("simulated"), F.when(k % 10 == 0, "RAW_MEASURED").otherwise("SIMULATED").alias("provenance"), F.when(k % 20 == 5, "MEASURED").otherwise("MODEL_INFERRED").alias("interpretation_level"))
    return contracts.violations(documents, "p_partkey", contracts.physics_gate())


@query(
    """WITH d AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS o_orderkey, 'enum:preset' AS rule FROM d WHERE k % 9 = 0 UNION ALL SELECT k, 'range:field_parameters.field_res' FROM d WHERE k % 11 = 0 UNION ALL SELECT k, 'range:operator_parameters.discovery_threshold' FROM d WHERE k % 13 = 0
UNION ALL SELECT k, 'unique:status_flags' FROM d WHERE k % 17 = 0 UNION ALL SELECT k, 'length:run_id' FROM d WHERE k % 19 = 0 UNION ALL SELECT k, 'discoveries' FROM d WHERE k % 23 = 0 UNION ALL SELECT k, 'required:experiment_id' FROM d WHERE k % 29 = 0"""
)
def discovery_document_violations(spark, sf):
    k = F.col("o_orderkey")
    made = {
        "schema_version": F.lit("2.0.0"), "experiment_id": F.when(k % 29 != 0, "EXP-1"), "run_id": F.when(k % 19 == 0, "r").otherwise("run-1"), "preset": F.when(k % 9 == 0, "loud").otherwise("baseline"), "provenance": F.lit("DERIVED"), "interpretation_level": F.lit("DERIVED"),
        "field_parameters": F.struct(F.when(k % 11 == 0, 4).otherwise(64).alias("field_res"), F.lit(4).alias("channels")),
        "operator_parameters": F.struct(F.lit(3).alias("agent_count"), F.lit(300).alias("memory_depth"), F.lit(50).alias("corr_window"), F.when(k % 13 == 0, 1.5).otherwise(0.32).alias("discovery_threshold"), F.lit(0.995).alias("confidence_decay")),
        "moderator_parameters": F.struct(F.lit(True).alias("geomagnetic")), "metrics_summary": F.struct(F.lit(5).alias("total_discoveries"), F.lit(0).alias("coherence_frame_count")),
        "status_flags": F.when(k % 17 == 0, F.array(F.lit("OK"), F.lit("OK"))).otherwise(F.array(F.lit("OK"))),
        "discoveries": F.array(F.struct(F.when(k % 23 == 0, 1.5).otherwise(0.5).alias("confidence"), F.lit(1).alias("frame"), F.array(F.lit("a"), F.lit("b")).alias("edge"))),
    }
    documents = table(spark, sf, "orders").select("o_orderkey", *[v.alias(n) for n, v in made.items()])
    return contracts.violations(documents, "o_orderkey", contracts.discovery_document())


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 OR (o_orderkey % 100) / 1000.0 >= 0.05 THEN 'INCONCLUSIVE' WHEN o_custkey % 2 = 1 THEN 'SUPPORTS' ELSE 'REFUTES' END AS conclusion FROM orders")
def trial_conclusions(spark, sf):
    k = F.col("o_orderkey")
    trials_ = table(spark, sf, "orders").select(k, ((k % 100) / 1000.0).alias("p"), (F.col("o_custkey") % 2 * 2 - 1).cast("double").alias("effect"), (k % 3 != 0).alias("valid"), F.lit(1.0).alias("registered"), F.when(k % 7 == 0, "PROTOCOL_CHANGED").otherwise("OK").alias("protocol_status"))
    return trials_.select("o_orderkey", intervals.conclusion("p", "effect", "valid", "registered").alias("conclusion"))


@query("SELECT 'u' || user_id AS session_id, event_id * 10 AS device_time_us, stream, round(value, 6) AS value FROM (SELECT user_id, event_id, 'PPG_Red' AS stream, value FROM events WHERE value IS NOT NULL UNION ALL SELECT user_id, event_id, 'flag', CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END FROM events)")
def session_record_samples(spark, sf):
    """Session records written as JSON lines, read against their schema and flattened: texts that are no numbers are left out."""
    i = F.col("event_id")
    payload = F.create_map(F.lit("PPG_Red"), F.col("value").cast("string"), F.lit("flag"), (i % 2 == 0).cast("string"), F.lit("note"), F.lit("n/a"))
    records = table(spark, sf, "events").select(F.lit("SAMPLE_CHUNK").alias("record_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), (i * 10).alias("device_time_start_us"), payload.alias("payload"))
    path = work_folder(spark, "records")
    sinks.json_records(records, path)
    return _rounded(readers.samples_of(readers.session_records(spark, path)))


@query(f"WITH {_R}, f AS (SELECT ch.frame, r.channel_a, r.channel_b, r.pearson_r FROM ch LEFT JOIN r ON r.frame = ch.frame AND abs(r.pearson_r) > 0.32) SELECT frame, channel_a, channel_b, round(pearson_r, 6) AS pearson_r, round(coalesce(abs(pearson_r), 0.0), 6) AS confidence FROM f")
def longitudinal_roundtrip(spark, sf):
    """Discovery history through its compressed CSV and back."""
    found = discover.discoveries(pairs(spark, sf), 0.32).withColumn("operator_type", F.lit("perceiver"))
    path = work_folder(spark, "longitudinal")
    sinks.longitudinal_csv(discover.longitudinal(hourly(spark, sf).select("session_id", "frame"), found).withColumn("moderators", F.create_map(F.lit("m"), F.lit(1.0))), path)
    back = readers.telemetry_csv(spark, path).where("moderators = '{\"m\":1.0}'")
    return _rounded(back.select(F.col("frame").cast("long"), F.nullif("channel_a", F.lit("")).alias("channel_a"), F.nullif("channel_b", F.lit("")).alias("channel_b"), F.col("pearson_r").cast("double"), F.col("confidence").cast("double")))


@query(f"WITH {_CONF}, k AS (SELECT CASE WHEN geometry = 'GOLDEN_RATIO_SPHERES' THEN 1 ELSE -1 END AS g, CASE WHEN core = 'DUAL_TETRAHEDRON_MERKABA' THEN 1 ELSE -1 END AS c, response FROM conf WHERE geometry IN ('GOLDEN_RATIO_SPHERES', 'EQUAL_SPHERES') AND core IN ('DUAL_TETRAHEDRON_MERKABA', 'SPHERICAL_CORE')) SELECT g, c, count(*) AS n, round(avg(response), 6) AS mean FROM k GROUP BY ALL")
def confirmatory_cells(spark, sf):
    cells = factorial.confirmatory(configurations(spark, sf))
    return _rounded(cells.groupBy("g", "c").agg(F.count("*").alias("n"), F.avg("response").alias("mean")))


@query(f"WITH {_SPEC}, ln AS (SELECT k, 12.0 + 9.5 * k AS f FROM range(30) q(k)) SELECT DISTINCT CAST(k AS VARCHAR) AS line FROM ln JOIN pk ON abs(bin - f) > 0.5 AND abs(bin - f) < 8")
def spectral_mode_splits(spark, sf):
    """Drive lines with a peak close by, but not on them."""
    found = _peaks(spark, sf).select("bin").crossJoin(F.broadcast(spark.range(30).select(F.col("id").cast("string").alias("line"))))  # 30 lines
    lines = spark.range(30).select(F.col("id").cast("string").alias("line"), (12.0 + 9.5 * F.col("id")).alias("f"))
    return spectrum.mode_splits(lines, found, "line", "bin")


@query("SELECT event_id, round(CASE WHEN event_id % 4 = 0 OR value IS NULL THEN 0.32 ELSE coalesce(nullif(value, 0.0), 0.32) END, 6) AS threshold FROM events")
def effective_threshold(spark, sf):
    calibrated = F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", _r(discover.effective_threshold(calibrated, F.lit(0.32))).alias("threshold"))


@query("SELECT CASE WHEN d.doc_id IS NULL THEN 'STALE' WHEN d.doc_id % 5 = 0 THEN 'ERROR' WHEN l.doc_id IS NULL THEN 'UNALLOWLISTED' ELSE 'ALLOWED' END AS verdict, count(*) AS n FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1")
def allowlist_errors(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "error").otherwise("warning").alias("severity"))
    return gates.allowlisted(found, table(spark, sf, "labels"), "doc_id", errors_pass=False).groupBy("verdict").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1) SELECT 'DUPLICATE_REF' AS kind, p_name AS subject FROM r UNION ALL SELECT 'UNKNOWN_SHEET', p_name FROM part WHERE p_type = 'PROMO' UNION ALL SELECT 'HUMAN_GROUND_ON_LAB', s_name FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0")
def manifest_faults(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_name").alias("ref"), F.col("p_brand").alias("board"), F.col("p_type").alias("sheet"))
    sheets = parts.where("sheet <> 'PROMO'").select("board", "sheet").distinct()
    ground = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("BAT_GND"), F.lit("SYNC"))).otherwise(F.array(F.lit("LAB_GND")))
    connectors = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "LAB_ISO").otherwise("HUMAN").alias("domain"), ground.alias("pins"))
    return gates.manifest_violations(parts, sheets, connectors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("""SELECT coalesce(v.board, u.board) AS board, coalesce(v.violations, 0) AS violations, coalesce(u.unconnected, 0) AS unconnected, coalesce(u.nets, 0) AS nets FROM (SELECT nullif(p_brand, 'Brand#11') AS board, count(*) AS violations FROM part WHERE p_size < 45 GROUP BY 1) v
FULL JOIN (SELECT nullif(p_brand, 'Brand#11') AS board, count(*) AS unconnected, count(DISTINCT p_type) AS nets FROM part WHERE p_size > 40 GROUP BY 1) u ON v.board IS NOT DISTINCT FROM u.board""")
def report_counts(spark, sf):
    part = table(spark, sf, "part").select(F.nullif(F.col("p_brand"), F.lit("Brand#11")).alias("board"), "p_size", F.concat(F.lit("pad ["), "p_type", F.lit("] of U1")).alias("description"))
    return gates.report_counts(part.where("p_size < 45"), part.where("p_size > 40"))


@query(
    f"""WITH c(condition, geometry, core, freq_hz, amp_v, modulation) AS (VALUES {", ".join(f"({k}, '{g}', '{c}', {73.2 if on else 0.0}::DOUBLE, {3.3 if on else 0.0}::DOUBLE, '{m}')" for k, (g, c, on, m) in enumerate(factorial.BLOCK))})
SELECT o_orderkey, condition, geometry, core, freq_hz, amp_v, modulation, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY {_lcg2("o_orderkey * 7919 + condition * 104729 + 1")}, condition) - 1 AS INTEGER) AS block_index FROM orders CROSS JOIN c"""
)
def matched_blocks(spark, sf):
    draw = lambda block, condition: lcg(lcg(block * 7919 + condition * 104729 + 1))
    return factorial.matched_blocks(table(spark, sf, "orders"), "o_orderkey", draw)


@query(
    """SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, make_timestamp(event_id * 1000) AS ts,
0.0::DOUBLE AS em_rf, coalesce(value, 0.0) AS optical_ir, coalesce(CASE WHEN event_type = 'click' THEN value END, 0.0) AS consciousness_proxy, 0.0::DOUBLE AS control_baseline FROM events"""
)
def bridged_streams(spark, sf):
    samples = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") * 1000).alias("device_time_us"), F.col("value").alias("PPG_Red"), F.when(F.col("event_type") == "click", F.col("value")).alias("EDA_CONDUCTANCE")
    )
    return canonical.bridge(samples).select("session_id", "frame", "ts", *CHANNELS)

