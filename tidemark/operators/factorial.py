"""Two-by-two factorial models, session variance components, condition roles and follow-up choice."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import t_critical
from tidemark.operators import gaussian

#: Category orders of the experiment (fixed values).
GEOMETRIES = ("GOLDEN_RATIO_SPHERES", "EQUAL_SPHERES", "RANDOM_SPHERES", "SHAM_OFF")
CORES = ("DUAL_TETRAHEDRON_MERKABA", "SPHERICAL_CORE", "CUBIC_CORE", "NO_CORE", "SHAM_OFF")
MODULATIONS = ("NONE_CW", "SINE_AM", "PULSED", "BURST", "SHAM_OFF")


def condition_role(geometry: Column, core: Column, amplitude: Column) -> Column:
    target = (geometry == GEOMETRIES[0]) & (core == CORES[0])
    control = geometry.isin("EQUAL_SPHERES", "RANDOM_SPHERES") | core.isin("SPHERICAL_CORE", "CUBIC_CORE", "NO_CORE")
    return F.when((geometry == "SHAM_OFF") | (amplitude <= 0), "SHAM").when(target, "TARGET_HYPOTHESIS").when(control, "ACTIVE_CONTROL").otherwise("EXPLORATORY")


def confirmatory(trials: DataFrame) -> DataFrame:
    """Trials of the four confirmatory cells, effect coded as g and c."""
    cells = trials.where(F.col("geometry").isin(*GEOMETRIES[:2]) & F.col("core").isin(*CORES[:2]))
    return cells.withColumns({"g": F.when(F.col("geometry") == GEOMETRIES[0], 1).otherwise(-1), "c": F.when(F.col("core") == CORES[0], 1).otherwise(-1)})


def ols(trials: DataFrame, by: list[str]) -> DataFrame:
    """Saturated 2 x 2 least squares of y on g, c (each +-1) and their product, from cell counts, means and squares.

    Statuses INSUFFICIENT_SAMPLES (fewer than 4 rows), MODEL_NOT_IDENTIFIABLE (an empty cell), ILL_CONDITIONED_DESIGN
    (largest over smallest cell beyond 10000) and IDENTIFIED_OLS; estimates only for the last.
    """
    cell = trials.groupBy(*by, "g", "c").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("v"))
    contrast = {"b0": F.lit(1.0), "bg": F.col("g") * 1.0, "bc": F.col("c") * 1.0, "bgc": F.col("g") * F.col("c") * 1.0}
    fit = cell.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("*").alias("rank"), (F.max("n") / F.min("n")).alias("kappa"), F.sum(F.col("v") * (F.col("n") - 1)).alias("sse"), (F.sum(1.0 / F.col("n")) / 16).alias("inverse"),
        *[(F.sum(s * F.col("m")) / 4).alias(k) for k, s in contrast.items()],
    )
    status = F.when(F.col("n") < 4, "INSUFFICIENT_SAMPLES").when(F.col("rank") < 4, "MODEL_NOT_IDENTIFIABLE").when(F.col("kappa") > 1e4, "ILL_CONDITIONED_DESIGN").otherwise("IDENTIFIED_OLS")
    fit = fit.withColumns({"status": status, "df": F.col("n") - 4})
    error = F.sqrt(F.try_divide(F.col("sse"), F.col("df")) * F.col("inverse"))
    known = lambda c: F.when(F.col("status") == "IDENTIFIED_OLS", c)
    fit = fit.withColumns({"se": known(F.coalesce(error, F.lit(0.0))), "t": t_critical(F.col("df"))})
    return fit.select(
        *by, "status", "n", "df", "rank", "kappa", known(F.col("sse")).alias("sse"), "se", *[known(F.col(k)).alias(k) for k in contrast],
        known(2 * F.col("bg")).alias("contrast_g"), known(2 * F.col("bc")).alias("contrast_c"), known(4 * F.col("bgc")).alias("contrast_gc"),
        (F.col("bg") - F.col("t") * F.col("se")).alias("bg_low"), (F.col("bg") + F.col("t") * F.col("se")).alias("bg_high"),
    )


def session_components(trials: DataFrame, by: list[str], session: str) -> DataFrame:
    """Session variance and within-session fixed effects of g, c and their product (y centred by session, no intercept).

    INSUFFICIENT_SESSIONS below 2 sessions or 8 trials, MODEL_NOT_IDENTIFIABLE for a singular design, else CONVERGED.
    """
    means = trials.groupBy(*by, session).agg(F.avg("y").alias("mean"))
    between = means.groupBy(*by).agg(F.count("*").alias("sessions"), F.avg("mean").alias("grand_mean"), F.coalesce(F.var_samp("mean"), F.lit(0.0)).alias("var_u"))
    rows = trials.join(means, [*by, session]).withColumns({"r": F.col("y") - F.col("mean"), "x1": F.col("g") * 1.0, "x2": F.col("c") * 1.0, "x3": F.col("g") * F.col("c") * 1.0})
    x = ("x1", "x2", "x3")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rr"), *[F.sum(F.col(a) * F.col("r")).alias(f"{a}r") for a in x], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(x) for b in x[i:]]
    )
    m = [[F.col(f"{min(a, b)}{max(a, b)}") for b in x] for a in x]
    minor = lambda i, j: [[m[r][s] for s in range(3) if s != j] for r in range(3) if r != i]
    det2 = lambda q: q[0][0] * q[1][1] - q[0][1] * q[1][0]
    cofactor = [[det2(minor(i, j)) * (-1) ** (i + j) for j in range(3)] for i in range(3)]
    det = sum((m[0][j] * cofactor[0][j] for j in range(1, 3)), m[0][0] * cofactor[0][0])
    full = sums.join(between, by).withColumn("det", det)
    beta = [F.try_divide(sum((cofactor[k][i] * F.col(f"x{k + 1}r") for k in range(1, 3)), cofactor[0][i] * F.col("x1r")), F.col("det")) for i in range(3)]
    full = full.withColumns({f"b{i + 1}": b for i, b in enumerate(beta)} | {f"inv{i + 1}": F.try_divide(cofactor[i][i], F.col("det")) for i in range(3)})
    fitted = sum((F.col(f"b{i}") * F.col(f"x{i}r") for i in (2, 3)), F.col("b1") * F.col("x1r"))
    full = full.withColumn("var_e", F.greatest(F.lit(0.0), F.col("rr") - fitted) / F.greatest(F.lit(1), F.col("n") - F.col("sessions") - 3))
    status = F.when((F.col("sessions") < 2) | (F.col("n") < 8), "INSUFFICIENT_SESSIONS").when(F.abs("det") < 1e-9, "MODEL_NOT_IDENTIFIABLE").otherwise("CONVERGED")
    full = full.withColumns({"status": status, "df": F.col("sessions") - 1})
    se = {f"se{i}": F.sqrt(F.greatest(F.lit(1e-8), (F.col("var_e") + F.col("var_u") / F.col("sessions")) * F.col(f"inv{i}"))) for i in (1, 2, 3)}
    return full.withColumns(se).withColumn("t", t_critical(F.col("df"))).select(*by, "status", "sessions", "n", "grand_mean", "var_u", "var_e", "b1", "b2", "b3", "se1", "se2", "se3", "t")


def coupling_sums(matrix: Column) -> tuple[Column, Column]:
    """Row and column sums of a square matrix given as an array of rows."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    rows = F.transform(matrix, total)
    columns = F.transform(F.sequence(F.lit(0), F.size(matrix) - 1), lambda j: total(F.transform(matrix, lambda r: F.get(r, j))))
    return rows, columns


def one_hot(category: Column, categories: tuple[str, ...]) -> Column:
    """1.0 at the category's place; all zero for an unknown one."""
    return F.transform(F.array(*[F.lit(c) for c in categories]), lambda x: F.coalesce((x == category).cast("double"), F.lit(0.0)))


def features(df: DataFrame) -> DataFrame:
    """features: log frequency, amplitude, then one-hot geometry, core and modulation (16 numbers)."""
    head = F.array(F.log10(F.greatest(F.lit(1.0), F.col("freq_hz"))), F.greatest(F.lit(0.0), F.col("amp_v")))
    return df.withColumn("features", F.concat(head, one_hot(F.col("geometry"), GEOMETRIES), one_hot(F.col("core"), CORES), one_hot(F.col("modulation"), MODULATIONS)))


#: Length scales of frequency, amplitude and each one-hot block (fixed values).
LENGTH_SCALES = (0.5, 2.0, *(1.0,) * 14)


def rbf(a: Column, b: Column, scales: tuple[float, ...] = LENGTH_SCALES) -> Column:
    """Squared-exponential kernel of two feature arrays."""
    scale = F.array(*[F.lit(float(s)) for s in scales])
    squares = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), scale, lambda d, s: (d / s) * (d / s))
    return F.exp(-0.5 * F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def kernel_top1(observations: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """For each group the candidate with the greatest kernel-weighted mean response; ties to the smaller candidate id.

    Candidates are a fixed small set (30 by default), so each observation meets each of them.
    """
    met = observations.crossJoin(F.broadcast(candidates.select("candidate_id", F.col("features").alias("cf")))).withColumn("k", rbf(F.col("features"), F.col("cf")))
    score = met.groupBy(*by, "candidate_id").agg((F.sum(F.col("k") * F.col("response")) / F.greatest(F.sum("k"), F.lit(1e-12))).alias("score"))
    return score.groupBy(*by).agg(F.max_by(F.struct("candidate_id", "score"), F.struct("score", -F.col("candidate_id"))).alias("best")).select(*by, "best.candidate_id", "best.score")


def gaussian_process(observations: DataFrame, candidates: pd.DataFrame, by: str, kappa: float = 1.96, noise_variance: float = 0.05, most: int = 256) -> DataFrame:
    """Posterior mean and deviation of each candidate for each group, and the upper confidence bound mu + kappa * sigma, from the group's whole history."""
    return gaussian.posterior(observations, candidates, by, LENGTH_SCALES, kappa, noise_variance, most)


def best_candidate(scored: DataFrame, by: str, score: str = "bound") -> DataFrame:
    """The candidate of greatest score in each group; the first of equals."""
    return scored.groupBy(by).agg(F.max_by(F.struct("candidate_id", score), F.struct(score, -F.col("candidate_id"))).alias("b")).select(by, "b.candidate_id", f"b.{score}")


def blind(trials: DataFrame, secret: str) -> tuple[DataFrame, DataFrame]:
    """Trials under opaque tokens, and the sealed table of tokens and configurations."""
    token = F.sha2(F.concat_ws("|", F.lit(secret), F.col("trial_id").cast("string")), 256).alias("trial_token")
    return trials.select(token, *[c for c in trials.columns if c not in ("geometry", "core", "modulation", "trial_id")]), trials.select(token, "trial_id", "geometry", "core", "modulation")


def unblind(results: DataFrame, sealed: DataFrame) -> DataFrame:
    return results.join(sealed, "trial_token")


#: The seven conditions of a matched block: geometry, core, whether it is driven, modulation (fixed values).
BLOCK = (
    ("GOLDEN_RATIO_SPHERES", "DUAL_TETRAHEDRON_MERKABA", True, "NONE_CW"),
    ("GOLDEN_RATIO_SPHERES", "SPHERICAL_CORE", True, "NONE_CW"),
    ("EQUAL_SPHERES", "DUAL_TETRAHEDRON_MERKABA", True, "NONE_CW"),
    ("EQUAL_SPHERES", "SPHERICAL_CORE", True, "NONE_CW"),
    ("GOLDEN_RATIO_SPHERES", "NO_CORE", True, "NONE_CW"),
    ("RANDOM_SPHERES", "DUAL_TETRAHEDRON_MERKABA", True, "NONE_CW"),
    ("SHAM_OFF", "SHAM_OFF", False, "SHAM_OFF"),
)


def matched_blocks(blocks: DataFrame, block: str, draw: Callable[[Column, Column], Column], freq_hz: float = 73.2, amp_v: float = 3.3) -> DataFrame:
    """The seven conditions of each block in an order of their own: by draw(block, condition), a random number.

    Seven rows a block, dealt by a literal array; the order is a window of seven rows.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("condition"), F.lit(g).alias("geometry"), F.lit(c).alias("core"), F.lit(freq_hz if on else 0.0).alias("freq_hz"), F.lit(amp_v if on else 0.0).alias("amp_v"), F.lit(m).alias("modulation")) for k, (g, c, on, m) in enumerate(BLOCK)])
    each = blocks.select(block, F.explode(rows).alias("x")).select(block, "x.*")
    order = Window.partitionBy(block).orderBy(draw(F.col(block), F.col("condition")), "condition")
    return each.withColumn("block_index", F.row_number().over(order) - 1)


def score_changes(decisions: DataFrame, by: str, step: str, score: str) -> DataFrame:
    """Each decision with the score that followed it."""
    return decisions.withColumn("next_score", F.lead(score).over(Window.partitionBy(by).orderBy(step)))


#: Golden ratio (fixed value).
PHI = (1 + math.sqrt(5)) / 2


def diameters(geometry: Column, outer: Column, seed: Column) -> Column:
    """Outer, middle and inner diameter by geometry; an unknown geometry is an error."""
    draw = lambda salt, a, b: a + (b - a) * F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(1_000_000)) / 1e6
    triple = lambda x, y, z: F.array(*[F.round(v, 3) for v in (x, y, z)])
    return (
        F.when(geometry == "GOLDEN_RATIO_SPHERES", triple(outer, outer / PHI, outer / PHI**2))
        .when(geometry == "EQUAL_SPHERES", triple(outer, outer * 2 / 3, outer / 3))
        .when(geometry == "RANDOM_SPHERES", triple(outer, outer * draw(1, 0.55, 0.75), outer * draw(2, 0.30, 0.50)))
        .when(geometry == "SHAM_OFF", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown geometry: "), geometry)).cast("array<double>"))
    )


#: Multiples of the base frequency by mode, outer to inner core (fixed values).
LADDERS = {"phi": (1.0, PHI, PHI**2, PHI**3, PHI**2.5), "harmonic": (1.0, 2.0, 3.0, 4.0, 5.0), "equal": (1.0, 1.5, 2.0, 2.5, 3.0), "sham": (0.0,) * 5}
RESONATORS = ("R_outer", "R_middle", "R_inner", "R_core_up", "R_core_down")


def frequency_ladder(df: DataFrame) -> DataFrame:
    """Five rows for each (base_freq_hz, mode): resonator and its frequency."""
    steps = F.lit(None).cast("array<double>")
    for mode, multiples in LADDERS.items():
        steps = F.when(F.col("mode") == mode, F.array(*[F.lit(m) for m in multiples])).otherwise(steps)
    rows = df.withColumn("_m", steps).select(*df.columns, F.posexplode("_m").alias("_i", "_k"))
    return rows.select(*df.columns, F.element_at(F.array(*[F.lit(r) for r in RESONATORS]), F.col("_i") + 1).alias("resonator"), F.round(F.col("base_freq_hz") * F.col("_k"), 3).alias("freq_hz"))


def bandwidth(frequency: Column, q: Column) -> Column:
    return F.when((q > 0) & (frequency > 0), F.try_divide(frequency, q)).otherwise(0.0)


def power_budget(channels: DataFrame, by: str) -> DataFrame:
    """Input and output power of a configuration; output is at most 99 % of input, the rest heats."""
    g = channels.groupBy(by).agg(F.sum("power_in_w").alias("power_in_w"), F.sum("power_out_w").alias("_out"))
    g = g.withColumn("power_out_w", F.least(F.col("_out"), 0.99 * F.col("power_in_w"))).withColumn("dissipated_w", F.greatest(F.lit(0.0), F.col("power_in_w") - F.col("power_out_w")))
    return g.withColumn("temperature_rise_c", 0.40 * F.col("dissipated_w")).drop("_out")
